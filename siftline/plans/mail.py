"""Queries on mailboxes, ledgers and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import ledger, runs
from ..session import shared_folder
from ..sources import bodystructure
from . import pipelines
from .registry import query
from .views import MAIL, events, ingested, server, table

LEDGER = """
raw as (select event_type as mailbox, user_id % 3 as uidvalidity, event_id % 4000 as uid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as ingested_at from events)"""


def raw(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("mailbox"), (F.col("user_id") % 3).alias("uidvalidity"), (F.col("event_id") % 4000).alias("uid"), text.utc_text(F.col("ts")).alias("ingested_at"))


@query("ledger_min_upsert", f"with {LEDGER} select mailbox, uidvalidity, uid, min(ingested_at) as ingested_at from raw group by all")
def ledger_min_upsert(spark, sf_dir):
    return ledger.earliest(raw(spark, sf_dir))


@query("ledger_parse", f"with {LEDGER} select mailbox, uidvalidity, uid, ingested_at from raw where uid % 5 <> 0")
def ledger_parse(spark, sf_dir):
    """Lines, every fifth of them damaged in one of three ways, back to rows."""
    tab = F.lit("\t")
    line = F.concat("mailbox", tab, F.col("uidvalidity").cast("string"), tab, F.col("uid").cast("string"), tab, "ingested_at")
    damaged = F.when(F.col("uid") % 5 != 0, line).when(F.col("uid") % 3 == 0, F.concat(F.lit("# "), line)).when(F.col("uid") % 3 == 1, F.concat(line, tab, F.lit("more"))).otherwise("inbox\tx\t1\t2024")
    return ledger.parse(raw(spark, sf_dir).select(damaged.alias("value")))


@query("ledger_lines", f"with {LEDGER}, l as (select mailbox, uidvalidity, uid, min(ingested_at) as ingested_at from raw group by all) select concat_ws(chr(9), mailbox, uidvalidity::varchar, uid::varchar, ingested_at) as value from l")
def ledger_lines(spark, sf_dir):
    return ledger.serialize(ledger.earliest(raw(spark, sf_dir)))


@query("ledger_missing_uids", f"with {MAIL} select s.* from server s anti join ingested i using (mailbox, uidvalidity, uid)")
def ledger_missing_uids(spark, sf_dir):
    return ledger.missing(server(spark, sf_dir), ingested(spark, sf_dir))


@query("legacy_missing_uids", f"with {MAIL} select s.* from server s anti join (select distinct mailbox, uid from ingested where uid % 7 <> 0) i using (mailbox, uid)")
def legacy_missing_uids(spark, sf_dir):
    return ledger.missing_by_uid(server(spark, sf_dir), ingested(spark, sf_dir).where(F.col("uid") % 7 != 0))


SCAN = f"""{MAIL},
j as (select coalesce(s.mailbox, i.mailbox) as mailbox, s.uid as su, i.uid as iu from (select distinct mailbox, uid from server) s full join (select distinct mailbox, uid from ingested) i on s.mailbox = i.mailbox and s.uid = i.uid),
m as (select mailbox, count(su) as server_messages, count(iu) as ingested, count(*) filter (iu is null) as new_messages, count(*) filter (su is null) as removed_on_server,
      case when mailbox <> 'click' then count(*) filter (iu is null and su % 4 = 0) end as new_attachments from j group by mailbox),
t as (select * from m union all select '*', sum(server_messages)::bigint, sum(ingested)::bigint, sum(new_messages)::bigint, sum(removed_on_server)::bigint,
      case when count(new_attachments) = count(*) then sum(new_attachments)::bigint end from m)"""


def scanned(spark, sf_dir, synced: str = ""):
    s, i = server(spark, sf_dir), ingested(spark, sf_dir)
    i = i.unionByName(s.where(F.col("mailbox") == synced)) if synced else i
    new = s.join(i.select("mailbox", "uid"), ["mailbox", "uid"], "left_anti").groupBy("mailbox").agg(F.count_if(F.col("uid") % 4 == 0).alias("a"))
    rows = ledger.scan(s, i).join(new, "mailbox", "left").withColumn("new_attachments", F.when(F.col("mailbox") != "click", F.coalesce("a", F.lit(0)))).drop("a")
    return ledger.with_total(rows)


@query("scan_status", f"with {SCAN} select * from t")
def scan_status(spark, sf_dir):
    return scanned(spark, sf_dir)


SYNCED = SCAN.replace("from events where event_id % 3 <> 0)", "from events where event_id % 3 <> 0 or event_type = 'signup')")


@query("scan_carry_forward", f"""with {SYNCED},
p as (select * from (values ('*', '2023', 1), ('view', '2022', 1), ('view', '2021', 2), ('error', null, 1)) v(mailbox, last_in_sync_at, line)),
b as (select mailbox, last_in_sync_at from (select *, row_number() over (partition by mailbox order by line desc) as rn from p) where rn = 1)
select t.mailbox, t.new_messages, case when t.new_messages = 0 then '2024' else b.last_in_sync_at end as last_in_sync_at from t left join b using (mailbox)""")
def scan_carry_forward(spark, sf_dir):
    # one mailbox has nothing new
    previous = spark.createDataFrame([("*", "2023", 1), ("view", "2022", 1), ("view", "2021", 2), ("error", None, 1)], "mailbox string, last_in_sync_at string, line int")
    current = scanned(spark, sf_dir, "signup").withColumn("last_scanned_at", F.lit("2024"))
    return ledger.carry_forward(current, previous).select("mailbox", "new_messages", "last_in_sync_at")


@query("attachment_cap", """with r as (select user_id % 20 as identity, event_type as mailbox, count(*) as new_messages, count(*) filter (event_id % 3 = 0) as new_attachments from events group by all)
select identity, mailbox, new_messages, case when sum(new_messages) over (partition by identity) <= (select count(*) // 20 from events) then new_attachments end as new_attachments from r""")
def attachment_cap(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = e.groupBy((F.col("user_id") % 20).alias("identity"), F.col("event_type").alias("mailbox")).agg(F.count("*").alias("new_messages"), F.count_if(F.col("event_id") % 3 == 0).alias("new_attachments"))
    return ledger.attachments_within_cap(rows, cap=e.count() // 20).select("identity", "mailbox", "new_messages", "new_attachments")


BOXES = """
boxes as (select n_name as mailbox, lower(substr(n_name, 8, 1)) as relpath, n_nationkey::bigint as uidvalidity from nation),
listing as (select lower(substr(n_name, 8, 1)) as relpath, event_id as uid, event_id % 9 <> 0 as is_message from events join nation on n_nationkey = user_id % 25),
owned as (select relpath, count(*) as owners, min(mailbox) as mailbox, min(uidvalidity) as uidvalidity from boxes group by 1)"""


def seeded(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    rel = F.lower(F.substring("n_name", 8, 1))
    boxes = nation.select(F.col("n_name").alias("mailbox"), rel.alias("relpath"), F.col("n_nationkey").cast("bigint").alias("uidvalidity"))
    e = events(spark, sf_dir).join(nation, F.col("n_nationkey") == F.col("user_id") % 25)
    end = F.when(F.col("event_id") % 9 != 0, ".eml").otherwise("/attachments/a.pdf")
    listing = e.select(F.concat(rel, F.lit("/"), F.col("event_id").cast("string"), end).alias("key"))
    return ledger.seed(listing, boxes, "2024-01-01T00:00:00Z")


@query("seed_unique_owner", f"with {BOXES} select distinct mailbox, uidvalidity, uid, '2024-01-01T00:00:00Z' as ingested_at from listing join owned using (relpath) where owners = 1 and is_message")
def seed_unique_owner(spark, sf_dir):
    return seeded(spark, sf_dir)[0]


@query("seed_ambiguous", f"with {BOXES} select distinct relpath from listing join owned using (relpath) where owners > 1 and is_message")
def seed_ambiguous(spark, sf_dir):
    return seeded(spark, sf_dir)[1]


@query("epoch_reset", f"with {MAIL} select i.mailbox, i.uidvalidity, i.uid from ingested i where i.uidvalidity = length(i.mailbox) % 3")
def epoch_reset(spark, sf_dir):
    rows = ingested(spark, sf_dir)
    now = rows.select("mailbox").distinct().withColumn("uidvalidity", (F.length("mailbox") % 3).cast("bigint"))
    return ledger.reset_epoch(rows, now).select("mailbox", "uidvalidity", "uid")


BATCHES = f"""{MAIL}, p as (select mailbox, uid, (row_number() over (partition by mailbox order by uid) - 1) // 20 as batch from server),
b as (select mailbox, batch, string_agg(uid::varchar, ' ' order by uid) as uids from p group by all)"""


@query("batch_uids", f"with {BATCHES} select mailbox, batch, uids from b")
def batch_uids(spark, sf_dir):
    batched = ledger.batches(server(spark, sf_dir).select("mailbox", "uid"), 20)
    return batched.withColumn("uids", F.array_join(F.transform("uids", lambda u: u.cast("string")), " "))


@query("round_robin", f"with {BATCHES} select mailbox as identity, batch as position, row_number() over (partition by mailbox order by batch) as turn from b")
def round_robin(spark, sf_dir):
    batched = ledger.batches(server(spark, sf_dir).select("mailbox", "uid"), 20).select(F.col("mailbox").alias("identity"), F.col("batch").alias("position"))
    return ledger.round_robin(batched)


@query("identity_summary", f"with {MAIL} select uidvalidity as identity, count(distinct mailbox) as mailboxes, count(*) as messages from server group by 1")
def identity_summary(spark, sf_dir):
    return ledger.identity_summary(server(spark, sf_dir).withColumnRenamed("uidvalidity", "identity"))


@query("pacing_schedule", """with r as (select user_id % 16 as lane, event_id as i, event_id * 0.25::double + (event_id % 10)::double as due, 1 + event_id % 3 as n from events),
s as (select *, coalesce(sum(n) over (partition by lane order by i rows between unbounded preceding and 1 preceding), 0)::double * 0.5::double as spent from r)
select lane, i, spent + max(due - spent) over (partition by lane order by i rows unbounded preceding) as start from s""")
def pacing_schedule(spark, sf_dir):
    r = events(spark, sf_dir).select((F.col("user_id") % 16).alias("lane"), F.col("event_id").alias("i"), (F.col("event_id") * F.lit(0.25) + (F.col("event_id") % 10).cast("double")).alias("at"), (1 + F.col("event_id") % 3).alias("n"))
    return runs.schedule(r, 120).select("lane", "i", "start")


@query("durations", """with d as (select event_id, event_id * 7 as messages, 1 + event_id % 130 as pace, value / 1000.0 as days from events),
m as (select *, messages::double / pace as minutes, greatest(round(days * 86400), 0)::bigint as s from d)
select event_id, case when minutes < 60 then printf('%.0f', minutes) || 'm' when minutes < 2880 then printf('%.1f', minutes / 60) || 'h' else printf('%.1f', minutes / 60 / 24) || 'd' end as estimate,
lpad((s // 3600)::varchar, greatest(2, length((s // 3600)::varchar))::int, '0') || ':' || lpad((s // 60 % 60)::varchar, 2, '0') || ':' || lpad((s % 60)::varchar, 2, '0') as elapsed from m""")
def durations(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.select("event_id", text.estimate_duration(F.col("event_id") * 7, 1 + F.col("event_id") % 130).alias("estimate"), text.elapsed(F.col("value") / 1000.0).alias("elapsed"))


@query("provider_detect", """with p as (select page_id, case page_id % 5 when 0 then 'a@gmail.com' when 1 then 'b@FastMail.fm' when 2 then 'c@me.com' when 3 then 'd@icloud.com' else 'e@' || split_part(split_part(url, '/', 3), ':', 1) end as email from pages)
select page_id, email, case lower(split_part(email, '@', -1)) when 'gmail.com' then 'gmail' when 'fastmail.fm' then 'fastmail' when 'me.com' then 'icloud' when 'icloud.com' then 'icloud' end as provider,
case lower(split_part(email, '@', -1)) when 'gmail.com' then 'imap.gmail.com' when 'fastmail.fm' then 'imap.fastmail.com' when 'me.com' then 'imap.mail.me.com' when 'icloud.com' then 'imap.mail.me.com' end as host from p""")
def provider_detect(spark, sf_dir):
    from ..functions import kinds

    k = F.col("page_id") % 5
    host = F.split_part(F.split_part("url", F.lit("/"), F.lit(3)), F.lit(":"), F.lit(1))
    email = F.when(k == 0, "a@gmail.com").when(k == 1, "b@FastMail.fm").when(k == 2, "c@me.com").when(k == 3, "d@icloud.com").otherwise(F.concat(F.lit("e@"), host))
    p = table(spark, sf_dir, "pages").select("page_id", email.alias("email"))
    return p.select("page_id", "email", kinds.provider(F.col("email")).alias("provider")).withColumn("host", kinds.provider_host(F.col("provider")))


@query("tls_hints", """with e as (select page_id, 'handshake with ' || url || case page_id % 3 when 0 then ': Wrong Version Number' when 1 then ': record OVERFLOW' else ': timeout' end as error,
case page_id % 4 when 0 then '* OK [CAPABILITY IMAP4rev1 STARTTLS] ready' when 1 then '* OK [capability IMAP4rev1 IDLE] ready' when 2 then '* OK ready' else '* OK [CAPABILITY IMAP4rev1  starttls]' end as greeting from pages)
select page_id, error like '%Wrong Version Number' or error like '%record OVERFLOW' as hinted, page_id % 4 = 1 as lacks_starttls from e""")
def tls_hints(spark, sf_dir):
    k = F.col("page_id")
    error = F.concat(F.lit("handshake with "), "url", F.when(k % 3 == 0, ": Wrong Version Number").when(k % 3 == 1, ": record OVERFLOW").otherwise(": timeout"))
    greeting = F.when(k % 4 == 0, "* OK [CAPABILITY IMAP4rev1 STARTTLS] ready").when(k % 4 == 1, "* OK [capability IMAP4rev1 IDLE] ready").when(k % 4 == 2, "* OK ready").otherwise("* OK [CAPABILITY IMAP4rev1  starttls]")
    return table(spark, sf_dir, "pages").select("page_id", text.tls_hint(error).isNotNull().alias("hinted"), text.lacks_starttls(greeting).alias("lacks_starttls"))


PLAIN = '("TEXT" "PLAIN" ("CHARSET" "utf-8") NIL NIL "7BIT" 10 1 NIL NIL NIL)'
ATTACHED = '("APPLICATION" "PDF" NIL NIL NIL "BASE64" 10 NIL ("ATTACHMENT" ("FILENAME" "a (1) \\"x\\".pdf")) NIL)'
NAMED = '("IMAGE" "PNG" ("NAME" "x.png") NIL NIL "BASE64" 10)'
INNER = f'("MESSAGE" "RFC822" NIL NIL NIL "7BIT" 99 (NIL NIL NIL NIL NIL NIL NIL NIL NIL NIL) {ATTACHED} 3 NIL ("inline" NIL))'


@query("attachment_counts", """select source as mailbox, count(*) as messages, sum(case when doc_id % 13 = 0 or doc_id % 11 = 0 then 0 else doc_id % 4 + case when doc_id % 3 = 0 then 2 else 0 end end)::bigint as attachments,
count(*) filter (doc_id % 11 = 0 and doc_id % 13 <> 0) as unparsed from documents group by source""")
def attachment_counts(spark, sf_dir):
    """Documents as messages with parts in parts; some structures are damaged, some are missing."""
    d = table(spark, sf_dir, "documents")
    related = F.when(F.col("doc_id") % 3 == 0, f'({NAMED}{NAMED} "MIXED")').otherwise("")
    whole = F.concat(F.lit(f"({PLAIN}"), F.repeat(F.lit(ATTACHED), (F.col("doc_id") % 4).cast("int")), related, F.lit(f'{INNER} "MIXED" ("BOUNDARY" "b"))'))
    cut = F.when(F.col("doc_id") % 11 == 0, F.expr("left(s, length(s) - 1)")).otherwise(F.col("s"))
    rows = d.select(F.col("source").alias("mailbox"), "doc_id", whole.alias("s")).select("mailbox", F.when(F.col("doc_id") % 13 != 0, cut).alias("structure"))
    return bodystructure.by_mailbox(rows)


@query("import_delivery", """select coalesce(lang, 'none') as mailbox, 1::bigint as uidvalidity, doc_id as uid, '2024-01-01T00:00:00Z' as ingested_at, strlen('Subject: x' || chr(10) || chr(10) || coalesce(text, ''))::bigint as bytes
from documents where doc_id % 3 <> 0""")
def import_delivery(spark, sf_dir):
    """Documents as messages: what the ledger says after an import, with the sizes of the objects that were written."""
    body = F.encode(F.concat(F.lit("Subject: x\n\n"), F.coalesce("text", F.lit(""))), "UTF-8")
    mail = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("mailbox"), F.lit(1).cast("bigint").alias("uidvalidity"), F.col("doc_id").alias("uid"), body.alias("content"))
    known = mail.where(F.col("uid") % 3 == 0).select(*ledger.KEY, F.lit("2023").alias("ingested_at"))
    folder = shared_folder(spark, "import")
    done = pipelines.deliver(mail, known, "me", "2024-01-01T00:00:00Z", f"file://{folder}/objects" if folder.startswith("/") else f"{folder}/objects", f"{folder}/ledger")
    there = done.where("outcome = 'written'").select(F.regexp_extract("key", r"/([0-9]+)\.eml$", 1).try_cast("bigint").alias("uid"), "bytes")
    return ledger.parse(spark.read.text(f"{folder}/ledger")).join(there, "uid").select(*ledger.KEY, "ingested_at", "bytes")
