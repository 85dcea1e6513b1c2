"""Queries on files by reference and on streams with state; what they read is written from the given tables first."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import ledger
from ..session import settle_each, shared_folder, spread
from ..sources import mailbox, sinks, stores, zips
from ..streaming import logs, state
from .extracts import made, nested, zipped
from .mail import LEDGER, raw
from .registry import query
from .runs import ARRIVALS
from .views import events, table


def root_of(spark, label: str) -> str:
    """A new folder in the shared one, as a URI."""
    folder = shared_folder(spark, label)
    return f"file://{folder}" if folder.startswith("/") else folder


def put(spark, files, label: str):
    """files (key, content) written under a new root: key, path and size of each."""
    root = root_of(spark, label)
    return sinks.put(files, root).select("key", F.concat(F.lit(f"{root}/"), "key").alias("path"), F.col("bytes").alias("size"))


@query("zip_expand", """select doc_id, m.member, sha256(text) as content_hash from documents, (values ('doc.txt'), ('a/doc-2.txt')) m(member)""")
def zip_expand(spark, sf_dir):
    """Archives of documents, written and then read by reference: directories first, then members by their bytes."""
    d = table(spark, sf_dir, "documents")
    files = made(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("key"), "text", F.lit("doc").alias("name")), zipped)
    found = zips.digests(zips.within_budget(zips.directory(put(spark, files, "zips")))).where(F.col("error").isNull())
    return found.select(F.substring_index("key", ".", 1).cast("bigint").alias("doc_id"), F.col("part").alias("member"), "content_hash")


#: Bytes of archives that lie at a time, about.
SHARE = 1 << 30


@query("zip_nested", """select doc_id, m.member, case m.depth when 1 then sha256(coalesce(text, '')) else sha256(reverse(coalesce(text, ''))) end as content_hash, m.depth, doc_id % 7 = 0 as tainted
from documents, (values ('a.txt', 1), ('b.zip!c.zip!d.txt', 3)) m(member, depth)""")
def zip_nested(spark, sf_dir):
    """What is in archives of three levels, with whether their root has a damaged member. The archives are made, read and
    deleted a share of them at a time, for all of them take several times the room of the table."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".zip")).alias("key"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    room = rows.agg(F.coalesce(F.sum(2 * F.octet_length("text").cast("bigint") + 1024), F.lit(0))).first()[0]
    shares = max(1, -(-room // SHARE))

    def share(k):
        some = rows.where(F.pmod(F.xxhash64("key"), F.lit(shares)) == k)
        found = zips.tree(sinks.packed(made(some, nested), root_of(spark, "nested")))
        tainted = found.groupBy("root_key").agg(F.bool_or(F.col("error").isNotNull()).alias("tainted"))
        leaves = found.where(F.col("error").isNull() & ~paths.is_zip(F.col("key"))).join(tainted, "root_key")
        member = F.substr("key", F.length("root_key") + 2, F.length("key"))
        return leaves.select(F.substring_index("root_key", ".", 1).cast("bigint").alias("doc_id"), member.alias("member"), "content_hash", "depth", "tainted")

    return settle_each(spark, [partial(share, k) for k in range(shares)], "nested")


@query("copy_by_reference", """select doc_id, case when doc_id % 5 = 0 then 'kept' else 'written' end as outcome, case when doc_id % 5 = 0 then 0 else strlen(coalesce(text, '')) end::bigint as bytes, case when doc_id % 5 <> 0 then sha256(coalesce(text, '')) end as content_hash from documents
union all select -1, 'failed: there is no such source', 0, null""")
def copy_by_reference(spark, sf_dir):
    """Documents as files copied between stores, a fifth of which are there already; and one that does not exist."""
    d = table(spark, sf_dir, "documents")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    files = put(spark, spread(d.select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("key"), body.alias("content")), "key"), "copies")
    target = root_of(spark, "copied")
    wanted = files.select(F.col("path").alias("source"), F.concat(F.lit(f"{target}/"), "key").alias("target"), "size")
    number = F.substring_index("source", "/", -1).cast("bigint")
    stores.copy(wanted.where(number % 5 == 0))
    absent = wanted.limit(1).select(F.lit(f"{target}/none/-1").alias("source"), F.lit(f"{target}/x").alias("target"), F.lit(0).cast("long").alias("size"))
    done = stores.copy(wanted.unionByName(absent), existing="skip")
    return done.select(number.alias("doc_id"), "outcome", "bytes", "content_hash")


BOX = "coalesce(lang, 'none')"


@query("mailbox_stream", f"""with m as (select {BOX} as mailbox, doc_id + 1 as uid, doc_id * 2 <= (select max(doc_id) from documents) as early, strlen('Subject: x' || chr(10) || chr(10) || coalesce(text, ''))::bigint as bytes, {BOX} = (select min({BOX}) from documents) as renewed from documents)
select mailbox, 1::bigint as uidvalidity, uid, bytes from m where not renewed or early
union all select mailbox, 2::bigint, uid, bytes from m where renewed""")
def mailbox_stream(spark, sf_dir):
    """Documents as messages of mailboxes that grow while a stream follows them; one mailbox gets a new validity."""
    body = F.encode(F.concat(F.lit("Subject: x\n\n"), F.coalesce("text", F.lit(""))), "UTF-8")
    mail = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("box"), (F.col("doc_id") + 1).alias("uid"), body.alias("content"))
    half = mail.agg(F.max("uid")).first()[0] - 1
    early = (F.col("uid") - 1) * 2 <= half
    boxes = mail.select("box").distinct()
    root = root_of(spark, "mail")
    folder = root.removeprefix("file://")
    epochs = lambda n: boxes.select(F.concat("box", F.lit("/uidvalidity")).alias("key"), F.encode(F.lit(str(n)), "UTF-8").alias("content"))
    files = spread(mail, "uid").select(F.concat("box", F.lit("/"), F.col("uid").cast("string"), F.lit(".eml")).alias("key"), "content", "uid", "box")
    spark.dataSource.register(mailbox.MailboxSource)
    most = max(1, mail.count() // 4)
    stream = spark.readStream.format("mailbox").option("folder", f"{folder}/boxes").option("per_batch", str(most)).option("ranges", "32").option("position", f"{folder}/position").load()
    sized = stream.select("mailbox", "uidvalidity", "uid", F.octet_length("content").cast("bigint").alias("bytes"))

    def drained() -> None:
        running = state.to_table(sized, folder, every="0 seconds")
        running.processAllAvailable()
        running.stop()

    sinks.put(files.where(early).unionByName(epochs(1), allowMissingColumns=True), f"{root}/boxes")
    drained()
    first = boxes.agg(F.min("box").alias("box"))
    sinks.put(files.where(~early).unionByName(epochs(2).join(first, F.col("key") == F.concat("box", F.lit("/uidvalidity")), "left_semi"), allowMissingColumns=True), f"{root}/boxes", existing="overwrite")
    drained()
    return spark.read.schema(sized.schema).parquet(f"{folder}/out").select("mailbox", "uidvalidity", "uid", "bytes")


@query("dispatch_stream", f"""with {ARRIVALS} select event_id, key, case when user_id % 10 = 0 then 'apple_double' when user_id % 10 = 1 then 'lock_stub' when user_id % 4 = 0 then 'already_done'
when event_id > min(event_id) over (partition by key) then 'already_dispatched' else 'queued' end as outcome from a""")
def dispatch_stream(spark, sf_dir):
    """Events as arrivals of files from three sources, in three micro-batches each."""
    k = F.col("user_id") % 10
    start = F.when(k == 0, "d/._").when(k == 1, "d/~$").otherwise("d/")
    e = events(spark, sf_dir).select("event_id", F.concat(start, F.col("user_id").cast("string"), F.lit(".xlsx")).alias("key"), F.col("user_id").cast("string").alias("grp"), F.col("event_id").alias("position"), (F.col("event_id") % 3).alias("source"))
    folder = shared_folder(spark, "arrivals")
    cuts = e.select(F.percentile_approx("event_id", [0.33, 0.66])).first()[0]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:], strict=False):  # what one micro-batch finds is a file a source, read by all tasks and written by one a source
        part = e.where((F.lit(True) if low is None else F.col("event_id") > low) & (F.lit(True) if high is None else F.col("event_id") <= high))
        part.repartition(3, "source").write.mode("append").partitionBy("source").parquet(f"{folder}/feed")
    fields = e.drop("source").schema
    sources = [spark.readStream.schema(fields).option("maxFilesPerTrigger", 1).parquet(f"{folder}/feed/source={s}") for s in range(3)]
    complete = events(spark, sf_dir).where(F.col("user_id") % 4 == 0).select(F.col("user_id").cast("string").alias("grp"))
    done = state.dispatched(state.united(sources), complete)
    state.to_table(done, folder).awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{folder}/out").select("event_id", F.substring_index("key", "/", -1).alias("key"), "outcome")


@query("ledger_stream", f"with {LEDGER} select mailbox, uidvalidity, uid, min(ingested_at) as ingested_at from raw group by all")
def ledger_stream(spark, sf_dir):
    """A ledger that a stream of entries keeps, in several micro-batches with snapshots between them."""
    rows = raw(spark, sf_dir)
    folder = shared_folder(spark, "ledger")
    rows.repartition(4, "uid").write.parquet(f"{folder}/feed")
    updates = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/feed")
    return logs.ledger_follow(updates, f"{folder}/ledger", f"{folder}/state", flush_seconds=1).select(*ledger.KEY, "ingested_at")
