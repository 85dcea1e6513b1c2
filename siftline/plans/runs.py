"""Queries on runs: outcomes, breakers, logs, budgets and process trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import dedup, reports, runs, select
from ..session import shared_folder
from .registry import query
from .files import KEPT
from .views import BASE, EXTENSION, LOG, OBJECTS, OUTCOMES, events, log, objects, outcomes, table

STAGES = ["pull", "transcode", "place", "push"]
COUNTS = ", ".join(f"count(*) filter (outcome = 'failed' and stage = '{s}') as failed_{s}" for s in STAGES)
BREAKDOWN = f"select job, count(*) filter (outcome = 'transcoded') as transcoded, count(*) filter (outcome = 'copied') as copied, count(*) filter (outcome = 'failed') as failed, {COUNTS} from outcomes group by job"


@query("failure_breakdown", f"with {OUTCOMES} {BREAKDOWN}")
def failure_breakdown(spark, sf_dir):
    return runs.failure_breakdown(outcomes(spark, sf_dir), STAGES)


@query("breakdown_merge", f"with {OUTCOMES} {BREAKDOWN}")
def breakdown_merge(spark, sf_dir):
    """Breakdowns of two halves of a run, merged."""
    o = outcomes(spark, sf_dir)
    half = lambda k: runs.failure_breakdown(o.where(F.col("position") % 2 == k), STAGES)
    return runs.merge_breakdowns(half(0).unionByName(half(1)))


@query("phase_counts", f"with {OUTCOMES} select job, coalesce(stage, 'done') as phase, outcome, sum(position % 4)::bigint as n from outcomes group by all")
def phase_counts(spark, sf_dir):
    o = outcomes(spark, sf_dir)
    return runs.phase_counts(o.select("job", F.coalesce("stage", F.lit("done")).alias("phase"), "outcome", (F.col("position") % 4).alias("n")))


@query("circuit_breaker", f"""with {OUTCOMES},
r as (select *, row_number() over (partition by job order by position) as rn from outcomes where not skipped),
s as (select job, count(*) as samples, count(*) filter (stage = 'transcode' and error like '%moov atom not found%') as matches from r where rn <= 20 group by job)
select job, samples, matches, samples = 20 and matches >= 18 as tripped from s""")
def circuit_breaker(spark, sf_dir):
    return runs.breaker(outcomes(spark, sf_dir))


MESSAGES = ["lookup x: no such host", "Too Many Requests, THROTTLED", "a.vcf is not a vCard file", "Unknown encoder", "over quota; moov atom not found", "No Such Host", "done"]


def any_of(parts: list[str], value: str = "error") -> str:
    return " or ".join(f"contains({value}, {sql_text(p)})" for p in parts)


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("error_classes", f"""with {OUTCOMES}, e as (select position, coalesce(error, '') || ' ' || [{', '.join(map(sql_text, MESSAGES))}][position % 7 + 1] as error from outcomes)
select position, {any_of(text.UNREACHABLE)} as unreachable, {any_of(text.OVERLOADED, 'lower(error)')} as overloaded, {any_of(text.WRONG_KIND)} as wrong_kind, {any_of(text.NOT_RETRYABLE)} as not_retryable from e""")
def error_classes(spark, sf_dir):
    """Errors of completions, each with a second message behind it, by the four classes."""
    second = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("position") % 7 + 1).cast("int"))
    e = outcomes(spark, sf_dir).select("position", F.concat(F.coalesce("error", F.lit("")), F.lit(" "), second).alias("error"))
    classes = {"unreachable": text.is_unreachable, "overloaded": text.is_overloaded, "wrong_kind": text.is_wrong_kind, "not_retryable": text.is_not_retryable}
    return e.select("position", *[f(F.col("error")).alias(n) for n, f in classes.items()])


@query("counter_deltas", f"""with {LOG},
l as (select user_id % 4 as lane, poll, cast(floor(value) as bigint) as c, row_number() over (partition by user_id % 4, poll order by ts desc, event_id desc) as rn from log),
p as (select lane, poll, c from l where rn = 1)
select lane, poll, greatest(c - coalesce(lag(c) over (partition by lane order by poll), 0), 0) as bytes from p""")
def counter_deltas(spark, sf_dir):
    stats = log(spark, sf_dir).withColumn("lane", F.col("user_id") % 4).withColumn("bytes", F.floor("value"))
    return runs.counter_deltas(stats, ["bytes"])


@query("error_streaks", f"""with {LOG},
f as (select *, case when lag(cause) over (partition by poll order by ts, event_id) = cause then 0 else 1 end as st from log),
g as (select *, sum(st) over (partition by poll order by ts, event_id rows unbounded preceding) as isl from f)
select poll, cause, arg_min(event_id, [epoch_us(ts), event_id]) as first_key, count(*) - 1 as repeated from g group by poll, isl, cause having count(*) > 1""")
def error_streaks(spark, sf_dir):
    return runs.error_streaks(log(spark, sf_dir))


@query("log_json_parse", """select event_id, event_type as level, 'Copied (new)' as msg, (props->>'k')::bigint as bytes, event_type = 'view' as copied from events where event_id % 10 <> 0""")
def log_json_parse(spark, sf_dir):
    """JSON lines built from events, a tenth of them garbage."""
    stats = F.get_json_object("props", "$.k").cast("bigint")
    line = F.to_json(F.struct(F.col("event_type").alias("level"), F.lit("Copied (new)").alias("msg"), F.struct(stats.alias("bytes")).alias("stats"), F.lit(1).alias("unknown")))
    lines = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 10 != 0, line).otherwise("{garbage").alias("value"))
    return runs.parse_log(lines).select("event_id", "level", "msg", F.col("stats.bytes").alias("bytes"), runs.is_copied(F.replace("level", F.lit("view"), F.lit("INFO")), F.col("msg")).alias("copied"))


@query("run_log_extract", """select event_id, '{"run_id":"r' || (user_id % 50)::varchar || '","msg":"' || event_type || '"}' as value from events where user_id % 50 = 7""")
def run_log_extract(spark, sf_dir):
    value = F.concat(F.lit('{"run_id":"r'), (F.col("user_id") % 50).cast("string"), F.lit('","msg":"'), "event_type", F.lit('"}'))
    return runs.of_run(events(spark, sf_dir).select("event_id", value.alias("value")), "r7")


@query("extraction_budget", """select l_orderkey, l_linenumber, l_quantity::bigint as size,
l_quantity::bigint = 0 or sum(l_quantity::bigint) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows unbounded preceding) <= 100 as kept from lineitem""")
def extraction_budget(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("archive"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.col("l_quantity").cast("bigint").alias("size"), F.lit(1).alias("zip_size"))
    return runs.within_budget(members).select(F.col("archive").alias("l_orderkey"), F.col("position.l_linenumber").alias("l_linenumber"), "size", "kept")


@query("process_tree", """with recursive p as (select c_custkey as pid, c_custkey // 3 as parent from customer),
t(pid) as (select pid from p where pid = 7 union select p.pid from p join t on p.parent = t.pid) select pid from t""")
def process_tree(spark, sf_dir):
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 3).alias("parent"))
    return runs.process_tree(p, 7)


@query("truncation_guard", """select l_orderkey, l_linenumber, l_partkey, l_quantity - (l_quantity - l_discount * 10) > greatest(0.5, 0.02 * abs(l_quantity)) as truncated,
case when l_linenumber > 2 then l_linenumber <> 5 else false end as stale from lineitem""")
def truncation_guard(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    disk = F.when(F.col("l_linenumber") > 2, F.col("l_linenumber"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", text.is_truncated(F.col("l_quantity"), F.col("l_quantity") - F.col("l_discount") * 10).alias("truncated"), text.is_stale(disk, F.lit(5)).alias("stale"))


@query("resource_sums", """select user_id % 10 as pid, floor(epoch(ts))::bigint // 600 as tick, sum(event_id % 100)::bigint as cpu, count(*) as samples from events group by all""")
def resource_sums(spark, sf_dir):
    tick = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 600)
    return events(spark, sf_dir).groupBy((F.col("user_id") % 10).alias("pid"), tick.alias("tick")).agg(F.sum(F.col("event_id") % 100).alias("cpu"), F.count("*").alias("samples"))


REMOVED = f"""with {OBJECTS}, {KEPT}, broken as (select * from objects where doc_id % 97 = 0),
k as (select *, {EXTENSION.replace('key', 'kept_key')} || '/' || {BASE.replace('key', 'kept_key')} as kept_path from ranked where rn > 1)"""


@query("dedup_report_lines", f"""{REMOVED}
select {sql_text(chr(9).join(reports.DEDUP_HEAD))} as line
union all select concat_ws(chr(9), key, content_hash, kept_path, kept_key, coalesce(bucket_alias, ''), coalesce(kept_bucket, '')) from k
union all select count(*)::varchar || ' duplicate(s) removed.' from k
union all select count(*)::varchar || ' archive(s) need manual attention:' from broken
union all select key || chr(9) || 'BadZipFile' from broken""")
def dedup_report_lines(spark, sf_dir):
    """The report of a deduplication, written under a run's folder and read from there."""
    files = objects(spark, sf_dir)
    records = dedup.merge_records(dedup.keep_first(files.withColumn("extension", paths.extension_of(F.col("key")))))
    failures = files.where(F.col("doc_id") % 97 == 0).select("key", F.lit("BadZipFile").alias("error"))
    root = shared_folder(spark, "reports")
    reports.publish({"deduplicate-report": reports.dedup_lines(records, failures)}, root, "run")
    return spark.read.text(f"{root}/run/deduplicate-report").withColumnRenamed("value", "line")


SKIPPED = "case when skipped then ['already_done', 'apple_double', 'lock_stub', 'email_shaped'][position % 4 + 1] end"
TOLD = f"""with {OUTCOMES}, o as (select 'k-' || position::varchar as key, case when skipped then 'skipped' else outcome end as outcome, stage, error, {SKIPPED} as skip_reason from outcomes),
w as (select *, case when outcome = 'transcoded' then 2 when outcome = 'copied' then 1 else 0 end as n from o)"""


def counts(column: str, values: list[str], where: str = "true") -> str:
    return " || ', ' || ".join(f"count(*) filter ({where} and {column} = '{v}')::varchar || ' {v}'" for v in values)


@query("transform_report_lines", f"""{TOLD}
select {sql_text(chr(9).join(reports.TRANSFORM_HEAD))} as line
union all select concat_ws(chr(9), key, outcome, coalesce(stage, ''), case n when 2 then key || '-a.csv,' || key || '-b.csv' when 1 then key || '-a.csv' else '' end, coalesce(error, '')) from w where outcome <> 'skipped'
union all select concat_ws(chr(9), key, 'skipped_email_shaped', '', '', 'email-shaped: ' || key) from w where skip_reason = 'email_shaped'
union all select count(*) filter ((outcome <> 'skipped' or skip_reason = 'email_shaped') and coalesce(stage, '') <> 'pull')::varchar || ' pulled, ' || count(*) filter (outcome = 'failed' and stage = 'pull')::varchar || ' pull error(s).' from w
union all select {counts('outcome', ['transcoded', 'copied', 'failed'])} || '.' from w
union all select sum(n)::bigint::varchar || ' output file(s).' from w
union all select 'failures by stage: ' || {counts('stage', reports.STAGES, "outcome = 'failed'")} || '.' from w
union all select 'skipped: ' || {counts('skip_reason', reports.SKIPS)} || '.' from w""")
def transform_report_lines(spark, sf_dir):
    """The report of a conversion, written under a run's folder and read from there."""
    reason = F.element_at(F.array(*[F.lit(s) for s in ("already_done", "apple_double", "lock_stub", "email_shaped")]), (F.col("position") % 4 + 1).cast("int"))
    o = outcomes(spark, sf_dir).select(F.concat(F.lit("k-"), F.col("position").cast("string")).alias("key"), F.when(F.col("skipped"), "skipped").otherwise(F.col("outcome")).alias("outcome"), "stage", "error", F.when(F.col("skipped"), reason).alias("skip_reason"))
    o = o.withColumn("error", F.when(F.col("skip_reason") == "email_shaped", F.concat(F.lit("email-shaped: "), "key")).otherwise(F.col("error")))
    ends = F.when(F.col("outcome") == "transcoded", F.array(F.lit("-b.csv"), F.lit("-a.csv"))).when(F.col("outcome") == "copied", F.array(F.lit("-a.csv")))
    outputs = o.select("key", F.explode(ends).alias("end")).select("key", F.concat("key", "end").alias("name"))
    root = shared_folder(spark, "reports")
    reports.publish({"transform-report": reports.transform_lines(o, outputs)}, root, "run")
    return spark.read.text(f"{root}/run/transform-report").withColumnRenamed("value", "line")


@query("run_summary_lines", f"with {OUTCOMES} select '{{\"job\":\"' || job || '\",\"failed\":' || count(*) filter (outcome = 'failed')::varchar || ',\"first_error\":' || coalesce('\"' || arg_min(error, position) || '\"', 'null') || '}}' as line from outcomes group by job")
def run_summary_lines(spark, sf_dir):
    first = F.min_by("error", F.when(F.col("error").isNotNull(), F.col("position")))
    summary = outcomes(spark, sf_dir).groupBy("job").agg(F.count_if(F.col("outcome") == "failed").alias("failed"), first.alias("first_error"))
    return reports.summary_lines(summary).select("line")


@query("run_prefixes", """select event_id, strftime(ts, '%Y-%m-%d') || '-' || event_type || '-' || printf('%x', epoch_us(ts) * 1000 + event_id) || '-host-' || printf('%x', user_id) as prefix from events""")
def run_prefixes(spark, sf_dir):
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id")
    run = reports.run_id(nanos, F.lit("host"), F.col("user_id"))
    return events(spark, sf_dir).select("event_id", reports.run_prefix(F.col("ts"), F.col("event_type"), run).alias("prefix"))


ARRIVALS = """a as (select event_id, user_id, case user_id % 10 when 0 then '._' when 1 then '~$' else '' end || user_id::varchar || '.xlsx' as key from events)"""


@query("dispatch_outcomes", f"""with {ARRIVALS} select event_id, key, case when user_id % 10 = 0 then 'apple_double' when user_id % 10 = 1 then 'lock_stub' when user_id % 4 = 0 then 'already_done'
when event_id > min(event_id) over (partition by key) then 'already_dispatched' else 'queued' end as outcome from a""")
def dispatch_outcomes(spark, sf_dir):
    """Events as arrivals of files, every fourth of which is complete at the destination."""
    k = F.col("user_id") % 10
    start = F.when(k == 0, "d/._").when(k == 1, "d/~$").otherwise("d/")
    a = events(spark, sf_dir).select("event_id", F.concat(start, F.col("user_id").cast("string"), F.lit(".xlsx")).alias("key"), F.col("user_id").cast("string").alias("grp"), F.col("event_id").alias("position"), "user_id")
    complete = a.where(F.col("user_id") % 4 == 0).select("grp")
    return select.dispatch(a, complete).select("event_id", F.substring_index("key", "/", -1).alias("key"), "outcome")


@query("requeue_rounds", """select o_orderkey, least(o_orderkey % 7, 3)::int as tried, case when o_orderkey % 7 > 3 then ['fetch', 'push'][o_orderkey % 2 + 1] end as failed_step, 30.0::double * least(o_orderkey % 7, 3) as last_wait from orders""")
def requeue_rounds(spark, sf_dir):
    """Orders as batches; each fails as often as its key says."""
    step = F.when(F.col("o_orderkey") % 2 == 0, "fetch").otherwise("push")
    attempt = lambda rows: rows.withColumn("failed_step", F.when(F.col("o_orderkey") % 7 > F.col("tried"), step))
    done = runs.in_rounds(table(spark, sf_dir, "orders").select("o_orderkey"), attempt)
    return done.select("o_orderkey", "tried", "failed_step", runs.retry_wait(F.col("tried"), 30.0).alias("last_wait"))
