"""The inputs that the queries need, derived from the given tables; each with the same derivation as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ENDINGS = [".TXT", ".md", "", ".tar.gz", ".html"]


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: bucket_alias, original_key, key, size, content_hash."""
    d = table(spark, sf_dir, "documents")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % 5 + 1).cast("int"))
    date = F.when(F.col("doc_id") % 7 == 0, "0000-00-00-").otherwise("2024-01-01-")
    key = F.concat("lang", F.lit("/"), date, F.lit("doc-"), F.col("doc_id").cast("string"), ending)
    return d.select("doc_id", F.col("source").alias("bucket_alias"), key.alias("key"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("content_hash")).withColumn("original_key", F.col("key"))


OBJECTS = """
objects as (
  select doc_id, source as bucket_alias, n_chars as size, sha256(text) as content_hash,
         lang || '/' || case when doc_id % 7 = 0 then '0000-00-00-' else '2024-01-01-' end || 'doc-' || doc_id::varchar
         || case doc_id % 5 when 0 then '.TXT' when 1 then '.md' when 2 then '' when 3 then '.tar.gz' else '.html' end as key
  from documents
)"""
BASE = "split_part(key, '/', -1)"
EXTENSION = f"case when regexp_matches({BASE}, '^.+\\.[^.]*$') then lower(split_part({BASE}, '.', -1)) else '(none)' end"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def server(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where(F.col("event_id") % 5 != 0).select(F.col("event_type").alias("mailbox"), (F.col("user_id") % 3).alias("uidvalidity"), F.col("event_id").alias("uid"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where(F.col("event_id") % 3 != 0)
    return e.select(F.col("event_type").alias("mailbox"), (F.col("user_id") % 3).alias("uidvalidity"), F.col("event_id").alias("uid"))


MAIL = """
server as (select event_type as mailbox, user_id % 3 as uidvalidity, event_id as uid from events where event_id % 5 <> 0),
ingested as (select event_type as mailbox, user_id % 3 as uidvalidity, event_id as uid from events where event_id % 3 <> 0)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as log lines: lane, poll (an hour), position, cause."""
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600)
    position = F.struct("ts", "event_id")
    return events(spark, sf_dir).select(F.lit("log").alias("lane"), hour.alias("poll"), position.alias("position"), F.col("event_type").alias("cause"), F.col("event_id").alias("key"), F.col("value"), "user_id")


LOG = "log as (select floor(epoch(ts))::bigint // 3600 as poll, ts, event_id, event_type as cause, value, user_id from events)"


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as completions: job, outcome, stage, error."""
    stages = F.array(*[F.lit(s) for s in ("pull", "transcode", "place", "push")])
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.concat(F.lit("job-"), (F.col("user_id") % 10).cast("string")).alias("job"),
        F.when(failed, "failed").when(F.col("event_type") == "view", "copied").otherwise("transcoded").alias("outcome"),
        F.when(failed, F.element_at(stages, (F.col("event_id") % 4 + 1).cast("int"))).alias("stage"),
        F.when(failed & (F.col("event_id") % 3 != 0), "x.mov: moov atom not found").when(failed, "dial tcp: i/o timeout").alias("error"),
        F.col("event_id").alias("position"),
        (F.col("event_type") == "signup").alias("skipped"),
    )


OUTCOMES = """
outcomes as (
  select 'job-' || (user_id % 10)::varchar as job,
         case when event_type = 'error' then 'failed' when event_type = 'view' then 'copied' else 'transcoded' end as outcome,
         case when event_type = 'error' then ['pull', 'transcode', 'place', 'push'][event_id % 4 + 1] end as stage,
         case when event_type = 'error' and event_id % 3 <> 0 then 'x.mov: moov atom not found'
              when event_type = 'error' then 'dial tcp: i/o timeout' end as error,
         event_id as position, event_type = 'signup' as skipped
  from events
)"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part names as keys, every second one in capitals and every third twice in different cases."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return p.select(F.concat("p_brand", F.lit("/"), name).alias("key"))


PARTS = "parts as (select p_brand || '/' || case when p_partkey % 2 = 0 then upper(p_name) else p_name end as key from part)"


def dest_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines of orders as sheets: some whole, some with a line missing, some with totals that disagree, some plain."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("bigint").alias("i"))
    li = li.where("k is not null").withColumn("n", F.max("i").over(W.partitionBy("k")))
    group = F.concat(F.lit("doc-"), F.substring(F.sha2(F.col("k").cast("string"), 256), 1, 16))
    n = F.when((F.col("k") % 11 == 0) & (F.col("i") == 1), F.col("n") + 1).otherwise(F.col("n"))
    two = lambda c: F.lpad(c.cast("string"), F.greatest(F.lit(2), F.length(c.cast("string"))), F.lit("0"))
    sheet = F.concat(group, F.lit("-"), two(F.col("i")), F.lit("of"), two(n), F.lit("-line.csv"))
    return li.select(F.when(F.col("k") % 13 == 0, F.concat(group, F.lit(".csv"))).otherwise(sheet).alias("name"))


DEST = """
li as (select l_orderkey as k, l_linenumber::bigint as i from lineitem),
tot as (select k, max(i) as n from li group by k),
marks as (
  select 'doc-' || substr(sha256(k::varchar), 1, 16) as grp, k % 13 = 0 as plain, i,
         case when k % 11 = 0 and i = 1 then n + 1 else n end as n
  from li join tot using (k)
)"""
