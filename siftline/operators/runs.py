"""Runs and their logs: schedules, budgets, outcomes, breakers, counters and streaks of errors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import text
from . import scans

#: Completions that the breaker looks at, and failures among them that trip it.
BREAKER_SAMPLE, BREAKER_TRIPS = 20, 18
#: Fixed value: extracted bytes allowed for each byte of an archive.
EXPANSION = 100

LOG_LINE = T.StructType([
    T.StructField("level", T.StringType()),
    T.StructField("msg", T.StringType()),
    T.StructField("object", T.StringType()),
    T.StructField("stats", T.StructType([T.StructField(n, T.LongType()) for n in ("bytes", "transfers", "errors", "deletes")])),
])


def interval(per_minute: int) -> float:
    """Seconds between requests at a pace."""
    return 60.0 / max(per_minute, 1)


def schedule(requests: DataFrame, per_minute: int = 120, lane: str = "lane") -> DataFrame:
    """requests (lane, i, at, n) with `start`: none before its time, none before the ones ahead have been paid for.

    Idle time is not paid back. In closed form: what was spent before, plus the longest lag of any request so far
    behind what had been spent. Both are running values in chunks, so a lane of any length uses all cores.
    """
    dealt = scans.deal(requests, [lane], ["i"])
    spent = scans.running_sum(dealt, "__paid", F.col("n"), [lane], ["i"], before=True)
    spent = spent.withColumn("__paid", F.col("__paid") * F.lit(interval(per_minute)))
    lagged = scans.running_max(spent, "__lag", F.col("at") - F.col("__paid"), [lane], ["i"])
    return scans.done(lagged).withColumn("start", F.col("__paid") + F.col("__lag")).drop("__paid", "__lag")


#: Fixed value: how often a batch that failed is tried again.
ATTEMPTS = 3


def retry_wait(attempt: Column, backoff: float) -> Column:
    """Seconds before an attempt, counted from 0: the wait grows by one back-off each time."""
    return attempt * F.lit(backoff)


def in_rounds(batches: DataFrame, attempt: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS) -> DataFrame:
    """batches with `tried` (how often before the last time) and `failed_step` (null: it worked in the end).

    attempt takes rows with `tried` and returns them with `failed_step`. What fails is put behind all that waits, so
    the work goes in rounds; each round is written down, and none is repeated when an executor is lost.
    """
    from ..session import settle

    waiting, finished = batches, []
    for tried in range(attempts + 1):
        done = settle(attempt(waiting.withColumn("tried", F.lit(tried))), "round")
        if tried == attempts:
            finished.append(done)
            break
        finished.append(done.where("failed_step is null"))
        waiting = done.where("failed_step is not null").drop("failed_step")
        if waiting.isEmpty():
            break
    every = finished[0]
    for more in finished[1:]:
        every = every.unionByName(more)
    return every


def within_budget(members: DataFrame, times: int = EXPANSION) -> DataFrame:
    """Archive members (archive, position, size, zip_size) with `kept`: dropped once the running total of sizes, those
    of dropped members included, is beyond the archive's budget; empty members always pass."""
    dealt = scans.deal(members, ["archive"], ["position"])
    summed = scans.done(scans.running_sum(dealt, "__total", F.col("size"), ["archive"], ["position"]))
    return summed.withColumn("kept", (F.col("size") == 0) | (F.col("__total") <= F.col("zip_size") * times)).drop("__total")


def failure_breakdown(outcomes: DataFrame, stages: list[str]) -> DataFrame:
    """Files by outcome and failures by stage, in one row a job."""
    count = lambda c: F.count_if(c)
    stage = [count((F.col("outcome") == "failed") & (F.col("stage") == s)).alias(f"failed_{s}") for s in stages]
    return outcomes.groupBy("job").agg(count(F.col("outcome") == "transcoded").alias("transcoded"), count(F.col("outcome") == "copied").alias("copied"), count(F.col("outcome") == "failed").alias("failed"), *stage)


def merge_breakdowns(parts: DataFrame) -> DataFrame:
    """The sum of breakdowns of one job, whatever their order."""
    numbers = [f.name for f in parts.schema if f.name != "job"]
    return parts.groupBy("job").agg(*[F.sum(n).alias(n) for n in numbers])


def phase_counts(samples: DataFrame) -> DataFrame:
    return samples.groupBy("job", "phase", "outcome").agg(F.sum("n").alias("n"))


def breaker(completions: DataFrame, sample: int = BREAKER_SAMPLE, trips: int = BREAKER_TRIPS) -> DataFrame:
    """(job, samples, matches, tripped) over each job's first completions that were not skipped.

    Only a job's first rows count, so they are picked by an aggregate that holds no more than the sample.
    """
    ranked = completions.where(~F.col("skipped")).withColumn("rank", F.row_number().over(W.partitionBy("job").orderBy("position")))
    hit = (F.col("stage") == "transcode") & text.is_not_retryable(F.col("error"))
    seen = ranked.where(F.col("rank") <= sample).groupBy("job").agg(F.count("*").alias("samples"), F.count_if(hit).alias("matches"))
    return seen.withColumn("tripped", (F.col("samples") == sample) & (F.col("matches") >= trips))


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """Fields of JSON log lines; what is missing is null, what is unknown is left out, garbage and blanks are dropped."""
    parsed = lines.withColumn("log", F.from_json(value, LOG_LINE, {"mode": "PERMISSIVE"}))
    return parsed.where(F.col("log.level").isNotNull() | F.col("log.msg").isNotNull() | F.col("log.stats").isNotNull()).select(*[c for c in lines.columns if c != value], "log.*")


def is_copied(level: Column, msg: Column) -> Column:
    return (F.lower(level) == "info") & F.startswith(msg, F.lit("Copied "))


def is_listed_twice(level: Column, msg: Column) -> Column:
    return (F.lower(level) == "notice") & F.contains(msg, F.lit("Duplicate object found in source"))


def counter_deltas(stats: DataFrame, counters: list[str], lane: str = "lane") -> DataFrame:
    """Per poll what each counter has grown by: within a poll the last line holds, a missing counter is 0, and a
    counter that fell has grown by nothing."""
    rank = F.struct("position", *counters)
    last = stats.groupBy(lane, "poll").agg(F.max(rank).alias("last"))
    now = last.select(lane, "poll", *[F.coalesce(F.col(f"last.{c}"), F.lit(0)).alias(c) for c in counters])
    dealt = scans.previous(scans.deal(now, [lane], ["poll"]), "__before", F.struct(*counters), [lane], ["poll"])
    grown = lambda c: F.greatest(F.col(c) - F.coalesce(F.col(f"__before.value.{c}"), F.lit(0)), F.lit(0)).alias(c)
    return dealt.select(lane, "poll", *[grown(c) for c in counters])


def error_streaks(errors: DataFrame) -> DataFrame:
    """(poll, cause, first_key, repeated): errors of one cause in a row within a poll, where there are several."""
    lane, order = ["poll"], ["position"]
    before = scans.previous(scans.deal(errors, lane, order), "__before", F.col("cause"), lane, order)
    begins = F.coalesce((F.col("__before.value") != F.col("cause")).cast("long"), F.lit(1))
    island = scans.running_sum(before, "island", begins, lane, order)
    found = island.groupBy("poll", "island", "cause").agg(F.min_by("key", "position").alias("first_key"), F.count("*").alias("n"))
    return found.where("n > 1").select("poll", "cause", "first_key", (F.col("n") - 1).alias("repeated"))


def of_run(lines: DataFrame, run_id: str, value: str = "value") -> DataFrame:
    """The log lines of one run."""
    return lines.where(F.contains(value, F.lit(f'"run_id":"{run_id}"')))


def process_tree(processes: DataFrame, root: int) -> DataFrame:
    """pid of the root and of everything that descends from it, however deep; processes has (pid, parent)."""
    from ..session import settle

    found = processes.where(F.col("pid") == root).select("pid")
    newest = found
    while not newest.isEmpty():  # a pid that was found before does not come again, so cycles end
        newest = settle(processes.join(newest.select(F.col("pid").alias("parent")), "parent", "left_semi").select("pid").distinct().join(found, "pid", "left_anti"))
        found = settle(found.unionByName(newest))
    return found.distinct()
