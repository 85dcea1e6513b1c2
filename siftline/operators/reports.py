"""Reports of runs: a table, then its totals, as ordered lines; and the folder of a run that they are written to."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The heads of the reports' tables.
DEDUP_HEAD = ["duplicate_key", "content_hash", "kept_path", "kept_original_key", "duplicate_bucket_alias", "kept_bucket_alias"]
TRANSFORM_HEAD = ["source_relative_path", "outcome", "stage", "destination_filenames", "detail"]
#: Stages in which a file can fail, and reasons for which one is skipped.
STAGES = ["pull", "transcode", "place", "push"]
SKIPS = ["already_done", "apple_double", "lock_stub", "email_shaped"]


def run_id(nanos: Column, host: Column, pid: Column) -> Column:
    """A run's name: its start in nanoseconds, host and process, the numbers in hexadecimal."""
    return F.concat_ws("-", F.lower(F.hex(nanos)), host, F.lower(F.hex(pid)))


def run_prefix(at: Column, job: Column, run: Column) -> Column:
    """The folder of a run's artifacts: its day in UTC, job and name."""
    day = F.date_from_unix_date(F.floor(F.unix_micros(at.cast("timestamp")) / 86_400_000_000).cast("int"))
    return F.concat_ws("-", day.cast("string"), job, run)


def section(rows: DataFrame, number: int, line: Column) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), F.coalesce(line, F.lit("")).alias("line"))


def joined(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def cells(*names: str) -> Column:
    """Values with tabs between, nothing for a null."""
    return F.array_join(F.array(*[F.col(n).cast("string") for n in names]), "\t", "")


def heading(like: DataFrame, names: list[str]) -> DataFrame:
    return section(like.sparkSession.range(1), 0, F.lit("\t".join(names)))


def dedup_lines(records: DataFrame, failures: DataFrame) -> DataFrame:
    """(section, line) of a deduplication: a line a duplicate, how many there are, and the archives that failed.

    records are dedup.merge_records(), failures (key, error). Lines within a section are in order of their text.
    """
    removed = records.agg(F.count("*").alias("n"))
    broken = failures.agg(F.count("*").alias("n"))
    return joined([
        heading(records, DEDUP_HEAD),
        section(records, 1, cells(*DEDUP_HEAD)),
        section(removed, 2, F.concat(F.col("n").cast("string"), F.lit(" duplicate(s) removed."))),
        section(broken, 3, F.concat(F.col("n").cast("string"), F.lit(" archive(s) need manual attention:"))),
        section(failures, 4, cells("key", "error")),
    ])


def transform_lines(outcomes: DataFrame, outputs: DataFrame, collisions: DataFrame | None = None) -> DataFrame:
    """(section, line) of a conversion: a line a file that was pulled, then totals by outcome, stage and reason, and of
    the pull. Of skipped files only those that look like messages have been pulled, so they have a line too.

    outcomes (key, outcome, stage, error, skip_reason), outputs (key, name), collisions (members) as
    plans/pipelines.transform gives them.
    """
    names = outputs.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))
    shaped = F.coalesce(F.col("skip_reason") == "email_shaped", F.lit(False))
    pulled = outcomes.where((F.col("outcome") != "skipped") | shaped).withColumn("outcome", F.when(shaped, "skipped_email_shaped").otherwise(F.col("outcome")))
    told = pulled.join(names, "key", "left")
    count = lambda column, value: F.count_if(F.col(column) == value).cast("string")
    listed = lambda column, values: F.concat_ws(", ", *[F.concat(count(column, v), F.lit(f" {v}")) for v in values])
    failed = F.when(F.col("outcome") == "failed", F.col("stage"))
    totals = outcomes.withColumn("stage", failed).agg(
        listed("outcome", ["transcoded", "copied", "failed"]).alias("outcome"), listed("stage", STAGES).alias("stage"), listed("skip_reason", SKIPS).alias("skip")
    )
    at_pull = (F.col("outcome") == "failed") & (F.col("stage") == "pull")
    pull = pulled.agg(F.count_if(~F.coalesce(at_pull, F.lit(False))).cast("string").alias("n"), F.count_if(at_pull).cast("string").alias("m"))
    pushed = outputs.agg(F.count("*").cast("string").alias("n"))
    parts = [
        heading(outcomes, TRANSFORM_HEAD),
        section(told, 1, cells("key", "outcome", "stage", "names", "error")),
        section(totals, 2, F.concat("outcome", F.lit("."))),
        section(pushed, 3, F.concat("n", F.lit(" output file(s)."))),
        section(totals, 4, F.concat(F.lit("failures by stage: "), "stage", F.lit("."))),
        section(totals, 5, F.concat(F.lit("skipped: "), "skip", F.lit("."))),
        section(pull, 6, F.concat("n", F.lit(" pulled, "), "m", F.lit(" pull error(s)."))),
    ]
    if collisions is not None:
        parts.append(section(collisions, 7, F.array_join("members", " | ")))
    return joined(parts)


def summary_lines(summary: DataFrame) -> DataFrame:
    """(section, line) of any summary: a JSON object a row, nulls included."""
    return section(summary, 0, F.to_json(F.struct(*[F.col(c) for c in summary.columns]), {"ignoreNullFields": "false"}))


def publish(artifacts: dict[str, DataFrame], root: str, prefix: str) -> dict[str, str]:
    """Writes each artifact, (section, line) rows or lines of a log (value), as text under the run's folder.

    Files of a report are in order of their names. What cannot be written is warned about and returned with its error:
    a report never fails the run it tells of.
    """
    failed = {}
    for name, rows in artifacts.items():
        if "section" in rows.columns:
            order = ["section", "line"]
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
        try:
            rows.write.text(f"{root.rstrip('/')}/{prefix}/{name}")
        except Exception as error:  # noqa: BLE001  whatever the sink raises
            failed[name] = str(error)
            warnings.warn(f"{prefix}/{name} was not written: {error}", stacklevel=2)
    return failed
