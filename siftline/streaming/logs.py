"""Logs followed while they are written: each micro-batch is a poll, counters carry over, streaks of errors do not.

The source's offset is the bytes read of each file, up to the end of the last whole line, so that lines appended to a
known file arrive once and a line that is still being written waits for its end.
"""

from __future__ import annotations

import io
import re
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.runs import LOG_LINE
from . import state
from .state import COUNTERS

#: Bytes that one task reads of a file, and bytes looked at in one step for the last line's end.
PART_BYTES, STEP = 64 << 20, 1 << 16


@dataclass
class Stretch(InputPartition):
    """Lines of a file that begin in first <= byte < last, where a line begins at first or where one ended before."""

    name: str
    first: int
    last: int
    begins: bool


class LogReader(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)

    def initialOffset(self) -> dict:  # noqa: N802
        self.seen: dict[str, int] = {}
        return {}

    def latestOffset(self, *_) -> dict:  # noqa: N802
        """Bytes up to the last line end of each file that is there; a folder that is not there yet holds nothing new.

        Files that are gone leave the offset, so it grows with the folder and not with its history. A file that is shorter
        than it was has been truncated: its lines count from the beginning again.
        """
        from pyarrow import fs

        store, root = self.store()
        before, found = getattr(self, "seen", {}), {}
        for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            name = info.path[len(root.rstrip("/")) + 1 :]
            if info.type == fs.FileType.File and not re.search("(^|/)[._]", name):
                known = before.get(name, 0)
                end = self.line_end(store, info.path, known if known <= info.size else 0, info.size)
                if end:
                    found[name] = end
        self.seen = found
        return dict(found)

    @staticmethod
    def line_end(store, path: str, low: int, size: int) -> int:
        """The place after the last line end between low and size, or low."""
        with store.open_input_file(path) as file:
            end = size
            while end > low:
                begin = max(low, end - STEP)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return low

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        found = []
        for name, last in sorted(end.items()):
            first = start.get(name, 0)
            cuts = range(first if first <= last else 0, last, PART_BYTES)
            found += [Stretch(name, a, min(a + PART_BYTES, last), k == 0) for k, a in enumerate(cuts)]
        return found

    def read(self, partition: Stretch) -> Iterator[tuple]:
        store, root = self.store()
        with io.BufferedReader(store.open_input_file(f"{root.rstrip('/')}/{partition.name}"), 1 << 20) as file:
            at = partition.first - (not partition.begins)
            file.seek(at)
            if not partition.begins:  # the line before belongs to the stretch before
                at += len(file.readline())
            while at < partition.last:
                line = file.readline()
                yield partition.name, at, line.decode(errors="replace").strip()
                at += len(line)


class LogSource(DataSource):
    """Files of a folder as (part, position, value): a file's name, a line's first byte and its text."""

    @classmethod
    def name(cls) -> str:
        return "lines_of_logs"

    def schema(self) -> str:
        return "part string, position long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(self.options["path"])


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Parsed lines of the files in a folder as they grow; a file's name up to its first -, . or / is the lane. Garbage
    and blanks are dropped."""
    spark.dataSource.register(LogSource)
    text = spark.readStream.format("lines_of_logs").load(folder)
    parsed = text.select(F.regexp_replace("part", r"[-./].*$", "").alias("lane"), "part", "position", F.from_json("value", LOG_LINE).alias("log"))
    return parsed.where(F.col("log").isNotNull() & (F.col("log.level").isNotNull() | F.col("log.stats").isNotNull())).select("lane", "part", "position", "log.*")


def follow(parsed: DataFrame, folder: str) -> DataFrame:
    """What the lanes of parsed have grown by, and their streaks, up to all that there is now: a row a lane and poll (kind
    "poll": the counters) and one a streak (kind "streak": cause, first_key, repeated), after those of earlier calls.

    Every micro-batch is a poll. Counters stay in the state store from poll to poll; streaks of errors end with theirs. A
    poll that is run again writes the same rows under its number.
    """
    start(parsed, folder).awaitTermination()
    return changes(parsed.sparkSession, folder)


def start(parsed: DataFrame, folder: str, *, every: str | None = None, progress_seconds: float = 0):
    """The running query behind follow(): with `every` it polls at that tick until it is stopped, and with progress_seconds it
    tells where a lane stands (kind "progress") as often, as long as its counters move."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        if not batch.isEmpty():
            batch.write.mode("overwrite").parquet(f"{folder}/out/poll={number:09d}")
        batch.unpersist()

    return state.to_table(state.lane_changes(parsed, progress_seconds=progress_seconds), folder, every=every, write=write)


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that follow() and start() have written, with the number of their poll."""
    schema = T.StructType([*state.CHANGE.fields, T.StructField("poll", T.IntegerType())])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(f"{folder}/out") if there else spark.createDataFrame([], schema)


def ledger_upsert(updates: DataFrame, path: str, checkpoint: str, *, flush_seconds: float = 0, every: str | None = None):
    """Follows a stream of (mailbox, uidvalidity, uid, ingested_at) into a ledger under path; the running query.

    The least ingested_at of each key is state of the stream; what a batch lowers is appended as a change under its number.
    A snapshot of the whole is written when the last one is flush_seconds old, so its cost does not come with each
    batch. `ledger_now` reads both, `ledger_flush` writes a last snapshot; ledger_follow() does so at the end, whatever ends it.
    """
    from ..operators import ledger

    flushed = [time.monotonic()]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/changes/batch={number:09d}")
        if time.monotonic() - flushed[0] >= flush_seconds:
            ledger_flush(batch.sparkSession, path, number)
            flushed[0] = time.monotonic()

    keyed = updates.groupBy(*ledger.KEY).agg(F.min("ingested_at").alias("ingested_at"))
    writer = keyed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def ledger_follow(updates: DataFrame, path: str, checkpoint: str, *, flush_seconds: float = 60) -> DataFrame:
    """The ledger after all that the stream has now; a last snapshot is written also if the stream ends in an error."""
    spark = updates.sparkSession
    try:
        ledger_upsert(updates, path, checkpoint, flush_seconds=flush_seconds).awaitTermination()
    finally:
        if numbered(spark, f"{path}/changes", "batch="):
            ledger_flush(spark, path)
    return ledger_now(spark, path)


def ledger_now(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """The last snapshot with the changes since, up to a batch if one is given."""
    from ..operators import ledger

    schema = "mailbox string, uidvalidity long, uid long, ingested_at string"
    batches = [n for n in numbered(spark, f"{path}/changes", "batch=") if upto is None or n <= upto]
    snapshots = [n for n in numbered(spark, path, "snapshot=") if upto is None or n < upto]
    since = [n for n in batches if not snapshots or n > snapshots[-1]]
    parts = ([f"{path}/snapshot={snapshots[-1]:09d}"] if snapshots else []) + [f"{path}/changes/batch={n:09d}" for n in since]
    return ledger.earliest(spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema))


def ledger_flush(spark: SparkSession, path: str, number: int | None = None) -> None:
    """Writes the snapshot as of a batch, the last one if none is given; one that is run again writes the same."""
    batches = numbered(spark, f"{path}/changes", "batch=")
    number = batches[-1] if number is None else number
    if number not in numbered(spark, path, "snapshot="):
        ledger_now(spark, path, number).write.mode("overwrite").parquet(f"{path}/snapshot={number:09d}")


def numbered(spark: SparkSession, path: str, start: str) -> list[int]:
    """The numbers of the whole tables of a folder whose names begin like that, in order."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[len(start) :]) for n in names if n.startswith(start) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger as of the last snapshot; None without any."""
    numbers = numbered(spark, path, "snapshot=")
    return spark.read.parquet(f"{path}/snapshot={numbers[-1]:09d}") if numbers else None
