"""State by key in the state store: counters and streaks of lanes, first arrivals of keys.

The processors run in transformWithStateInPandas. What meets the state is small: lines are summed up where they are read
(`summaries`), so that a lane that has most of all lines is a few rows a task when it comes to its key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import settings

COUNTERS = ("bytes", "transfers", "errors", "deletes")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

NUMBERS = [T.StructField(c, T.LongType()) for c in COUNTERS]
STREAK = T.StructType([T.StructField("cause", T.StringType()), T.StructField("first_key", T.StringType()), T.StructField("n", T.LongType())])
SUMMARY = T.StructType([T.StructField("lane", T.StringType()), T.StructField("part", T.StringType()), T.StructField("position", T.LongType()), T.StructField("told", T.BooleanType()), *NUMBERS, T.StructField("islands", T.ArrayType(STREAK))])
#: A row is a poll's growth, one streak of it, or a lane's progress at a tick of the clock.
CHANGE = T.StructType([T.StructField("lane", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("number", T.LongType()), *NUMBERS, T.StructField("cause", T.StringType()), T.StructField("first_key", T.StringType()), T.StructField("repeated", T.LongType())])


def plain(value):
    """None for what pandas has for null."""
    return None if value is None or value != value else value


def summaries(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines (lane, part, position, level, msg, object, stats) to SUMMARY: the last counters and the errors' islands of each
    lane and part in a batch. Of the islands between the first and the last only those of several errors are told."""
    for batch in batches:
        rows = []
        for (lane, part), lines in batch.sort_values("position", kind="stable").groupby(["lane", "part"], sort=False):
            stats = [s for s in lines["stats"] if s is not None and s == s]
            last = dict(stats[-1].asDict() if hasattr(stats[-1], "asDict") else stats[-1]) if stats else {}
            islands: list[list] = []
            for level, cause, key in zip(lines["level"], lines["msg"], lines["object"], strict=True):
                if not isinstance(level, str) or level.lower() != "error":
                    continue
                cause = plain(cause)
                if islands and islands[-1][0] == cause:
                    islands[-1][2] += 1
                else:
                    if len(islands) > 1 and islands[-1][2] == 1:
                        islands.pop()
                    islands.append([cause, plain(key), 1])
            counts = [int(plain(last.get(c)) or 0) for c in COUNTERS]
            told = [{"cause": c, "first_key": k, "n": n} for c, k, n in islands]
            rows.append([lane, part, int(lines["position"].iloc[0]), bool(stats), *counts, told])
        yield pd.DataFrame(rows, columns=SUMMARY.names)


class LaneState(StatefulProcessor):
    """Where a lane's counters stand. Each poll gives its growth and its streaks; a counter that fell has grown by nothing,
    and streaks end with the poll. With `progress_ms` a timer tells where a lane stands, as long as it moves."""

    def __init__(self, progress_ms: int = 0):
        self.progress_ms = progress_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counters = handle.getValueState("counters", T.StructType(NUMBERS))
        self.shown = handle.getValueState("shown", T.StructType(NUMBERS))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        polled = pd.concat(list(rows)).sort_values(["part", "position"], kind="stable")
        before = self.counters.get() if self.counters.exists() else (0,) * len(COUNTERS)
        now, closed, current = before, [], None
        for row in polled.itertuples(index=False):
            if row.told:
                now = tuple(int(getattr(row, c)) for c in COUNTERS)
            for k, island in enumerate(row.islands if row.islands is not None else []):
                cause, first, n = plain(island["cause"]), plain(island["first_key"]), int(island["n"])
                if k == 0 and current and current[0] == cause:
                    current = (cause, current[1], current[2] + n)
                else:
                    closed += [current] if current else []
                    current = (cause, first, n)
        closed += [current] if current else []
        self.counters.update(now)
        out = [(key[0], "poll", 0, *(max(a - b, 0) for a, b in zip(now, before, strict=True)), None, None, None)]
        streaks = [s for s in closed if s[2] > 1]
        out += [(key[0], "streak", k, *(None,) * len(COUNTERS), cause, first, n - 1) for k, (cause, first, n) in enumerate(streaks, 1)]
        if self.progress_ms and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.progress_ms)
        yield changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = tuple(self.counters.get())
        if self.shown.exists() and tuple(self.shown.get()) == now:
            return  # idle: the next poll sets the clock again
        self.shown.update(now)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.progress_ms)
        yield changes([(key[0], "progress", 0, *now, None, None, None)])

    def close(self) -> None:
        pass


def changes(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=CHANGE.names)
    return frame.astype({c: "Int64" for c in ("number", *COUNTERS, "repeated")})


def lane_changes(lines: DataFrame, *, progress_seconds: float = 0) -> DataFrame:
    """CHANGE rows of a stream of lines."""
    short = lines.select("lane", "part", "position", "level", "msg", "object", "stats").mapInPandas(summaries, SUMMARY)
    clock = "ProcessingTime" if progress_seconds else "None"
    return short.groupBy("lane").transformWithStateInPandas(LaneState(int(progress_seconds * 1000)), CHANGE, "Append", clock)


class FirstArrival(StatefulProcessor):
    """Tells where the first arrival of a key is, for as long as the key is remembered. The rows are plain ones, for most keys
    come with few and a frame for each costs more than all else that is done with it."""

    def __init__(self, columns: list[str], remembered_ms: int | None):
        self.columns, self.remembered_ms = columns, remembered_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", self.remembered_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        marked = Row(*self.columns, "first")
        if self.seen.exists():
            for row in rows:
                yield marked(*row, False)
            return
        arrived = sorted(rows, key=lambda row: row["position"])
        self.seen.update((int(arrived[0]["position"]),))
        for k, row in enumerate(arrived):
            yield marked(*row, k == 0)

    def close(self) -> None:
        pass


def first_arrivals(arrivals: DataFrame, *, key: str = "key", remembered_seconds: float | None = None) -> DataFrame:
    """A stream of arrivals (key, position, ...) with `first`: is it the key's first one? Within a batch the least position
    is first. Keys are forgotten after remembered_seconds without an arrival that is new, which bounds the state; None
    remembers all, a few bytes each."""
    out = T.StructType([*arrivals.schema.fields, T.StructField("first", T.BooleanType())])
    remembered = None if remembered_seconds is None else int(remembered_seconds * 1000)
    clock = "None" if remembered is None else "ProcessingTime"
    return arrivals.groupBy(key).transformWithState(FirstArrival(arrivals.columns, remembered), out, "Append", clock)


def dispatched(arrivals: DataFrame, complete: DataFrame, *, remembered_seconds: float | None = None) -> DataFrame:
    """A stream of arrivals (key, grp, position, ...) with `outcome`, as operators.select.dispatch gives it for a table: a skip
    reason, already_dispatched behind the key's first arrival, or queued. complete is a table of the groups that are done;
    a stream and a table are joined, so it is read afresh in every batch."""
    from ..operators.select import skip_reason

    done = complete.select("grp").distinct().withColumn("done", F.lit(True))
    seen = first_arrivals(arrivals, remembered_seconds=remembered_seconds).join(done, "grp", "left")
    later = F.when(F.col("first"), "queued").otherwise("already_dispatched")
    return seen.withColumn("outcome", F.coalesce(skip_reason(F.col("done").isNotNull()), later)).drop("done", "first")


def united(sources: list[DataFrame]) -> DataFrame:
    """Streams of one schema as one: what lies on the local disk, what the listing has, what copies report."""
    every = sources[0]
    for more in sources[1:]:
        every = every.unionByName(more)
    return every


def to_table(stream: DataFrame, folder: str, *, every: str | None = None, mode: str = "append", write: Callable[[DataFrame, int], None] | None = None):
    """Starts the stream into {folder}/out/batch=N, with its offsets and state beside it; every micro-batch writes its own
    folder, so that a batch that is run again writes the same. every: a processing-time tick; None ends with what there is,
    without the batches that only look at clocks, which would not end."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number:09d}")

    with settings(stream.sparkSession, spark_sql_streaming_stateStore_providerClass=PROVIDER, spark_sql_streaming_noDataMicroBatches_enabled=str(bool(every)).lower()):
        writer = stream.writeStream.outputMode(mode).foreachBatch(write or put).option("checkpointLocation", f"{folder}/offsets")
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
