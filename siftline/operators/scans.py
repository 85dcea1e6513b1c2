"""Running values over ordered lanes, where one lane may hold any share of the rows.

A window over a lane is one task for all its rows. Here the rows are dealt by ranges of (lane, order), so that a long lane
is in many chunks; each chunk is scanned by a window of its own, and what the chunks before it amount to is carried in.
The operators are associative (sums, counts, maxima, the value before), so the result is the window's over the whole lane.

What is carried is a row for each chunk of a lane that has several: fewer than twice the ranges, whatever the rows, which
is the bound of the broadcast. Sums of whole numbers and maxima are those of the window exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import settle

CHUNK = "__chunk"


def deal(rows: DataFrame, lane: list[str], order: list[str]) -> DataFrame:
    """rows in chunks of neighbouring ones, written, so that every use of them sees the same chunks.

    Rows with equal (lane, order) share a chunk. Null lanes are one lane, null orders come first.
    """
    keys = [F.col(c) for c in (*lane, *order)]
    return settle(rows.repartitionByRange(*keys).withColumn(CHUNK, F.spark_partition_id()), "chunks")


def _with_carry(dealt: DataFrame, lane: list[str], totals: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """dealt with the columns of `carry`: aggregates over `totals` (aggregates of a chunk) of a lane's chunks so far."""
    whole = dealt.groupBy(*lane, CHUNK).agg(*[c.alias(n) for n, c in totals.items()])
    spread = whole.withColumn("__chunks", F.count("*").over(W.partitionBy(*lane))).where("__chunks > 1")
    ahead = W.partitionBy(*lane).orderBy(CHUNK)
    brought = spread.select(*[F.col(c).alias(f"__{c}") for c in lane], F.col(CHUNK).alias("__c"), *[c.over(ahead if n.endswith("_lag") else ahead.rowsBetween(W.unboundedPreceding, -1)).alias(n) for n, c in carry.items()])
    same = F.col(CHUNK) == F.col("__c")
    for c in lane:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return dealt.join(F.broadcast(brought), same, "left").drop("__c", *[f"__{c}" for c in lane])


def _window(lane: list[str], order: list[str], last: int = 0) -> W:
    return W.partitionBy(*lane, CHUNK).orderBy(*order).rowsBetween(W.unboundedPreceding, last)


def running_sum(dealt: DataFrame, name: str, value: Column, lane: list[str], order: list[str], *, before: bool = False) -> DataFrame:
    """dealt with the sum of value over a lane's rows up to this one, or of those before it; nulls count as 0."""
    held = dealt.withColumn("__v", F.coalesce(value, F.lit(0)))
    brought = _with_carry(held, lane, {"__t": F.sum("__v")}, {"__s": F.sum("__t")})
    own = F.coalesce(F.sum("__v").over(_window(lane, order, -1 if before else 0)), F.lit(0))
    return brought.withColumn(name, own + F.coalesce("__s", F.lit(0))).drop("__v", "__s")


def running_count(dealt: DataFrame, name: str, lane: list[str], order: list[str]) -> DataFrame:
    """dealt with each row's number in its lane, from 1 on."""
    return running_sum(dealt, name, F.lit(1).cast("long"), lane, order)


def running_max(dealt: DataFrame, name: str, value: Column, lane: list[str], order: list[str]) -> DataFrame:
    """dealt with the greatest value of a lane's rows up to this one."""
    held = dealt.withColumn("__v", value)
    brought = _with_carry(held, lane, {"__t": F.max("__v")}, {"__m": F.max("__t")})
    return brought.withColumn(name, F.greatest(F.max("__v").over(_window(lane, order)), F.col("__m"))).drop("__v", "__m")


def previous(dealt: DataFrame, name: str, value: Column, lane: list[str], order: list[str]) -> DataFrame:
    """dealt with `name`, a struct of the value (`value`) of the lane's row before, null for its first row."""
    held = dealt.withColumn("__v", F.struct(value.alias("value")))
    last = F.max_by("__v", F.struct(*order))
    brought = _with_carry(held, lane, {"__t": last}, {"__p_lag": F.lag("__t")})
    own = F.lag("__v").over(W.partitionBy(*lane, CHUNK).orderBy(*order))
    return brought.withColumn(name, F.coalesce(own, F.col("__p_lag"))).drop("__v", "__p_lag")


def done(scanned: DataFrame) -> DataFrame:
    """The rows without the chunks."""
    return scanned.drop(CHUNK)
