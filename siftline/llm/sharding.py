"""Operator 5: shards of near-equal bytes by a minimax contiguous partition.

Documents of equal text form an atomic group, and groups stand in the order of their least identifier. The
operator finds the smallest capacity with which the groups, taken in order and a new shard begun whenever the next
group does not fit, fill no more than the wanted number of shards, and cuts there. (Law "bytes": shards of nearly
equal size. grown_shard is null.)

The groups' running totals are a distributed table; the driver never sees it. Whether a capacity is feasible takes
one look-up a shard: the largest running total within reach. Candidates are looked up PROBES at a time, each task
answering with a binary search in its own part, so that each job narrows the capacity by a factor of PROBES.

A group of a third of all rows is one group, as the law wants, but its rows are numbered in parts by identifier.
Null text counts as empty and has size 1, as all sizes are one more than the bytes. Null identifiers come first.
Rows with one identifier and text share a slot order given by a hash, and still have slots of their own. An empty
table gives no rows; shards may stay empty where there are fewer groups than shards.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import one_row, settle
from .order import ranges

SHARDS, PROBES = 16, 255
#: Rows of a range of identifiers at most, whose running totals one task makes; and ranges at least, so that a group of
#: copies is numbered in parts at every size.
RANGE_ROWS, RANGES = 200_000, 256


class Totals:
    """A table of groups with their running totals, for look-ups of the largest total within a reach."""

    def __init__(self, groups: DataFrame, total: str):
        self.table = groups.select(F.col(total).alias("t"))

    def within(self, reaches: list[int]) -> list[int]:
        """For each reach the largest running total that does not exceed it, 0 if none."""
        wanted = sorted(set(reaches))
        goals = np.array(wanted, np.int64)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = np.zeros(len(goals), np.int64)
            for batch in batches:
                totals = np.sort(batch.column(0).to_numpy(zero_copy_only=False))
                at = np.searchsorted(totals, goals, side="right")
                best = np.maximum(best, np.where(at > 0, totals[np.maximum(at - 1, 0)], 0)) if len(totals) else best
            hit = np.nonzero(best)[0]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(best[hit], pa.int64())], ["k", "t"])

        rows = self.table.mapInArrow(run, "k int, t long").groupBy("k").agg(F.max("t").alias("t")).collect()
        found = {wanted[r["k"]]: r["t"] for r in rows}
        return [found.get(r, 0) for r in reaches]


def smallest_capacity(totals: Totals, total: int, heaviest: int, shards: int = SHARDS, probes: int = PROBES) -> tuple[int, list[int]]:
    """The smallest feasible capacity, and the running total at which each of its shards ends.

    Lower bounds: the mean, and the heaviest group. Their sum is always enough: a shard is closed only when the
    next group does not fit, so each but the last is filled beyond the mean.
    """
    low = max(-(-total // shards), heaviest)
    high = max(low, -(-total // shards) + heaviest)
    ends: list[int] = []
    while True:
        step = max(1, -(-(high - low + 1) // probes))
        tried = [*range(low, high, step), high]
        cuts: list[list[int]] = [[] for _ in tried]
        at = [0] * len(tried)
        for _ in range(shards):
            at = totals.within([a + c for a, c in zip(at, tried, strict=True)])
            for c, a in zip(cuts, at, strict=True):
                c.append(a)
            if min(at) == total:
                break
        first = next(k for k, a in enumerate(at) if a == total)
        if step == 1 or not first:
            ends = [*cuts[first], *[total] * (shards - len(cuts[first]))]
            return tried[first], ends
        low, high = tried[first - 1] + 1, tried[first]


def assign(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    base = settle(
        docs.select(
            F.col(key).cast("long").alias("doc_id"),
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(body, 256)).alias("digest"),
        ),
        "documents",
    )
    spans = ranges(base.withColumn("one", F.lit(1)), "doc_id", "one", min(RANGE_ROWS, -(-base.count() // RANGES)))
    if not len(spans):
        return base.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    # a cell is the part of a group in one range of identifiers; a group has at most as many cells as there are ranges
    celled = settle(base.withColumn("span", spans.of(F.col("doc_id"))), "cells")
    cells = celled.groupBy("digest", "span").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull()).alias("null_id"))
    cell_rows = W.partitionBy("digest").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    cells = settle(cells.withColumn("before", F.coalesce(F.sum("n").over(cell_rows), F.lit(0))), "offsets")
    first = F.when(F.max("null_id"), F.lit(None)).otherwise(F.min("first"))
    groups = cells.groupBy("digest").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), first.alias("first"))
    groups = settle(groups.withColumn("span", spans.of(F.col("first"))), "groups")
    # running totals: inside a range of first identifiers by a window, across ranges by their sums
    sums = {r["span"]: (r["n"], r["bytes"]) for r in groups.groupBy("span").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    rows_before, bytes_before, n, total = [], [], 0, 0
    for k in range(len(spans)):
        rows_before.append(n)
        bytes_before.append(total)
        n, total = n + sums.get(k, (0, 0))[0], total + sums.get(k, (0, 0))[1]
    base_of = docs.sparkSession.createDataFrame(list(zip(range(len(spans)), rows_before, bytes_before, strict=True)), "span int, rows_before long, bytes_before long")
    upto = W.partitionBy("span").orderBy(F.col("first").asc_nulls_first(), "digest").rowsBetween(W.unboundedPreceding, 0)
    ordered = groups.withColumn("rows_to", F.sum("n").over(upto)).withColumn("bytes_to", F.sum("bytes").over(upto)).join(base_of, "span")
    ordered = settle(ordered.select("digest", "n", "bytes", (F.col("rows_to") + F.col("rows_before")).alias("rows_to"), (F.col("bytes_to") + F.col("bytes_before")).alias("bytes_to")), "totals")
    heaviest = one_row(ordered.agg(F.max("bytes").alias("b")))["b"]
    _, ends = smallest_capacity(Totals(ordered, "bytes_to"), total, heaviest, shards)
    # a shard's first row is the one after the last group that ends at or before the shard's start
    starts = [0, *ends[:-1]]
    firsts = {r["bytes_to"]: r["rows_to"] for r in ordered.where(F.col("bytes_to").isin(sorted(set(starts)))).select("bytes_to", "rows_to").collect()}
    shard = sum(((F.col("bytes_to") > F.lit(s)).cast("int") for s in starts[1:]), F.lit(0))
    row_start = F.element_at(F.array(*[F.lit(firsts.get(s, 0)).cast("long") for s in starts]), F.col("shard") + 1)
    placed = ordered.withColumn("shard", shard).select("digest", "shard", (F.col("rows_to") - F.col("n") - row_start).alias("group_slot"))
    offsets = cells.select("digest", "span", "before").join(placed, "digest").select("digest", "span", "shard", (F.col("group_slot") + F.col("before")).alias("cell_slot"))
    inside = F.row_number().over(W.partitionBy("digest", "span").orderBy(F.col("doc_id").asc_nulls_first())) - 1
    return (
        celled.join(offsets, ["digest", "span"])
        .withColumn("slot", F.col("cell_slot") + inside)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
