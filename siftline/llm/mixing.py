"""Operator 3: mixing sources to target weights by pivotal dependent rounding.

A source that should give `target` words out of `source_size` takes each of its documents target / source_size
times on average: the whole part of it always, and once more with the probability of the fractional part. The
extra copies are not drawn one by one. Documents duel in pairs: probability mass, weighted with the documents'
sizes, moves from one to the other, at random in which direction but so that nobody's expected copies change and
the pair's expected words stay the same, until one of the two is decided (0 or 1). The other goes on to the next
duel. A source's words so stay exactly on target until a single undecided document is left.

Documents first duel inside buckets of about BUCKET documents; the undecided document of each bucket goes on, and
FAN buckets at a time are combined in a tree, level by level, until one document a source is undecided, which is
rounded: a source misses its target by at most half of that document. A source of a third of all rows is so many
buckets. Every order is fixed by hashes of the identifiers and the seed, and a bucket's duels draw from a generator
that its members seed, a fresh number each, so a rerun takes the same words.

Defined cases: null text has size 0 and takes part with 0 words; null is a source of its own, the last in order.
Rows that share identifier, source and size are decided as one unit, so that each of them gets the same copies;
a unit's weight is that of its rows together. A source of size 0 has target 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import WORD, one_row, settle, unused

#: Documents in a bucket of the first level, about; buckets combined into one at each further level.
BUCKET, FAN = 4096, 512
#: A source gives at most so many times its size.
MOST_TIMES = 3.0


def words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycle_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, for ranks 0, 1, 2, ..."""
    return (F.pmod(rank, F.lit(3)) + 1).cast("double")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with their rank by code point, null last.

    Ranks are counted from the sizes of groups of sources by their first two bytes; those counts are at most 65,537
    rows, and the ranks inside a group are counted group by group.
    """
    head = F.coalesce(F.hex(F.substring(F.col("source").cast("binary"), 1, 2)), F.lit("~"))
    grouped = sources.withColumn("head", head)
    before = W.orderBy("head").rowsBetween(W.unboundedPreceding, -1)
    offsets = grouped.groupBy("head").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("head", "before")
    inside = F.row_number().over(W.partitionBy("head").orderBy("source")) - 1
    return grouped.withColumn("inside", inside).join(F.broadcast(offsets), "head").withColumn("rank", F.col("before") + F.col("inside")).drop("head", "inside", "before")


def targets(sizes: DataFrame, weight: Callable[[Column], Column] = cycle_weight, most_times: float = MOST_TIMES) -> DataFrame:
    """source, source_size, n, weight and target for rows of (source, size).

    Targets are shares of all words by weight. Those above most_times their source's size stop there, and the
    excess is shared again by weight until none is above: one small aggregate a round, the sources stay distributed.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    found = settle(ranked(by_source).withColumn("weight", weight(F.col("rank"))), "sources")
    cap = F.col("source_size") * F.lit(most_times)
    total = one_row(found.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")))["t"]
    level, capped = 0.0, -1
    while True:
        full = cap < F.lit(level) * F.col("weight") if level else F.lit(False)
        r = one_row(found.agg(
            F.sum(F.when(full, cap).otherwise(0.0)).alias("taken"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(full).alias("capped"),
        ))
        if r["capped"] == capped or not r["open"]:
            break
        capped, level = r["capped"], (total - r["taken"]) / r["open"]
    return found.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


UNIT = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("size", T.LongType()),
    T.StructField("rows", T.LongType()),
    T.StructField("bucket", T.LongType()),
    T.StructField("draw", T.DoubleType()),
    T.StructField("p", T.DoubleType()),
])


def duel(units: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Decides all units of a bucket but one at most; p is 0 or 1 where decided. last: decides that one too."""
    units = units.sort_values(["size", "draw", "doc_id"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    p = units["p"].tolist()
    mass = (units["size"] * units["rows"]).tolist()
    draws = units["draw"].tolist()
    tiny = 1e-12
    held = -1
    fresh = np.random.default_rng([int(draws[0] * (1 << 52)), len(p), int(sum(p) * (1 << 32))]) if p else None
    for k in range(len(p)):
        if p[k] <= tiny or p[k] >= 1 - tiny:
            p[k] = float(round(p[k]))
            continue
        if not mass[k]:
            p[k] = 1.0 if draws[k] < p[k] else 0.0
            continue
        if held < 0:
            held = k
            continue
        a, b, wa, wb = p[held], p[k], mass[held], mass[k]
        up = min((1 - a) * wa, b * wb)  # words that can move to the held document
        down = min(a * wa, (1 - b) * wb)  # and from it
        move = up if fresh.random() * (up + down) < down else -down
        p[held], p[k] = a + move / wa, b - move / wb
        open_held, open_k = tiny < p[held] < 1 - tiny, tiny < p[k] < 1 - tiny
        for at, is_open in ((held, open_held), (k, open_k)):
            if not is_open:
                p[at] = float(round(p[at]))
        held = held if open_held else k if open_k else -1
    if last and held >= 0:
        p[held] = float(p[held] >= 0.5)
    units["p"] = p
    return units


def semifinal(units: pd.DataFrame) -> pd.DataFrame:
    return duel(units, False)


def final(units: pd.DataFrame) -> pd.DataFrame:
    return duel(units, True)


LEVELS = {False: semifinal, True: final}


def copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, weight: Callable[[Column], Column] = cycle_weight, most_times: float = MOST_TIMES) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target and copies (how often the mix takes the row)."""
    spark = docs.sparkSession
    sizes = settle(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size")), "sizes")
    shares = settle(targets(sizes, weight, most_times), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # sources are as many as they are: joined by the planner's choice, never broadcast by order
    share = shares.select(F.col("source").alias("s"), "source_size", "target", "n", rate.alias("rate"))
    mark = F.xxhash64("source", "doc_id", "size", F.lit(seed))
    units = (
        sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows"))
        .join(share, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("whole", F.floor("rate"))
        .select(
            "source", "doc_id", "size", "rows",
            F.pmod(mark, F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET))).cast("long").alias("bucket"),
            (F.pmod(F.xxhash64(mark, F.lit("draw")), F.lit(1 << 52)) / float(1 << 52)).alias("draw"),
            (F.col("rate") - F.floor("rate")).alias("p"),
        )
    )
    most = one_row(shares.agg(F.max("n").alias("n")))["n"] or 0
    buckets = max(1, -(-most // BUCKET))
    decided: DataFrame | None = None
    while True:
        last = buckets == 1
        done = settle(units.groupBy("source", "bucket").applyInPandas(LEVELS[last], UNIT), "duels")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        now = done.where(~is_open)
        decided = now if decided is None else decided.unionByName(now)
        if last:
            break
        buckets = -(-buckets // FAN)
        units = done.where(is_open).withColumn("bucket", F.floor(F.col("bucket") / FAN).cast("long"))
    extra = decided.select(F.col("source").alias("s2"), F.col("doc_id").alias("d2"), F.col("size").alias("z2"), F.col("p").cast("long").alias("extra"))
    same = F.col("source").eqNullSafe(F.col("s2")) & F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("size") == F.col("z2"))
    return (
        sizes.join(extra, same)
        .join(share, F.col("source").eqNullSafe(F.col("s")))
        .select("doc_id", "source", "size", "source_size", "target", (F.floor("rate") + F.col("extra")).cast("long").alias("copies"))
    )


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it, all columns kept."""
    d, s, n, c, size, number = unused(docs, "d", "s", "n", "c", "size", "number")
    found = copies(docs, key=key, text=text, source=source, **options)
    plan = found.where("copies > 0").select(F.col("doc_id").alias(d), F.col("source").alias(s), F.col("size").alias(n), F.col("copies").alias(c)).distinct()
    same = F.col(key).cast("long").eqNullSafe(F.col(d)) & F.col(source).cast("string").eqNullSafe(F.col(s)) & (F.col(size) == F.col(n))
    joined = docs.withColumn(size, words(F.col(text))).join(plan, same)
    return joined.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(c).cast("int")))).select(*docs.columns)


def taken(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken: the words that the mix takes of each document."""
    found = copies(docs)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
