"""Operator 11: periodic runs of words, by an all-lag vectorised scan.

A run is a stretch of words that repeats with a smallest period q at least TIMES times, at least LEAST words long, and
that no neighbouring word extends. The array of word numbers is compared with itself shifted by every lag q up to
n / TIMES; a long enough stretch of equal places, q words lengthened, is a run if q is its smallest period.

* Texts of a batch are laid behind each other, longest first, so that one comparison serves all texts that are long
  enough for the lag. No stretch of equal places across two texts is long enough to count.
* A stretch that counts has (TIMES - 1) * q equal places, so two neighbouring places of every ((TIMES - 1) * q / 2)-th
  are equal: only these are compared at first, and a stretch is measured where both are. All lags of n words take in
  the order of n log n comparisons that way, and lose no run.
* A multiple of a run's period finds the same stretch: it is left out by its smallest period, and not measured again.

Texts of more than SPLIT bytes are dealt over the cluster by ranges of lags, at most PARTS a text; equal ones are
scanned once. A run belongs to the range of its smallest period, so ranges find disjoint runs.

Null, empty and blank texts have no words and no runs, and their collapsed text is empty. Rows repeated with or without
the same key are annotated each. A null key is passed on. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, grouped, kept, settle, small_batches
from .private import let

#: Words of a run, and times its period, at least.
LEAST, TIMES = 6, 4
#: Texts of more bytes are dealt by ranges of lags, at most so many a text.
SPLIT, PARTS = 1 << 16, 64
#: Bytes of text that are scanned together.
TOGETHER = 4 << 20

RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def numbered(bodies: list[bytes]) -> tuple[list[list[bytes]], list[np.ndarray]]:
    """Each text's words (runs of anything but ASCII white space), and their numbers: equal words have equal ones."""
    known: defaultdict = defaultdict(count().__next__)
    words = [body.split() for body in bodies]
    return words, [np.fromiter(map(known.__getitem__, w), np.int32, len(w)) for w in words]


def forward(ids: np.ndarray, at: int, lag: int, stop: int) -> int:
    """The first place from `at` on, or stop, that differs from the one a lag on."""
    step = 64
    while at < stop:
        end = min(at + step, stop)
        other = ids[at:end] != ids[at + lag : end + lag]
        k = int(other.argmax())
        if other[k]:
            return at + k
        at, step = end, min(2 * step, 1 << 16)
    return stop


def backward(ids: np.ndarray, at: int, lag: int) -> int:
    """The first place of the stretch up to `at` of places equal to those a lag on."""
    step = 64
    while at > 0:
        low = max(0, at - step)
        other = (ids[low:at] != ids[low + lag : at + lag])[::-1]
        k = int(other.argmax())
        if other[k]:
            return at - k
        at, step = low, min(2 * step, 1 << 16)
    return 0


def smallest_period(block: np.ndarray, lag: int) -> int:
    """The smallest period of a stretch with period lag; block is its first 2 * lag words.

    At two or more times its length, a smaller period divides the lag: prime factors are taken out while it stays one.
    """
    period, rest, p = lag, lag, 2
    while rest > 1:
        p = p if p * p <= rest else rest
        if rest % p:
            p += 1
            continue
        while rest % p == 0:
            rest //= p
            if period % p == 0 and np.array_equal(block[:lag], block[period // p : period // p + lag]):
                period //= p
        p += 1
    return period


def scan(texts: list[np.ndarray], low: int = 1, high: int | None = None, least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Each text's runs (start, length, period) with a period of low..high, by start, then period."""
    found: list[list] = [[] for _ in texts]
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    sizes = [len(texts[k]) for k in order]
    if not sizes or sizes[0] < max(least, times * low):
        return found
    wall = np.array([-1], np.int32)
    ids = np.concatenate([part for k in order for part in (texts[k], wall)])
    starts = np.cumsum([0, *[n + 1 for n in sizes[:-1]]])
    period_at, until = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
    n_texts, top = len(sizes), sizes[0] // times
    for lag in range(low, min(top, high or top) + 1):
        need = max(least, times * lag)
        while n_texts and sizes[n_texts - 1] < need:
            n_texts -= 1
        if not n_texts:
            break
        stop = int(starts[n_texts - 1]) + sizes[n_texts - 1] - lag
        places = need - lag
        step = max(1, places // 2)
        same = ids[:stop:step] == ids[lag : stop + lag : step]
        at = np.flatnonzero(same[:-1] & same[1:] if places > 1 else same) * step
        for part in (2, 4, 8):
            between = at + step // part
            at = at[ids[between] == ids[between + lag]]
        if len(at):  # stretches of a known period that divides the lag are those of that period
            known = period_at[at]
            at = at[~((known > 0) & (lag % np.maximum(known, 1) == 0) & (until[at] > at + lag))]
        done = -1
        for place in at.tolist():
            if place < done:
                continue
            first, done = backward(ids, place, lag), forward(ids, place, lag, stop)
            length = done - first + lag
            if length < need:
                continue
            period = smallest_period(ids[first : first + 2 * lag], lag)
            period_at[first : done + lag], until[first : done + lag] = period, done + lag
            if period == lag:
                k = int(np.searchsorted(starts, first, side="right")) - 1
                found[order[k]].append((first - int(starts[k]), length, lag))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def without_repeats(words: list[bytes], runs: Iterable[tuple[int, int, int]]) -> bytes:
    """The words but for those that a run holds after its first period, joined by single spaces."""
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join(compress(words, stay.tolist()))


def rows_out(keys: pa.ChunkedArray, words: list, runs: list, names: list[str]) -> pa.RecordBatch:
    as_rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
    kept_text = [without_repeats(w, r) for w, r in zip(words, runs, strict=True)]
    keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
    return pa.RecordBatch.from_arrays([keys, pa.array([len(w) for w in words], pa.int64()), pa.array(as_rows, ARROW_RUNS), pa.array(kept_text, pa.binary()).cast(pa.string())], names)


def annotate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES, split: int = SPLIT) -> DataFrame:
    """Per row of docs: key, n_words, runs (start, length, period; by start, then period) and the collapsed text."""
    if times < 2:
        raise ValueError("a run has its period twice at least")
    small_batches(docs.sparkSession)
    names = ["key", "n_words", "runs", "collapsed"]
    out = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("body"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in grouped(batches, TOGETHER):
            words, ids = numbered(batch.column(1).to_pylist())
            yield rows_out(batch.column(0), words, scan(ids, least=least, times=times), names)

    def ranged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        for batch in batches:
            for mark, body, part, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = numbered([body])[1]
                lags = len(ids[0]) // times
                low, high = part * lags // parts + 1, (part + 1) * lags // parts
                if low <= high:
                    runs = scan(ids, low, high, least, times)[0]
                    yield pa.RecordBatch.from_pylist([{"mark": mark, "start": s, "length": n, "period": p} for s, n, p in runs], pa.schema([("mark", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [body.split() for body in batch.column(1).to_pylist()]
            runs = [[(r["start"], r["length"], r["period"]) for r in rs or []] for rs in batch.column(2).to_pylist()]
            yield rows_out(batch.column(0), words, runs, names)

    long = F.octet_length("body") > split
    short = rows.where(~long).mapInArrow(whole, out)
    large = settle(rows.where(long).withColumn("mark", F.sha2("body", 256)), "long")
    parts = F.least(F.lit(PARTS), F.ceil(F.octet_length("body") / split)).cast("int")
    once = large.dropDuplicates(["mark"]).select("mark", "body", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), parts.alias("parts"))
    runs = once.repartition("mark", "part").mapInArrow(ranged, "mark string, start long, length long, period long")
    # a text has fewer runs than words, so the list is bounded by the text beside it
    listed = runs.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("found"))
    listed = settle(listed.select("mark", F.transform("found", lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"), r["period"].alias("period"))).alias("found")), "runs")
    dealt = large.join(listed, "mark", "left").select("key", "body", "found").mapInArrow(collapse, out)
    return short.unionByName(dealt).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equal ones; null without runs."""
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    nothing = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(runs, nothing, lambda best, r: F.when(more(best, r), r).otherwise(best))


def summary(annotated: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per annotated row: its number of runs, the strongest of them, and digests of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in ("start", "length", "period")]), F.lit("\n")))
    rows = annotated.select(key, F.size("runs").cast("long").alias("n_runs"), strongest(F.col("runs")).alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exact = F.expr("1000 * best.length div best.period")
    return rows.select(key, "n_runs", "best.start", "best.length", "best.period", exact.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_planted_periods(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and text, where every tenth text by h = crc32(key) repeats itself from a word on.

    With g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), word i >= a becomes word a + (i - a) % p.
    Texts without words and rows without a key stay as they are. The changed rows are written, so that they are made once.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(v: Column) -> Column:
        w, n, a, p = v["w"], v["n"], v["a"], v["p"]
        word = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), word), " ")

    def planned(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(n > 0, let(F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p")), repeated))

    # the words are split once a row, whatever Catalyst makes of the projections
    planted = let(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), planned)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    changed = settle(docs.where(chosen).select(key, F.coalesce(planted, F.col(text)).alias(text)), "planted")
    return docs.where(~chosen).select(key, text).unionByName(changed)
