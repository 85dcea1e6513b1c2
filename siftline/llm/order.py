"""Exact, repeatable ranges of a whole-number key, for operators that write or number rows in its order."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Into so many parts the key's span is cut at first, and a part that is still too heavy again.
FIRST, AGAIN = 4096, 64
LEAST = -(1 << 63)


class Ranges:
    """Neighbouring ranges of a key by their first values; the first range takes all below, and null."""

    def __init__(self, starts: list[int], weights: list[int], rows: list[int]):
        self.starts, self.weights, self.rows = starts, weights, rows

    def __len__(self) -> int:
        return len(self.starts)

    def of(self, key: Column) -> Column:
        """The number of the range that a key falls into."""
        starts = np.array(self.starts[1:], np.int64)

        @F.pandas_udf("int")
        def find(keys: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(starts, keys.to_numpy(np.int64), side="right").astype("int32"))

        return find(F.coalesce(key.cast("long"), F.lit(LEAST))) if len(starts) else F.lit(0)


def ranges(rows: DataFrame, key: str, weight: str, most: int) -> Ranges:
    """Ranges of rows' key that weigh at most `most` each, as far as single keys allow.

    The span of the keys is cut into equal parts whose weights are summed; a part heavier than allowed is cut
    again, however unevenly the keys lie. Only weights of parts come to the driver: FIRST at first, and AGAIN for
    each part that is too heavy, of which there are no more than total weight / most. Sums are exact and the cuts
    follow from them, so a rerun finds the same ranges.
    """
    keyed = rows.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("k"), F.col(weight).cast("long").alias("w"))
    null, known = F.col("k") == LEAST, F.when(F.col("k") > LEAST, F.col("k"))
    low, high, w_null, n_null = keyed.agg(F.min(known), F.max(known), F.sum(F.when(null, F.col("w"))), F.count_if(null)).first()
    found: dict[int, tuple[int, int]] = {LEAST: (w_null, n_null)} if n_null else {}
    keyed = keyed.where(F.col("k") > LEAST)
    todo = cut(low, high + 1, FIRST) if low is not None else []
    spans = dict(zip(todo, [*todo[1:], high + 1], strict=True)) if todo else {}
    only: list[tuple[int, int]] = []
    while todo:
        part = Ranges([LEAST, *todo[1:]] if not only else todo, [], []).of(F.col("k"))
        chosen = keyed if not only else keyed.where(Ranges(*edges(only)).of(F.col("k")) % 2 == 1)
        sums = {r["p"]: (r["w"], r["n"]) for r in chosen.groupBy(part.alias("p")).agg(F.sum("w").alias("w"), F.count("*").alias("n")).collect()}
        heavy = []
        for p, (w, n) in sums.items():
            start = todo[p]
            if w > most and spans[start] - start > 1:
                heavy.append((start, spans[start]))
            else:
                found[start] = (w, n)
        todo, only = [], sorted(heavy)
        for a, b in only:
            parts = cut(a, b, AGAIN)
            spans.update(zip(parts, [*parts[1:], b], strict=True))
            todo += parts
    starts, weights, counts = [], [], []
    for start in sorted(found):
        w, n = found[start]
        if starts and weights[-1] + w <= most:
            weights[-1] += w
            counts[-1] += n
        else:
            starts.append(start if starts else LEAST)
            weights.append(w)
            counts.append(n)
    return Ranges(starts, weights, counts)


def cut(a: int, b: int, parts: int) -> list[int]:
    """First values of at most so many equal parts of a..b-1."""
    step = max(1, -(-(b - a) // parts))
    return list(range(a, b, step))


def edges(spans: list[tuple[int, int]]) -> tuple[list[int], list, list]:
    """Ranges whose odd members are the spans (sorted, apart or touching)."""
    starts: list[int] = [LEAST]
    for a, b in spans:
        if starts[-1] == a and len(starts) % 2 == 1 and len(starts) > 1:
            starts.pop()
            starts.append(b)
        else:
            starts += [a, b]
    return starts, [], []


def place(starts: list[int], key: int) -> int:
    """The range of one key, as Ranges.of gives it."""
    return max(0, bisect_right(starts, key) - 1)
