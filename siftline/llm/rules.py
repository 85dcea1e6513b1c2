"""Operator 4: quality rules as a short-circuit cascade.

Each rule says of a text whether it fails. On a bounded sample the operator measures what a rule costs and how
often it rejects, and orders the rules by rejections per cost; the main pass then tries them in that order and
stops at the first that rejects. The verdict is that of all rules together, so the order changes the time and
never the result. The sample is for the order only: every text gets its verdict from its whole self.

Null text has no words. An empty table gives an empty result, and the rules keep the order they were given in.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

SYMBOLS = "#*$%&|<>"
#: The sample that the order of the rules is estimated on has about so many rows.
SAMPLE_ROWS = 2000
#: Words in a window whose repetition counts.
WINDOW = 5


class Text:
    """What the rules look at, each part made when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    def __getattr__(self, name: str):
        make = PARTS.get(name)
        if make is None:
            raise AttributeError(name)
        value = make(self)
        self.__dict__[name] = value
        return value


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW that occur twice or more, the first occurrence included."""
    windows = list(zip(*[words[k:] for k in range(WINDOW)], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = until = 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            covered += at + WINDOW - max(at, until)
            until = at + WINDOW
    return covered


def worded_lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]


PARTS: dict[str, Callable[[Text], object]] = {
    "words": lambda t: t.text.encode("utf-8", "replace").split(),  # bytes split at ASCII white space only
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.text) - sum(map(t.text.count, " \t\n\r\x0b\x0c")),
    "n_symbols": lambda t: sum(map(t.text.count, SYMBOLS)),
    "lines": lambda t: worded_lines(t.text),
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": lambda t: repeated_words(t.words),
}

Rule = Callable[[Text], bool]
#: Fails if true. Bounds are generous: a rule is there to reject junk, not to judge style.
RULES: dict[str, Rule] = {
    "too_few_words": lambda t: t.n_words < 10,
    "repetitive": lambda t: 100 * t.n_repeat_words > 20 * t.n_words,
    "symbols": lambda t: 4 * t.n_symbols > t.n_words,
    "word_length": lambda t: not 2 * t.n_words <= t.word_chars <= 20 * t.n_words,
    "duplicate_lines": lambda t: 2 * t.n_dup_lines > len(t.lines),
    "top_word": lambda t: t.n_words >= 50 and 10 * max(Counter(t.words).values()) > 4 * t.n_words,
    "few_letters": lambda t: 2 * sum(w.isdigit() for w in t.words) > t.n_words,
}
BASE = ("too_few_words", "repetitive")


def estimate(docs: DataFrame, rules: dict[str, Rule] = RULES, *, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, made: Iterable[str] = ()) -> list[tuple[str, float, float]]:
    """(rule, seconds a text, share rejected) on a sample of rows by hash, most rejections per second first.

    Rules share parts of a text. A part's cost counts for the first rule in the order that needs it, and for none if
    it is among those made in any case.
    """
    names, parts = list(rules), list(PARTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spent, rejected, needed = Counter(), Counter(), set()
            for value in batch.column(0).to_pylist():
                whole = Text(value)
                for part in parts:  # in this order each finds what it needs ready
                    began = time.perf_counter()
                    getattr(whole, part)
                    spent[part] += time.perf_counter() - began
                for name in names:
                    began = time.perf_counter()
                    rejected[name] += bool(rules[name](whole))
                    spent[name] += time.perf_counter() - began
                    rules[name](fresh := Text(value))
                    needed |= {(name, part) for part in parts if part in fresh.__dict__}
            rows = [("", "", 0.0, 0, batch.num_rows), *[(n, "", spent[n], rejected[n], 0) for n in [*names, *parts]], *[(n, p, 0.0, 0, 0) for n, p in needed]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["rule", "part", "spent", "rejected", "rows"])

    small_batches(docs.sparkSession)
    n = docs.count()
    share = max(1, n // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(share)) == 0).select(text).limit(2 * sample_rows)
    figures = sample.mapInArrow(run, "rule string, part string, spent double, rejected long, rows long")
    totals = {(r["rule"], r["part"]): r for r in figures.groupBy("rule", "part").agg(F.sum("spent").alias("spent"), F.sum("rejected").alias("rejected"), F.sum("rows").alias("rows")).collect()}
    rows = totals["", ""]["rows"] if totals else 0
    if not rows:
        return [(name, 0.0, 0.0) for name in names]
    ready, left, found = set(made), list(names), []
    needs = {name: {part for part in parts if (name, part) in totals} for name in names}
    cost = lambda name: (totals[name, ""]["spent"] + sum(totals[part, ""]["spent"] for part in needs[name] - ready)) / rows
    while left:
        share_of = {name: totals[name, ""]["rejected"] / rows for name in left}
        best = max(left, key=lambda name: share_of[name] / max(cost(name), 1e-9))
        found.append((best, cost(best), share_of[best]))
        ready |= needs[best]
        left.remove(best)
    return found


def first_failure(text: Text, order: list[str], rules: dict[str, Rule] = RULES) -> str | None:
    """The first rule in this order that rejects; later ones are not tried."""
    return next((name for name in order if rules[name](text)), None)


def cascade(docs: DataFrame, rules: dict[str, Rule] = RULES, *, key: str = "doc_id", text: str = "text", base: bool = True) -> DataFrame:
    """Per row: key, n_words, the base figures, base_failed and kept.

    base=False leaves the base figures out, so that a text costs no more than the rules tried on it.
    """
    figures = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"] if base else []
    longs = ["n_words", *figures]
    order = [name for name, _, _ in estimate(docs, rules, key=key, text=text, made=PARTS if base else ("words", "n_words"))]
    schema = T.StructType(
        [docs.schema[key]]
        + [T.StructField(n, T.LongType()) for n in longs]
        + ([T.StructField("base_failed", T.BooleanType())] if base else [])
        + [T.StructField("kept", T.BooleanType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in schema.names[1:]}
            for value in batch.column(1):
                t = Text(value.as_py())
                for n in longs:
                    columns[n].append(getattr(t, n))
                failed = False
                if base:
                    failed = any(rules[n](t) for n in BASE)
                    columns["base_failed"].append(failed)
                columns["kept"].append(not failed and first_failure(t, order, rules) is None)
            types = [pa.int64()] * len(longs) + [pa.bool_()] * (1 + base)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, x) for c, x in zip(columns.values(), types, strict=True)]], schema.names)

    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, schema)
