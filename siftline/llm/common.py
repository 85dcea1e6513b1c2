"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle
from ..session import shared_folder as fresh_dir

#: A word, wherever an operator says "word": a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text whose words are numbered together.
GROUP_BYTES = 8 << 20
#: A-Z and a-z, for lower-casing that leaves every other letter alone.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, so that a batch of long texts fits into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def ascii_lower(text: Column) -> Column:
    """text with A-Z lowered and nothing else."""
    return F.translate(text, UPPER, LOWER)


def unused(df: DataFrame, *names: str) -> list[str]:
    """These names, each lengthened until df has no column of that name."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def one_row(df: DataFrame) -> dict:
    """The single row of an aggregate without keys."""
    return df.first().asDict()


def halved(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many bytes, as far as single rows allow."""
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
    else:
        half = batch.num_rows // 2
        yield from halved(batch.slice(0, half), size)
        yield from halved(batch.slice(half), size)


def grouped(batches: Iterable[pa.RecordBatch], size: int = GROUP_BYTES) -> Iterator[pa.Table]:
    """The batches joined to tables of about so many bytes, for work that pays off on many texts at a time."""
    held, have = [], 0
    for batch in chain.from_iterable(map(partial(halved, size=size), batches)):
        held.append(batch)
        have += batch.nbytes
        if have >= size:
            yield pa.Table.from_batches(held)
            held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


_kept: dict[tuple, object] = {}


def kept(key: tuple | None = None, make: Callable[[], object] = lambda: None):
    """What an operator keeps in a Python worker from task to task, made when first asked for.

    A worker keeps one thing at a time, and nothing once an operator calls this without a key: workers are used again,
    and the tables of stages that follow each other would add up.
    """
    if key not in _kept:
        _kept.clear()
        if key:
            _kept[key] = make()
    return _kept.get(key)


class Memo:
    """A word cache of bounded size: make(words) fills in what is missing.

    It has two generations of at most `limit` words. When the young one is full it becomes the old one, and what is
    still asked for moves on from there, so frequent words stay.
    """

    def __init__(self, make: Callable[[list], list], limit: int = 250_000, longest: int = 64):
        self.make, self.limit, self.longest = make, limit, longest
        self.known: dict = {}
        self.old: dict = {}

    def all(self, words: list) -> list:
        """The value of each word, in order; no value is None."""
        found = list(map(self.known.get, words))
        if None not in found:
            return found
        gaps = [k for k, value in enumerate(found) if value is None]
        missing = {words[k] for k in gaps}
        if len(self.known) + len(missing) > self.limit:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        new = [word for word in missing if word not in old]
        for word in missing.difference(new):
            known[word] = old[word]
        if new:
            known.update(zip(new, self.make(new), strict=True))
        for k in gaps:
            found[k] = known[words[k]]
        for word in new:
            if len(word) > self.longest:
                del known[word]
        return found
