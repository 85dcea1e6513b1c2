"""Operator 13: lines that many documents share are left to one of them.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. The keys of at least LETTERS code points
that stand in at least DOCUMENTS documents stay in the document with the largest identifier that has them and go from
all others; all other lines stay.

Each document makes one row a key: a 128-bit digest and the places of the key's lines. The rows are dealt by ranges of
(digest, identifier) and sorted with the largest identifier first, so that a task streams over a key's documents, its first
occurrence ahead, and knows after DOCUMENTS of them that the others' lines go. A key that very many documents have spans
several ranges and is no task's alone. What lies at a range's edges, or is too much to be held until the key is decided, is
left open with its rows; a few rows of each such stretch tell how many documents the key has and which is the largest.

What comes out are places, gathered to a compressed bitmap of kept lines a document, not texts. Bitmaps are applied to the
texts at the end (`drop_lines`).

Null and empty texts are one empty line. Rows that share an identifier are one document, so a key's lines stay in all rows
of the largest; null identifiers are one document as well, the smallest. Rows repeated with identifier and text have one
bitmap. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, settle, small_batches, unused

#: Code points of a key, and documents that have it, from which on its lines go.
LETTERS, DOCUMENTS = 40, 5
#: White space that a key is stripped of.
SPACE = " \t\n\x0b\x0c\r"
#: Rows of an undecided key that a task holds; rows that it puts out together.
HOLD, OUT = 200_000, 50_000

PLACES = T.ArrayType(T.IntegerType())
KEYED = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("known", T.BooleanType()),
    T.StructField("id", T.LongType()),
    T.StructField("mark", T.BinaryType()),
    T.StructField("n_lines", T.IntegerType()),
    T.StructField("places", PLACES),
])
#: State of a row: it goes, or it is open, or it is open and one of those that tell of its key.
GOES, OPEN, TELLS = 0, 1, 2


def keyed(batches: Iterable[pa.RecordBatch], letters: int) -> Iterator[pa.RecordBatch]:
    """(id, mark, text) to KEYED, a row for each key of a text that is long enough."""
    kept()
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    names = ["digest", "known", "id", "mark", "n_lines", "places"]

    def out(rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows: list = []
    for batch in batches:
        for doc_id, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines = (text or "").split("\n")
            places: dict[str, list[int]] = {}
            for k, line in enumerate(lines):
                if len(line) >= letters and len(line := line.strip(SPACE)) >= letters:
                    places.setdefault(line.translate(lower), []).append(k)
            for key, at in places.items():
                rows.append((hashlib.blake2b(key.encode(), digest_size=16).digest(), doc_id is not None, doc_id or 0, mark, len(lines), at))
            if len(rows) >= OUT:
                yield out(rows)
                rows = []
    yield out(rows)


def decide(batches: Iterable[pa.RecordBatch], documents: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows of KEYED, with what becomes of them: those that stay are left out."""
    held: pa.Table | None = None
    still_open: bytes | None = None
    first = True

    def settled(rows: pa.Table, final: bool) -> tuple[list[pa.Table], pa.Table | None]:
        """What can be put out of these rows, and the rows of the last key if they are to be held."""
        nonlocal still_open, first
        digest = np.frombuffer(b"".join(rows.column(0).to_pylist()), ">u8").reshape(-1, 2)
        known, ids = rows.column(1).to_numpy(), rows.column(2).to_numpy()
        new_key = np.concatenate([[True], (digest[1:] != digest[:-1]).any(axis=1)])
        new_doc = new_key | np.concatenate([[True], (known[1:] != known[:-1]) | (ids[1:] != ids[:-1])])
        starts = np.flatnonzero(new_key)
        key_of = np.cumsum(new_key) - 1
        number = np.cumsum(new_doc)
        number = number - number[starts][key_of] + 1  # of the row's document within its key
        n_docs = np.maximum.reduceat(number, starts)
        is_open = np.zeros(len(starts), bool)
        leading = rows.column(0)[0].as_py()
        is_open[0] = first or leading == still_open
        first = False
        last = int(starts[-1])
        rest = None
        if final or is_open[-1] or len(ids) - last > HOLD:
            is_open[-1] = True
            still_open = rows.column(0)[last].as_py()
        else:
            rest = rows.slice(last)
            starts, n_docs, is_open = starts[:-1], n_docs[:-1], is_open[:-1]
            rows, key_of, number, new_doc = rows.slice(0, last), key_of[:last], number[:last], new_doc[:last]
        if not len(starts):
            return [], rest
        goes = ~is_open[key_of] & (n_docs >= documents)[key_of] & (number > 1)
        state = np.where(goes, GOES, np.where(new_doc & (number <= documents), TELLS, OPEN)).astype(np.int8)
        chosen = goes | is_open[key_of]
        return [rows.append_column("state", pa.array(state)).filter(pa.array(chosen))], rest

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if rows.num_rows:
            done, held = settled(rows, False)
            for table in done:
                yield from table.combine_chunks().to_batches()
    if held is not None and held.num_rows:
        for table in settled(held, True)[0]:
            yield from table.combine_chunks().to_batches()


def keep_bitmaps(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: int = LETTERS, documents: int = DOCUMENTS) -> DataFrame:
    """known (is there an identifier?), id, mark (a digest of the text), n_dropped and keep, for the documents that lose lines.

    keep is a zlib-compressed bitmap with a bit a line, the first line's the highest of the first byte, set where it stays.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.unhex(F.md5(body.cast("binary"))).alias("mark"), body.alias("body"))
    by_key = settle(rows.mapInArrow(lambda batches: keyed(batches, letters), KEYED), "keys")
    order = [F.col("digest"), F.col("known").desc(), F.col("id").desc()]
    dealt = by_key.repartitionByRange(*order).sortWithinPartitions(*order)
    decided = settle(dealt.mapInArrow(lambda batches: decide(batches, documents), T.StructType([*KEYED.fields, T.StructField("state", T.ByteType())])), "decided")
    told = decided.where(F.col("state") == TELLS).groupBy("digest").agg(F.count_distinct("known", "id").alias("n"), F.max(F.struct("known", "id")).alias("largest"))
    # keys left open are two a task, and one for every HOLD rows of them: few enough to be sent to where their rows are
    open_rows = decided.where(F.col("state") != GOES).join(F.broadcast(told.where(F.col("n") >= documents)), "digest").where(F.struct("known", "id") != F.col("largest"))
    names = ["known", "id", "mark", "n_lines", "places"]
    gone = decided.where(F.col("state") == GOES).select(*names).unionByName(open_rows.select(*names))
    # a set, so that rows repeated with identifier and text do not add up; no longer than the text has lines
    lost = gone.groupBy("known", "id", "mark", "n_lines").agg(F.array_sort(F.flatten(F.collect_set("places"))).alias("places"))

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for n, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                stays = np.ones(n, bool)
                stays[places] = False
                found.append(zlib.compress(np.packbits(stays).tobytes()))
            sizes = pa.array([len(p) for p in batch.column(4).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), sizes, pa.array(found, pa.binary())], ["known", "id", "mark", "n_dropped", "keep"])

    return lost.mapInArrow(bits, "known boolean, id long, mark binary, n_dropped long, keep binary")


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, key: str, text: str, names: list[str]) -> DataFrame:
    """docs with n_dropped and keep of their bitmaps, null for those that lose nothing, under these names."""
    known, doc, mark = unused(docs, "known", "id", "mark")
    right = bitmaps.select(F.col("known").alias(known), F.col("id").alias(doc), F.col("mark").alias(mark), F.col("n_dropped").alias(names[0]), F.col("keep").alias(names[1]))
    this = F.col(key).cast("long")
    same = (this.isNotNull() == F.col(known)) & (F.coalesce(this, F.lit(0)) == F.col(doc)) & (F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))) == F.col(mark))
    return docs.join(right, same, "left").drop(known, doc, mark)


def kept_text(text: str | None, keep: bytes | None) -> str:
    """The lines that a bitmap keeps, joined by line feeds."""
    if keep is None:
        return text or ""
    lines = (text or "").split("\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=len(lines))
    return "\n".join(line for line, s in zip(lines, stays.tolist(), strict=True) if s)


def drop_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", letters: int = LETTERS, documents: int = DOCUMENTS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs without the shared lines, all columns kept; null stays null where nothing goes.

    `counts` names two more columns: the lines of the text before, and those dropped.
    """
    bitmaps = settle(keep_bitmaps(docs, key=key, text=text, letters=letters, documents=documents), "bitmaps")
    dropped, keep, out = unused(docs, "dropped", "keep", "out")
    joined = with_bitmaps(docs, bitmaps, key, text, [dropped, keep])

    @F.pandas_udf("string")
    def apply(texts, keeps):
        return pd.Series([kept_text(t, k) if isinstance(k, bytes) else None for t, k in zip(texts, keeps, strict=True)], dtype=object)

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    extra = [] if counts is None else [(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long").alias(counts[0]), F.coalesce(dropped, F.lit(0).cast("long")).alias(counts[1])]
    changed = F.when(F.col(keep).isNull(), F.col(text)).otherwise(apply(F.col(text), F.col(keep)))
    others = [F.col(c) if c != text else changed.alias(text) for c in docs.columns]
    return joined.select(*others, *extra)


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256 of every row."""
    left = drop_lines(docs.select(key, text), key=key, text=text, counts=("n_lines", "n_dropped"), **options)
    return left.select(key, "n_lines", "n_dropped", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as pos
  from documents
), keyed as (
  select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines
), shared as (
  select key, max(doc_id) as largest from keyed where length(key) >= 40 group by key having count(distinct doc_id) >= 5
), told as (
  select doc_id, line, pos, largest is not null and doc_id <> largest as goes from keyed left join shared using (key)
)
select doc_id, count(*) as n_lines, count(*) filter (goes) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not goes), '')) as kept_sha256
from told group by doc_id
"""
