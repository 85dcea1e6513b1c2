"""Operator 12: phrases whose words keep together, mined pass by pass with hashed buckets (PCY/DHP) and Apriori pruning.

Texts are cut into pieces at [.,;:!?] and line ends, pieces into words at spaces and tabs, A-Z lower-cased. Everything is
per language. Pass k counts the phrases of k words exactly, but only those that may be frequent:

* Apriori: both their parts of k - 1 words must be frequent;
* buckets: while pass k - 1 ran, every phrase of k words whose parts it counted was hashed into one of 2 ** BITS buckets.
  Counts stop at `least`, so a bucket is a byte or two; their sums over all tasks, kept segment by segment, leave one
  bit a bucket. A phrase in a bucket below `least` is not frequent.

Frequent phrases reach the tasks as such a bitmap as well. Both bitmaps are broadcast and have 2 ** BITS bits whatever the
corpus: 2 MB each. A phrase that passes them by collision is counted exactly like all others and found too rare, so
BITS decides how much is counted, never what is found. Within a batch phrases are told apart by the numbers of their words,
not by hashes.

A phrase's score is that of its weakest cut: with a occurrences of the phrase, l of the part before the cut, r of the rest
and n words, floor(1000 * a * n / (l * r)), in decimals. A phrase that a longer candidate contains nearly as often
(100 * longer >= percent * a) is dropped.

Null and empty texts have no words; a null language is "und". Repeated rows count each. An empty table gives no rows.
No key is read, so null and repeated keys do not matter.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import scans
from .common import LOWER, UPPER, grouped, kept, settle, small_batches

#: Occurrences of a candidate, words of the longest, phrases reported a language, per cent of a longer phrase's count.
LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Buckets are 2 ** BITS, dealt in segments of 2 ** SEGMENT.
BITS, SEGMENT = 24, 16
#: Bytes of text whose words are numbered together.
TOGETHER = 4 << 20

#: The byte between pieces: no UTF-8 text has it.
WALL = b"\xff"
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode() + BREAKS, LOWER.encode() + WALL * len(BREAKS))
STEP = np.uint64(0xD6E8FEB86659FD93)

#: A row is a phrase with its hash and count in a batch, or a segment's buckets with something in them.
PASS = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("phrase", T.StringType()),
    T.StructField("hash", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("segment", T.IntegerType()),
    T.StructField("cells", T.BinaryType()),
    T.StructField("counts", T.BinaryType()),
])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * STEP
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of some texts of one language: tokens, numbers (0 between pieces), and a hash for each word."""

    def __init__(self, lang: str, bodies: list[bytes]):
        self.tokens = WALL.join(bodies).translate(FOLD).replace(WALL, b" \xff ").split()
        known: defaultdict = defaultdict(count().__next__)
        known[WALL]
        self.ids = np.fromiter(map(known.__getitem__, self.tokens), np.int64, len(self.tokens))
        self.vocabulary = list(known)
        seed = xxhash.xxh3_64_intdigest(lang.encode())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        self.first = hashes[self.ids]

    def hashes(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, hash of the k words from each place on, does the place have k words in its piece?) for k = 1, 2, ..."""
        inside = self.ids > 0
        value, whole = mixed(self.first), inside
        yield 1, value, whole
        for k in range(2, longest + 1):
            n = max(0, len(self.ids) - k + 1)
            value = mixed(value[:n] * STEP + self.first[k - 1 :][:n])
            whole = whole[:n] & inside[k - 1 :][:n]
            yield k, value, whole

    def counted(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First places and counts of the distinct k-word phrases at these places, told apart by all their words."""
        size = len(self.vocabulary)
        code, span = self.ids[places], size
        for j in range(1, k):
            if span > (1 << 62) // size:
                _, code = np.unique(code, return_inverse=True)
                span = len(code)
            code, span = code * size + self.ids[places + j], span * size
        _, at, n = np.unique(code, return_index=True, return_counts=True)
        return places[at], n


class Buckets:
    """Counts of a task's hashes that stop at `least`."""

    def __init__(self, bits: int, least: int):
        self.shift = np.uint64(64 - bits)
        self.least = least
        self.counts = np.zeros(1 << bits, np.uint8 if least < 256 else np.uint16 if least < 65536 else np.uint32)

    def add(self, hashes: np.ndarray, n: np.ndarray | None = None) -> None:
        cells, more = np.unique(hashes >> self.shift, return_counts=True)
        more = more if n is None else n
        self.counts[cells] = np.minimum(self.counts[cells].astype(np.int64) + more, self.least)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """PASS rows of the segments that have something, with the places and counts of that."""
        size = min(len(self.counts), 1 << SEGMENT)
        for k in range(0, len(self.counts), size):
            part = self.counts[k : k + size]
            cells = np.flatnonzero(part)
            if len(cells):
                yield pass_rows(segments=[(k // size, cells.astype(np.uint16).tobytes(), part[cells].tobytes())])


def pass_rows(lang: str | None = None, phrases: list | None = None, hashes=(), counts=(), segments: list | None = None) -> pa.RecordBatch:
    phrases, segments = phrases or [], segments or []
    m, s = len(phrases), len(segments)
    blank = lambda t: pa.nulls(m, t)
    columns = [
        pa.array([lang] * m + [None] * s, pa.string()),
        pa.array(phrases + [None] * s, pa.binary()).cast(pa.string()),
        pa.concat_arrays([pa.array(np.asarray(hashes, np.uint64).view(np.int64)), pa.nulls(s, pa.int64())]),
        pa.concat_arrays([pa.array(np.asarray(counts, np.int64)), pa.nulls(s, pa.int64())]),
        pa.concat_arrays([blank(pa.int32()), pa.array([x[0] for x in segments], pa.int32())]),
        pa.concat_arrays([blank(pa.binary()), pa.array([x[1] for x in segments], pa.binary())]),
        pa.concat_arrays([blank(pa.binary()), pa.array([x[2] for x in segments], pa.binary())]),
    ]
    return pa.RecordBatch.from_arrays(columns, PASS.names)


def marked(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Which hashes have their bit set?"""
    cell = hashes >> np.uint64(64 - bits)
    return (bitmap[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0


def one_pass(docs: DataFrame, k: int, bitmaps: tuple, least: int, bits: int, more: bool) -> DataFrame:
    """PASS: phrases of k words that may be frequent with their counts, and buckets of phrases of k + 1 words if `more`.

    docs has lang and body; bitmaps are broadcasts of the frequent phrases of k - 1 words and of the buckets of k words,
    for k > 1.
    """

    def eligible(value: np.ndarray, whole: np.ndarray, frequent: np.ndarray | None) -> np.ndarray:
        """The k-word phrases that may be frequent, by the bits of their parts and of their bucket."""
        if frequent is None:
            return whole
        chosen = whole & frequent[: len(whole)] & frequent[1 : len(whole) + 1]
        places = np.flatnonzero(chosen)
        chosen[places] = marked(bitmaps[1].value, value[places], bits)
        return chosen

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        buckets = Buckets(bits, least) if more else None
        for batch in grouped(batches, TOGETHER):
            by_lang: defaultdict[str, list[bytes]] = defaultdict(list)
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang[lang].append(body)
            for lang, bodies in by_lang.items():
                words = Words(lang, bodies)
                frequent = chosen = None
                for j, value, whole in words.hashes(k + 1 if more else k):
                    if j == k - 1:
                        frequent = whole.copy()
                        places = np.flatnonzero(whole)
                        frequent[places] = marked(bitmaps[0].value, value[places], bits)
                    elif j == k:
                        chosen = eligible(value, whole, frequent)
                        at, n = words.counted(np.flatnonzero(chosen), k)
                        yield pass_rows(lang, [b" ".join(words.tokens[p : p + k]) for p in at.tolist()], value[at], n)
                    elif j == k + 1:
                        buckets.add(value[whole & chosen[: len(whole)] & chosen[1 : len(whole) + 1]])
        if buckets:
            yield from buckets.rows()

    return docs.mapInArrow(run, PASS)


def bitmap(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """A bit a bucket whose counts of all tasks reach `least`: 2 ** bits of them come to the driver, whatever the corpus."""
    size, kind = min(1 << bits, 1 << SEGMENT), Buckets(0, least).counts.dtype

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have = held.setdefault(segment, np.zeros(size, kind))
                at = np.frombuffer(cells, np.uint16)
                have[at] = np.minimum(have[at].astype(np.int64) + np.frombuffer(counts, kind), least)
        for segment, have in held.items():
            yield pa.RecordBatch.from_pylist([{"segment": segment, "bits": np.packbits(have >= least).tobytes()}], pa.schema([("segment", pa.int32()), ("bits", pa.binary())]))

    full = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    parts = rows.where("segment is not null").select("segment", "cells", "counts").repartition("segment").mapInArrow(run, "segment int, bits binary")
    for segment, packed in parts.collect():
        some = np.frombuffer(packed, np.uint8)
        full[segment * len(some) : (segment + 1) * len(some)] = some
    return full


def hash_bits(frequent: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the hashes of a table of phrases."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets(bits, least)
        for batch in batches:
            hashes = np.unique(batch.column(0).to_numpy().view(np.uint64))
            buckets.add(hashes, least)
        yield from buckets.rows()

    return bitmap(frequent.select("hash").mapInArrow(run, PASS), least, bits)


def frequencies(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n) of the phrases of up to `longest` words with `least` occurrences or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    small_batches(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), body.alias("body"))
    found, words, bitmaps = None, None, ()
    for k in range(1, longest + 1):
        done = settle(one_pass(rows, k, bitmaps, least, bits, k < longest), f"pass{k}")
        summed = done.where("segment is null").groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
        if k == 1:
            words = settle(done.where("segment is null").groupBy("lang").agg(F.sum("n").alias("n")), "words")
        frequent = settle(summed.where(F.col("n") >= least), f"frequent{k}")
        found = frequent.withColumn("k", F.lit(k)) if found is None else found.unionByName(frequent.withColumn("k", F.lit(k)))
        if k == longest or frequent.isEmpty():
            break
        arrays = hash_bits(frequent, least, bits), bitmap(done, least, bits)
        for old in bitmaps:
            old.unpersist()
        bitmaps = tuple(spark.sparkContext.broadcast(a) for a in arrays)
    return found.select("lang", "phrase", "k", "n"), words


def scores(found: DataFrame, words: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates that no longer one contains nearly as often."""
    several = found.where("k > 1").withColumnRenamed("n", "a").withColumn("w", F.split("phrase", " "))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    # written, so that the joins have an exchange on either side and a word that begins many phrases can be split
    cuts = several.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = settle(cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k")).alias("tail")), "cuts")
    known = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(known("head", "l"), ["lang", "head"]).join(known("tail", "r"), ["lang", "tail"]).join(words, "lang")
    wide = lambda name: F.col(name).cast("decimal(38,0)")
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(38,0)") * wide("a")).cast("decimal(38,0)") * wide("n")).withColumn("below", wide("l") * wide("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    weakest = cuts.groupBy("lang", "phrase").agg(F.min_by(F.struct("a", "l", "r", "n", "score"), F.struct("score", "cut")).alias("s")).select("lang", "phrase", "s.*")
    # the longer candidates' parts of two words or more
    start = F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("start")
    parts = several.where("k > 2").select("lang", "w", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")).select("lang", "w", "a", "size", start)
    inside = parts.select("lang", part(F.col("start"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    told = weakest.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    return told.drop("longer")


def collocations(docs: DataFrame, *, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, bits: int = BITS) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score."""
    found, words = frequencies(docs, lang=lang, text=text, least=least, longest=longest, bits=bits)
    scored = scores(found, words, percent=percent).withColumn("__score", -F.col("score")).withColumn("__a", -F.col("a"))
    # a language's candidates are numbered in ranges of the order, whatever part of all of them it has
    order = ["__score", "__a", "phrase"]
    ranked = scans.running_count(scans.deal(scored, ["lang"], order), "rank", ["lang"], order).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), words as (
  select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces
), grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase
  from words, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k
), f as (
  select lang, phrase, k, count(*) as a from grams group by all
), total as (
  select lang, sum(a) as n from f where k = 1 group by lang
), cand as (
  select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 100
), cuts as (
  select c.lang, c.phrase, c.a, cut, h.a as l, t.a as r, n, (1000::hugeint * c.a * n) // (h.a::hugeint * t.a) as score
  from (select *, unnest(range(1, k)) as cut from cand) c
  join f h on h.lang = c.lang and h.phrase = array_to_string(list_slice(c.w, 1, cut), ' ')
  join f t on t.lang = c.lang and t.phrase = array_to_string(list_slice(c.w, cut + 1, c.k), ' ')
  join total on total.lang = c.lang
), weakest as (
  select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), parts as (
  select lang, a, k, size, w, unnest(range(1, k - size + 2)) as i from (select *, unnest(range(2, k)) as size from cand)
), inside as (
  select lang, array_to_string(list_slice(w, i, i + size - 1), ' ') as phrase, max(a) as longer from parts group by all
), ranked as (
  select lang, phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from weakest left join inside using (lang, phrase) where longer is null or 100 * longer < 100 * a
)
select lang, rank, phrase, a, l, r, n::bigint as n, score::bigint as score from ranked where rank <= 2000
"""
