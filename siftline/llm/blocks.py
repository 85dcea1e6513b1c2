"""Operator 8: token ids in patched frame-of-reference blocks, written in document order and read back.

A file holds the documents of one range of identifiers in ascending order. Its ids are cut into blocks of BLOCK:
a block stores its least id, and each id's difference from it in as many bits as the PERCENTILE-th percentile of
the differences takes; ids that need more are exceptions, stored whole in a list of positions and values. An
index of block starts and a table of documents (identifier, ids) stand at the end, so that any document can be
read without the ones before it.

    "SIFTPFR1" | blocks | index: u64 a block | documents: i64 identifier, u8 null, u64 ids | footer: 5 x u64, "SIFTPFR1"
    block: u32 least | u16 ids | u8 width | u16 exceptions | packed bits, low bit first | u16 positions | u32 values

Null text counts as empty: the document is its end id alone. Null identifiers come first; rows with one
identifier follow each other ordered by a hash of their text. An empty table gives no file and an empty result.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, fresh_dir, grouped, kept, settle, small_batches
from .files import Commit, cleaning, store
from .order import ranges

MAGIC = b"SIFTPFR1"
BLOCK, PERCENTILE = 512, 90
#: Bytes of text in a file, about; and the id that ends a document.
FILE_BYTES, END_ID = 16 << 20, 1
HEAD = struct.Struct("<IHBH")
FOOT = struct.Struct("<QQQQQ")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordTokens:
    """Ids of whole texts by the tokenizers library, whose words are kept in a cache of bounded size.

    The tokenizer drops white space and never looks across it, so a text's ids are those of its words in a row. Plain
    Latin letters, and ASCII symbols after them, are known to be a unit each to the tokenizer, and go to the library's
    model at once; any other word takes the library's whole way.
    """

    LETTERS = "[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0134-\u0137\u0139-\u0148\u014a-\u017e]"
    SYMBOLS = r"[!-&(-/:-@\[-`{-~]"  # without the apostrophe, which begins units like 's
    WORD = f"^(?P<stem>{LETTERS}+)(?P<mark>{SYMBOLS}*)$"
    UNIT = re.compile(f"{LETTERS}+|{SYMBOLS}+")

    def __init__(self, file: str, cache: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.memo = Memo(self.make, limit=cache)
        self.letters = dict(enumerate(byte_letters()))
        self.short = self.takes_units()

    def takes_units(self) -> bool:
        """Does the short way give what the long way gives? Seen on words of all the characters that it is for."""
        letters = "".join(chr(c) for c in range(0x180) if re.fullmatch(self.LETTERS, chr(c)))
        symbols = "".join(chr(c) for c in range(0x80) if re.fullmatch(self.SYMBOLS, chr(c)))
        stems = [letters[k : k + n] for k in range(len(letters)) for n in (1, 3, 7)]
        marks = [symbols[k : k + n] for k in range(len(symbols)) for n in (1, 3)]
        pairs = zip(stems, marks * (len(stems) // len(marks) + 1), strict=False)
        return all(self.unit(s.lower()) + self.unit(m) == self.whole(s + m) for s, m in pairs)

    def whole(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def unit(self, word: str) -> bytes:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.letters)
        ids = [t.id for t in self.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def make(self, words: list[str]) -> list[bytes]:
        fits = self.UNIT.fullmatch if self.short else lambda _: None
        return [(self.unit(w) if fits(w) else self.whole(w)) if w else b"" for w in words]

    def ids(self, texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin; the last entry is their number.

        Arrow splits the texts into words and numbers the distinct ones; these are taken apart into stem and mark
        where they are plain, and each distinct part is looked up once.
        """
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()).combine_chunks(), ""))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary
        taken_apart = pc.extract_regex(distinct, self.WORD) if self.short else pa.nulls(len(distinct), pa.struct([("stem", pa.large_string()), ("mark", pa.large_string())]))
        stem = pc.if_else(pc.is_valid(taken_apart), pc.utf8_lower(pc.struct_field(taken_apart, "stem")), distinct)
        mark = pc.if_else(pc.is_valid(taken_apart), pc.struct_field(taken_apart, "mark"), "")
        parts = pa.concat_arrays([stem, mark.cast(pa.large_string())]).dictionary_encode()
        found = self.memo.all(parts.dictionary.to_pylist())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        of_word = parts.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T  # stem and mark of each distinct word
        order = of_word[numbered.indices.to_numpy(zero_copy_only=False)].ravel()
        taken = sizes[order]
        ends = np.concatenate([[0], np.cumsum(taken)])
        ids = pool[np.arange(ends[-1]) + np.repeat(starts[order] - ends[:-1], taken)]
        offsets = words.offsets.to_numpy()
        return ids, ends[2 * (offsets - offsets[0])]


def tokens(file: str) -> WordTokens:
    """One in each Python worker, kept from task to task."""
    return kept(("tokens", file), lambda: WordTokens(file))


def pack(ids: np.ndarray, percentile: int = PERCENTILE) -> list[bytes]:
    """Blocks of the rows of ids, all of one length."""
    count, size = ids.shape
    least = ids.min(axis=1)
    over = (ids - least[:, None]).astype(np.uint32)
    at = min(size - 1, size * percentile // 100)
    typical = np.partition(over, at, axis=1)[:, at]
    widths = np.ceil(np.log2(typical.astype(np.float64) + 1)).astype(int)
    found: list[bytes] = [b""] * count
    for width in np.unique(widths):
        rows = np.nonzero(widths == width)[0]
        part = over[rows]
        beyond = (part >> np.uint32(width)) > 0 if width < 32 else np.zeros(part.shape, bool)
        low = np.where(beyond, 0, part)
        if width:
            bits = ((low[:, :, None] >> np.arange(width, dtype=np.uint32)) & 1).astype(np.uint8).reshape(len(rows), -1)
            packed = np.packbits(bits, axis=1, bitorder="little")
        else:
            packed = np.zeros((len(rows), 0), np.uint8)
        for k, row in enumerate(rows):
            where = np.nonzero(beyond[k])[0]
            head = HEAD.pack(int(least[row]), size, int(width), len(where))
            found[row] = head + packed[k].tobytes() + where.astype("<u2").tobytes() + ids[row][where].astype("<u4").tobytes()
    return found


def unpack(data: bytes, starts: Iterable[int]) -> Iterator[np.ndarray]:
    """The ids of each block that starts at these places of data."""
    for at in starts:
        least, size, width, exceptions = HEAD.unpack_from(data, at)
        at += HEAD.size
        n = (size * width + 7) // 8
        if width:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, n, at), count=size * width, bitorder="little").reshape(size, width)
            whole = np.zeros((size, 32), np.uint8)
            whole[:, :width] = bits
            ids = np.packbits(whole, axis=1, bitorder="little").view("<u4").ravel() + np.uint32(least)
        else:
            ids = np.full(size, least, np.uint32)
        at += n
        if exceptions:
            where = np.frombuffer(data, "<u2", exceptions, at)
            ids = ids.copy()
            ids[where] = np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions)
        yield ids


class FileWriter:
    """One file of blocks, in the order the documents come."""

    def __init__(self, path: str, block: int = BLOCK):
        self.file, self.block = Commit(path), block
        self.file.write(MAGIC)
        self.waiting: list[bytes] = []
        self.n_waiting = 0
        self.index: list[int] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= 256 * self.block:
            self.flush()

    def flush(self, last: bool = False) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        full = len(ids) // self.block * self.block
        for k in range(0, full, 256 * self.block):
            self.put(pack(ids[k : min(full, k + 256 * self.block)].reshape(-1, self.block)))
        rest = ids[full:]
        if last and len(rest):
            self.put(pack(rest.reshape(1, -1)))
            rest = rest[:0]
        self.waiting, self.n_waiting = [rest.tobytes()], len(rest)

    def put(self, blocks: list[bytes]) -> None:
        for b in blocks:
            self.index.append(self.file.size)
            self.file.write(b)

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the finished file."""
        self.flush(last=True)
        at = self.file.size
        self.file.write(np.array(self.index, "<u8").tobytes())
        docs_at = self.file.size
        docs = np.array(self.docs, [("id", "<i8"), ("null", "u1"), ("n", "<u8")])
        self.file.write(docs.tobytes())
        n = int(docs["n"].sum())
        self.file.write(FOOT.pack(at, len(self.index), docs_at, len(docs), n) + MAGIC)
        return len(docs), n, self.file.commit()


def read_file(path: str, blocks_at_once: int = 512) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(identifier, place of the first id in the file, ids) of each document, a few blocks in memory at a time."""
    fs, inner = store(path)
    with fs.open_input_file(inner) as f:
        size = f.size()
        f.seek(size - FOOT.size - len(MAGIC))
        tail = f.read()
        if tail[FOOT.size :] != MAGIC:
            raise ValueError(f"{path} is not a whole file of blocks")
        index_at, n_blocks, docs_at, n_docs, _ = FOOT.unpack(tail[: FOOT.size])
        f.seek(index_at)
        index = np.frombuffer(f.read(8 * n_blocks), "<u8").astype(np.int64)
        f.seek(docs_at)
        docs = np.frombuffer(f.read(17 * n_docs), [("id", "<i8"), ("null", "u1"), ("n", "<u8")])

        def blocks() -> Iterator[np.ndarray]:
            for k in range(0, n_blocks, blocks_at_once):
                part = index[k : k + blocks_at_once]
                end = index[k + blocks_at_once] if k + blocks_at_once < n_blocks else index_at
                f.seek(int(part[0]))
                yield np.concatenate(list(unpack(f.read(int(end - part[0])), (part - part[0]).tolist())))

        source, have, at = blocks(), np.zeros(0, np.uint32), 0
        for doc in docs:
            n = int(doc["n"])
            pieces, missing = [], n
            while missing:
                if not len(have):
                    have = next(source)
                pieces.append(have[:missing])
                missing -= len(pieces[-1])
                have = have[len(pieces[-1]) :]
            yield (None if doc["null"] else int(doc["id"])), at, np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
            at += n


def write(docs: DataFrame, tokenizer_file: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes the files and returns the manifest: shard, path, n_docs, n_tokens and bytes of each, in order.

    The manifest is also written to the folder, last, so that a folder with one is whole.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sized = settle(docs.select(F.col(key).cast("long").alias("k"), (F.coalesce(F.octet_length(text), F.lit(0)) + 64).cast("long").alias("w")), "sizes")
    parts = ranges(sized, "k", "w", file_bytes)
    if not len(parts):
        return []
    rows = docs.select(parts.of(F.col(key)).alias("shard"), F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    ordered = rows.repartitionById(len(parts), F.col("shard")).sortWithinPartitions("shard", F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def run(batches: Iterable[pa.RecordBatch], opened: list[Commit]) -> Iterator[pa.RecordBatch]:
        words, writer, current, path = tokens(tokenizer_file), None, None, ""
        end = np.array([end_id], "<u4").tobytes()

        def done() -> pa.RecordBatch:
            n_docs, n, size = writer.close()
            return pa.RecordBatch.from_pylist([{"shard": current, "path": path, "n_docs": n_docs, "n_tokens": n, "bytes": size}], schema)

        for batch in grouped(batches):
            ids, begins = words.ids(batch.column(2))
            for shard, k, (a, b) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), pairwise(begins), strict=True):
                if shard != current:
                    if writer:
                        yield done()
                    current, path = shard, f"{folder}/ids-{shard:06d}.pfr"
                    writer = FileWriter(path)
                    opened[:] = [writer.file]
                writer.add(k, ids[a:b].tobytes() + end)
        if writer:
            yield done()

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("bytes", pa.int64())])
    manifest = ordered.mapInArrow(cleaning(run), "shard int, path string, n_docs long, n_tokens long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return [r.asDict() for r in spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    starts = np.cumsum([0, *[m["n_tokens"] for m in manifest]]).tolist()
    files = spark.createDataFrame([(m["path"], s) for m, s in zip(manifest, starts, strict=False)], "path string, start long")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, at, ids in read_file(path):
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield batched(rows)
                        rows = []
                yield batched(rows)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names)

    return files.repartition(max(1, len(manifest))).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def round_trip(docs: DataFrame, tokenizer_file: str, **options) -> DataFrame:
    """Writes the ids of docs into a fresh folder and reads them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, tokenizer_file, fresh_dir(spark, "ids"), **options))
