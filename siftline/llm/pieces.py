"""Operator 1: SentencePiece BPE encoding through a merge-type prefix table, and decoding.

For every prefix of a chunk the table keeps one number: the last token of the prefix's encoding. That token
is unique. It ends at the prefix's end, so an automaton over the vocabulary proposes the candidates; the right
one is the candidate whose pair with the last token of what stands before it is compatible, that is, whose two
tokens are what merging would make of their joined text. Walking back from the end over the last tokens
recovers the ids. One pass, whatever the order in which merging would have gone.

Texts are cut into chunks where no merge can cross (before a white-space mark that follows something else, and
around characters that no piece holds); the encodings of chunks are kept in a cache of bounded size.

Null text counts as empty: no ids, and an empty decoded text. Repeated rows are encoded each for itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Memo, kept, small_batches

SPACE = "▁"


class PrefixTable:
    """Encoder for the pieces of one SentencePiece BPE model."""

    def __init__(self, processor):
        import ahocorasick

        sp = processor
        self.sp = sp
        kinds = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not any(k(i) for k in kinds)}
        self.score = {p: sp.get_score(i) for p, i in pieces.items()}
        self.text = {i: p for p, i in pieces.items()}
        self.bytes = {b: sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)}
        self.unknown = sp.unk_id()
        self.fallback = sp.is_byte(self.bytes[0])
        self.pairs: dict[int, bool] = {}
        self.stories: dict[int, list[tuple[float, str, str]]] = {}
        self.cut = self.cuts(pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, i in pieces.items():  # a piece that merging never makes can be nobody's last token
            if len(piece) == 1 or [x for _, parts in self.steps(piece) for x in (len(parts),)][-1:] == [1]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()

    @staticmethod
    def cuts(pieces: Iterable[str]) -> re.Pattern:
        """Finds the chunks. Two neighbours can only meet in a merge if some piece holds them side by side."""
        side_by_side = {p[k : k + 2] for p in pieces for k in range(len(p) - 1)}
        known = {c for p in pieces for c in p}
        escaped = lambda chars: "".join(re.escape(c) for c in sorted(chars))
        lone = {chr(c) for c in range(128)} - known
        if any(pair[1] == SPACE != pair[0] for pair in side_by_side):  # merges may cross words
            return re.compile(f"[^{escaped(lone)}]+|[{escaped(lone)}]" if lone else "(?s:.+)")
        marks = {chr(c) for c in range(33, 127) if not chr(c).isalnum()} & known
        while joined := {m for m in marks if any(p[1] == m and p[0] not in marks and p[0] != SPACE for p in side_by_side)}:
            marks -= joined  # what is left never follows a letter or digit inside a piece
        m, plain = escaped(marks), f"[^{SPACE}{escaped(marks | lone)}]"
        led = f"|[{m}]+{plain}*" if marks else ""
        return re.compile(f"{SPACE}+{f'[{m}]*' if marks else ''}{plain}*|{plain}+{led}" + (f"|[{escaped(lone)}]" if lone else ""))

    def steps(self, text: str) -> Iterator[tuple[float, list[str]]]:
        """The definition: join the best-scored neighbours, leftmost first, until none form a piece."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            yield best, parts

    def story(self, token: int) -> list[tuple[float, str, str]]:
        """How merging makes the token: each merge's score, and the first and last part before it."""
        if token not in self.stories:
            text = self.text[token]
            ends, scores = [(text[0], text[-1])], []
            for score, parts in self.steps(text):
                scores.append(score)
                ends.append((parts[0], parts[-1]))
            self.stories[token] = [(s, *e) for s, e in zip([*scores, float("-inf")], ends, strict=True)]
        return self.stories[token]

    def compatible(self, left: int, right: int) -> bool:
        """Does merging turn the joined text of the two tokens into just these two?

        Both sides go through their own merges, better score first, until a merge across the border scores better.
        """
        a, b, i, j, score = self.story(left), self.story(right), 0, 0, self.score
        while True:
            (s, _, x), (t, y, _) = a[i], b[j]
            across = score.get(x + y)
            if across is not None and across > s and across >= t:
                return False
            if s >= t:
                if i + 1 == len(a):
                    return True
                i += 1
            else:
                j += 1

    def encode_chunk(self, chunk: str) -> list[int]:
        size = len(chunk)
        last = [-1] * (size + 1)  # by prefix length; -1: a character that no piece covers, or nothing
        width = [1] * (size + 1)
        pairs, done = self.pairs, -1
        for end, (token, n) in self.automaton.iter(chunk):
            if end == done:
                continue
            before = last[end + 1 - n]
            if before >= 0:
                key = before << 24 | token
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 250_000:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(before, token)
                if not fits:
                    continue
            done = end
            last[end + 1], width[end + 1] = token, n
        ids: list[int] = []
        while size:
            token = last[size]
            if token >= 0:
                ids.append(token)
            elif self.fallback:
                ids.extend(self.bytes[b] for b in reversed(chunk[size - 1].encode()))
            else:
                ids.append(self.unknown)
            size -= width[size]
        ids.reverse()
        return ids

    def chunks(self, text: str) -> list[str]:
        """The model's own normalisation, then cuts where no merge can cross."""
        return self.cut.findall(self.normalise(text))

    def normalise(self, text: str) -> str:
        return self.sp.normalize(text) if text else ""


class Codec:
    """Whole texts to ids and back, with the cache of chunks."""

    def __init__(self, model_file: str, cache: int = 250_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.table = PrefixTable(self.sp)
        self.memo = Memo(self.make, limit=cache)
        self.decimal = [str(i) for i in range(self.sp.get_piece_size())]

    def make(self, chunks: list[str]) -> list[tuple[int, ...]]:
        return [tuple(ids) for ids in map(self.table.encode_chunk, chunks)]

    def encode(self, text: str | None) -> tuple[list[int], str]:
        """ids, and the ids in decimal joined by commas."""
        ids = list(chain.from_iterable(self.memo.all(self.table.chunks(text)))) if text else []
        return ids, ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.sp.decode(ids) if ids else ""


def codec(model_file: str, cache: int = 250_000) -> Codec:
    """One codec in each Python worker, kept from task to task."""
    return kept(("codec", model_file, cache), lambda: Codec(model_file, cache))


def encode(docs: DataFrame, model_file: str, *, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text, and with the text decoded from them where a name is given for it.

    Columns of these names in docs are replaced. Null text: an empty array and an empty string.
    """
    keep = [f for f in docs.schema if f.name not in (ids, decoded)]
    extra = [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            rows = [c.encode(s)[0] for s in batch.column(text).to_pylist()]
            more = {ids: pa.array(rows, pa.list_(pa.int32()))}
            if decoded:
                more[decoded] = pa.array([c.decode(r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *more.values()], [*[f.name for f in keep], *more])

    small_batches(docs.sparkSession)
    return docs.select(*{*[f.name for f in keep], text}).mapInArrow(run, T.StructType([*keep, *extra]))


def digests(docs: DataFrame, model_file: str, *, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256 of the decoded text.

    The ids themselves stay in the tasks unless they are asked for, so the result is narrow however long the texts are.
    """
    schema = T.StructType([
        docs.schema[key],
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_file)
        for batch in batches:
            n, left, right, kept = [], [], [], []
            for value in batch.column(1):
                found, joined = c.encode(value.as_py())
                n.append(len(found))
                left.append(hashlib.sha256(joined.encode()).hexdigest())
                right.append(hashlib.sha256(c.decode(found).encode()).hexdigest())
                if ids:
                    kept.append(np.array(found, np.int32))
            more = [pa.array(kept, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string()), *more], schema.names)

    small_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, schema)
