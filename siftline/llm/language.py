"""Operator 9: language identification of mixed-language text.

Words are cut into units where the script changes, and those of a script after every LONGEST letters, so that text
written without spaces is read whole and can change its language inside; below, a word is such a unit.

The script of a word narrows down the languages it can be in; each candidate scores the word by its letter
sequences; Viterbi over the words, where a change of language costs a penalty, labels every word, so that a text
falls into spans. A document's language is the one with the most letters, its score their share.

The model is a naive Bayes classifier over letter n-grams hashed into SLOTS slots, learned from labelled documents.
fit() counts over a bounded sample of them (SAMPLE_DOCS a language, chosen by hash of the identifier), in Spark; what
comes to the driver is one count a slot and language, a bound that does not grow with the data.

Work goes by batches: Arrow splits the texts and numbers the distinct words, whose scores are made together. Where no
stretch of a text gains as much as the penalty by leaving its best language, Viterbi's path is that language
throughout, which one pass over running sums shows; the other texts take Viterbi's steps side by side.

Null text or text without a letter: "und", score 0. No labelled document at all: everything is "und".
Repeated rows are labelled alike. Words without letters carry no evidence and take their neighbours' language.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import grouped, kept, small_batches, unused

#: Labelled documents that the model learns from, a language, where there are more (fewer than twice as many are taken,
#: by a hash); slots of its n-grams; and languages at most, more being an error.
SAMPLE_DOCS, SLOTS, MOST_LANGS = 2000, 1 << 16, 500
#: The longest n-gram, the most letters of a unit, and what a change of language costs in nats.
GRAM, LONGEST, PENALTY = 3, 64, 6.0
#: The least that a word can say against a language.
FLOOR = -30.0
#: Bytes of text whose words are scored together; a worker takes some 70 bytes for each.
TOGETHER = 2 << 20
#: A language is a candidate for a word if at least this share of its letters is in the word's script.
SCRIPT_SHARE = 0.001

#: First and last code point of the blocks by which scripts are told apart.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
RANGES = sorted((lo, hi, name) for name, ranges in SCRIPTS.items() for lo, hi in ranges)
NAMES = [*SCRIPTS, "other"]
STARTS = np.array([x for lo, hi, _ in RANGES for x in (lo, hi + 1)])
#: Script numbers between the STARTS, outside the blocks the last.
BETWEEN = np.array([len(SCRIPTS), *[x for _, _, name in RANGES for x in (NAMES.index(name), len(SCRIPTS))]])
ONE, TWO, THREE = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


#: The script of every code point.
SCRIPT_OF = BETWEEN[np.searchsorted(STARTS, np.arange(0x110000), side="right")].astype(np.uint8)


def scripts(letters: np.ndarray) -> np.ndarray:
    """The number of each letter's script in NAMES."""
    return SCRIPT_OF[letters]


def cut(stems: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The units of all stems one after another, and how many each has; that of an empty stem is empty."""
    texts = stems.to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    letters = scripts(np.frombuffer("".join(texts).encode("utf-32-le"), "<u4"))
    runs = np.union1d(np.nonzero(letters[1:] != letters[:-1])[0] + 1, starts[sizes > 0])
    lengths = np.diff(np.append(runs, len(letters)))
    more = [np.arange(a + LONGEST, a + n, LONGEST) for a, n in zip(runs[lengths > LONGEST], lengths[lengths > LONGEST], strict=True)]
    cuts = np.sort(np.concatenate([runs, *more]))
    first = np.searchsorted(cuts, starts)
    count = np.searchsorted(cuts, ends) - first
    found, done = [], 0
    for k in np.nonzero(count > 1)[0].tolist():
        at = cuts[first[k] : first[k] + count[k]] - starts[k]
        found += texts[done:k]
        found += [texts[k][a:b] for a, b in pairwise([*at.tolist(), len(texts[k])])]
        done = k + 1
    return (pa.array(found + texts[done:], pa.large_string()) if done else stems), np.maximum(count, 1)


class Words:
    """The texts of a batch as numbers of distinct units, lower-cased and stripped to their letters.

    order has the units of all texts, bounds where each text's begin and end, place the word that each stands in.
    """

    def __init__(self, texts: pa.ChunkedArray):
        split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()).combine_chunks(), ""))
        numbered = split.flatten().dictionary_encode()
        stems = pc.utf8_lower(pc.replace_substring_regex(numbered.dictionary, r"[^\p{L}]+", "")).dictionary_encode()
        pieces, count = cut(stems.dictionary)
        units = pieces.dictionary_encode()
        self.sizes = pc.utf8_length(units.dictionary).to_numpy(zero_copy_only=False)
        stem = stems.indices.to_numpy(zero_copy_only=False)[numbered.indices.to_numpy(zero_copy_only=False)]
        times = count[stem]
        ends = np.cumsum(times)
        self.place = np.repeat(np.arange(len(stem)), times)
        at = np.arange(len(self.place)) + ((np.cumsum(count) - count)[stem] - (ends - times))[self.place]
        self.order = units.indices.to_numpy(zero_copy_only=False)[at]
        offsets = split.offsets.to_numpy()
        self.bounds = np.concatenate([[0], ends])[offsets - offsets[0]]
        self.codes = np.frombuffer(f" {' '.join(units.dictionary.to_pylist())} ".encode("utf-32-le"), "<u4").astype(np.uint64)
        self.count = len(units.dictionary)

    def grams(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(word, slot) of all n-grams of each length; bounds of words take part in those of two and three."""
        c, space = self.codes, self.codes == 32
        word = np.cumsum(space) - 1
        slot = lambda h: ((h ^ (h >> np.uint64(29))) * TWO >> np.uint64(48)).astype(np.int64) % SLOTS
        letters = np.nonzero(~space)[0]
        yield word[letters], slot(c[letters] * ONE)
        at = np.nonzero(~(space[:-1] & space[1:]))[0]
        yield word[at], slot((c[at] * ONE + c[at + 1]) * THREE + np.uint64(2))
        at = np.nonzero(~space[1:-1])[0]
        yield word[at], slot(((c[at] * ONE + c[at + 1]) * THREE + c[at + 2]) * ONE + np.uint64(3))

    def first_scripts(self) -> np.ndarray:
        """The script of each word's first letter."""
        starts = np.nonzero(self.codes[:-1] == 32)[0]
        return scripts(self.codes[starts + 1])


def held_out(doc_id: Column) -> Column:
    """Documents set aside for measuring: crc32 of the identifier in decimal leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, most_langs: int = MOST_LANGS) -> dict:
    """A model from the rows of labelled with text and a language.

    More than most_langs languages are an error that tells what their model would weigh: none is left out in silence.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    frequent = rows.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(most_langs + 1)
    sizes = {r[0]: r[1] for r in frequent.collect()}
    if len(sizes) > most_langs:
        raise ValueError(f"more than {most_langs} languages are labelled: raise most_langs, at {SLOTS * 4 >> 10} kB of every worker's memory a language")
    langs = sorted(sizes)
    if not langs:
        return {"langs": []}
    share = F.coalesce(*[F.when(F.col(lang) == name, F.lit(max(1, sizes[name] // sample_docs))) for name in langs])
    sample = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("learn")), share) == 0).select(lang, text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, TOGETHER):
            names = np.array(table.column(0).to_pylist(), object)
            words = Words(table.column(1))
            of_word = np.repeat(np.arange(len(names)), np.diff(words.bounds))
            grams = list(words.grams())
            scripts_of = np.where(words.sizes > 0, words.first_scripts(), len(NAMES))
            for name in dict.fromkeys(names.tolist()):
                times = np.bincount(words.order[(names == name)[of_word]], minlength=words.count).astype(float)
                counts = sum(np.bincount(slot, weights=times[word], minlength=SLOTS) for word, slot in grams)
                by_script = np.bincount(scripts_of, weights=times * words.sizes, minlength=len(NAMES) + 1)[: len(NAMES)]
                counts = np.concatenate([counts, by_script]).astype(np.int64)  # scripts come after the slots
                at = np.nonzero(counts)[0]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(counts[at])], ["name", "slot", "n"])

    small_batches(labelled.sparkSession)
    totals = sample.mapInArrow(run, "name string, slot long, n long").groupBy("name", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((SLOTS + len(NAMES), len(langs)))
    counts[totals["slot"].to_numpy(np.int64), [langs.index(x) for x in totals["name"]]] = totals["n"].to_numpy(float)
    grams, letters = counts[:SLOTS], counts[SLOTS:]
    weights = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * SLOTS))
    return {"langs": langs, "weights": weights.astype(np.float32), "scripts": (letters > 0) & (letters >= SCRIPT_SHARE * letters.sum(axis=0))}


class Labeller:
    """A fitted model at work in a Python worker."""

    def __init__(self, model: dict, penalty: float = PENALTY):
        self.langs, self.penalty = model["langs"], penalty
        self.weights, self.scripts = model.get("weights"), model.get("scripts")

    def score(self, words: Words) -> np.ndarray:
        """What each language gives for each distinct word, best 0. Overlapping n-grams repeat their evidence: it is
        brought down to that of about one n-gram a letter."""
        total = np.zeros((words.count, len(self.langs)))
        for word, slot in words.grams():
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(word, weights=self.weights[slot, k], minlength=words.count)[: words.count]
        total /= GRAM
        candidates = self.scripts[words.first_scripts()] if words.count else np.zeros(total.shape, bool)
        some = candidates.any(axis=1) & (words.sizes > 0)
        total = np.where(candidates, total, -np.inf)
        best = np.where(some, total.max(axis=1), 0.0)
        return np.where(some[:, None], np.maximum(total - best[:, None], FLOOR), 0.0).astype(np.float32)

    def label(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The language (a position in langs) of every word, and the sum of scores of each text."""
        scores = self.score(words)[words.order]
        texts, bounds = len(words.bounds) - 1, words.bounds
        of_word = np.repeat(np.arange(texts), np.diff(bounds))
        sums = np.stack([np.bincount(of_word, weights=scores[:, k], minlength=texts) for k in range(len(self.langs))], axis=1) if texts else np.zeros((0, len(self.langs)))
        best = sums.argmax(axis=1)
        path = best[of_word]
        for first, last in self.bundles(todo := self.leaving(scores, path, of_word, bounds), bounds):
            which = todo[first:last]
            for text, found in zip(which, self.viterbi([scores[bounds[i] : bounds[i + 1]] for i in which]), strict=True):
                path[bounds[text] : bounds[text + 1]] = found
        return path, sums

    def leaving(self, scores: np.ndarray, path: np.ndarray, of_word: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The texts, longest first, in which some stretch gains more than the penalty by leaving the best language."""
        if len(self.langs) < 2 or not len(path):
            return np.zeros(0, np.int64)
        own = scores[np.arange(len(path)), path]
        others = scores.copy()
        others[np.arange(len(path)), path] = -np.inf
        gain = (others.max(axis=1) - own).astype(float)
        # running sums, each text from 0 and far below the one before, so that the running least stays in the text
        total = np.cumsum(gain)
        before = np.concatenate([[0.0], total])[bounds[:-1]]
        far = 1e7
        inside = total - before[of_word]
        shifted = inside - far * of_word
        start = np.minimum.accumulate(np.minimum(np.concatenate([[np.inf], shifted[:-1]]), -far * of_word))
        most = np.zeros(len(bounds) - 1)
        np.maximum.at(most, of_word, shifted - start)
        todo = np.nonzero(most > self.penalty)[0]
        return todo[np.argsort(-np.diff(bounds)[todo], kind="stable")]

    @staticmethod
    def bundles(texts: np.ndarray, bounds: np.ndarray, cells: int = 2_000_000) -> Iterator[tuple[int, int]]:
        """Runs of texts (longest first) of at least half the longest's length, that take at most so many cells."""
        lengths = np.diff(bounds)[texts]
        first = 0
        while first < len(lengths):
            half = int(np.searchsorted(-lengths, -(lengths[first] // 2), side="right"))
            last = max(first + 1, min(half, first + cells // max(1, int(lengths[first]))))
            yield first, last
            first = last

    def viterbi(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """The best path of each text, longest first; a change of language costs the penalty."""
        lengths = np.array([len(s) for s in scores])
        texts, steps, langs = len(scores), int(lengths[0]), len(self.langs)
        grid = np.zeros((steps, texts, langs), np.float32)
        for i, s in enumerate(scores):
            grid[: len(s), i] = s
        came = np.zeros((steps, texts, langs), np.int16)
        active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # texts with a word at this step
        total = np.zeros((texts, langs), np.float32)
        own, rows = np.arange(langs, dtype=np.int16), np.arange(texts)
        for t in range(steps):
            n = active[t]
            now = total[:n]
            if t:
                best = now.argmax(axis=1)
                switched = now[rows[:n], best][:, None] - self.penalty
                stay = now >= switched
                came[t, :n] = np.where(stay, own, best[:, None])
                now = np.where(stay, now, switched)
            total[:n] = now + grid[t, :n]
        at = total.argmax(axis=1)
        path = np.zeros((steps, texts), np.int64)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            path[t, :n] = at[:n]
            if t:
                at[:n] = came[t, rows[:n], at[:n]]
        return [path[: lengths[i], i] for i in range(texts)]

    def spans(self, text: str | None) -> list[tuple[int, int, str]]:
        """(first word, end word, language) of each run in one language; a word that changes its language is in several."""
        words = Words(pa.chunked_array([pa.array([(text or "").strip()], pa.large_string())]))
        path, _ = self.label(words)
        cuts = [k for k in range(len(path)) if not k or path[k] != path[k - 1]]
        return [(int(words.place[a]), int(words.place[b - 1]) + 1, self.langs[path[a]]) for a, b in zip(cuts, [*cuts[1:], len(path)], strict=True)]

    def predict(self, texts: pa.ChunkedArray) -> tuple[list[str], list[float]]:
        """The language with the most letters on each text's path, and its share of the letters times the probability
        that it has against the other languages over the whole text."""
        return self.told(texts)[:2]

    def told(self, texts: pa.ChunkedArray) -> tuple[list[str], list[float], list[float]]:
        """predict(), and the share of each text's letters that are in a script of some learned language."""
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        words = Words(texts)
        path, sums = self.label(words)
        of_word = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
        letters = np.zeros((len(texts), len(self.langs)))
        np.add.at(letters, (of_word, path), words.sizes[words.order])
        whole = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        sure = np.exp(sums - sums.max(axis=1, keepdims=True))
        score = np.where(whole > 0, letters.max(axis=1) / np.maximum(whole, 1) * (sure.max(axis=1) / sure.sum(axis=1)), 0.0)
        known = np.where(self.scripts.any(axis=1)[words.first_scripts()], words.sizes, 0)
        evidence = np.bincount(of_word, weights=known[words.order], minlength=len(texts)) / np.maximum(whole, 1)
        return [self.langs[k] if n else "und" for k, n in zip(best, whole, strict=True)], score.tolist(), evidence.tolist()


def predict(docs: DataFrame, model: dict, *, text: str = "text", lang_pred: str = "lang_pred", score: str = "score", evidence: str | None = None) -> DataFrame:
    """docs with the language of each text and its share of the letters, and on request the share of the letters that
    some learned language can have; columns of these names are replaced."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by SLOTS a language
    keep = [f for f in docs.schema if f.name not in (lang_pred, score, evidence)]
    more = [T.StructField(evidence, T.DoubleType())] if evidence else []
    schema = T.StructType([*keep, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType()), *more])
    columns = [f.name for f in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept()
        lab = Labeller(sent.value)
        for table in grouped(batches, TOGETHER):
            langs, scores, shares = lab.told(table.column(text))
            found = table.select(columns).append_column(lang_pred, pa.array(langs, pa.string())).append_column(score, pa.array(scores, pa.float64()))
            found = found.append_column(evidence, pa.array(shares, pa.float64())) if evidence else found
            yield from found.to_batches()

    small_batches(spark)
    return docs.select(*columns, *([] if text in columns else [text])).mapInArrow(run, schema)


def held_out_predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; the model learns from the documents that are not held out."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    model = fit(marked.where(~F.col("held_out")))
    slim = marked.select("doc_id", "held_out", "text")
    return predict(slim, model).select("doc_id", "held_out", "lang_pred", "score")


#: Documents whose score is below are rejected, and those of whose letters a smaller share is in scripts of learned languages.
LEAST_SCORE, LEAST_EVIDENCE = 0.2, 0.1


def accepted(docs: DataFrame, *, text: str = "text", lang: str = "lang", least_score: float = LEAST_SCORE, least_evidence: float = LEAST_EVIDENCE) -> DataFrame:
    """The rows of docs whose language can be told, all columns kept; the model learns from docs' own labels.

    A text in scripts of no learned language has no evidence, however few languages share the score out. Without any label no language can be told, and all documents with a letter are accepted.
    """
    model = fit(docs, text=text, lang=lang)
    if not model["langs"]:
        return docs.where(F.col(text).rlike(r"\p{L}"))
    pred, score, evidence = unused(docs, "lang_pred", "score", "evidence")
    found = predict(docs, model, text=text, lang_pred=pred, score=score, evidence=evidence)
    return found.where((F.col(pred) != "und") & (F.col(score) >= least_score) & (F.col(evidence) >= least_evidence)).select(*docs.columns)
