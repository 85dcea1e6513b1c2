"""Periodic runs, phrases and shared lines, against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SCHEMA, row

from siftline.llm import lines, periods, phrases
from siftline.llm.common import table
from siftline.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=periods.LEAST, times=periods.TIMES):
    found = {}
    for q in range(1, len(words) // times + 1):
        at = 0
        for same, group in itertools.groupby(a == b for a, b in zip(words, words[q:], strict=False)):
            size = len(list(group))
            if same and size + q >= max(least, times * q):
                found.setdefault((at, size + q), q)
            at += size
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(r, most=60):
    letters = r.randint(1, 3)
    words = [r.randrange(letters) for _ in range(r.randint(0, most))]
    if words and r.random() < 0.6:
        block = [r.randrange(letters) for _ in range(r.randint(1, 9))]
        at = r.randrange(len(words))
        words[at:at] = [block[k % len(block)] for k in range(r.randint(0, most))]
    return np.array(words, np.int32)


@pytest.mark.parametrize("least,times", [(6, 4), (2, 2), (5, 3)])
def test_scan_equals_brute_force(least, times):
    r = random.Random(least)
    for k in range(700):
        texts = [repetitive(r) for _ in range(r.randint(1, 6))]
        cuts = [(1, None)] if k % 2 else [(1, 1), (2, 4), (5, 9), (10, None)]
        got = [[] for _ in texts]
        for low, high in cuts:
            for runs, more in zip(got, periods.scan(texts, low, high, least, times), strict=True):
                runs += more
        assert [sorted(g, key=lambda x: (x[0], x[2])) for g in got] == [all_runs(t.tolist(), least, times) for t in texts]


def test_long_text_of_one_word_is_one_run():
    assert periods.scan([np.zeros(100_000, np.int32)])[0] == [(0, 100_000, 1)]


@pytest.mark.parametrize("split", [periods.SPLIT, 300])
def test_periods_of_tables(spark, messy, sf_dir, split):
    extra = spark.createDataFrame([row(100 + k, " ".join(map(str, repetitive(random.Random(k), 400)))) for k in range(60)] + [row(200, "a b c " * 9), row(201, "x " * 3000)], SCHEMA)
    for docs in (messy.unionByName(extra), table(spark, sf_dir, "documents")):
        got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periods.annotate(docs, split=split).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            words = WORD.findall(r.text or "")
            runs = all_runs(words) if len(words) < 4000 or len(set(words)) == 1 else periods.scan(periods.numbered([r.text.encode()])[1])[0]
            want[r.doc_id, len(words), tuple(runs), collapsed(words, runs)] += 1
        assert got == want


def test_periods_query(spark, sf_dir):
    got = {tuple(r) for r in QUERIES["op11_periods"](spark, sf_dir).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    want, planted = set(), 0
    for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect():
        words = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = all_runs(words)
        planted += bool(runs)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.add((r.doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(words, runs))))
    assert got == want and planted > 5


def test_periods_of_nothing(empty):
    assert periods.annotate(empty).count() == 0 and periods.summary(periods.annotate(empty)).count() == 0
    with pytest.raises(ValueError):
        periods.annotate(empty, times=1)


def mined(rows, least, longest, top, percent=100):
    counts, total, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        cands = {g: n for g, n in f.items() if len(g) > 1 and n >= least}
        held = Counter()
        for g, n in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    held[g[i : i + k]] = max(held[g[i : i + k]], n)
        found = []
        for g, a in cands.items():
            if held[g] and 100 * held[g] >= percent * a:
                continue
            score, _, left, right = min((1000 * a * total[lang] // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), a, left, right, score))
        for rank, (_, _, phrase, a, left, right, score) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, total[lang], score))
    return sorted(out)


@pytest.mark.parametrize("bits,least,longest", [(24, 5, 5), (7, 5, 4), (18, 300, 2), (3, 2, 3)])
def test_phrases_equal_brute_force(spark, messy, sf_dir, bits, least, longest):
    odd = spark.createDataFrame([row(k, "A b, a b; A b\ta b? é É a b.\r c c c c c c c c\x1cd", lang) for k, lang in enumerate(["und", None, "x", "x"])], SCHEMA)
    docs = messy.where("length(text) < 50000 or text is null").unionByName(odd).select("lang", "text").union(table(spark, sf_dir, "documents").where("doc_id < 60").select("lang", "text"))
    got = sorted(tuple(r) for r in phrases.collocations(docs, least=least, longest=longest, top=40, bits=bits).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == mined([tuple(r) for r in docs.collect()], least, longest, 40)
    assert any(r[0] == "und" for r in got) or least > 5


def test_phrases_prune_and_are_exact_beyond_64_bits(spark, empty):
    assert phrases.collocations(empty).count() == 0
    huge = 3_000_000_000_000
    found = spark.createDataFrame([("x", "a", 1, huge), ("x", "b", 1, huge + 7), ("x", "a b", 2, huge - 5)], "lang string, phrase string, k int, n long")
    words = spark.createDataFrame([("x", 9 * huge)], "lang string, n long")
    (r,) = phrases.scores(found, words).collect()
    assert r.score == 1000 * (huge - 5) * 9 * huge // (huge * (huge + 7)) == 8999
    buckets = phrases.Buckets(8, 100)
    buckets.add(np.array([1 << 56] * 70, np.uint64))
    buckets.add(np.array([1 << 56] * 250 + [2 << 56], np.uint64))
    assert buckets.counts[1] == 100 and buckets.counts[2] == 1 and buckets.counts.sum() == 101


def without_shared(rows, letters=40, documents=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    rank = lambda d: (d is not None, d or 0)
    out = Counter()
    for doc, text in rows:
        split = (text or "").split("\n")
        stay = [x for x in split if len(key(x)) < letters or len(holders[key(x)]) < documents or doc == max(holders[key(x)], key=rank)]
        out[doc, len(split), len(split) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()] += 1
    return out


def shared_lines(spark, n=400):
    r = random.Random(8)
    pool = ["  Shared line %d, which is long enough to be one of the keys" % k for k in range(30)] + ["short", "", "É" * 40, "é" * 40, "x" * 39, " " * 50]
    rows = []
    for k in range(n):
        picked = [r.choice(pool[: r.choice((3, 8, 36))]) for _ in range(r.randint(0, 12))]
        picked = [x.upper() if r.random() < 0.3 else x + r.choice(("", " ", "\t\r", " ")) for x in picked]
        rows.append(row(r.choice((k, k, k, k // 7, None)), "\n".join(picked)))
    return spark.createDataFrame(rows + rows[:5] + [row(9999, pool[0] + "\n" + pool[0]), row(-9, pool[1])], SCHEMA)


def test_shared_lines(spark, messy, sf_dir):
    for docs in (messy, shared_lines(spark), table(spark, sf_dir, "documents")):
        got = Counter(tuple(r) for r in lines.report(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
        assert got == without_shared([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_stream_holds_little_and_decides_the_same():
    r = random.Random(3)
    for hold in (1, 4, 20_000):
        rows = sorted(((bytes([r.randrange(4)]) * 16, True, r.randrange(12), b"m%d" % r.randrange(3), 9, [1]) for _ in range(300)), key=lambda x: (x[0], -x[2]))
        names = lines.KEYED.names
        types = [pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int32())]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 7], strict=True), types, strict=True)], names) for k in range(0, 300, 7)]
        old, lines.HOLD = lines.HOLD, hold
        out = [x for b in lines.decide(iter(batches), 5) for x in b.to_pylist()]
        lines.HOLD = old
        docs, gone = defaultdict(set), Counter((x["digest"], x["id"]) for x in out if x["state"] == lines.GOES)
        for x in out:
            if x["state"] == lines.TELLS:
                docs[x["digest"]].add(x["id"])
        for x in out:
            if x["state"] != lines.GOES and len(docs[x["digest"]]) >= 5 and x["id"] != max(docs[x["digest"]]):
                gone[x["digest"], x["id"]] += 1
        want = Counter()
        for d in {x[0] for x in rows}:
            ids = {x[2] for x in rows if x[0] == d}
            want.update((x[0], x[2]) for x in rows if x[0] == d and len(ids) >= 5 and x[2] != max(ids))
        assert gone == want


def test_lines_keep_columns_and_bitmaps(spark, empty):
    docs = shared_lines(spark, 60)
    left = lines.drop_lines(docs)
    assert left.columns == docs.columns and left.count() == docs.count()
    for r in lines.keep_bitmaps(docs).collect():
        assert np.unpackbits(np.frombuffer(zlib.decompress(r.keep), np.uint8)).sum() >= 0 and r.n_dropped > 0
    assert lines.report(empty).count() == 0 and lines.drop_lines(empty).count() == 0
