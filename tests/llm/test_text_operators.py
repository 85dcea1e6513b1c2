"""Encoding, token blocks, quality rules and language, against the libraries and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from siftline.llm import blocks, language, pieces, rules
from siftline.llm.common import Memo
from siftline.llm.queries import QUERIES, tokenizer

ODD = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "日本語", "▁", "\x00", "😀", "the", "ing", "aaaa", "==", "́", "0", "12", ".", "Q", "\t", "한국", "'s", "Σ", "İ", "\x1c", "\x85"]


def odd_texts(n, most=25):
    r = random.Random(5)
    return ["".join(r.choices(ODD, k=r.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(tokenizer("piece_bpe_32k.model"))


def test_pieces_equal_the_library(codec):
    for text in [*odd_texts(3000), "a" * 20_000, " " * 20_001, "ab" * 9_000, "=" * 7_001]:
        assert codec.encode(text)[0] == codec.sp.encode(text)


def test_pieces_query(spark, messy, sf_dir, codec):
    for docs in (messy, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(docs, tokenizer("piece_bpe_32k.model")).collect()}
        want = set()
        for r in docs.select("doc_id", "text").collect():
            ids = codec.sp.encode(r.text or "")
            want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((codec.sp.decode(ids) if ids else "").encode()).hexdigest()))
        assert got == want


def test_pieces_encode_keeps_columns(messy, empty, codec):
    out = pieces.encode(messy, tokenizer("piece_bpe_32k.model"), ids="size", decoded="back")
    assert set(out.columns) == {*messy.columns, "back"}
    for r in out.collect():
        assert r.size == codec.sp.encode(r.text or "")
    assert pieces.digests(empty, tokenizer("piece_bpe_32k.model")).count() == 0


def test_memo_is_bounded_and_right():
    memo = Memo(lambda words: [w * 2 for w in words], limit=10, longest=5)
    r = random.Random(1)
    for _ in range(300):
        words = ["".join(r.choices("abc", k=r.randint(0, 8))) for _ in range(r.randint(0, 8))]
        assert memo.all(words) == [w * 2 for w in words]
        assert len(memo.known) <= 18 and len(memo.old) <= 18


def test_word_tokens_equal_the_library():
    words = blocks.WordTokens(tokenizer("word_bpe_49k.json"))
    assert words.short
    texts = [*odd_texts(3000), None, "", "It's  can't’d  ÉCOLE,### ÀÉ. x,, a.b " * 50]
    ids, begins = words.ids(pa.chunked_array([pa.array(texts, pa.string())]))
    for k, text in enumerate(texts):
        assert ids[begins[k] : begins[k + 1]].tolist() == (words.tokenizer.encode(text, add_special_tokens=False).ids if text else [])


def test_blocks_round_trip():
    r = np.random.default_rng(2)
    for high, size in ((1, 512), (2, 7), (300, 512), (1 << 32, 512), (50_000, 1)):
        ids = r.integers(0, high, (5, size), dtype=np.uint64).astype("<u4")
        ids[0, : size // 9] = np.uint32(min(high, 4_000_000_000) - 1)
        data = blocks.pack(ids)
        joined = b"".join(data)
        starts = np.cumsum([0, *map(len, data[:-1])]).tolist()
        assert np.array_equal(np.stack(list(blocks.unpack(joined, starts))), ids)


def test_block_files_of_messy_documents(messy, empty):
    t = blocks.WordTokens(tokenizer("word_bpe_49k.json")).tokenizer
    got = blocks.round_trip(messy, tokenizer("word_bpe_49k.json"), file_bytes=50_000).collect()
    rows = messy.select("doc_id", "text").collect()
    ids = {(r.doc_id, r.text): [*t.encode(r.text or "", add_special_tokens=False).ids, 1] for r in rows}
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got if r.doc_id is not None) == sorted(
        (True, r.doc_id, len(ids[r.doc_id, r.text]), zlib.crc32(np.array(ids[r.doc_id, r.text], "<u4").tobytes())) for r in rows if r.doc_id is not None
    )
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in rows), key=lambda d: (d is not None, d or 0))
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    assert blocks.round_trip(empty, tokenizer("word_bpe_49k.json")).count() == 0


def base_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


@pytest.mark.parametrize("which", ["messy", "sf"])
def test_rules_base_figures(spark, messy, sf_dir, which):
    docs = messy if which == "messy" else spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rules.cascade(docs).collect())
    assert got == sorted((r.doc_id is None, r.doc_id or 0, *base_figures(r.text)) for r in docs.select("doc_id", "text").collect())


def test_cascade_verdict_is_that_of_all_rules(messy, empty):
    found = rules.cascade(messy).collect()
    want = {(r.doc_id, not any(rule(rules.Text(r.text)) for rule in rules.RULES.values())) for r in messy.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.kept) for r in found} == want
    assert all(not r.kept for r in found if r.base_failed)
    slim = rules.cascade(messy, base=False)
    assert slim.columns == ["doc_id", "n_words", "kept"] and {(r.doc_id, r.kept) for r in slim.collect()} == want
    assert rules.cascade(empty).count() == 0


def test_cascade_stops_at_the_first_rejection_and_orders_by_rejections_per_cost(messy):
    tried = []
    probes = {n: (lambda t, n=n: tried.append(n) or n == "b") for n in "abc"}
    assert rules.first_failure(rules.Text("x"), ["a", "b", "c"], probes) == "b" and tried == ["a", "b"]

    def slow(t):
        return sum(range(20_000)) < 0

    order = [n for n, _, _ in rules.estimate(messy, {"slow": slow, "all": lambda t: True})]
    assert order == ["all", "slow"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op9_language"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_messy_rows(messy, empty):
    found = {r.doc_id: r for r in language.held_out_predictions(messy).collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (6, 7, 8))
    assert {r.lang_pred for k, r in found.items() if k not in (6, 7, 8, None)} <= {"en", "de"}
    assert language.held_out_predictions(empty).count() == 0
    unlabelled = language.predict(messy, {"langs": []})
    assert {r.lang_pred for r in unlabelled.collect()} == {"und"}
    assert set(language.accepted(messy).columns) == set(messy.columns)


def plain_viterbi(scores, penalty):
    best, back = scores[0].copy(), []
    for s in scores[1:]:
        top = best.argmax()
        stay = best >= best[top] - penalty
        back.append(np.where(stay, np.arange(len(best)), top))
        best = np.where(stay, best, best[top] - penalty) + s
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1], best.max()


def test_viterbi_paths_are_best(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lab = language.Labeller(language.fit(docs))
    texts = [r.text for r in docs.limit(80).collect()]
    mixed = [*texts, *[f"{a} {b[:400]} {a[:300]}" for a, b in zip(texts[:30], texts[5:], strict=False)], "", "1 2 3"]
    words = language.Words(pa.chunked_array([pa.array([t.strip() for t in mixed], pa.large_string())]))
    path, _ = lab.label(words)
    scores = lab.score(words)[words.order].astype(float)
    worth = lambda s, p: sum(s[k, x] for k, x in enumerate(p)) - lab.penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
    for a, b in zip(words.bounds, words.bounds[1:], strict=False):
        if b > a:
            best, _ = plain_viterbi(scores[a:b], lab.penalty)
            assert worth(scores[a:b], path[a:b]) == pytest.approx(worth(scores[a:b], best), abs=1e-3)


def test_spans_of_mixed_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lab = language.Labeller(language.fit(docs))
    two = {r.lang: r.text for r in docs.where("n_chars between 900 and 1500").limit(300).collect()}
    spans = lab.spans(two["en"] + " " + two["es"])
    assert [s[2] for s in spans] == ["en", "es"]
    assert abs(spans[0][1] - len(two["en"].split())) <= 3


def unspaced(alphabet, seed, n):
    return "".join(random.Random(seed).choices(alphabet, k=n))


#: Letters of languages written without spaces; the last two share their script, each with letters of its own.
ALPHABETS = {"ja": "".join(map(chr, range(0x3042, 0x3090))), "th": "".join(map(chr, range(0xE01, 0xE2E))), "zh": "".join(map(chr, range(0x4E00, 0x4E60))), "yue": "".join(map(chr, range(0x4E40, 0x4EA0)))}


@pytest.fixture(scope="module")
def unspaced_labeller(spark):
    rows = [(k, unspaced(letters, k, 400), lang) for k in range(20) for lang, letters in ALPHABETS.items()]
    rows += [(k, " ".join(unspaced("abcdefghijklm", 9 * k + j, 6) for j in range(60)), "en") for k in range(20)]
    return language.Labeller(language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")))


def test_words_are_cut_into_units_that_lose_no_letter():
    texts = ["", "1 2", "a日本語b", "x" * 200 + " y", "日本" * 100 + "のテキスト" + "ก" * 64 + "z", "plain words, no cut"]
    words = language.Words(pa.chunked_array([pa.array(texts, pa.large_string())]))
    units = "".join(chr(c) for c in words.codes)[1:-1].split(" ")
    for k, text in enumerate(texts):
        own = words.order[words.bounds[k] : words.bounds[k + 1]]
        assert "".join(units[u] for u in own) == "".join(c for c in text.lower() if c.isalpha())
        assert words.sizes[own].sum() == sum(map(str.isalpha, text))
        assert all(len(units[u]) <= language.LONGEST and len(set(language.scripts(np.array([ord(c) for c in units[u]], np.int64)))) <= 1 for u in own)


def test_language_of_unspaced_text_counts_all_letters(unspaced_labeller):
    lab = unspaced_labeller
    a, b = unspaced(ALPHABETS["zh"], 101, 64), unspaced(ALPHABETS["yue"], 102, 50_000)
    thai, kana = unspaced(ALPHABETS["th"], 103, 900), unspaced(ALPHABETS["ja"], 104, 100)
    langs, scores = lab.predict(pa.chunked_array([pa.array([a + b, "a" + thai, kana + thai, thai], pa.large_string())]))
    assert langs == ["yue", "th", "th", "th"]
    assert scores[2] == pytest.approx(0.9, abs=0.01)
    assert [s[2] for s in lab.spans(a * 4 + b)] == ["zh", "yue"]
    assert lab.spans(kana + thai) == [(0, 1, "ja"), (0, 1, "th")]
    assert lab.spans("a " + kana)[-1][1:] == (2, "ja")


@pytest.mark.parametrize("langs", [2, 4, 8])
def test_texts_in_unlearned_scripts_are_rejected(spark, langs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null and lang is not null").select("doc_id", "text", "lang")
    names = sorted(r.lang for r in docs.select("lang").distinct().collect())
    few = docs.where(docs.lang.isin(names[:2])) if langs == 2 else docs
    few = few.collect() + [(10_000 + 10 * k + j, unspaced(chr(97 + k) * 3 + "xyz ", j, 400), f"more{k}") for k in range(langs - 4) for j in range(10)]
    strange = [(-1, "ภาษาไทยเป็นภาษาราชการ " * 20, None), (-2, "यह हिन्दी में लिखा है " * 20, None), (-3, "η ελληνική γλώσσα " * 20 + "ok", None)]
    kept = {r.doc_id for r in language.accepted(spark.createDataFrame([*few, *strange], "doc_id long, text string, lang string")).collect()}
    assert kept == {r[0] for r in few if re.search("[A-Za-z]", r[1])}


def plain_units(text):
    """Letters of each word, cut where the script changes and every LONGEST letters of a script."""
    found = []
    for word in (text or "").encode().split():
        stem = regex.sub(r"[^\p{L}]+", "", word.decode()).lower()
        runs = []
        for c in stem:
            script = int(language.SCRIPT_OF[ord(c)])
            if runs and runs[-1][0] == script and len(runs[-1][1]) < language.LONGEST:
                runs[-1][1].append(c)
            else:
                runs.append((script, [c]))
        found += ["".join(r) for _, r in runs] or [""]
    return found


def plain_prediction(model, text):
    """lang_pred and score by loops over letters, units and languages, with Viterbi's steps one by one."""
    mask, one, two, three = (1 << 64) - 1, int(language.ONE), int(language.TWO), int(language.THREE)
    slot = lambda h: (((h ^ (h >> 29)) * two & mask) >> 48) % language.SLOTS
    langs, units, table = model["langs"], plain_units(text), []
    for unit in units:
        c = [32, *map(ord, unit), 32]
        slots = [slot(x * one & mask) for x in c[1:-1]]
        slots += [slot(((a * one + b) * three + 2) & mask) for a, b in zip(c, c[1:], strict=False)] if unit else []
        slots += [slot((((a * one + b) * three + x) * one + 3) & mask) for a, b, x in zip(c, c[1:], c[2:], strict=False)] if unit else []
        fits = model["scripts"][language.SCRIPT_OF[c[1]]]
        sums = {k: float(sum(float(model["weights"][s, k]) for s in slots)) / language.GRAM for k in range(len(langs)) if fits[k]}
        best = max(sums.values(), default=0.0)
        table.append([max(sums[k] - best, language.FLOOR) if k in sums else language.FLOOR if sums else 0.0 for k in range(len(langs))] if unit else [0.0] * len(langs))
    if not any(units):
        return "und", 0.0
    total, came = table[0], []
    for row in table[1:]:
        top = max(range(len(langs)), key=lambda k: total[k])
        came.append([k if total[k] >= total[top] - language.PENALTY else top for k in range(len(langs))])
        total = [total[b] - language.PENALTY * (b != k) + x for k, (b, x) in enumerate(zip(came[-1], row, strict=True))]
    at = max(range(len(langs)), key=lambda k: total[k])
    letters = [0] * len(langs)
    for unit, back in zip(reversed(units), [*reversed(came), None], strict=True):
        letters[at] += len(unit)
        at = back[at] if back else at
    sums = np.sum(table, axis=0)
    best = int(np.argmax(letters))
    return langs[best], letters[best] / sum(letters) * float(1 / np.exp(sums - sums.max()).sum())


def test_language_equals_plain_loops(spark, messy, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    for rows in (docs, messy.where("length(text) < 20000 or text is null").select("doc_id", "text", "lang")):
        found = language.predict(rows, model).collect()
        assert found
        for r in found:
            lang, score = plain_prediction(model, r.text)
            assert r.lang_pred == lang and r.score == pytest.approx(score, abs=2e-3), r.doc_id


def test_too_many_languages_are_an_error(spark):
    rows = spark.createDataFrame([(k, "some text", f"l{k}") for k in range(4)], "doc_id long, text string, lang string")
    assert len(language.fit(rows, most_langs=4)["langs"]) == 4
    with pytest.raises(ValueError, match="more than 3 languages"):
        language.fit(rows, most_langs=3)
