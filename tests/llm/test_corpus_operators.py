"""Dedup, mixing, sharding, personal data, archives, near copies and the pipeline, against brute force."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, prose, row

from siftline.llm import exact, mixing, near, order, private, sharding, warc
from siftline.llm.common import table


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("which", ["messy", "sf"])
def test_exact_groups(spark, messy, sf_dir, which):
    docs = messy if which == "messy" else table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[fold(r.text)].append(r.doc_id)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
    want = Counter((r.doc_id, keep[fold(r.text)], len(groups[fold(r.text)]), r.doc_id == keep[fold(r.text)], hashlib.sha256(fold(r.text).encode()).hexdigest()) for r in rows)
    assert Counter(tuple(r) for r in exact.groups(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want


def test_exact_smallest_and_deduplicate(messy, empty):
    smallest = {r.keep_id for r in exact.groups(messy, largest=False).where("doc_id in (1, 2)").collect()}
    assert smallest == {1}
    kept = exact.deduplicate(messy)
    assert kept.columns == messy.columns
    texts = [fold(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({fold(r.text) for r in messy.collect()})
    assert exact.groups(empty).count() == 0 and exact.deduplicate(empty).count() == 0


def test_exact_uses_no_python(spark, sf_dir):
    plan = exact.groups(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def water_fill(sizes, weights):
    total, level, full = sum(sizes.values()), 0.0, set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / (sum(w for s, w in weights.items() if s not in full) or 1)
        more = {s for s in sizes if 3 * sizes[s] < level * weights[s]}
        if more <= full:
            return {s: min(3.0 * sizes[s], level * weights[s]) for s in sizes}
        full |= more


@pytest.mark.parametrize("which", ["messy", "sf"])
def test_mixing(spark, messy, which):
    docs = messy if which == "messy" else table(spark, "/root/testdata/sf0.01", "documents")
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    targets = water_fill(sizes, {s: 1 + k % 3 for k, s in enumerate(names)})
    found = mixing.copies(docs).collect()
    assert len(found) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in found:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size * (2 if which == "messy" else 1))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]
    again = Counter((r.doc_id, r.copies) for r in mixing.copies(docs.repartition(5)).collect())
    assert again == Counter((r.doc_id, r.copies) for r in found)


def test_mixing_is_unbiased_and_repeats_rows(spark, messy, empty):
    totals = Counter()
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    for seed in range(25):
        totals.update({r.doc_id: r.copies for r in mixing.copies(docs, seed=seed).collect()})
    rates = {r.doc_id: r.target / r.source_size for r in mixing.copies(docs).collect()}
    assert np.mean([totals[d] / 25 - rates[d] for d in rates]) == pytest.approx(0, abs=0.1)
    mixed = mixing.mix(messy)
    assert mixed.columns == messy.columns
    want = Counter()
    for r in mixing.copies(messy).collect():
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_duels_keep_the_mass(spark):
    import pandas as pd

    r = np.random.default_rng(3)
    units = pd.DataFrame({"source": "a", "doc_id": range(500), "size": r.integers(1, 900, 500), "rows": 1, "bucket": 0, "draw": r.random(500), "p": 0.37})
    done = mixing.duel(units, False)
    is_open = (done.p > 0) & (done.p < 1)
    assert is_open.sum() <= 1
    assert (done.p * done["size"]).sum() == pytest.approx(0.37 * units["size"].sum())


def greedy(sizes, capacity, shards):
    cuts, load, at = [], 0, 0
    for k, s in enumerate(sizes):
        if s > capacity:
            return None
        if load + s > capacity:
            cuts.append(k)
            load = 0
        load += s
    return cuts if len(cuts) < shards else None


@pytest.mark.parametrize("which", ["messy", "sf", "two"])
def test_sharding(spark, messy, sf_dir, which):
    docs = {"messy": messy, "sf": table(spark, sf_dir, "documents"), "two": spark.createDataFrame([row(1, "a"), row(2, "bb")], SCHEMA)}[which]
    found = sharding.assign(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    first = {t: (min if None not in ids else lambda _: None)([d for d in ids]) for t, ids in groups.items()}
    ordered = sorted(groups, key=lambda t: (first[t] is not None, first[t] or 0, hashlib.sha256(t.encode()).digest()))
    sizes = [len(groups[t]) * (len(t.encode()) + 1) for t in ordered]
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy(sizes, mid, 16) is not None else (mid + 1, high)
    cuts = greedy(sizes, low, 16)
    shard_of = {t: sum(k >= c for c in cuts) for k, t in enumerate(ordered)}
    assert Counter((r.doc_id, r.shard) for r in found) == Counter((r.doc_id, shard_of[r.text or ""]) for r in rows)
    by_shard = defaultdict(list)
    for r in found:
        assert 0 <= r.shard <= 15 and r.law == "bytes" and r.grown_shard is None
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_sharding_of_nothing(empty):
    assert sharding.assign(empty).count() == 0


def test_ranges_are_exact_however_keys_lie(spark):
    keys = [0, 1, 2, 3, 5, 1 << 60, -(1 << 60), 7, 7, 7, None]
    rows = spark.createDataFrame([(k, 10) for k in keys], "k long, w long")
    for most in (5, 10, 25, 1000):
        found = order.ranges(rows, "k", "w", most)
        assert sum(found.rows) == len(keys) and sum(found.weights) == 10 * len(keys)
        placed = rows.select("k", found.of(rows.k).alias("r")).collect()
        assert Counter(r.r for r in placed) == Counter({k: n for k, n in enumerate(found.rows) if n})
        in_order = sorted(placed, key=lambda r: (r.k is not None, r.k or 0))
        assert [r.r for r in in_order] == sorted(r.r for r in placed)
        for k, w in enumerate(found.weights):
            assert w <= most or len({r.k for r in placed if r.r == k}) == 1 or most < 10


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def sound(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, digits[::-1]))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS) for m in re.finditer(p, text or "") if sound(kind, m[0]))


TRICKY = [
    "a@b.c_d@e.f x@y a@b..c a@b.c._d@e.f", "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 99999999999999999999.1.1.1", "4111-1111 1111 1111 4111111111111112 4 1 1", "+1 (555) 010-9999. +12345678 +1-2-3-4-5-6-7-8-9-",
    "é😀 a.b@c.org 😀10.0.0.1é", "@" * 50 + "a@a.a" * 40, "1" * 5000, "a" * 30_000 + "@", "a." * 20_000, "1 " * 20_000, "a@b" + ".c" * 9000, "+1" + " " * 9000 + "2", "1.1." * 5000, "x@y.z" + "%@y.z" * 50, "+" * 2000 + "1 23456789",
]


def test_private_base_spans(spark, messy, sf_dir):
    tricky = spark.createDataFrame([row(k, t) for k, t in enumerate(TRICKY)], SCHEMA)
    for docs in (messy, tricky, table(spark, sf_dir, "documents")):
        got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in private.report(docs).collect())
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            spans = base_spans(r.text)
            n = Counter(s[3] for s in spans)
            want[r.doc_id, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()] += 1
        assert got == want


def test_private_terms_by_information(spark, empty):
    rows = [row(k, f"{prose(k, 30)} write to Quillfeather at q.f@mail.example.com today {prose(k + 99, 30)}") for k in range(6)]
    rows += [row(100 + k, f"{prose(k + 500, 60)} write at today") for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = {r.doc_id: r for r in private.find(docs).collect()}
    for k in range(6):
        text = rows[k][1]
        assert [text[t.start : t.end] for t in found[k].terms] == ["Quillfeather"]
    assert not any(found[100 + k].terms for k in range(60))
    clean = {r.doc_id: r.text for r in private.sanitise(docs).collect()}
    assert all("[TERM] at [EMAIL] today" in clean[k] for k in range(6)) and clean[100] == rows[6][1]
    assert private.sanitise(docs).columns == docs.columns
    assert private.report(empty).count() == 0 and private.sanitise(empty).count() == 0


def disclosed(rows):
    """Per row: (start, end) of the words that disclose an entity of its document, by counting in dictionaries."""
    docs = {(r.doc_id, r.text or ""): None for r in rows}
    n, n_e, n_t, n_te, held = len(rows), Counter(), Counter(), Counter(), {}
    value = lambda kind, m: f"{kind}:{m.lower() if kind == 'email' else m if kind == 'ip' else re.sub('[^0-9]', '', m)}"
    for r in rows:
        n_t.update({w for w, _, _ in outside_mails(r.text or "")})
    for doc_id, text in docs:
        entities = {value(kind, text[a:b]) for a, _, b, kind in base_spans(text)}
        held[doc_id, text] = entities
        n_e.update(entities)
        n_te.update((e, w) for w in {w for w, _, _ in outside_mails(text)} for e in entities)
    told = {(e, w) for (e, w), k in n_te.items() if k > 1 and np.log2((k - 1) * n / (n_t[w] * n_e[e])) >= private.DISCLOSURE * np.log2(n / n_e[e]) > 0}
    return {d: [(a, b) for w, a, b in outside_mails(d[1]) if any((e, w) in told for e in held[d])] for d in docs}


def outside_mails(text):
    mails = [(a, b) for a, _, b, kind in base_spans(text) if kind == "email"]
    words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|['-])+", text)]
    return [w for w in words if not any(a < w[2] and b > w[1] for a, b in mails)]


def test_private_terms_stand_anywhere_in_the_texts(spark, sf_dir):
    card = "4111 1111 1111 1111"
    far = "lorem " * 60
    rows = [row(k, f"{prose(k, 20)} Ann, order 42, card {card} {far} Quillfeather's {prose(k + 50, 20)} Ann") for k in range(5)]
    rows += [row(20 + k, f"李明 a{k}@b.org and c@d.org {prose(k + 90, 30)} 李明") for k in range(2)] + [row(30, f"Solo {card[:-1]}0 x@y.z alone"), row(31, "Ann.b@c.de Ann")]
    rows += [row(100 + k, prose(k + 500, 60)) for k in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for which in (docs, table(spark, sf_dir, "documents")):
        plain = which.select("doc_id", "text").collect()
        want = disclosed(plain)
        texts = {r.doc_id: r.text or "" for r in plain}
        got = {(r.doc_id, texts[r.doc_id]): [(t.start, t.end) for t in r.terms] for r in private.find(which).collect()}
        assert got == want
    marked = {d: [t[a:b] for a, b in spans] for (d, t), spans in disclosed(docs.select("doc_id", "text").collect()).items()}
    assert {"Ann", "Quillfeather's"} <= set(marked[0]) and marked[0].count("Ann") == 2 and "李明" in marked[20] and not marked[30] and not marked[100]


def test_private_many_matches_in_one_text(spark):
    text = " ".join(f"{k} 4111111111111111 10.0.{k % 250}.{k % 9}" for k in range(25_000)) + " " + "7 " * 200_000
    began = time.time()
    r = private.report(spark.createDataFrame([row(1, text)], SCHEMA)).first()
    spans = base_spans(text)
    assert (r.n_card, r.n_ip) == (sum(s[3] == "card" for s in spans), 25_000) and time.time() - began < 60
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans).encode()).hexdigest()


def test_private_long_lists_in_common_make_few_pairs(spark):
    """Two texts that share 3,000 addresses and 3,000 words: all words tell of all addresses, by one pair of classes."""
    n = 3000
    letters = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    shared = " ".join(f"user{k}@host.example word{letters(k)}" for k in range(n))
    rows = [(k, prose(k + 40, 12)) for k in range(200)] + [(1000, shared), (1001, shared + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.time()
    found = {r.doc_id: r.n for r in private.find(docs).selectExpr("doc_id", "size(filter(terms, t -> t.kind = 'term')) as n").where("n > 0").collect()}
    assert found == {1000: n, 1001: n} and time.time() - started < 120


def test_private_main_path_is_native(spark, sf_dir, monkeypatch):
    plans, settle = [], private.settle
    monkeypatch.setattr(private, "settle", lambda df, label: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df, label))
    plans.append(private.report(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 4 and not any(re.search("Python|Pandas|Arrow", plan) for plan in plans)


PAGES = "page_id long, url string, html string, run int, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    big, other = "<p>" + prose(1, 400) + "</p>", "<p>é" + prose(2, 300) + "</p>"
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, "http://a/3\r\nX: y", big), (2, None, other), (None, "u", other), (9, "s", "tiny"), (8, "s", "tiny"), (7, "n", None), (6, "e", ""), (5, "http://a/5", big), (11, "l", "x" * 3_000_000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], PAGES)


def page_rows(pages):
    rows = pages.select("page_id", "html").collect()
    last = defaultdict(lambda: None)
    for r in rows:
        body = r.html or ""
        if r.page_id is not None:
            last[body] = max(r.page_id, last[body] if last[body] is not None else r.page_id)
    out = Counter()
    for r in rows:
        body = (r.html or "").encode()
        to = last[r.html or ""] if len(body) >= 1000 and last[r.html or ""] != r.page_id else None
        out[r.page_id, len(body), hashlib.sha1(body).hexdigest(), "response" if to is None else "revisit", to] += 1
    return out


def test_warc_round_trip(spark, pages, sf_dir, empty):
    for p in (pages, table(spark, sf_dir, "pages")):
        got = Counter(tuple(r) for r in warc.round_trip(p, shard_bytes=60_000, file_bytes=20_000).collect())
        assert got == page_rows(p)
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_warc_files_are_the_same_again(spark, pages, tmp_path):
    a, b = (warc.write(p, f"{tmp_path}/{name}", shard_bytes=5000) for name, p in (("a", pages), ("b", pages.repartition(4))))
    read = lambda p: open(p, "rb").read()
    assert [p.rpartition("/")[2] for p in a] == [p.rpartition("/")[2] for p in b] and [read(p) for p in a] == [read(p) for p in b]
    assert len(a) > 1
    kinds = [warc.parse(m)[0] for p in a for m in warc.members(p)]
    assert kinds[0] == "warcinfo" and kinds.count("warcinfo") == len(a)
    broken = read(a[0])[:-40]
    (tmp_path / "broken.warc.gz").write_bytes(broken)
    with pytest.raises(ValueError):
        list(warc.members(str(tmp_path / "broken.warc.gz")))


def near_truth(rows, percent=85):
    sets = [near.shingle_set(r.text or "") for r in rows]
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            same = rows[a].doc_id is not None and rows[a].doc_id == rows[b].doc_id
            if None not in (rows[a].doc_id, rows[b].doc_id) and (same or both and 100 * both >= percent * len(sets[a] | sets[b])):
                parent[top(a)] = top(b)
    least = {}
    for k, r in enumerate(rows):
        if r.doc_id is not None:
            least[top(k)] = min(least.get(top(k), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[k]), least[top(k)] if r.doc_id is not None else None) for k, r in enumerate(rows))


def variants(spark):
    """Chains and families of near copies around the limit, a passage shared by many, and equal sets in another order."""
    rows, n = [], 0
    for family in range(4):
        base = prose(family + 50, 150).split()
        for copy in range(40):
            words = list(base)
            for k in range(copy % 9):
                words[(copy * 7 + k * 17) % len(words)] = f"w{copy}x{k}"
            rows.append(row(n := n + 1, " ".join(words)))
    passage = prose(77, 90)
    rows += [row(n := n + 1, f"{passage} {prose(k + 300, 25)}") for k in range(60)]
    loop = prose(78, 30)
    rows += [row(n := n + 1, f"{loop} {loop} {loop}"), row(n := n + 1, f"{loop} {loop} {loop} {loop}")]
    chain = prose(79, 200).split()
    rows += [row(n := n + 1, " ".join(chain[k * 6 : k * 6 + 120])) for k in range(12)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("which", ["messy", "sf", "variants"])
def test_near_components(spark, messy, sf_dir, which):
    docs = {"messy": messy, "sf": table(spark, sf_dir, "documents"), "variants": variants(spark)}[which]
    found = near.clusters(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == near_truth(docs.select("doc_id", "text").collect())
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def counted_pairs(monkeypatch):
    """A list that gets the number of pairs of each confirmation."""
    counts, confirm = [], near.confirm

    def counting(pairs, docs, percent):
        counts.append(pairs.count())
        return confirm(pairs, docs, percent)

    monkeypatch.setattr(near, "confirm", counting)
    return counts


def test_near_pairs_of_large_groups_are_few(spark, monkeypatch):
    """A passage of 5,000 unlike documents, and a family of 1,500 near copies, make a few pairs a document at most."""
    counts = counted_pairs(monkeypatch)
    passage = prose(501, 90)
    unlike = spark.createDataFrame([(k, f"{passage} {prose(k + 5000, 40)}") for k in range(5000)], "doc_id long, text string")
    assert near.clusters(unlike, percent=80).where("not kept").count() == 0 and sum(counts) <= 3 * 5000
    counts.clear()
    base, rows = prose(502, 150).split(), []
    for k in range(1500):
        words, r = list(base), random.Random(k)
        for at in r.sample(range(len(words)), k % 4):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
    family = near.clusters(spark.createDataFrame(rows, "doc_id long, text string"), percent=80)
    assert family.where("kept").count() == 1 and sum(counts) <= 3 * 1500


@pytest.mark.parametrize("size", [300, 600])
def test_near_families_below_the_limit_make_few_pairs(spark, monkeypatch, size):
    """Texts that are all just below the limit to each other, with some real links among them, are compared in blocks."""
    counts = counted_pairs(monkeypatch)
    base, rows = prose(77, 300).split(), []
    for k in range(size):
        words, r = list(base), random.Random(k)
        for at in r.sample(range(len(words)), 5):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words)))
        if k % 50 == 0:
            rows.append((10_000 + k, " ".join([*words[:-1], "last"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.clusters(docs).collect())
    assert got == near_truth(docs.collect()) and sum(counts) <= 3 * len(rows)


def test_forest_joins_what_all_pairs_join():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(2, 40))
        own, component, near_by = r.integers(0, 2, n), r.integers(0, n, n), r.random((n, n)) < 0.05
        near_by |= near_by.T
        name = np.arange(n) * 10
        for every in (False, True):
            for x, y in ((0, 0), (0, 1)):
                pairs, met = near.forest(own, x, y, name, component, lambda k, o, m=near_by: m[k][o], every)
                trees = {}
                def top(v, trees=trees):
                    while trees.get(v, v) != v:
                        v = trees[v]
                    return v
                want = {}
                def above(v, want=want):
                    while want.get(v, v) != v:
                        v = want[v]
                    return v
                for c in range(n):
                    same = np.flatnonzero(component == component[c])
                    trees[top(c)] = top(int(same[0]))
                    want[above(c)] = above(int(same[0]))
                active = set()
                for a in range(n):
                    for b in range(n):
                        if own[a] == x and own[b] == y and a != b and near_by[a, b] and component[a] != component[b]:
                            want[above(a)] = above(b)
                            active |= {a, b}
                for a, b in pairs // 10:
                    trees[top(int(a))] = top(int(b))
                assert len({(top(k), above(k)) for k in range(n)}) == len({top(k) for k in range(n)}) == len({above(k) for k in range(n)})
                assert len(pairs) < n and (not every or set(np.flatnonzero(met)) == active)


def test_near_hashes_and_bounds(spark, empty, monkeypatch):
    texts = [prose(k, n).encode() for k, n in enumerate((0, 1, 4, 5, 6, 300))] + [b"", b" a\t\nB  c d E ", b"x" * 50_000]
    for text, hashes in zip(texts, near.hashed_sets(texts), strict=True):
        assert len(hashes) == len(near.shingle_set(text.decode()))
    left, right = (near.hashed_sets([t])[0] for t in (texts[5], texts[5].upper()))
    assert np.array_equal(left, right)
    assert near.clusters(empty).count() == 0
    monkeypatch.setattr(near, "BLOCK", 7)  # buckets dealt into many blocks give the same components
    docs = variants(spark)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in near.clusters(docs).collect()) == near_truth(docs.select("doc_id", "text").collect())


def test_min_and_max_estimate_the_similarity(spark):
    r = np.random.default_rng(4)
    pool = r.integers(0, 1 << 63, 3000, dtype=np.uint64)
    agree = []
    for k in range(60):
        r.shuffle(pool)
        a, b = pool[:900], pool[100:1000]
        agree.append(np.mean(np.concatenate(near.signature(a)) == np.concatenate(near.signature(b))))
    assert np.mean(agree) == pytest.approx(0.8, abs=0.02)


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 101), (102, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in near.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 100: 100, 101: 100, 102: 100}
    assert near.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline(spark, messy, empty):
    import corpus_pipeline as p

    docs = messy
    for name, stage in p.STAGES:
        before, docs = docs, stage(spark, docs, "")
        docs = docs.persist()
        rows = docs.collect()
        if name != "encode_pieces":
            assert docs.columns == messy.columns
        if name == "language_id":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in rows} == {6, 7, 8, 17}
        if name == "exact_dedup":
            assert len(rows) == len({fold(r.text) for r in before.collect()})
        if name == "near_dedup":
            groups = near_truth(before.select("doc_id", "text").collect())
            assert len({r.doc_id for r in rows if r.doc_id is not None}) == len({g[2] for g in groups if g[2] is not None})
    assert {"doc_id", "n_tokens", "ids_sha256", "ids"} <= set(docs.columns)
    out = empty
    for _, stage in p.STAGES:
        out = stage(spark, out, "")
    assert out.count() == 0


def test_bands_and_agreement_follow_the_limit():
    assert [near.band_rows(p) for p in (85, 80)] == [5, 4] and [near.least_agree(p) for p in (85, 80)] == [82, 73]
    for percent in (95, 85, 80, 70, 50):
        r = near.band_rows(percent)
        assert near.PERMUTATIONS % r == 0 and (1 - (percent / 100) ** r) ** (120 // r) <= near.MISSED


def test_pipeline_takes_near_copies_from_080(spark):
    import corpus_pipeline as p

    rows = variants(spark).select("doc_id", "text").collect()
    rows = [row(r.doc_id, r.text) for r in rows]
    for k in range(12):  # pairs with a similarity from 0.75 to 0.9: 3 to 8 words of 300 are other ones
        words = prose(k + 900, 300).split()
        rows.append(row(1000 + 2 * k, " ".join(words)))
        for j in range(3 + k % 6):
            words[20 + 35 * j] = f"other{j}"
        rows.append(row(1001 + 2 * k, " ".join(words)))
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id for r in p.near_dedup(spark, docs, "").collect()}
    truth = {percent: {g[2] for g in near_truth(docs.select("doc_id", "text").collect(), percent)} for percent in (80, 85)}
    assert kept == truth[80] and truth[80] < truth[85]


def test_pipeline_runs_whole(spark, sf_dir):
    import corpus_pipeline as p

    out = p.run(spark, sf_dir)
    assert out.count() > 100 and p.ORACLE_SQL is None
