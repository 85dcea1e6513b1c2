"""Operator 10: near-duplicate detection by min-max hashing.

A document's set is that of its distinct five-word shingles. Under each of PERMUTATIONS hash functions the set's
minimum and its maximum are both kept: either equals that of another set with a probability that is the sets'
Jaccard similarity, so one evaluation of a hash function gives two values of the signature. Signatures are cut into
bands, minima and maxima apart; documents that agree in a band meet in a bucket. The limit decides how many values a
band has (band_rows) and how many of two signatures must agree (least_agree).

Documents with equal word sequences are one class and take part once. In a bucket nobody meets everybody:

1. every document meets one other: of the leaders (smallest identifiers) of its buckets the one with which it shares
   the most; what the full sets confirm links them, and linked documents form components;
2. the documents of buckets that still hold more than one component go on. Their shingles are ordered by how many of
   these documents have them, rarest first. Two similar documents must share a shingle among the first few of each
   (at 85 the smaller's first 8 %, the larger's first 15 %, as in prefix filtering), so documents meet again by these, and
   those that only share a passage that many have do not meet at all. In each of ROUNDS rounds all members of such a
   group that are not in the leader's component meet the leader. The first leader is the member with the fewest
   shingles of its own, as an original has among its copies; later ones are drawn, and so come from large components
   mostly. That joins nearly all that belongs together, with at most one pair a row of a prefix and round;
3. then all members of different components in a group whose sizes and places in the order allow enough in common, and
   whose signatures agree enough; both are tested where the rows are. No pair leaves the task but a spanning forest of
   those that pass, whose components are families. In a family the hashed sets themselves are compared, in blocks, and
   again a spanning forest is what leaves the task. Texts that are all just below the limit to each other are compared in
   their blocks, and make no pair.

Nothing is capped, and steps 2 and 3 lose no link between the buckets' documents that is not made by others. Candidate
pairs are confirmed on the full sets of shingles themselves, not of hashes. Components come from alternating large-star and small-star rounds over a
distributed table of links, each round a written table.

Null text and text without words have an empty set and are linked with nothing. With fewer than five words the whole
sequence is the one shingle. Rows that share an identifier are one document: they reach each other. A null identifier
is its own component (null), and its row is kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import kept, settle, small_batches, unused

#: Words of a shingle; hash functions, each giving two values.
WORDS, PERMUTATIONS = 5, 60
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the limit is missed by all bands with at most this probability, and has so many deviations fewer values
#: in common than expected with about the same.
MISSED, DEVIATIONS = 1e-6, 5.1
#: Rounds in which groups meet their leaders before all that may still be linked are compared.
ROUNDS = 2
#: Members of a block, shingles of a block, and identifiers that are sent to all executors at most.
BLOCK, BLOCK_SHINGLES, BROADCAST_IDS = 400, 1 << 20, 500_000
#: Bytes of text that one round of vectorised hashing takes.
CHUNK = 1 << 20

SEEDS = np.random.Generator(np.random.PCG64(20240229))
MULTIPLY = SEEDS.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
ADD = SEEDS.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def band_rows(percent: int) -> int:
    """Values of a band: the most, dividing PERMUTATIONS, that miss a pair at the limit with probability MISSED at most."""
    missed = lambda r: (1 - (percent / 100) ** r) ** (2 * PERMUTATIONS // r)
    return max((r for r in range(2, PERMUTATIONS + 1) if PERMUTATIONS % r == 0 and missed(r) <= MISSED), default=1)


def least_agree(percent: int) -> int:
    """Of the 120 values of two signatures so many must agree: at 85, 82 of 102 expected; at 80, 73 of 96."""
    share = percent / 100
    return max(0, int(2 * PERMUTATIONS * share - DEVIATIONS * (2 * PERMUTATIONS * share * (1 - share)) ** 0.5))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def hashed_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct 64-bit hashes of each text's shingles, all texts in a few passes over their bytes."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    low = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    solid = ~((low == 32) | ((low >= 9) & (low <= 13)))
    starts = np.nonzero(solid & ~np.concatenate([[False], solid[:-1]]))[0]
    if not len(starts):
        return [np.zeros(0, np.uint64)] * len(texts)
    at = np.arange(len(data))
    inside = at[starts[0] :] - np.repeat(starts, np.diff([*starts, len(data)]))
    powers = np.cumprod(np.full(int(inside.max()) + 1, BASE, np.uint64))
    values = np.where(solid[starts[0] :], low[starts[0] :].astype(np.uint64) + np.uint64(1), np.uint64(0)) * powers[inside]
    words = mixed(np.add.reduceat(values, starts - starts[0]))
    shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        shingles = shingles * STEP + words[k : len(words) - WORDS + 1 + k] if len(shingles) else shingles
    shingles = mixed(shingles)
    last = np.searchsorted(starts, ends, side="left")
    found = []
    for a, b in zip([0, *last[:-1]], last, strict=True):
        if b - a >= WORDS:
            found.append(np.unique(shingles[a : b - WORDS + 1]))
        elif b > a:  # the whole sequence, told from a shingle by its length
            h = np.array([b - a], np.uint64)
            for w in words[a:b]:
                h = mixed(h * STEP + w)
            found.append(h)
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of the set under each hash function."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least, most = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for k in range(0, len(short), 4096):
        values = short[k : k + 4096] * MULTIPLY + ADD
        least, most = np.minimum(least, values.min(axis=0)), np.maximum(most, values.max(axis=0))
    return least, most


def bands(least: np.ndarray, most: np.ndarray, n_rows: int) -> np.ndarray:
    """A 64-bit key for each band, minima first."""
    rows = np.concatenate([least, most]).astype(np.uint64).reshape(-1, n_rows)
    key = np.arange(len(rows), dtype=np.uint64)
    for k in range(n_rows):
        key = mixed(key * STEP + rows[:, k])
    return key.view(np.int64)


SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("cls", T.BinaryType()),
    T.StructField("bands", T.ArrayType(T.LongType())),
    T.StructField("sig", T.BinaryType()),
])


def sketch(batches: Iterable[pa.RecordBatch], n_rows: int) -> Iterator[pa.RecordBatch]:
    """(identifier, text) to SKETCH, with bands of n_rows values. cls names the word sequence; sig has the low byte of each signature value.

    Sequences of fewer than five words have no bands: only equal ones share their shingle, and these are one class.
    """
    kept()
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
        rows: dict[str, list] = {n: [] for n in SKETCH.names[1:]}
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                size += len(texts[last])
                last += 1
            for text, hashes in zip(texts[first:last], hashed_sets(texts[first:last]), strict=True):
                words = text.lower().split()
                rows["n_shingles"].append(len(hashes))
                rows["cls"].append(hashlib.blake2b(b" ".join(words), digest_size=16).digest() if words else None)
                if len(words) >= WORDS:
                    least, most = signature(hashes)
                    rows["bands"].append(bands(least, most, n_rows))
                    rows["sig"].append(np.concatenate([least, most]).astype(np.uint8).tobytes())
                else:
                    rows["bands"].append(None)
                    rows["sig"].append(None)
            first = last
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows["n_shingles"], pa.int64()), pa.array(rows["cls"], pa.binary()), pa.array(rows["bands"], pa.list_(pa.int64())), pa.array(rows["sig"], pa.binary())],
            SKETCH.names,
        )


def shingle_set(text: str) -> set:
    words = text.encode().lower().split()
    return set(zip(*[words[k:] for k in range(WORDS)], strict=False)) if len(words) >= WORDS else {tuple(words)} if words else set()


def confirm(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; docs has doc_id and text."""
    ids = settle(pairs.select(F.col("a").alias("i")).union(pairs.select("b")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = settle(docs.join(wanted, F.col("doc_id") == F.col("i"), "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, set()
        for batch in batches:
            hold = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = a.as_py() or "", b.as_py() or ""
                if a is not last and a != last:
                    last, left = a, shingle_set(a)
                right = shingle_set(b)
                common = len(left & right)
                hold.append(common > 0 and 100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hold, pa.bool_())), batch.column(1).filter(pa.array(hold, pa.bool_()))], ["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct()


def agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar enough by their set sizes and signatures."""
    side = lambda s: reps.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    both = pairs.join(side("a"), "a").where(F.col("n_a") > 0).join(side("b"), "b")
    both = both.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    enough = least_agree(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS) for k in (2, 3))
            near = pa.array((left == right).sum(axis=1) >= enough)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(near), batch.column(1).filter(near)], ["a", "b"])

    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): component is the least node that a node reaches; lone nodes are left out.

    Large-star hangs each node's larger neighbours on its least neighbour, small-star the smaller ones and itself;
    both only shorten paths, and when neither changes anything every component is a star around its least node.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state: tuple | None = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large.where("u <> v"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = settle(small.distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(now)


SETS = T.StructType([
    T.StructField("rep", T.LongType()),
    T.StructField("mark", T.LongType()),
    T.StructField("set", T.ArrayType(T.LongType())),
])


def shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identifier, mark of the text, text) to SETS: the hashes of each text's shingles."""
    for batch in batches:
        texts = [(t or "").encode() for t in batch.column(2).to_pylist()]
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
                size += len(texts[last])
                last += 1
            sets = hashed_sets(texts[first:last])
            ends = np.cumsum([0, *[len(h) for h in sets]]).astype(np.int32)
            held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), held], SETS.names)
            first = last


def open_sets(members: DataFrame, labels: DataFrame, docs: DataFrame) -> DataFrame:
    """SETS of the documents in buckets of several components."""
    named = members.join(labels, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    named = settle(named, "named")
    mixed_keys = settle(named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key"), "mixed")
    open_ids = settle(named.join(mixed_keys, "key", "left_semi").select(F.col("rep").alias("i")).distinct(), "open")
    wanted = F.broadcast(open_ids) if open_ids.count() <= BROADCAST_IDS else open_ids
    texts = docs.join(wanted, F.col("doc_id") == F.col("i"), "left_semi").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return settle(texts.mapInArrow(shingle_sets, SETS), "sets")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(h, rep, n, pos, own) of the first shingles, in one order of all, of each set.

    Shingles that only one document has are left out, since nobody meets there; own is the share of those.
    """
    rows = sets.select("rep", "mark", F.size("set").cast("long").alias("n"), F.explode("set").alias("h"))
    ranked = rows.join(rows.groupBy("h").agg(F.count("*").alias("df")), "h")
    of_text = W.partitionBy("rep", "mark")
    ranked = ranked.withColumn("pos", F.row_number().over(of_text.orderBy("df", "h")).cast("long")).withColumn("own", F.count_if(F.col("df") == 1).over(of_text) / F.col("n"))
    least = F.ceil(F.col("n") * percent / 100)
    return settle(ranked.where((F.col("pos") <= F.col("n") - least + 1) & (F.col("df") > 1)).select("h", "rep", "n", "pos", "own").distinct(), "prefixes")


def may_link(n_a, pos_a, n_b, pos_b, percent: int, least=np.minimum, choose=np.where):
    """Can sets of these sizes be similar enough if the first element they share stands at these places?

    They need percent / (100 + percent) of both sizes in common; the smaller must have the element among its first
    ones, as many as it would still have enough with an equal partner. For arrays, or for columns with their `least`
    and `choose`.
    """
    swap = n_b < n_a
    n_s, pos_s, n_l, pos_l = choose(swap, n_b, n_a), choose(swap, pos_b, pos_a), choose(swap, n_a, n_b), choose(swap, pos_a, pos_b)
    common = 1 + least(n_s - pos_s, n_l - pos_l)
    indexed = (100 + percent) * (n_s - pos_s + 1) >= 2 * percent * n_s
    return indexed & (100 * n_s >= percent * n_l) & ((100 + percent) * common >= percent * (n_s + n_l))


def with_components(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    return tokens.join(labels, F.col("rep") == F.col("node"), "left").select("h", "rep", F.coalesce("component", "rep").alias("component"), "n", "pos", "own")


def stars(tokens: DataFrame, labels: DataFrame, percent: int, number: int) -> DataFrame:
    """Pairs (a, b) of the leader of each group of a shingle and its members in other components.

    The leader is an aggregate that rows are joined to, so that no group has to be in one task. In round 0 it is the
    member with the smallest share of shingles of its own, later any, by a hash.
    """
    named = settle(with_components(tokens, labels), "named")
    rank = F.col("own") if number == 0 else F.xxhash64("rep", F.lit(f"round {number}"))
    found = named.groupBy("h").agg(F.min(F.struct(rank.alias("rank"), F.col("rep").alias("leader"), F.col("component").alias("c_l"), F.col("n").alias("n_l"), F.col("pos").alias("pos_l"))).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    leaders = settle(found.where("lo <> hi").select("h", "l.leader", "l.c_l", "l.n_l", "l.pos_l"), "leaders")
    near = may_link(F.col("n"), F.col("pos"), F.col("n_l"), F.col("pos_l"), percent, F.least, lambda c, a, b: F.when(c, a).otherwise(b))
    met = named.join(leaders, "h").where((F.col("component") != F.col("c_l")) & near)
    return met.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b")).distinct()


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows that are sorted by their first `keys` columns, as tables of whole groups with the groups' bounds.

    Only the rows of a group that is not whole yet are held; they are joined once it is.
    """
    held: list[pa.RecordBatch] = []

    def bounds(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
        change = np.zeros(max(0, rows.num_rows - 1), bool)
        for k in range(keys):
            column = rows.column(k).to_numpy()
            change |= column[1:] != column[:-1]
        return np.nonzero(change)[0] + 1

    def table(parts: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        rows = pa.Table.from_batches(parts)
        return rows, list(pairwise([0, *bounds(rows).tolist(), rows.num_rows]))

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = bounds(batch)
        same = not held or all(held[-1].column(k)[-1] == batch.column(k)[0] for k in range(keys))
        if not same:
            yield table(held)
            held = []
        if len(cuts):
            last = int(cuts[-1])
            yield table([*held, batch.slice(0, last)])
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield table(held)


def forest(own: np.ndarray, x: int, y: int, name: np.ndarray, component: np.ndarray, similar: Callable[[int, np.ndarray], np.ndarray], every: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of names that join what similar rows of two blocks join, or of one block if x is y: at most one a row; and
    which rows have somebody similar.

    similar(k, others) says which others a row is similar to. Rows of one component are not compared, nor rows that
    earlier pairs have joined, unless `every` other pair is wanted.
    """
    label = np.unique(component, return_inverse=True)[1]
    first = label.copy()
    left, right = np.nonzero(own == x)[0], np.nonzero(own == y)[0]
    found, met = [], np.zeros(len(own), bool)
    for k in left:
        other = right if x != y else right[right > k]
        other = other[first[other] != first[k]] if every else other[label[other] != label[k]]
        other = other[similar(k, other)] if len(other) else other
        if len(other):
            met[k] = met[other] = True
            joins, at = np.unique(label[other], return_index=True)
            other = other[at[joins != label[k]]]
            found.append(np.stack([np.minimum(name[other], name[k]), np.maximum(name[other], name[k])], axis=1))
            label[np.isin(label, joins)] = label[k]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64), met


def in_blocks(rows: DataFrame, group: str, sizes: DataFrame, columns: list[str]) -> DataFrame:
    """rows (group, rep, ...) dealt into blocks by `sizes` (group, blocks), so that every two blocks of a group meet in a
    group (group, x, y) of its own, sorted by it; own is the row's block."""
    own = F.pmod(F.xxhash64("rep", F.lit("block")), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, group).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    dealt = dealt.select(group, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "component", *columns)
    return dealt.repartition(F.col(group), F.col("x"), F.col("y")).sortWithinPartitions(group, "x", "y", "rep")


def n_blocks(rows: Column, weight: Column | None = None) -> Column:
    """Blocks of BLOCK rows, or of the square root of all if that is more, so that n rows make n ** 1.5 copies at most; and
    more where they would weigh more than BLOCK_SHINGLES each."""
    by_rows = F.ceil(rows / F.greatest(F.lit(BLOCK), F.sqrt(rows)))
    return F.greatest(by_rows, F.ceil(weight / BLOCK_SHINGLES)) if weight is not None else by_rows


def families(tokens: DataFrame, labels: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """(rep, component, family) of the documents that may be similar enough to one of another component.

    Pairs meet by a shingle of their prefixes, and are told by sizes, places and signatures where the rows are. What
    leaves a task is who has such a partner, and a spanning forest of their components; families are its trees.
    """
    named = settle(with_components(tokens, labels), "named")
    groups = named.groupBy("h").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    groups = settle(groups.select("h", n_blocks(F.col("size")).alias("blocks")), "groups")
    rows = in_blocks(named.join(signed.select("rep", "sig"), "rep"), "h", groups, ["n", "pos", "sig"])
    enough = least_agree(percent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, 3):
            _, x, y, own, rep, comp, n, pos = (rows.column(k).to_numpy() for k in range(8))
            sig = np.frombuffer(b"".join(rows.column(8).to_pylist()), np.uint8).reshape(-1, 2 * PERMUTATIONS)
            pairs, who = [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
            for a, b in bounds:
                if b - a < 2:
                    continue

                def similar(k: int, other: np.ndarray, a: int = a) -> np.ndarray:
                    k, other = k + a, other + a
                    may = may_link(n[k], pos[k], n[other], pos[other], percent)
                    may[may] = (sig[other[may]] == sig[k]).sum(axis=1) >= enough
                    return may

                more, met = forest(own[a:b], x[a], y[a], comp[a:b], comp[a:b], similar, every=True)
                pairs.append(more)
                who.append(np.stack([rep[a:b][met], comp[a:b][met]], axis=1))
            both, those = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(who), axis=0)
            tree = np.concatenate([np.ones(len(both), bool), np.zeros(len(those), bool)])
            all_rows = np.concatenate([both, those])
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(all_rows[:, 0]), pa.array(all_rows[:, 1])], ["tree", "a", "b"])

    found = settle(rows.mapInArrow(run, "tree boolean, a long, b long"), "related")
    if found.isEmpty():
        return found.select(F.col("a").alias("rep"), F.col("b").alias("component"), F.col("a").alias("family"))
    trees = components(found.where("tree").select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("family"))
    return found.where("not tree").select(F.col("a").alias("rep"), F.col("b").alias("component")).distinct().join(trees, "component")


def rest(related: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that join what similar pairs within the families join; related has (rep, component, family).

    A family's members carry the hashes of their shingles into its blocks and are compared there, hash by hash; what
    leaves a task is a spanning forest of the pairs that are similar enough.
    """
    rows = settle(related.join(sets.select("rep", "set"), "rep"), "members")
    sizes = settle(rows.groupBy("family").agg(n_blocks(F.count("*"), F.sum(F.size("set"))).alias("blocks")), "sizes")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, 3):
            _, x, y, own, rep, comp = (rows.column(k).to_numpy() for k in range(6))
            sets = rows.column(6).combine_chunks()
            ends, values = sets.offsets.to_numpy(), sets.values.to_numpy()
            found = [np.zeros((0, 2), np.int64)]
            for a, b in bounds:
                if b - a < 2:
                    continue
                known, ids = np.unique(values[ends[a] : ends[b]], return_inverse=True)
                at, size, mark = ends[a : b + 1] - ends[a], np.diff(ends[a : b + 1]), np.zeros(len(known), bool)

                def similar(k: int, other: np.ndarray, ids: np.ndarray = ids, at: np.ndarray = at, size: np.ndarray = size, mark: np.ndarray = mark) -> np.ndarray:
                    small, large = np.minimum(size[k], size[other]), np.maximum(size[k], size[other])
                    may = 100 * small >= percent * large
                    mark[ids[at[k] : at[k + 1]]] = True
                    common = np.array([np.count_nonzero(mark[ids[at[o] : at[o + 1]]]) for o in other[may]], np.int64)
                    mark[ids[at[k] : at[k + 1]]] = False
                    may[may] = 100 * common >= percent * (size[k] + size[other[may]] - common)
                    return may

                found.append(forest(own[a:b], x[a], y[a], rep[a:b], comp[a:b], similar)[0])
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    return in_blocks(rows, "family", sizes, ["set"]).mapInArrow(run, "a long, b long").distinct()


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, component) after links between their nodes, or nodes that have no label yet."""
    name = lambda s: labels.select(F.col("node").alias(s), F.col("component").alias(f"c_{s}"))
    bridges = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    tops = settle(components(bridges), "bridges").select(F.col("node").alias("component"), F.col("component").alias("top"))
    known = labels.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = tops.join(labels.select("node"), F.col("component") == F.col("node"), "left_anti").select(F.col("component").alias("node"), F.col("top").alias("component"))
    return settle(known.unionByName(new), "components")


def clusters(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_rows = band_rows(percent)
    base = settle(slim.mapInArrow(lambda batches: sketch(batches, n_rows), SKETCH), "sketches")
    sound = base.where(F.col("cls").isNotNull() & F.col("doc_id").isNotNull())
    chosen = sound.groupBy("cls").agg(F.min(F.struct("doc_id", "n_shingles", "bands", "sig")).alias("r"))
    reps = settle(chosen.select("cls", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), F.col("r.bands").alias("bands"), F.col("r.sig").alias("sig")), "classes")
    banded = reps.where(F.col("bands").isNotNull())
    spread = banded.select(F.explode("bands").alias("key"), "rep")
    # written first, so that the join has an exchange on either side and a hot bucket can be split
    shared = settle(spread.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).where("size > 1").select("key", "leader"), "shared")
    members = settle(spread.join(shared, "key"), "members")
    signed = banded.select("rep", "n", "sig")
    shares = members.where("rep <> leader").groupBy("rep", "leader").agg(F.count("*").alias("bands"))
    starred = shares.groupBy(F.col("rep").alias("b")).agg(F.max_by("leader", F.struct("bands", -F.col("leader"))).alias("a")).select("a", "b")
    labels = settle(components(confirm(settle(agreeing(starred, signed, percent), "met"), slim, percent)), "components")
    sets = open_sets(members.select("key", "rep"), labels, slim)
    tokens = prefixes(sets, percent)
    for number in range(ROUNDS):
        more = settle(agreeing(stars(tokens, labels, percent, number), signed, percent), "met")
        if not more.isEmpty():
            labels = joined(labels, confirm(more, slim, percent))
    more = settle(rest(families(tokens, labels, signed, percent), sets, percent), "met")
    if not more.isEmpty():
        labels = joined(labels, confirm(more, slim, percent))
    # rows of one identifier with different texts are one document: each of its classes already has that one name
    of_class = reps.select("cls", "rep").join(labels, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("found"))
    placed = base.select("doc_id", "n_shingles", "cls").join(of_class, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return placed.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs with one document of each component, all columns kept."""
    (name,) = unused(docs, "dropped")
    dropped = clusters(docs, key=key, text=text, percent=percent).where(~F.col("kept")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(settle(dropped, "dropped"), F.col(key) == F.col(name), "left_anti")
