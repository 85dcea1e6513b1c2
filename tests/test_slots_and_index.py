"""Slots of colliding names against the loop that defines them, and the content index in buckets."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedup, select
from siftline.sources.content_index import ContentIndex


def fold(text):
    return unicodedata.normalize("NFC", text).lower()


def first_fit(keys):
    """Each key in order goes to the first slot in which all beginnings of its path are free or spelt the same."""
    count = {}
    for key in keys:
        count[fold(key)] = count.get(fold(key), 0) + 1
    slots, placed = [], {}
    for key in sorted(k for k in keys if count[fold(k)] > 1):
        parts = key.split("/")
        heads = ["/".join(parts[: n + 1]) for n in range(len(parts))]
        number = next((n for n, claimed in enumerate(slots) if all(claimed.get(fold(h), h) == h for h in heads)), len(slots))
        if number == len(slots):
            slots.append({})
        slots[number].update({fold(h): h for h in heads})
        placed[key] = number
    return placed


@pytest.mark.parametrize("seed", range(6))
def test_slots_equal_the_loop(spark, seed):
    r = random.Random(seed)
    names = ["a", "A", "b", "B", "é", "é", "É", "ab", "aB", "AB", "", "!", "a!"]
    keys = {"/".join(r.choice(names[: r.choice((2, 4, 13))]) for _ in range(r.randint(1, 4))) for _ in range(300)}
    got = {x.key: x.slot for x in select.variant_slots(spark.createDataFrame([(k,) for k in sorted(keys)], "key string")).collect()}
    assert got == first_fit(keys) and len(got) > 50


def test_slots_of_many_keys_below_one_folder(spark):
    """One folder, spelt twice, with 40,000 colliding keys: no Python, and no window or group over all of them."""
    k = F.col("id")
    keys = spark.range(40_000).select(F.concat(F.when(k % 2 == 0, "Docs/").otherwise("docs/"), F.when(k % 4 < 2, "name").otherwise("NAME"), F.floor(k / 4).cast("string")).alias("key"))
    slots = select.variant_slots(keys)
    assert {tuple(x) for x in slots.groupBy("slot").count().collect()} == {(0, 10_000), (1, 10_000), (2, 10_000), (3, 10_000)}
    assert slots.where("key like 'Docs/NAME%'").agg(F.max("slot")).first()[0] == 0
    assert select.variant_slots(keys.limit(0)).count() == 0


def hashed(spark, rows):
    return spark.createDataFrame(rows, "content_hash string, original_key string, bucket_alias string, extension string")


def test_index_in_buckets_is_not_shuffled(spark, tmp_path):
    index = ContentIndex(str(tmp_path / "index"), 8)
    empty = index.lookup(hashed(spark, [("h1", "k", "b", "txt")])).collect()
    assert [(r.original_key, r.is_kept) for r in empty] == [("k", True)]
    row = lambda k, n: (f"h{k}", f"old/{k}-{n}", "b", n)
    schema = "content_hash string, index_key string, index_bucket string, line long"
    index.append(spark.createDataFrame([row(k, 1) for k in range(50)], schema))
    index.append(spark.createDataFrame([row(k, 2) for k in range(0, 50, 2)], schema))
    files = hashed(spark, [(f"h{k}", f"new/{k}", "b", "txt") for k in range(40, 60)] + [("h55", "new/x", "b", "txt")])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ContentIndex(str(tmp_path / "index")).lookup(files)  # the buckets are those it was written with
        got = {r.original_key: (r.kept_key, r.is_kept) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {f"new/{k}": ((f"old/{k}-{2 - k % 2}", False) if k < 50 else (f"new/{k}", True)) for k in range(40, 60)} | {"new/x": ("new/55", False)}
    assert "Bucketed: true" in plan and len(re.findall("hashpartitioning", plan)) == len(re.findall(r"hashpartitioning\(content_hash#\d+, 8\), REPARTITION_BY_NUM", plan))
    want = dedup.with_index(files, index.read(spark))
    assert found.select(sorted(want.columns)).exceptAll(want.select(sorted(want.columns))).count() == 0
