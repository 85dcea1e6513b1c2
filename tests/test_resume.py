"""Deduplication of files by reference, and runs that go on where an earlier one was cut off."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.journal import Journal, fingerprint
from siftline.operators import dedup
from siftline.plans import pipelines
from siftline.sources.content_index import ContentIndex

PARTS = ("summary", "placed", "merged", "failures", "checkpoint")


def source(spark, folder, by="path"):
    folder.mkdir()
    inner = folder / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "one")
        z.writestr("own.txt", "own")
    with zipfile.ZipFile(folder / "a.zip", "w") as z:
        z.writestr("one.txt", "one")
        z.writestr("in.zip", inner.read_bytes())
    os.remove(inner)
    for name, data in (("x.txt", b"one"), ("2024-y.txt", b"two"), ("bad.zip", b"damaged"), ("._r", b"r"), ("done.txt", b"three")):
        (folder / name).write_bytes(data)
    names = sorted(os.listdir(folder))
    rows = [("b", n, os.path.getsize(folder / n), str(folder / n) if by == "path" else bytearray((folder / n).read_bytes())) for n in names]
    return spark.createDataFrame(rows, f"bucket_alias string, key string, size long, {by} {'string' if by == 'path' else 'binary'}")


def known(spark):
    return spark.createDataFrame([("b", "done.txt")], "bucket_alias string, key string")


def told(result):
    drop = lambda part: result[part].drop("error") if part == "failures" else result[part]
    return {part: sorted(map(tuple, drop(part).collect()), key=repr) for part in PARTS}


def test_files_by_reference_give_what_their_contents_give(spark, tmp_path):
    by_path = told(pipelines.deduplicate(source(spark, tmp_path / "s"), known(spark)))
    by_content = told(pipelines.deduplicate(source(spark, tmp_path / "t", "content"), known(spark)))
    assert by_path == by_content
    assert [r[1] for r in by_path["placed"]] == ["2024-y.txt", "a.zip!in.zip!deep.txt", "a.zip!in.zip!own.txt"] or {r[1] for r in by_path["placed"]} == {"2024-y.txt", "a.zip!in.zip!deep.txt", "a.zip!in.zip!own.txt"}
    assert [r[1] for r in by_path["failures"]] == ["bad.zip"] and ("b", "bad.zip") not in by_path["checkpoint"]


@pytest.mark.parametrize("stage", ["keep_first", "exact_names", "to_checkpoint"])
def test_a_run_goes_on_after_each_stage(spark, tmp_path, monkeypatch, stage):
    files = source(spark, tmp_path / "s")
    want = told(pipelines.deduplicate(files, known(spark)))
    journal = Journal(spark, str(tmp_path / "journal"))
    with monkeypatch.context() as broken:
        broken.setattr(dedup, stage, lambda *_: (_ for _ in ()).throw(RuntimeError("cut off")))
        with pytest.raises(RuntimeError, match="cut off"):
            pipelines.deduplicate(files, known(spark), journal=journal)
    for name in os.listdir(tmp_path / "s"):  # what was read once is not read again
        os.remove(tmp_path / "s" / name)
    assert told(pipelines.deduplicate(files, known(spark), journal=journal)) == want
    for part in ("keep_first", "exact_names"):
        monkeypatch.setattr(dedup, part, lambda *_: (_ for _ in ()).throw(RuntimeError("made again")))
    assert told(pipelines.deduplicate(files, known(spark), journal=journal)) == want


def test_a_changed_input_is_made_anew(spark, tmp_path):
    journal = Journal(spark, str(tmp_path / "journal"))
    made = []
    rows = spark.range(5)
    step = lambda of: journal.step("s", lambda: made.append(1) or of.withColumn("v", F.col("id") * 2), of).count()
    assert [step(rows), step(rows.repartition(3)), step(spark.range(6)), step(rows)] == [5, 5, 6, 5] and len(made) == 3
    assert fingerprint(rows.union(rows)) != fingerprint(rows) and fingerprint(rows.limit(0)) == fingerprint(spark.range(0))


def test_an_index_in_buckets_serves_the_job(spark, tmp_path):
    files = source(spark, tmp_path / "s")
    index = ContentIndex(str(tmp_path / "index"), 4)
    one = files.limit(1).select(F.sha2(F.lit("one"), 256).alias("content_hash"), F.lit("old/one.txt").alias("index_key"), F.lit("b").alias("index_bucket"), F.lit(1).alias("line"))
    index.append(one)
    got = told(pipelines.deduplicate(files, known(spark), index))
    assert {r[1] for r in got["placed"]} == {"2024-y.txt", "a.zip!in.zip!own.txt"}
    assert got == told(pipelines.deduplicate(files, known(spark), index.read(spark)))
