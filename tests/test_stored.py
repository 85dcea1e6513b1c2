"""Running values in chunks, archives and copies by reference, streams with state."""

import hashlib
import io
import json
import os
import random
import struct
import subprocess
import sys
import zipfile
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from siftline.operators import ledger, runs, scans, select
from siftline.sources import mailbox, stores, zips
from siftline.streaming import logs, state


@pytest.fixture
def many_chunks(spark):
    """Ranges stay as many as the setting says, as on a large table."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scans_equal_windows_over_a_hot_lane(spark, many_chunks):
    lane = F.when(F.col("id") % 10 < 8, 0).when(F.col("id") % 10 == 8, 1)  # four fifths in one lane, a tenth in a null one
    rows = spark.range(60_000).select(lane.alias("lane"), F.col("id").alias("i"), (F.xxhash64("id") % 1000).alias("v"), F.when(F.xxhash64("id", F.lit(2)) % 3 > 0, (F.xxhash64("id", F.lit(1)) % 3).cast("string")).alias("c"))
    dealt = scans.deal(rows, ["lane"], ["i"])
    sizes = [r["count"] for r in dealt.groupBy(scans.CHUNK).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 60_000 / 4
    w = W.partitionBy("lane").orderBy("i")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    found = scans.running_sum(dealt, "s", F.col("v"), ["lane"], ["i"])
    found = scans.running_sum(found, "before", F.col("v"), ["lane"], ["i"], before=True)
    found = scans.running_count(found, "n", ["lane"], ["i"])
    found = scans.running_max(found, "m", F.col("v"), ["lane"], ["i"])
    found = scans.done(scans.previous(found, "p", F.col("c"), ["lane"], ["i"]))
    want = rows.select("*", F.sum("v").over(upto).alias("s"), F.coalesce(F.sum("v").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.row_number().over(w).cast("bigint").alias("n"), F.max("v").over(upto).alias("m"), F.lag(F.struct(F.col("c").alias("value"))).over(w).alias("p"))
    assert found.columns == want.columns
    assert found.exceptAll(want).count() == 0 and found.count() == want.count()


def test_lanes_are_dealt_and_give_the_same(spark, many_chunks):
    r = random.Random(2)
    asked = [("hot" if k % 9 else "b", k, float(r.randint(0, 4000)) / 4, r.randint(1, 5)) for k in range(3000)]
    got = {(x.lane, x.i): x.start for x in runs.schedule(spark.createDataFrame(asked, "lane string, i int, at double, n int"), 120).collect()}
    free: dict = {}
    for lane, i, at, n in asked:  # the pacer itself: wait for the time and for what was reserved, then reserve n more
        start = max(at, free.get(lane, 0.0))
        free[lane] = start + n * 0.5
        assert got[lane, i] == pytest.approx(start)
    mails = spark.createDataFrame([("in", k * 3) for k in range(2000)] + [("out", 5)], "mailbox string, uid long")
    found = {(x.mailbox, x.batch): x.uids for x in ledger.batches(mails, 20).collect()}
    assert len(found) == 101 and found["in", 7] == [k * 3 for k in range(140, 160)] and found["out", 0] == [5]
    assert sorted(x.turn for x in ledger.round_robin(spark.range(900).select(F.lit("me").alias("identity"), F.col("id").alias("position"))).collect()) == list(range(1, 901))
    members = [("z", k, r.randint(0, 9), 20) for k in range(2000)]
    total, kept = 0, set()
    for _, k, size, zip_size in members:
        total += size
        kept |= {k} if size == 0 or total <= 100 * zip_size else set()
    assert {x.position for x in runs.within_budget(spark.createDataFrame(members, "archive string, position int, size long, zip_size long")).where("kept").collect()} == kept
    causes = [r.choice("aab") for _ in range(3000)]
    errors = spark.createDataFrame([(1, k, c, f"k{k}") for k, c in enumerate(causes)], "poll int, position int, cause string, key string")
    streaks, at = Counter(), 0
    while at < len(causes):
        end = at
        while end < len(causes) and causes[end] == causes[at]:
            end += 1
        if end - at > 1:
            streaks[causes[at], f"k{at}", end - at - 1] += 1
        at = end
    assert Counter((x.cause, x.first_key, x.repeated) for x in runs.error_streaks(errors).collect()) == streaks


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name) if method == zipfile.ZIP_STORED else name, data)
    return str(path)


def listed(spark, *paths):
    return spark.createDataFrame([(os.path.basename(p), p, os.path.getsize(p)) for p in paths], "key string, path string, size long")


def test_directories_are_those_of_the_library(tmp_path):
    r = random.Random(1)
    for k in range(12):
        path = tmp_path / f"{k}.zip"
        with zipfile.ZipFile(path, "w", r.choice((zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED))) as z:
            for m in range(r.choice((0, 1, 7, 300))):
                name = r.choice(("a", "d/b", "é", "日本", "x" * 200)) + str(m) + r.choice(("", "", "/"))
                z.writestr(name, b"" if name.endswith("/") else r.randbytes(r.choice((0, 1, 5000))) + b"z" * r.choice((0, 100_000)))
            z.comment = b"PK" * r.choice((0, 300))
        if k % 4 == 3:
            path.write_bytes(b"#!/bin/sh\n" + path.read_bytes())
        with zipfile.ZipFile(path) as z, stores.opened(str(path)) as file:
            found = list(zips.members_of(file))
            want = [i for i in z.infolist() if not i.is_dir()]
            assert [(m["part"], m["size"], m["packed"], m["crc"]) for m in found] == [(i.filename, i.file_size, i.compress_size, i.CRC) for i in want]
            for m, i in zip(found, want, strict=True):
                assert b"".join(zips.stream(file, m)) == z.read(i)


def test_members_that_are_not_what_the_directory_says(spark, tmp_path):
    good = archive(tmp_path / "good.zip", [("a.txt", b"a" * 5000), ("__MACOSX/x", b"x"), ("b.txt", b"")])
    raw = (tmp_path / "good.zip").read_bytes()
    at = raw.find(b"PK\x01\x02")
    lies = bytearray(raw)
    lies[at + 24 : at + 28] = struct.pack("<I", 10)  # a size that hides a bomb
    locked = bytearray(raw)
    locked[at + 8] |= 1
    other = bytearray(raw)
    other[at + 10 : at + 12] = struct.pack("<H", 12)
    for name, data in (("lies", lies), ("locked", locked), ("other", other), ("bad", b"nothing here"), ("cut", raw[:40] + raw[-22:])):
        (tmp_path / f"{name}.zip").write_bytes(data)
    files = listed(spark, good, *[str(tmp_path / f"{n}.zip") for n in ("lies", "locked", "other", "bad", "cut")])
    files = files.unionByName(spark.createDataFrame([("gone.zip", str(tmp_path / "gone.zip"), 1)], files.schema))
    found = {(r.key, r.part): r for r in zips.digests(zips.within_budget(zips.directory(files))).collect()}
    assert found["good.zip", "a.txt"].content_hash == hashlib.sha256(b"a" * 5000).hexdigest() and found["good.zip", "b.txt"].bytes == 0
    assert ("good.zip", "__MACOSX/x") not in found
    told = lambda name: found[name, "a.txt"].error
    assert "not what the directory says" in told("lies.zip") and "encrypted" in told("locked.zip") and "method 12" in told("other.zip")
    assert {k for k, part in found if part is None} == {"bad.zip", "cut.zip", "gone.zip"}
    assert found["lies.zip", "b.txt"].error is None  # an error is the member's own


def test_budgets_and_depth(spark, tmp_path):
    bomb = archive(tmp_path / "bomb.zip", [("first", b"0" * 2_000_000), ("second", b"1"), ("empty", b"")])
    assert [r.part for r in zips.within_budget(zips.directory(listed(spark, bomb))).collect()] == ["empty"]
    data = b"note"
    for k in range(4):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(f"m{k}.zip" if k else "note.txt", data)
        data = out.getvalue()
    (tmp_path / "r.zip").write_bytes(data)
    (tmp_path / "plain.txt").write_bytes(b"plain")
    files = listed(spark, str(tmp_path / "r.zip"), str(tmp_path / "plain.txt"))
    got = {(r.root_key, r.key, r.depth, r.content_hash, bool(r.error)) for r in zips.tree(files).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("r.zip", "r.zip!m3.zip!m2.zip!m1.zip!note.txt", 4, sha(b"note"), False), ("plain.txt", "plain.txt", 0, sha(b"plain"), False)}
    deep = [r for r in zips.tree(files, depth=2).collect() if r.error]
    assert [(r.key, r.depth) for r in deep] == [("r.zip!m3.zip!m2.zip", 2)] and "deeper than 2" in deep[0].error
    assert zips.tree(files.limit(0)).count() == 0


def sparse_zip(path, size):
    """A stored member of zeros that takes no room on the disk, and one that does."""
    crc, zeros = 0, bytes(1 << 24)
    for _ in range(size >> 24):
        crc = zlib.crc32(zeros, crc)
    name = b"zeros.bin"
    with open(path, "wb") as f:
        f.write(b"PK\x03\x04" + struct.pack("<5H3I2H", 20, 0, 0, 0, 33, crc, size, size, len(name), 0) + name)
        f.seek(size, 1)
        at = f.tell()
        f.write(b"PK\x01\x02" + struct.pack("<6H3I5H2I", 20, 20, 0, 0, 0, 33, crc, size, size, len(name), 0, 0, 0, 0, 0, 0) + name)
        f.write(b"PK\x05\x06" + struct.pack("<4H2IH", 0, 0, 1, 1, 46 + len(name), at, 0))


MEASURED = """
import hashlib, resource, sys
from siftline.sources import stores, zips
with stores.opened(sys.argv[1]) as file:
    (member,) = zips.members_of(file)
    digest = hashlib.sha256()
    for piece in zips.stream(file, member):
        digest.update(piece)
print(digest.hexdigest(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


def test_a_member_of_three_gigabytes_is_streamed(spark, tmp_path):
    path, size = str(tmp_path / "large.zip"), 3 << 30
    sparse_zip(path, size)
    out = subprocess.run([sys.executable, "-c", MEASURED, path], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    digest, peak = out.stdout.split()
    assert int(peak) < 600
    (found,) = zips.digests(zips.within_budget(zips.directory(listed(spark, path)))).collect()
    assert (found.bytes, found.content_hash, found.error) == (size, digest, None)


def test_one_archive_is_many_tasks(spark, tmp_path, many_chunks):
    path = archive(tmp_path / "many.zip", [(f"{k:04d}", os.urandom(3000)) for k in range(400)])
    members = zips.within_budget(zips.directory(listed(spark, path)))
    dealt = stores.by_bytes(members, "packed", "key", "position", task_bytes=50_000)
    tasks = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(tasks) > 8 and sum(tasks) == 400 and max(tasks) < 100


def test_copies_by_reference(spark, tmp_path):
    data = {f"s/{k}": os.urandom(k * 1000) for k in range(6)}
    for name, body in data.items():
        os.makedirs(tmp_path / "s", exist_ok=True)
        (tmp_path / name).write_bytes(body)
    rows = [(f"{tmp_path}/{n}", f"file://{tmp_path}/t/deep/{n}", len(b)) for n, b in data.items()] + [(f"{tmp_path}/none", f"{tmp_path}/t/none", None)]
    files = spark.createDataFrame(rows, "source string, target string, size long")
    first = {r.source: r for r in stores.copy(files).collect()}
    for name, body in data.items():
        done = first[f"{tmp_path}/{name}"]
        assert (done.bytes, done.content_hash, done.outcome) == (len(body), hashlib.sha256(body).hexdigest(), "written")
        assert (tmp_path / "t/deep" / name).read_bytes() == body
    assert first[f"{tmp_path}/none"].outcome.startswith("failed")
    (tmp_path / "t/deep/s/3").write_bytes(b"cut off")
    outcomes = lambda how: Counter(r.outcome.split(":")[0] for r in stores.copy(files, existing=how).collect())
    assert outcomes("skip") == {"kept": 5, "written": 1, "failed": 1}
    assert outcomes("error") == {"failed": 7}
    assert outcomes("overwrite") == {"written": 6, "failed": 1}
    assert not [f for _, _, names in os.walk(tmp_path / "t") for f in names if f.endswith(".tmp")]
    with pytest.raises(ValueError):
        stores.copy(files, existing="maybe")


def write_lines(folder, name, *entries, end="\n"):
    folder.mkdir(exist_ok=True)
    with (folder / name).open("a") as file:
        file.write("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + end)


def stats(n):
    return {"level": "info", "msg": "s", "stats": {"bytes": n, "transfers": 1}}


def error(cause, key):
    return {"level": "ERROR", "msg": cause, "object": key}


def shown(rows):
    return [(r.poll, r.lane, r.kind, r.bytes, r.cause, r.first_key, r.repeated) for r in rows.orderBy("poll", "lane", "number").collect()]


def test_a_stream_that_was_killed_gives_the_same(spark, tmp_path):
    results = []
    for name in ("whole", "killed"):
        folder, run = tmp_path / f"log-{name}", str(tmp_path / name)
        for poll in range(3):
            write_lines(folder, "a.log", stats(10 * poll + 5), error("x", f"{poll}a"), error("x", f"{poll}b"), error("y", "c"), stats(7 * poll))
            write_lines(folder, "b.log", error("z", f"{poll}"), *[error("z", "more")] * poll)
            if name == "killed" and poll == 1:

                def dies(batch, number):
                    batch.write.mode("overwrite").parquet(f"{run}/out/poll={number:09d}")
                    raise RuntimeError("killed")

                with pytest.raises(Exception, match="killed"):
                    state.to_table(state.lane_changes(logs.lines(spark, str(folder))), run, write=dies).awaitTermination()
            logs.follow(logs.lines(spark, str(folder)), run)
        results.append(shown(logs.changes(spark, run)))
    whole, killed = results
    assert whole == killed and len([r for r in whole if r[2] == "poll"]) == 6
    assert [r[3] for r in whole if r[1] == "a" and r[2] == "poll"] == [0, 7, 7]
    assert [r[4:] for r in whole if r[1] == "b" and r[2] == "streak"] == [("z", "1", 1), ("z", "2", 2)]


def test_summaries_join_streaks_across_batches():
    import pandas as pd

    causes = ["a", "a", "b", "c", "c", "c", None, None, "a"]
    rows = pd.DataFrame({"lane": "l", "part": "p", "position": range(9), "level": "error", "msg": causes, "object": [str(k) for k in range(9)], "stats": [None] * 9})
    (one,) = state.summaries([rows])
    assert [(i["cause"], i["first_key"], i["n"]) for i in one["islands"][0]] == [("a", "0", 2), ("c", "3", 3), (None, "6", 2), ("a", "8", 1)]


def test_progress_is_told_at_a_tick(spark, tmp_path):
    import time

    folder, run = tmp_path / "log", str(tmp_path / "run")
    write_lines(folder, "a.log", stats(5))
    query = logs.start(logs.lines(spark, str(folder)), run, every="200 milliseconds", progress_seconds=0.5)
    try:
        deadline = time.time() + 60
        told = []
        while time.time() < deadline and not told:
            time.sleep(1)
            told = [r for r in shown(logs.changes(spark, run)) if r[2] == "progress"]
    finally:
        query.stop()
    assert told[0][1:4] == ("a", "progress", 5)


def test_truncated_and_removed_logs(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("one\ntwo\n")
    (tmp_path / "b.log").write_text("x\n")
    reader = logs.LogReader(str(tmp_path))
    reader.initialOffset()
    first = reader.latestOffset()
    assert first == {"a.log": 8, "b.log": 2}
    log.write_text("new\n")
    os.remove(tmp_path / "b.log")
    second = reader.latestOffset()
    assert second == {"a.log": 4}
    assert [v for p in reader.partitions(first, second) for _, _, v in reader.read(p)] == ["new"]


def test_ledger_flushes_in_time_and_at_the_end(spark, tmp_path):
    schema = "mailbox string, uidvalidity long, uid long, ingested_at string"
    feed, path = str(tmp_path / "feed"), str(tmp_path / "ledger")
    want = {}
    for k in range(3):
        part = [("a", 1, u, f"20{30 - k + u % 2}") for u in range(k, k + 4)]
        for box, epoch, uid, at in part:
            want[box, epoch, uid] = min(at, want.get((box, epoch, uid), "9"))
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        found = logs.ledger_follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), path, str(tmp_path / "state"), flush_seconds=3600)
        assert {tuple(r)[:3]: r.ingested_at for r in found.collect()} == want
    assert len(logs.numbered(spark, path, "snapshot=")) == 3  # none in time, one at each end
    assert {tuple(r)[:3]: r.ingested_at for r in logs.latest_snapshot(spark, path).collect()} == want


def test_ledger_is_flushed_when_the_stream_fails(spark, tmp_path):
    schema = "mailbox string, uidvalidity long, uid long, ingested_at string"
    feed, path = str(tmp_path / "feed"), str(tmp_path / "ledger")
    spark.createDataFrame([("a", 1, 1, "2024")], schema).write.parquet(feed)
    logs.ledger_follow(spark.readStream.schema(schema).parquet(feed), path, str(tmp_path / "state"))
    broken = spark.readStream.schema(schema).parquet(feed).withColumn("ingested_at", F.expr("raise_error('no')").cast("string"))
    spark.createDataFrame([("a", 1, 2, "2024")], schema).write.mode("append").parquet(feed)
    with pytest.raises(Exception, match="no"):
        logs.ledger_follow(broken, path, str(tmp_path / "state"))
    assert logs.latest_snapshot(spark, path).count() == 1


def test_mailboxes_are_followed_through_new_validities(tmp_path):
    def put(box, epoch, *uids):
        (tmp_path / box).mkdir(exist_ok=True)
        (tmp_path / box / "uidvalidity").write_text(str(epoch))
        for u in uids:
            (tmp_path / box / f"{u}.eml").write_bytes(f"{box}{epoch}-{u}".encode())

    def batch(stream, start):
        end = json.loads(json.dumps(stream.latestOffset()))
        return end, [(r[0], r[1], r[2]) for p in stream.partitions(start, end) for r in stream.read(p)]

    note = str(tmp_path / ".position")
    make = lambda: mailbox.MailboxStream(mailbox.FolderReader({"folder": str(tmp_path)}), 2, note)
    stream = make()
    put("in", 1, 1, 2, 3)
    put("out", 7, 5)
    at, got = batch(stream, stream.initialOffset())
    assert at == {"in": [1, 2], "out": [7, 5]} and got == [("in", 1, 1), ("in", 1, 2), ("out", 7, 5)]
    put("in", 1, 4, 10)
    stream = make()  # a restart: the note says where admission stands
    at, got = batch(stream, at)
    assert got == [("in", 1, 3), ("in", 1, 4)]
    put("in", 2, 1, 2)  # a new validity: what is there counts anew
    (tmp_path / "out" / "5.eml").unlink()
    at, got = batch(stream, at)
    assert at == {"in": [2, 2], "out": [7, 5]} and got == [("in", 2, 1), ("in", 2, 2)]
    planned = stream.partitions(at, {"in": [2, 4]})
    put("in", 3)
    assert [r for p in planned for r in stream.read(p)] == []  # renewed since it was planned
    (tmp_path / "out" / "uidvalidity").unlink()
    (tmp_path / "out").rmdir()
    assert set(stream.latestOffset()) == {"in"}


def test_first_arrivals_equal_the_table(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice(["d/a.xlsx", "d/b.xlsx", "d/._c.xlsx", "d/~$d.xlsx", "d/e.xlsx"]), k) for k in range(60)]
    schema = "key string, grp string, position long"
    full = [(k, k[2:3], p) for k, p in rows]
    complete = spark.createDataFrame([("e",)], "grp string")
    feed = str(tmp_path / "feed")
    for k in range(0, 60, 20):
        spark.createDataFrame(full[k : k + 20], schema).coalesce(1).write.mode("append").parquet(feed)
        done = state.dispatched(spark.readStream.schema(schema).parquet(feed), complete)
        state.to_table(done, str(tmp_path / "run")).awaitTermination()
    got = Counter(tuple(x) for x in spark.read.schema(done.schema).parquet(str(tmp_path / "run/out")).select("key", "position", "outcome").collect())
    want = Counter(tuple(x) for x in select.dispatch(spark.createDataFrame(full, schema), complete).select("key", "position", "outcome").collect())
    assert got == want
