"""What keeps tasks and batches bounded on tables that are one file."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftline.sources import archives, mailbox, stores, vobject, zips

SF = "/root/testdata/sf0.001"


def dealt(spark, name):
    """Does the query work in as many tasks as an exchange has, though its table is one file?"""
    return entry.queries()[name](spark, SF).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_messages_are_dealt_before_they_are_parsed(spark):
    assert dealt(spark, "eml_attachments")


def test_header_fields_are_parsed_once(monkeypatch):
    from email.headerregistry import HeaderRegistry

    parsed = []
    plain = HeaderRegistry.__call__
    monkeypatch.setattr(HeaderRegistry, "__call__", lambda self, name, value: (parsed.append(name), plain(self, name, value))[1])
    head = b'Content-Type: multipart/mixed; boundary="parse once"\n\n'
    part = b"--parse once\nContent-Type: application/x-parse-once\nContent-Disposition: attachment; filename=%s\n\n%s\n"
    message = head + part % (b'"x/a.txt"', b"1") + part % (b'"a.txt"', b"2") + b"--parse once--\n"
    for _ in range(3):
        assert list(archives.attachments(message)) == [("a.txt", b"1"), ("a-2.txt", b"2")]
    assert len(parsed) == len(set(parsed)) + 2  # two types, and two names of attachments


def test_workbooks_are_dealt_before_they_are_made(spark):
    assert dealt(spark, "workbook_sheets")


def test_tasks_that_make_files_follow_the_rows(spark, monkeypatch):
    from siftline import session

    monkeypatch.setattr(session, "TASK_ROWS", 10)
    assert session.spread(spark.range(995), "id").rdd.getNumPartitions() == 100
    assert session.spread(spark.range(0), "id").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert entry.queries()["workbook_sheets"](spark, SF).rdd.getNumPartitions() == 15


def test_icons_come_in_bounded_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert dealt(spark, "icon_images")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 4 << 20


def test_icons_take_one_worker_a_task(spark):
    plan = entry.queries()["icon_images"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sum(plan.count(f"{name} run(") for name in ("MapInArrow", "MapInPandas")) == 1


def test_only_the_largest_image_is_copied():
    import tracemalloc

    part = lambda kind, data: kind + (len(data) + 8).to_bytes(4, "big") + data
    image = b"\x89PNG" + bytes(1 << 20)
    content = part(b"icns", b"".join(part(kind, image) for kind in (b"ic07", b"ic09", b"ic14", b"ic08")))
    tracemalloc.start()
    found = list(archives.largest_image(content))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [("ic09", image)] and most < 2 << 20
    assert list(archives.icon_images(content)) == [(kind, image) for kind in ("ic07", "ic09", "ic14", "ic08")]


def test_calendar_tasks_follow_the_bytes(spark, monkeypatch):
    monkeypatch.setattr(vobject, "TASK_BYTES", 1000)
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:"), F.repeat(F.lit("x"), 400), F.lit("\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    files = spark.range(100).select(F.col("id").cast("string").alias("key"), F.encode(body, "UTF-8").alias("content"))
    assert vobject.properties(files).rdd.getNumPartitions() >= 40
    assert vobject.calendar_text(files).count() == 100
    assert vobject.properties(files.limit(0)).count() == 0


def test_lines_of_calendars_are_read_and_sorted_once(spark):
    files = spark.createDataFrame([("a", bytearray(b"BEGIN:VCALENDAR\nEND:VCALENDAR"))], "key string, content binary")
    plan = vobject.calendar_text(files)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate posexplode") == 1 and "Join" not in plan and "[key" in plan


def test_markers_of_groups_meet_twice_and_lines_once(spark):
    from siftline.operators import select
    from siftline.plans import views

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    h, g = "0" * 16, "1" * 16
    names = spark.createDataFrame([(n,) for n in (f"a-{h}-1of2-x.csv", f"a-{h}-01of2-y.csv", f"a-{h}-2of02-x.csv", f"a-{g}-1of2-x.csv", f"a-{g}-2of3-x.csv", f"b-{g}-x.csv", f"b-{h}-3of2-x.csv", f"c-{h}.csv", f"c-{h}-{g}-1of1-.csv")], "name string")
    states = select.group_states(names)
    assert plan(states).count("Exchange hashpartitioning") == 2
    assert sorted(map(tuple, states.collect())) == [(f"a-{h}", True), (f"a-{g}", False), (f"c-{h}", True), (f"c-{h}-{g}", True)]
    lines = plan(views.dest_names(spark, SF))
    assert "Join" not in lines and lines.count("Exchange") == 1


def test_first_arrivals_take_plain_rows():
    from pyspark.sql import Row

    from siftline.streaming import state

    class Seen:
        value = None
        exists = lambda self: self.value is not None

        def update(self, value):
            self.value = value

    marker = state.FirstArrival(["key", "position"], None)
    marker.seen = Seen()
    arrive = lambda *positions: [(r.position, r.first) for r in marker.handleInputRows(("a",), iter([Row(key="a", position=p) for p in positions]), None)]
    assert arrive(5, 3, 4) == [(3, True), (4, False), (5, False)] and arrive(1, 2) == [(1, False), (2, False)]
    assert marker.seen.value == (3,)


def test_small_files_are_many_tasks(spark, tmp_path, monkeypatch):
    asked = []
    plain = stores.by_bytes
    monkeypatch.setattr(stores, "by_bytes", lambda rows, size, *more, **named: (asked.append(rows.agg(F.sum(size)).first()[0]), plain(rows, size, *more, **named))[1])
    (tmp_path / "a").write_bytes(b"12")
    files = spark.createDataFrame([(f"{tmp_path}/a", f"{tmp_path}/b{k}", 2) for k in range(3)], "source string, target string, size long")
    assert [tuple(r) for r in stores.copy(files).select("bytes", "outcome").collect()] == [(2, "written")] * 3
    assert asked == [3 * (2 + stores.FILE_BYTES)]


def test_rows_leave_tasks_in_batches():
    import pyarrow as pa

    sizes = lambda rows, **most: [b.num_rows for b in stores.batches_of(rows, ["a", "b"], [pa.int64(), pa.binary()], **most)]
    assert sizes([(k, b"") for k in range(2500)]) == [1000, 1000, 500]
    assert sizes([(k, b"x" * 60) for k in range(5)], most_bytes=100) == [2, 2, 1] and sizes([]) == []


def test_a_mailbox_is_read_in_ranges(tmp_path, monkeypatch):
    box = tmp_path / "boxes" / "in"
    box.mkdir(parents=True)
    uids = [1, 2, 5, 9, 40, 41, 90]
    for u in uids:
        (box / f"{u}.eml").write_bytes(b"%d" % u)
    monkeypatch.setattr(mailbox, "RANGE", 2)
    reader = mailbox.FolderReader({"folder": str(tmp_path / "boxes")})
    stream = mailbox.MailboxStream(reader, None, None, 3)
    parts = stream.partitions(stream.initialOffset(), stream.latestOffset())
    assert [[r[2] for r in stream.read(p)] for p in parts] == [[1, 2, 5], [9, 40, 41], [90]]
    assert [[r[2] for r in stream.read(p)] for p in stream.partitions({"in": [0, 9]}, {"in": [0, 41]})] == [[40, 41]]
    assert len(mailbox.MailboxStream(reader, None, None).partitions({}, {"in": [0, 90]})) == 1


def test_planning_a_mailbox_holds_little_of_each_message(tmp_path):
    import json
    import tracemalloc

    count = 20_000
    for box in ("in", "in/old", "out"):
        (tmp_path / "boxes" / box).mkdir(parents=True)
    for uid in range(1, count + 1):
        (tmp_path / "boxes" / "in" / f"{uid}.eml").touch()
    (tmp_path / "boxes" / "in" / "old" / "3.eml").touch()
    (tmp_path / "boxes" / "linked").symlink_to(tmp_path / "boxes" / "in")
    reader = mailbox.FolderReader({"folder": str(tmp_path / "boxes")})
    stream = mailbox.MailboxStream(reader, None, None, 4)
    tracemalloc.start()
    end = json.loads(json.dumps(stream.latestOffset()))
    parts = stream.partitions(stream.initialOffset(), end)
    planned = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    first = next(stream.read(parts[0]))
    read = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert planned < 50 * count and read < 100 * count  # bytes; a quarter of the messages is a task's
    assert end == {"in": [0, count], "in/old": [0, 3], "linked": [0, count], "out": [0, 0]} and first == ("in", 0, 1, b"")
    quarters = [(k * count // 4, (k + 1) * count // 4) for k in range(4)]
    assert [(p.name, p.above, p.upto) for p in parts] == [("in", *q) for q in quarters] + [("in/old", 0, 3)] + [("linked", *q) for q in quarters]


def zipped(compression, **members):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", compression) as z:
        for name, data in members.items():
            z.writestr(name.replace("_", "."), data)
    return out.getvalue()


def under(folder):
    import os

    return [f"{d}/{f}" for d, _, names in os.walk(folder) for f in names]


def test_stored_archives_are_read_where_they_lie(spark, tmp_path):
    import hashlib

    inner = zipped(0, a_txt=b"a" * 99, b_zip=zipped(8, c_txt=b"c"))
    (tmp_path / "r.zip").write_bytes(zipped(0, n_txt=b"n", s_zip=inner))
    (tmp_path / "d.zip").write_bytes(zipped(8, s_zip=inner, t_zip=inner))
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}") for n in ("r.zip", "d.zip")], "key string, path string")
    members = zips.within_budget(zips.directory(files)).where("part like '%.zip'")
    lying = {(r.key, r.part): r for r in zips.spilled(members, f"{tmp_path}/spill").collect()}
    for row in lying.values():
        with open(row.spill, "rb") as file:
            file.seek(row.start)
            assert row.error is None and file.read(row.size) == inner
    assert lying["r.zip", "s.zip"].spill == f"{tmp_path}/r.zip" and len(under(tmp_path / "spill")) <= 2
    got = {(r.key, r.content_hash) for r in zips.tree(files.selectExpr("*", "1L as size")).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {("r.zip!n.txt", sha(b"n"))} | {(f"{k}!{n}", sha(b)) for k in ("r.zip!s.zip", "d.zip!s.zip", "d.zip!t.zip") for n, b in (("a.txt", b"a" * 99), ("b.zip!c.txt", b"c"))}


def test_an_archive_in_a_file_ends_where_it_ends(spark, tmp_path):
    import struct
    import zlib

    inner = bytearray(zipped(0, a_txt=b"abc"))
    at = inner.find(b"PK\x01\x02")
    behind = b"what stands behind the archive"
    inside = bytes(inner[inner.find(b"abc"):])
    for bytes_of in (inside + behind[:4], b"abc" + b"x" * 500):  # sizes that reach beyond the archive, and beyond the file
        claims = bytearray(inner)
        claims[at + 16 : at + 28] = struct.pack("<3I", zlib.crc32(bytes_of), len(bytes_of), len(bytes_of))
        (tmp_path / "f").write_bytes(b"ahead" + claims + behind)
        file = spark.createDataFrame([("a.zip", f"{tmp_path}/f", 5, len(inner))], "key string, path string, start long, size long")
        (row,) = zips.digests(zips.directory(file)).collect()
        assert row.error == "EOFError: ends too early"


def test_a_file_that_cannot_be_written_is_no_members_error(tmp_path):
    import pytest

    (tmp_path / "f").write_bytes(b"")
    with stores.Pack(f"{tmp_path}/f/below") as pack, pytest.raises(RuntimeError, match="cannot be written"):
        pack.add([b"x"])
    with stores.Pack(f"{tmp_path}/g") as pack:
        assert [pack.add(p)[1:] for p in ([b"ab", b"c"], [], [b"d"])] == [(0, 3), (3, 0), (3, 1)]
    assert (tmp_path / "g" / pack.path.rpartition("/")[2]).read_bytes() == b"abcd"


def test_trees_leave_rows_only_and_archives_come_in_shares(spark, tmp_path, monkeypatch):
    from siftline import session
    from siftline.plans import stored

    monkeypatch.setattr(stored, "SHARE", 800_000)
    monkeypatch.setattr(session, "shared_root", lambda spark: f"file://{tmp_path}")
    told = []
    plain = zips.tree
    monkeypatch.setattr(zips, "tree", lambda files: (told.append(files.count()), plain(files))[1])
    found = entry.queries()["zip_nested"](spark, SF)
    assert found.count() == 2 * sum(told) == 2 * spark.read.parquet(f"{SF}/documents.parquet").count() and len(told) >= 2
    left = [f.rpartition("/")[2] for f in under(tmp_path)]
    assert all(name.removeprefix(".").removesuffix(".crc").startswith(("part-", "_SUCCESS")) for name in left)
    assert sum(name.startswith("part-") for name in left) == len(found.inputFiles())
