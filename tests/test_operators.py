"""Operators on small cases that the queries' data does not have."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedup, ledger, runs, select
from siftline.plans import pipelines
from siftline.sources import archives, listing, vobject
from siftline.sources.mailbox import MailboxSource

HASHED = "original_key string, bucket_alias string, extension string, content_hash string"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_keep_first_prefers_dated_keys_then_order(spark):
    files = spark.createDataFrame([("0000-00-00-a.pdf", "a", "pdf", "h"), ("2020-01-01-b.pdf", "b", "pdf", "h"), ("z", "a", "(none)", "g"), ("z", "b", "(none)", "g")], HASHED)
    kept = dedup.keep_first(files)
    assert rows(kept.where("is_kept"), "original_key", "bucket_alias") == [("2020-01-01-b.pdf", "b"), ("z", "a")]
    merged = dedup.merge_records(kept).collect()
    assert {(m.duplicate_key, m.kept_original_key, m.kept_path) for m in merged} == {("0000-00-00-a.pdf", "2020-01-01-b.pdf", "pdf/2020-01-01-b.pdf"), ("z", "z", "(none)/z")}


def test_index_comes_before_this_run(spark):
    files = spark.createDataFrame([("a", "x", "(none)", "h"), ("b", "x", "(none)", "i")], HASHED)
    index = spark.createDataFrame([("h", "old", "y", 1), ("h", "newer", "y", 2)], "content_hash string, index_key string, index_bucket string, line int")
    assert rows(dedup.with_index(files, index), "original_key", "is_kept", "kept_key") == [("a", False, "newer"), ("b", True, "b")]


def test_checkpoints(spark):
    tasks = spark.createDataFrame([("a", "k1", 1), ("b", "k1", 1), ("a", "k2", 1), ("b", "k2", 1)], "bucket_alias string, key string, size long")
    done = spark.createDataFrame([("a", "k1"), ("", "k2")], "bucket_alias string, key string")
    assert rows(dedup.pending(tasks, done), "bucket_alias", "key") == [("b", "k1")]
    roots = spark.createDataFrame([("a", "x.zip"), ("a", "bad.zip"), ("a", "f"), ("a", "unplaced"), ("a", "._r")], "bucket_alias string, key string")
    tainted = spark.createDataFrame([("a", "bad.zip")], "bucket_alias string, key string")
    placed = spark.createDataFrame([("a", "f")], "bucket_alias string, key string")
    assert {r.key for r in dedup.to_checkpoint(roots, tainted, placed).collect()} == {"x.zip", "f", "._r"}


def test_exact_names_skip_taken_numbers(spark):
    files = spark.createDataFrame([("1/a.txt", "x"), ("2/a.txt", "x"), ("3/a-2.txt", "x"), ("4/a.txt", "x"), ("5/.rc", "x"), ("6/.rc", "x")], "original_key string, bucket_alias string")
    got = {r.original_key: r.placed for r in dedup.exact_names(files).collect()}
    assert got == {"1/a.txt": "txt/a.txt", "2/a.txt": "txt/a-2.txt", "3/a-2.txt": "txt/a-2-2.txt", "4/a.txt": "txt/a-3.txt", "5/.rc": "(none)/.rc", "6/.rc": "(none)/.rc-2"}


def test_completeness(spark):
    h = "0123456789abcdef"
    names = [f"plain-{h}.csv", f"plain-{h}-01of09-x.csv", f"part-{h}-01of02-x.csv", f"full-{h}-01of02-x.csv", f"full-{h}-02of02-y.csv", f"torn-{h}-01of02-x.csv", f"torn-{h}-02of03-x.csv", f"twice-{h}-01of02-x.csv", f"twice-{h}-01of02-z.csv"]
    got = {r.grp: r.complete for r in select.group_states(spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    assert got == {f"plain-{h}": True, f"part-{h}": False, f"full-{h}": True, f"torn-{h}": False, f"twice-{h}": False}


def test_collisions_and_slots(spark):
    keys = spark.createDataFrame([("Caf\u00e9/a",), ("Cafe\u0301/a",), ("x/A.jpg",), ("x/a.jpg",), ("X/a.jpg",), ("lone",)], "key string")
    assert sorted(len(r.members) for r in select.collision_groups(keys).collect()) == [2, 3]
    bulk, variants = select.split_variants(keys)
    assert [r.key for r in bulk.collect()] == ["lone"] and variants.count() == 5
    slots = {r.key: r.slot for r in select.variant_slots(keys).collect()}
    assert slots["X/a.jpg"] == 0 and slots["x/A.jpg"] == 1 and slots["x/a.jpg"] == 2 and sorted(slots[k] for k in slots if k.startswith("Caf")) == [0, 1]


def test_unknown_is_contagious_and_totals(spark):
    schema = "mailbox string, server_messages long, ingested long, new_messages long, removed_on_server long, new_attachments long"
    some = spark.createDataFrame([("a", 1, 1, 1, 0, 2), ("b", 1, 1, 1, 0, None)], schema)
    assert rows(ledger.with_total(some).where("mailbox = '*'"), "server_messages", "new_attachments") == [(2, None)]
    assert rows(ledger.with_total(some.limit(0)), "mailbox", "server_messages", "new_attachments") == [("*", 0, 0)]


def test_ledger_lines_round_trip(spark):
    lines = ["# mailbox\tuidvalidity\tuid\tingested_at", "", "in\t1\t2\t2024", "in\t1\t2\t2023", "in\tx\t2\t2024", "in\t1\t2", "in\t1\t4294967296\t2024"]
    parsed = ledger.parse(spark.createDataFrame([(x,) for x in lines], "value string"))
    kept = ledger.earliest(parsed)
    assert rows(kept, *ledger.KEY, "ingested_at") == [("in", 1, 2, "2023")]
    assert rows(ledger.parse(ledger.serialize(kept)), *ledger.KEY, "ingested_at") == rows(kept, *ledger.KEY, "ingested_at")


def test_seed_and_reset(spark):
    boxes = spark.createDataFrame([("Inbox", "inbox", 7), ("A b", "a-b", 1), ("a.b", "a-b", 2)], "mailbox string, relpath string, uidvalidity long")
    files = spark.createDataFrame([("inbox/5.eml",), ("inbox/5/attachments/a.pdf",), ("a-b/1.eml",), ("inbox/x.eml",), ("other/1.eml",)], "key string")
    seeded, ambiguous = ledger.seed(files, boxes, "2024")
    assert rows(seeded, *ledger.KEY) == [("Inbox", 7, 5)] and rows(ambiguous, "relpath") == [("a-b",)]
    old = spark.createDataFrame([("Inbox", 6, 1), ("Inbox", 7, 1), ("Inbox", None, 2)], "mailbox string, uidvalidity long, uid long")
    assert ledger.reset_epoch(old, boxes).count() == 2


def simulate(requests, per_minute):
    at, out = 0.0, []
    for due, n in requests:
        start = max(at, due)
        at = start + n * 60 / per_minute
        out.append(start)
    return out


def test_schedule_equals_the_bucket(spark):
    requests = [(0.0, 1), (0.1, 3), (9.0, 1), (9.0, 2), (9.2, 1), (50.0, 5), (51.0, 1)]
    df = spark.createDataFrame([("l", k, due, n) for k, (due, n) in enumerate(requests)], "lane string, i int, at double, n int")
    assert [r.start for r in runs.schedule(df, 120).orderBy("i").collect()] == pytest.approx(simulate(requests, 120))
    assert runs.interval(0) == 60.0


def test_budget_keeps_counting_dropped_members(spark):
    m = spark.createDataFrame([("z", 1, 90, 1), ("z", 2, 20, 1), ("z", 3, 0, 1), ("z", 4, 1, 1)], "archive string, position int, size long, zip_size long")
    assert [r.kept for r in runs.within_budget(m).orderBy("position").collect()] == [True, False, True, False]


def test_breaker_needs_a_whole_sample(spark):
    def completions(job, failures, n, skipped=0):
        return [(job, k, k < skipped, "transcode", "moov atom not found" if k < skipped + failures else None) for k in range(n)]

    data = completions("trips", 18, 30) + completions("few", 19, 19) + completions("mixed", 17, 40) + completions("skips", 18, 25, skipped=5)
    got = {r.job: (r.samples, r.tripped) for r in runs.breaker(spark.createDataFrame(data, "job string, position int, skipped boolean, stage string, error string")).collect()}
    assert got == {"trips": (20, True), "few": (19, False), "mixed": (20, False), "skips": (20, True)}


def test_deltas_and_streaks(spark):
    stats = spark.createDataFrame([("l", 1, 1, 10), ("l", 1, 2, 30), ("l", 2, 3, 25), ("l", 3, 4, None), ("l", 4, 5, 7)], "lane string, poll int, position int, bytes long")
    assert [r.bytes for r in runs.counter_deltas(stats, ["bytes"]).orderBy("poll").collect()] == [30, 0, 0, 7]
    errors = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "x", "b"), (1, 3, "y", "c"), (2, 4, "x", "d"), (2, 5, "x", "e"), (2, 6, "x", "f")], "poll int, position int, cause string, key string")
    assert rows(runs.error_streaks(errors), "poll", "cause", "first_key", "repeated") == [(1, "x", "a", 1), (2, "x", "d", 2)]


def zip_of(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__S__", "/"), data)
    return out.getvalue()


def files(spark, **contents):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "key string, content binary")


def test_archives_in_archives(spark):
    inner = zip_of(deep="deep text", **{"._junk": "x"})
    df = spark.createDataFrame([("a.zip", bytearray(zip_of(top="t", **{"in.zip": inner}))), ("bad.zip", bytearray(b"PK?")), ("f.txt", bytearray(b"t"))], "key string, content binary")
    got = rows(archives.all_members(df).where("error is null").where("key not like '%.zip'"), "root_key", "key", "depth")
    assert got == [("a.zip", "a.zip!in.zip!deep", 2), ("a.zip", "a.zip!top", 1), ("f.txt", "f.txt", 0)]
    assert rows(archives.all_members(df).where("error is not null"), "root_key") == [("bad.zip",)]
    bomb = zip_of(a="0" * 2_000_000, b="1", c="")
    assert [n for n, _ in archives.zip_members(bomb)] == ["c"]


def workbook():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return zip_of(**{
        "xl/workbook.xml": f'<workbook {ns} {rel}><sheets><sheet name="One, a" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>a, \"b\"</t></si></sst>",
        "xl/styles.xml": f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" s="1"><v>45000.5</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><v>0.25</v></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })


def test_tables_and_clippings(spark):
    import plistlib

    got = archives.expand(files(spark, a=workbook()), archives.sheets).collect()
    assert [(r.part, bytes(r.content).decode()) for r in got] == [("1:One, a", '"a, ""b""",,3\n2023-03-15T12:00:00,true,0.25\n')]
    tsv = archives.expand(files(spark, a=b"a,b\tc\nd\n", b=b""), archives.tsv_to_csv).orderBy("key").collect()
    assert bytes(tsv[0].content) == b'"a,b",c\nd\n' and "no rows" in tsv[1].error
    clip = plistlib.dumps({"UTI-Data": {"com.apple.traditional-mac-plain-text": b"old", "public.utf8-plain-text": "new"}}, fmt=plistlib.FMT_BINARY)
    assert bytes(archives.expand(files(spark, a=clip), archives.clipping).first().content) == b"new"
    entry = lambda kind, data: kind + (len(data) + 8).to_bytes(4, "big") + data
    icon = entry(b"icns", entry(b"ic07", b"\x89PNGsmall") + entry(b"ic09", b"\x89PNGbig") + entry(b"ic10", b"raw"))
    assert archives.largest_icons(files(spark, a=icon)).first().part == "ic09"


def test_messages(spark):
    from email.message import EmailMessage

    m = EmailMessage()
    m.set_content("body")
    for _ in range(2):
        m.add_attachment(b"x", maintype="a", subtype="b", filename="../n.txt")
    m.add_attachment(b"y", maintype="a", subtype="b")
    assert [n for n, _ in archives.attachments(m.as_bytes())] == ["n.txt", "n-2.txt", "attachment"]


MEETING = (
    "BEGIN:VCALENDAR\r\nMETHOD:PUBLISH\r\nX-WR-CALNAME:Events\r\nBEGIN:VTIMEZONE\r\nTZID:Europe/Berlin\r\nBEGIN:DAYLIGHT\r\nDTSTART:19700329T020000\r\nEND:DAYLIGHT\r\nEND:VTIMEZONE\r\n"
    "BEGIN:VEVENT\r\nDTSTART;TZID=Europe/Berlin:20170621T184500\r\nDTEND;TZID=Europe/Berlin:20170621T220000\r\nSTATUS:CONFIRMED\r\nSUMMARY:June\\, 2017\r\nDESCRIPTION:One\\nTwo\\n\\nJoin us at Teu\r\n fel\\; our host.\r\n"
    'ORGANIZER;CN="Meetup: Reminder":MAILTO:info@meetup.example\r\nATTENDEE;PARTSTAT=NEEDS-ACTION:mailto:a@b.c\r\nBEGIN:VALARM\r\nDESCRIPTION:Reminder\r\nEND:VALARM\r\nEND:VEVENT\r\n'
    "BEGIN:VTODO\r\nDUE:20230501T120030Z\r\nEND:VTODO\r\nBEGIN:VEVENT\r\nSUMMARY:All day\r\nDTSTART;VALUE=DATE:20230501\r\nDURATION:PT1H\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"
)


def test_calendars(spark):
    got = {r.key: r.text for r in vobject.calendar_text(files(spark, a=MEETING.encode(), b=b"BEGIN:VCALENDAR\nUID:1\nEND:VCALENDAR", c=b"nothing")).collect()}
    assert got["a"] == (
        "Calendar: Events\nMethod: PUBLISH\n\nEvent 1 of 3\nSummary: June, 2017\nWhen: 2017-06-21 18:45 – 2017-06-21 22:00 (Europe/Berlin)\nOrganizer: Meetup: Reminder <info@meetup.example>\n"
        "Attendee: a@b.c (needs action)\nStatus: CONFIRMED\nDescription:\n  One\n  Two\n\n  Join us at Teufel; our host.\n"
        "\nTask 2 of 3\nSummary: (untitled)\nWhen: 2023-05-01 12:00:30 (UTC)\n\nEvent 3 of 3\nSummary: All day\nWhen: 2023-05-01, lasting PT1H\n"
    )
    assert got["b"] == "Calendar\n\nNo events.\n" and "c" not in got


CARDS = (
    "BEGIN:VCARD\nVERSION:3.0\nN:Doe;Jane;Q;Dr;Jr\nORG:Acme\\; Co;Unit\nitem1.TEL:+1\nitem1.X-ABLabel:_$!<Home>!$_\nEMAIL;TYPE=INTERNET,work:j@x.org\nADR:;;Street 1;Town;;123;\nPHOTO;ENCODING=b:AAAA\n"
    "NOTE;ENCODING=QUOTED-PRINTABLE:caf=C3=A9 =\nau lait\nEND:VCARD\nBEGIN:VCARD\nUID:1\nEND:VCARD\n"
)


def test_contacts(spark):
    got = vobject.contact_text(files(spark, a=CARDS.encode())).first().text
    assert got == "Contact 1 of 2\nName: Dr Jane Q Doe Jr\nOrganization: Acme; Co, Unit\nPhone (Home): +1\nEmail (work): j@x.org\nAddress: Street 1, Town, 123\nNote: café au lait\n\nContact 2 of 2\n(no details)\n"


def test_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.TXT").write_text("abc")
    (tmp_path / "b.md").write_text("x")
    root = str(tmp_path)
    assert rows(listing.listing(spark, root), "key", "size") == [("b.md", 1), ("d/a.TXT", 3)]
    assert rows(listing.listing(spark, root, extensions=["txt"]), "key") == [("d/a.TXT",)]
    assert listing.listing(spark, root + "/none", missing_ok=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listing.listing(spark, root + "/none")
    assert listing.contents(spark, root, most_bytes=2).count() == 1 and listing.oversized(spark, root, most_bytes=2).count() == 1


def test_mailbox_source(spark, tmp_path):
    (tmp_path / "inbox" / "sub").mkdir(parents=True)
    (tmp_path / "inbox" / "5.eml").write_bytes(b"Subject: x\n\nbody")
    (tmp_path / "inbox" / "uidvalidity").write_text("9")
    (tmp_path / "inbox" / "sub" / "7.eml").write_bytes(b"y")
    spark.dataSource.register(MailboxSource)
    got = spark.read.format("mailbox").option("folder", str(tmp_path)).load()
    assert rows(got, "mailbox", "uidvalidity", "uid") == [("inbox", 9, 5), ("inbox/sub", 0, 7)]


def test_deduplicate_job(spark):
    data = [("a", "2024-01-01-x.txt", b"one"), ("b", "y.txt", b"one"), ("a", "z.zip", zip_of(m="one", n="two")), ("a", "bad.zip", b"?"), ("a", "done.txt", b"three"), ("a", "._r", b"r")]
    tasks = spark.createDataFrame([(b, k, len(c), bytearray(c)) for b, k, c in data], "bucket_alias string, key string, size long, content binary")
    out = pipelines.deduplicate(tasks, spark.createDataFrame([("a", "done.txt")], "bucket_alias string, key string"))
    assert rows(out["placed"], "original_key", "placed") == [("2024-01-01-x.txt", "txt/2024-01-01-x.txt"), ("z.zip!n", "(none)/n")]
    assert {r.duplicate_key for r in out["merged"].collect()} == {"y.txt", "z.zip!m"}
    assert rows(out["failures"], "key") == [("bad.zip",)]
    assert {r.key for r in out["checkpoint"].collect()} == {"2024-01-01-x.txt", "y.txt", "z.zip", "._r"}


@pytest.mark.parametrize("kind", ["xls", "procreate", "procreate-2", "icns", "pdf"])
def test_no_kind_is_delivered_without_a_reader(spark, kind):
    from siftline.functions import kinds

    endings = next(k[1] for k in kinds.KINDS if k[0] == kind)
    ending = endings if kind == "procreate-2" else endings.split(" ")[0]
    out = pipelines.transform(files(spark, **{f"a/b.{ending}": b"bytes"}), spark.createDataFrame([], "name string"), kind, "src")
    assert out["outputs"].count() == (kind == "pdf") and rows(out["outcomes"], "outcome") == [("copied" if kind == "pdf" else "failed",)]


def test_icons_are_read(spark):
    entry = lambda kind, data: kind + (len(data) + 8).to_bytes(4, "big") + data
    icon = entry(b"icns", entry(b"ic07", b"\x89PNGsmall") + entry(b"ic09", b"\x89PNGbig"))
    out = pipelines.transform(files(spark, **{"i.icns": icon}), spark.createDataFrame([], "name string"), "icns", "src")
    assert bytes(out["outputs"].first().content) == b"\x89PNGbig" and out["outcomes"].first().outcome == "transcoded"


def test_archives_beyond_the_deepest_level_fail(spark):
    data = b"deep"
    for k in range(11):
        data = zip_of(**{f"m{k}.zip" if k else "note.txt": data})
    tasks = spark.createDataFrame([("a", "r.zip", len(data), bytearray(data))], "bucket_alias string, key string, size long, content binary")
    out = pipelines.deduplicate(tasks, spark.createDataFrame([], "bucket_alias string, key string"))
    assert out["failures"].count() == 1 and "deeper than 10" in out["failures"].first().error and out["checkpoint"].count() == 0
    assert out["placed"].count() == 0


def test_large_calendars_fail_with_their_size(spark, monkeypatch):
    from siftline.sources import vobject

    monkeypatch.setattr(vobject, "MOST_BYTES", 20)
    out = pipelines.transform(files(spark, **{"c.ics": MEETING.encode()}), spark.createDataFrame([], "name string"), "ics", "src")
    assert "is larger than" in out["outcomes"].first().error


def test_exact_names_equal_the_loop(spark):
    import random

    r = random.Random(5)
    names = [r.choice(["a.txt", "a-2.txt", "a-2-2.txt", "a-3.txt", "b", "b-2", "c-7.md", "c.md", "d.x", "a-02.txt"]) for _ in range(300)]
    data = [(f"{r.randrange(10**6):06d}/{n}", "b") for n in names]
    taken, want = set(), {}
    for key, _ in sorted(data):
        name = key.split("/")[1]
        stem, dot, end = name.rpartition(".") if "." in name else (name, "", "")
        n, choice = 1, name
        while (end, choice) in taken:
            n += 1
            choice = f"{stem}-{n}{dot}{end}"
        taken.add((end, choice))
        want[key] = f"{end or '(none)'}/{choice}"
    got = {x.original_key: x.placed for x in dedup.exact_names(spark.createDataFrame(data, "original_key string, bucket_alias string")).collect()}
    assert got == want


def test_many_equal_names_take_seconds(spark):
    import time

    from pyspark.sql import functions as F

    many = spark.range(100_000).select(F.concat(F.format_string("%06d", "id"), F.when(F.col("id") == 5, "/image-3.jpg").otherwise("/image.jpg")).alias("original_key"), F.lit("b").alias("bucket_alias"))
    began = time.time()
    assert dedup.exact_names(many).select("placed").distinct().count() == 100_000 and time.time() - began < 60


def test_transform_job(spark):
    nothing = spark.createDataFrame([], "name string")
    notes = files(spark, **{"a/n.md": FRONT_NOTE.encode(), "b/m.md": b"plain", "._x.md": b"r", "q.txt": b"other"})
    out = pipelines.transform(notes, nothing, "md", "src")
    assert rows(out["outcomes"], "key", "outcome", "skip_reason") == [("._x.md", "skipped", "apple_double"), ("a/n.md", "skipped", "email_shaped"), ("b/m.md", "failed", None)]
    books = files(spark, **{"t/w.xlsx": workbook(), "t/x.xlsx": b"?"})
    out = pipelines.transform(books, nothing, "xlsx", "src")
    names = out["outputs"].select("name")
    assert [r.name[-15:] for r in names.collect()] == ["01of01-One-a.csv"[-15:]]
    again = pipelines.transform(books, names, "xlsx", "src")
    assert rows(again["outcomes"], "key", "outcome") == [("t/w.xlsx", "skipped"), ("t/x.xlsx", "failed")]
    cal = pipelines.transform(files(spark, **{"c.ics": MEETING.encode(), "d.ics": b"no"}), nothing, "ics", "src")
    assert rows(cal["outcomes"], "key", "outcome") == [("c.ics", "transcoded"), ("d.ics", "failed")]
    same = pipelines.transform(files(spark, **{"p.pdf": b"%PDF"}), nothing, "pdf", "src")
    assert bytes(same["outputs"].first().content) == b"%PDF" and same["outcomes"].first().outcome == "copied"


FRONT_NOTE = "---\nfrom: a\nto: b\nuid: 1\n---\nbody"


def test_email_jobs(spark):
    from email.message import EmailMessage

    m = EmailMessage()
    m.set_content("x")
    m.add_attachment(b"data", maintype="a", subtype="b", filename="f.bin")
    schema = "mailbox string, uidvalidity long, uid long, content binary"
    mail = spark.createDataFrame([("In/Box", 1, 1, bytearray(b"Subject: a\n\nb")), ("In/Box", 1, 2, bytearray(m.as_bytes()))], schema)
    known = spark.createDataFrame([("In/Box", 1, 1, "2023"), ("In/Box", 0, 2, "2023")], "mailbox string, uidvalidity long, uid long, ingested_at string")
    out = pipelines.email_import(mail, known, "me", "2024")
    assert rows(out["objects"], "key") == [("me/in/box/2.eml",), ("me/in/box/2/attachments/f.bin",)]
    assert out["ledger"].count() == 3
    server = mail.select("mailbox", "uidvalidity", "uid", F.lit(1).cast("long").alias("attachments"))
    previous = spark.createDataFrame([("In/Box", "2020", 1)], "mailbox string, last_in_sync_at string, line int")
    status = {r.mailbox: r for r in pipelines.email_scan(server, known, previous, "2024").collect()}
    assert (status["In/Box"].new_messages, status["In/Box"].new_attachments, status["In/Box"].last_in_sync_at) == (1, 1, "2020")
    assert status["*"].server_messages == 2 and status["*"].last_in_sync_at is None


def test_objects_are_put_once(spark, tmp_path):
    from siftline.sources import sinks

    root = str(tmp_path / "out")
    objects = files(spark, **{"a/x": b"1", "b": b"22"})
    assert rows(sinks.put(objects, root), "key", "bytes", "outcome") == [("a/x", 1, "written"), ("b", 2, "written")]
    assert (tmp_path / "out" / "a" / "x").read_bytes() == b"1" and not list(tmp_path.rglob("*.tmp"))
    assert {r.outcome for r in sinks.put(objects, root, existing="skip").collect()} == {"kept"}
    again = sinks.put(objects, root)
    assert tuple(sinks.transfer_summary(again).first()) == (0, 0, 2)
    done = sinks.copy(objects, root, only=spark.createDataFrame([("b",)], "key string"))
    assert tuple(sinks.transfer_summary(done).first()) == (1, 2, 0)
    with pytest.raises(ValueError):
        sinks.purge(spark, root, confirm="yes")
    assert sinks.purge(spark, root, confirm=root) and not (tmp_path / "out").exists()


def test_buckets():
    from siftline.sources import buckets

    known = [buckets.Bucket("my-photos", "ph", "https://s3.example.com", "k"), buckets.Bucket("other", "ot", "https://s3.example.com", "k", "eu")]
    assert buckets.uri("my-photos:/a/b/", known) == "s3a://ph/a/b/" and buckets.uri("other", known) == "s3a://ot/"
    options = buckets.s3a_options(known, {"MY_PHOTOS": "secret"})
    assert options["spark.hadoop.fs.s3a.bucket.ph.secret.key"] == "secret" and options["spark.hadoop.fs.s3a.bucket.ot.endpoint.region"] == "eu"
    with pytest.raises(LookupError):
        buckets.resolve("none", known)
    with pytest.raises(ValueError):
        buckets.resolve("other:a/../b", known)
    with pytest.raises(ValueError):
        buckets.s3a_options([*known, buckets.Bucket("x", "ph", "https://elsewhere", "k")], {})


def test_ledger_stream(spark, tmp_path):
    from siftline.streaming import logs

    schema = "mailbox string, uidvalidity long, uid long, ingested_at string"
    feed = str(tmp_path / "feed")
    for part in ([("a", 1, 1, "2024"), ("a", 1, 2, "2024")], [("a", 1, 1, "2023"), ("b", 1, 1, "2024")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(feed)
        logs.ledger_upsert(spark.readStream.schema(schema).parquet(feed), str(tmp_path / "ledger"), str(tmp_path / "state")).awaitTermination()
    assert rows(logs.latest_snapshot(spark, str(tmp_path / "ledger")), "mailbox", "uid", "ingested_at") == [("a", 1, "2023"), ("a", 2, "2024"), ("b", 1, "2024")]


def test_log_stream(spark, tmp_path):
    import json

    from siftline.streaming import logs

    folder = tmp_path / "log"

    def write(name, *entries, end="\n"):
        folder.mkdir(exist_ok=True)
        with (folder / name).open("a") as file:
            file.write("\n".join(e if isinstance(e, str) else json.dumps(e) for e in entries) + end)

    stats = lambda n: {"level": "info", "msg": "s", "stats": {"bytes": n, "transfers": 1}}
    error = lambda cause, key: {"level": "ERROR", "msg": cause, "object": key}
    out = lambda: logs.follow(logs.lines(spark, str(folder)), str(tmp_path / "run")).orderBy("poll", "lane").collect()
    streaks = lambda rows, p: [(r.cause, r.first_key, r.repeated) for r in rows if r.kind == "streak" and (r.poll, r.lane) == (p.poll, p.lane)]
    shown = lambda rows: [(p.lane, p.bytes, streaks(rows, p)) for p in rows if p.kind == "poll"]
    assert out() == []  # the log is not there yet
    write("run-1.log", stats(10), "garbage", "", error("x", "a"), error("x", "b"), stats(30))
    write("run-1.log", '{"level": "ERROR", "msg"', end="")  # still being written
    first = [("run", 30, [("x", "a", 1)])]
    assert shown(out()) == first
    write("run-1.log", ': "y", "object": "c"}', error("y", "d"), stats(35))
    write("other.log", error("z", "é"))
    assert shown(out()) == [*first, ("other", 0, []), ("run", 5, [("y", "c", 1)])]
    assert len(shown(out())) == 3  # nothing new


def test_log_stretches_lose_no_line(tmp_path, monkeypatch):
    from siftline.streaming import logs

    lines = [f"line {k} {'x' * (k * 7 % 40)}." for k in range(200)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\nrest")
    for size in (1, 13, 100, 10_000):
        monkeypatch.setattr(logs, "PART_BYTES", size)
        monkeypatch.setattr(logs, "STEP", 5)
        reader = logs.LogReader(str(tmp_path))
        end = reader.latestOffset()
        assert end == {"a.log": len("\n".join(lines)) + 1}
        assert [v for p in reader.partitions({}, end) for _, _, v in reader.read(p)] == lines
