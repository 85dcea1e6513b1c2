"""Reports, structures of messages, batches that fail, and deliveries that are written down."""

import imaplib

import pytest
from pyspark.sql import functions as F

from siftline.functions import text
from siftline.operators import reports, runs, select
from siftline.plans import pipelines
from siftline.sources import bodystructure, mailbox

PLAIN = '("TEXT" "PLAIN" NIL NIL NIL "7BIT" 10 1 NIL NIL NIL)'
PDF = '("APPLICATION" "PDF" NIL NIL NIL "BASE64" 10 NIL ("attachment" NIL))'


def test_structures():
    count = bodystructure.count_attachments
    assert count(PLAIN) == 0 and count(PDF) == 1
    assert count(f'({PLAIN}({PDF}{PDF} "MIXED") "MIXED")') == 2
    assert count('("TEXT" "PLAIN" ("charset" "x" "NAME" {6}\r\na")(b ) NIL NIL "7BIT" 10 1)') == 1
    assert count(f'("MESSAGE" "RFC822" NIL NIL NIL "7BIT" 9 (NIL) {PDF} 3)') == 0
    deep = "(" * 5000 + PDF + ' "MIXED")' * 5000
    assert count(deep) == 1
    for damaged in ("", "()", PLAIN[:-1], PLAIN + ")", '("TEXT" "PLAIN")', "NIL", PLAIN + PLAIN):
        with pytest.raises(ValueError):
            count(damaged)


def test_a_damaged_structure_costs_no_other_count(spark):
    rows = spark.createDataFrame([("a", PDF), ("a", PDF[:-1]), ("a", None), ("b", None)], "mailbox string, structure string")
    found = {r.mailbox: (r.messages, r.attachments, r.unparsed) for r in bodystructure.by_mailbox(rows).collect()}
    assert found == {"a": (3, 1, 1), "b": (1, 0, 0)}
    assert bodystructure.by_mailbox(rows.limit(0)).count() == 0


def test_batches_are_halved():
    asked = []

    def fetch(batch):
        asked.append(len(batch))
        if 7 in batch:
            raise imaplib.IMAP4.error("cannot be parsed")
        return [(k, str(k)) for k in batch]

    assert list(mailbox.in_halves(fetch, list(range(20)), 10)) == [(k, None if k == 7 else str(k)) for k in range(20)]
    assert asked == [10, 5, 5, 2, 3, 1, 2, 10]

    def lost(batch):
        raise imaplib.IMAP4.abort("connection lost")

    with pytest.raises(imaplib.IMAP4.abort):
        list(mailbox.in_halves(lost, [1, 2], 2))


def test_structures_of_a_server():
    class Server:
        def uid(self, verb, uids, items):
            assert (verb, uids, items) == ("FETCH", "5,6,7", "(UID BODYSTRUCTURE)")
            return "OK", [f"1 (UID 5 BODYSTRUCTURE {PDF})".encode(), (b'2 (UID 6 BODYSTRUCTURE ("TEXT" "PLAIN" ("NAME" {1}', b"x"), b') NIL NIL "7BIT" 1 1))', f"3 (BODYSTRUCTURE {PLAIN} UID 7)".encode()]

    found = dict(mailbox.structures(Server(), [b"5", b"6", b"7"]))
    assert {k: bodystructure.count_attachments(v.decode()) for k, v in found.items()} == {b"5": 1, b"6": 1, b"7": 0}


def test_scan_counts_attachments_from_structures(spark):
    server = spark.createDataFrame([("In", 1, 1, PDF), ("In", 1, 2, "("), ("In", 1, 3, PDF)], "mailbox string, uidvalidity long, uid long, structure string")
    known = spark.createDataFrame([("In", 1, 3)], "mailbox string, uidvalidity long, uid long")
    previous = spark.createDataFrame([], "mailbox string, last_in_sync_at string, line int")
    status = {r.mailbox: r.new_attachments for r in pipelines.email_scan(server, known, previous, "2024").collect()}
    assert status == {"In": 1, "*": 1}


def test_reports_are_in_order_and_never_fail_a_run(spark, tmp_path):
    records = spark.createDataFrame([(f"k{n}", "h", "p", None, "b", "b") for n in (3, 1, 2)], ", ".join(f"{c} string" for c in reports.DEDUP_HEAD))
    failures = spark.createDataFrame([("z.zip", "damaged")], "key string, error string")
    lines = reports.dedup_lines(records, failures)
    assert reports.publish({"report": lines}, str(tmp_path), "run") == {}
    files = sorted((tmp_path / "run" / "report").glob("part-*"))
    read = "".join(f.read_text() for f in files).splitlines()
    assert read == ["\t".join(reports.DEDUP_HEAD), *[f"k{n}\th\tp\t\tb\tb" for n in (1, 2, 3)], "3 duplicate(s) removed.", "1 archive(s) need manual attention:", "z.zip\tdamaged"]
    with pytest.warns(UserWarning, match="was not written"):
        assert list(reports.publish({"report": lines}, str(tmp_path), "run")) == ["report"]
    empty = reports.dedup_lines(records.limit(0), failures.limit(0))
    assert [r.line for r in empty.orderBy("section").collect()][1:] == ["0 duplicate(s) removed.", "0 archive(s) need manual attention:"]


def test_report_of_a_conversion(spark, tmp_path):
    files = spark.createDataFrame([("a/x.key", b"private"), ("a/y.key", b"PK\x03\x04..."), ("a/._z.key", b"")], "key string, content binary")
    names = spark.createDataFrame([], "name string")
    result = pipelines.transform(files, names, "key", "bucket")
    errors = {r.key: r.error for r in result["outcomes"].collect()}
    assert text.WRONG_KIND[4] in errors["a/x.key"] and "soffice" in errors["a/y.key"] and errors["a/._z.key"] is None
    assert pipelines.report(result, "transform", str(tmp_path), "run") == {}
    read = [r.value for r in spark.read.text(str(tmp_path / "run" / "transform-report")).collect()]
    assert "0 transcoded, 0 copied, 2 failed." in read and "skipped: 0 already_done, 1 apple_double, 0 lock_stub, 0 email_shaped." in read


def test_only_what_arrived_enters_the_ledger(spark, tmp_path):
    mail = spark.createDataFrame([("In", 1, k, f"Subject: {k}\n\nx".encode()) for k in (1, 2)], "mailbox string, uidvalidity long, uid long, content binary")
    known = spark.createDataFrame([], "mailbox string, uidvalidity long, uid long, ingested_at string")
    (tmp_path / "objects" / "me" / "in" / "2.eml" / "in-the-way").mkdir(parents=True)
    done = pipelines.deliver(mail, known, "me", "2024", f"file://{tmp_path}/objects", str(tmp_path / "ledger"))
    assert {r.key: r.outcome.split(":")[0] for r in done.collect()} == {"me/in/1.eml": "written", "me/in/2.eml": "failed"}
    assert [r.value for r in spark.read.text(str(tmp_path / "ledger")).collect()] == ["In\t1\t1\t2024"]


def test_dispatch(spark):
    arrivals = spark.createDataFrame([("a/x.xlsx", "x", 2), ("a/x.xlsx", "x", 1), ("a/~$x.xlsx", "l", 3), ("a/d.xlsx", "d", 4), ("a/n.xlsx", None, 5)], "key string, grp string, position long")
    complete = spark.createDataFrame([("d",), ("d",)], "grp string")
    found = {r.position: r.outcome for r in select.dispatch(arrivals, complete).collect()}
    assert found == {1: "queued", 2: "already_dispatched", 3: "lock_stub", 4: "already_done", 5: "queued"}


def test_rounds_end(spark):
    seen = []

    def attempt(rows):
        seen.append(sorted(r.id for r in rows.collect()))
        return rows.withColumn("failed_step", F.when(F.col("id") > F.col("tried"), "push"))

    done = {r.id: (r.tried, r.failed_step) for r in runs.in_rounds(spark.range(6), attempt).collect()}
    assert done == {0: (0, None), 1: (1, None), 2: (2, None), 3: (3, None), 4: (3, "push"), 5: (3, "push")}
    assert seen == [[0, 1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [2, 3, 4, 5], [3, 4, 5]]
    seen.clear()
    assert runs.in_rounds(spark.range(1), attempt).count() == 1 and len(seen) == 1


def test_drawings(spark):
    cases = [("<svg></svg>", False), ("<svg><line", True), ("<svg><rect", True), ("<svg><rect>", True), ('<rect x="" class="BoundingBox">', False), ("<defs><path/></defs", False), ("<defs/><path/>", True), ("<pathology/>", False), (None, None)]
    rows = spark.createDataFrame(cases, "svg string, want boolean")
    assert rows.where(~text.draws_something(F.col("svg")).eqNullSafe(F.col("want"))).count() == 0


def test_shaped_markdown_has_a_line_and_pulls_are_counted(spark):
    rows = [("a.md", "copied", None, None, None), ("m.md", "skipped", None, "email-shaped: provenance", "email_shaped"), ("b.md", "failed", "pull", "no", None), ("._x", "skipped", None, None, "apple_double")]
    outcomes = spark.createDataFrame(rows, "key string, outcome string, stage string, error string, skip_reason string")
    told = [r.line for r in reports.transform_lines(outcomes, spark.createDataFrame([("a.md", "a-1.md")], "key string, name string")).orderBy("section", "line").collect()]
    assert "m.md\tskipped_email_shaped\t\t\temail-shaped: provenance" in told and "2 pulled, 1 pull error(s)." in told
    assert not any(line.startswith("._x") for line in told) and "skipped: 0 already_done, 1 apple_double, 0 lock_stub, 1 email_shaped." in told


def test_days_of_runs_are_those_of_utc(spark):
    from pyspark.sql import functions as F

    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        at = F.timestamp_seconds(F.lit(1_700_000_000 - 1_700_000_000 % 86_400 + 80_000))  # late in the day in UTC, the next day there
        assert spark.range(1).select(reports.run_prefix(at, F.lit("j"), F.lit("r"))).first()[0] == "2023-11-14-j-r"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_messages_that_cannot_be_unpacked_are_told(spark):
    from siftline.plans import pipelines

    deep = b"".join(b"Content-Type: multipart/mixed; boundary=b%d\n\n--b%d\n" % (k, k) for k in range(3000))
    mail = spark.createDataFrame([("in", 1, 1, bytearray(b"Subject: x\n\nhi")), ("in", 1, 2, bytearray(deep))], "mailbox string, uidvalidity long, uid long, content binary")
    out = pipelines.email_import(mail, spark.createDataFrame([], "mailbox string, uidvalidity long, uid long, ingested_at string"), "me", "2024")
    assert [(r.key.rpartition("/")[2], "Recursion" in r.error) for r in out["unpack_failed"].collect()] == [("2.eml", True)]
    assert out["objects"].count() == 2 and out["ledger"].count() == 2
