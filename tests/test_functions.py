"""Column functions on golden values."""

import pytest
from pyspark.sql import functions as F

from siftline.functions import kinds, paths, text


def run(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string").orderBy("k").select(column(F.col("v"))).collect()]


def test_keys(spark):
    assert run(spark, paths.after_zip_separator, "outer.zip!photos/img.jpg", "a/b", "a!b!c") == ["photos/img.jpg", "a/b", "c"]
    assert run(spark, paths.extension_of, "README", ".bashrc", "a/b.TXT", "x.zip!p/q.Tar.GZ", "a.b/c", "trail.", "d/.x.y") == ["(none)", "(none)", "txt", "gz", "(none)", "", "y"]
    assert run(spark, paths.is_undated, "0000-00-00-a", "x/0000-00-00-a", "a.zip!x/0000-00-00-a", "2024-01-01-a", "0000-00-00-/b") == [True, True, True, False, False]
    assert run(spark, paths.is_apple_double, "a/._x", "._x", "._x/a") == [True, True, False]
    assert run(spark, paths.is_lock_stub, "a/~$b.xlsx", "b~$.xlsx") == [True, False]
    assert run(spark, paths.is_skippable_member, "__MACOSX/a", "a/__MACOSX/b", "x/.git/y", ".gitignore", "node_modules/a", "a/.DS_Store") == [True, False, True, False, True, True]


def test_safe_names(spark):
    assert run(spark, paths.sanitize_filename, "a/b/c.txt", "", "..", "a/..", "dir/", "x" * 120 + ".jpeg", "é" * 80 + ".txt", "y" * 130, "a." + "z" * 120) == [
        "c.txt", "file", "file", "file", "dir", "x" * 95 + ".jpeg", "é" * 48 + ".txt", "y" * 100, ("a." + "z" * 120)[:100],
    ]
    assert run(spark, paths.sheet_slug, " A & B ", "***", "x" * 60, "a" * 39 + " b", "-a-", "ü") == ["A-B", "sheet", "x" * 40, "a" * 39, "a", "sheet"]
    assert run(spark, paths.strict_stem, "Budget (Normal, Reduced)", "a/b c") == ["Budget-Normal-Reduced", "b-c"]
    assert run(spark, paths.sanitize_segment, "First.Last", "--a--B--", "\u212a", "", "a" * 99 + "-b") == ["first-last", "a-b", "", "", "a" * 99]
    assert run(spark, paths.sanitize_alias, "first.last@example.com", "x") == ["first-last", "x"]
    assert run(spark, lambda c: paths.sanitize_mailbox(c, "."), "INBOX.Sent Mail..2024", "***") == ["inbox/sent-mail/2024", ""]
    assert run(spark, lambda c: paths.sanitize_mailbox(c, None), "A/B") == ["a-b"]


def test_groups_and_markers(spark):
    h = "0123456789abcdef"
    found = run(spark, paths.candidate_groups, f"doc-{h}", f"doc-{h}-01of02-x", f"a-{h}-{h}", "doc-0123", f"doc-{h.upper()}", f"doc-{h}0")
    assert [[g.grp for g in f] for f in found] == [[f"doc-{h}"], [f"doc-{h}"], [f"a-{h}", f"a-{h}-{h}"], [], [], []]
    marks = run(spark, paths.sheet_marker, "-03of05-x", "-00of05-x", "-06of05-x", "-1of2", "-aofb-x", "-100of100-x")
    assert [tuple(m) if m else None for m in marks] == [(3, 5), None, None, None, None, (100, 100)]
    two = spark.range(1).select(paths.two_digits(F.lit(5)), paths.two_digits(F.lit(123))).first()
    assert tuple(two) == ("05", "123")
    name = spark.range(1).select(paths.destination_name(F.lit("src"), F.lit("d/a b.png"), "jpg").alias("n"), paths.destination_name(F.lit("src"), F.lit("d/a b.xlsx"), "csv", True).alias("s")).first()
    assert name.n.startswith("a b-") and name.n.endswith(".jpg") and len(name.n) == 24 and name.s.startswith("a-b-")
    assert run(spark, paths.path_prefixes, "a/b/c", "x") == [["a", "a/b", "a/b/c"], ["x"]]
    assert run(spark, paths.local_fold, "É/A", "É/a", "abC") == ["é/a", "é/a", "abc"]


def test_targets(spark):
    got = run(spark, paths.remote_target, "photos", "photos:", "photos:/a/b/", "photos:a:b")
    assert [(g.alias, g.prefix) for g in got] == [("photos", None), ("photos", None), ("photos", "a/b/"), ("photos", "a:b/")]
    with pytest.raises(Exception, match="leaves its bucket"):
        run(spark, paths.remote_target, "x:a/../b")


def test_error_classes(spark):
    errors = ["dial tcp: lookup x: no such host", "DIAL TCP", "Too Many Connections from host", "a.mov: moov atom not found", "b.ics is not an iCalendar file", "other"]
    assert run(spark, text.is_unreachable, *errors) == [True, False, False, False, False, False]
    assert run(spark, text.is_overloaded, *errors) == [False, False, True, False, False, False]
    assert run(spark, text.is_not_retryable, *errors) == [False, False, False, True, True, False]
    assert run(spark, text.is_wrong_kind, *errors) == [False, False, False, False, True, False]


FRONT = '---\nsender_domain: example.com\nfrom: a\nsource: "m/5.EML"\n---\n'


def test_email_shape(spark):
    texts = [
        FRONT + "body", "plain note", "", "---\nfrom: a\nsubject: b\nno closing", "﻿---\r\nfrom: a\r\ncc: b\r\n---\r\nx", "---\ntags: [mailbox/inbox, x]\n---\n| **From** | a |\n|**To**| b |\n**Subject:** c\n",
        "| from | to |\n| Berlin | Paris |", "Message-ID: 1\nReceived: 2\nDKIM-Signature: 3\nOriginal file: a.eml", "---\n  from: a\n- to: b\n---\n", "x\n" * 100 + "**from:** a\n**to:** b\n**date:** c\n",
    ]
    signs = [tuple(s) for s in run(spark, text.email_signals, *texts)]
    assert signs == [
        (True, True, False, False), (False,) * 4, (False,) * 4, (False,) * 4, (True, False, False, False), (False, True, True, False), (False,) * 4, (False, True, False, True), (False,) * 4, (False,) * 4,
    ]
    assert run(spark, lambda c: text.describe(text.email_signals(c)), texts[0], texts[1]) == ["frontmatter-headers, provenance", ""]
    assert run(spark, lambda c: text.is_email_shaped(text.email_signals(c)), *texts[:2]) == [True, False]


def test_window(spark):
    long = "a" * 70_000 + "é" * 50_000
    got = run(spark, text.window, "short", long)
    assert got[0] == "short" and got[1].startswith("a" * 65_536 + "\n") and got[1].endswith("é") and len(got[1].encode()) <= 2 * 65_536 + 4


def test_sizes_and_times(spark):
    sizes = spark.createDataFrame([(k, v) for k, v in enumerate([0, 1023, 1024, 1280, 1 << 20, 5 << 40, 5000 << 40])], "k int, v long").orderBy("k")
    assert [r[0] for r in sizes.select(text.format_bytes(F.col("v"))).collect()] == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "5.0 TB", "5000.0 TB"]
    estimate = spark.createDataFrame([(120, 120), (7200, 60), (600_000, 60), (5, 0)], "n long, p long").select(text.estimate_duration(F.col("n"), F.col("p")))
    assert [r[0] for r in estimate.collect()] == ["1m", "2.0h", "6.9d", "5m"]
    days = spark.createDataFrame([(1.5,), (0.0,), (-1.0,), (100.0,)], "d double").select(text.elapsed(F.col("d")))
    assert [r[0] for r in days.collect()] == ["36:00:00", "00:00:00", "00:00:00", "2400:00:00"]
    serial = spark.createDataFrame([(45000.0,), (45000.25,), (0.5,)], "d double").select(text.serial_date(F.col("d")), text.serial_date(F.col("d"), True))
    assert [tuple(r) for r in serial.collect()] == [("2023-03-15", "2027-03-16"), ("2023-03-15T06:00:00", "2027-03-16T06:00:00"), ("1899-12-30T12:00:00", "1904-01-01T12:00:00")]


def test_kinds(spark):
    assert run(spark, kinds.parse_kind, "JPG", "markdown", "procreate 2", "Png") == ["jpeg", "md", "procreate-2", "png"]
    with pytest.raises(Exception, match="unknown kind"):
        run(spark, kinds.parse_kind, "exe")
    rows = kinds.dimension(spark).collect()
    assert len({r.kind for r in rows}) == 44 and {r.kind for r in rows if r.copied} == {"jpeg", "csv", "pdf", "txt", "svg"}
    assert run(spark, kinds.provider, "a@GMAIL.com", "b@mac.com", "c@work.example") == ["gmail", "icloud", None]


def test_one_decimal_rounds_by_the_exact_value(spark):
    # doubles whose shortest text ends in a 5 that they are not: just above, just below, and exact ties
    values = [241416 * 7 / (1 + 241416 % 130) / 60 / 24, 56376 * 7 / (1 + 56376 % 130) / 60 / 24, 167.65, 93.45, 0.35, 0.45, 0.25, 0.75, 2.0, -0.35, 1e12 + 0.5]
    frame = spark.createDataFrame(list(enumerate(values)), "k int, v double").orderBy("k")
    assert [r[0] for r in frame.select(text.one_decimal(F.col("v"))).collect()] == ["%.1f" % v for v in values]
    n = spark.createDataFrame([(k,) for k in (241416, 442152, 56376, 460152)], "k long")
    assert [r[0] for r in n.orderBy("k").select(text.estimate_duration(F.col("k") * 7, 1 + F.col("k") % 130)).collect()] == ["%.1fd" % (k * 7 / (1 + k % 130) / 60 / 24) for k in (56376, 241416, 442152, 460152)]
