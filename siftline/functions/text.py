"""Column functions on texts: error messages, message-shaped documents, sizes and durations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import ascii_lower, bound

# What error messages are recognised by.
UNREACHABLE = [
    "no such host",
    "dial tcp",
    "connection refused",
    "connection reset by peer",
    "i/o timeout",
    "no route to host",
    "network is unreachable",
    "TLS handshake timeout",
]
OVERLOADED = [
    "too many simultaneous connections",
    "too many connections",
    "too many requests",
    "try again later",
    "temporarily unavailable",
    "server unavailable",
    "over quota",
    "rate limit",
    "throttl",
]
WRONG_KIND = [
    "has no video stream",
    "is not an audio-only recording",
    "is not a readable spreadsheet",
    "is not a readable document",
    "is not a Keynote presentation",
    "is not a readable text clipping",
    "is not a readable icns icon",
    "is not a readable Procreate document",
    "is not an iCalendar file",
    "is not a vCard file",
]
NOT_RETRYABLE = [
    "moov atom not found",
    "Invalid data found when processing input",
    "Decoder (codec",
    "could not find codec parameters",
    "refusing an output that isn't full-size",
    "Unknown encoder",
    "converter crashed",
    "does not match its own thumbnail",
    "converted to an SVG that draws nothing",
    *WRONG_KIND,
]
# Header names of a raw message, and labels of a header table.
RAW_HEADERS = [
    "message-id:",
    "received:",
    "return-path:",
    "mime-version:",
    "dkim-signature:",
    "delivered-to:",
    "arc-seal:",
    "x-gmail-labels:",
]
LABELS = ["from", "to", "subject", "date"]
FAMILIES = ["frontmatter-headers", "provenance", "header-table", "raw-headers"]
#: Bytes read at either end of a long document; body lines searched for a header table.
WINDOW_BYTES, TABLE_LINES = 64 * 1024, 100


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def is_unreachable(error: Column) -> Column:
    return contains_any(error, UNREACHABLE)


def is_overloaded(error: Column) -> Column:
    return contains_any(ascii_lower(error), OVERLOADED)


def is_wrong_kind(error: Column) -> Column:
    return contains_any(error, WRONG_KIND)


def is_not_retryable(error: Column) -> Column:
    return contains_any(error, NOT_RETRYABLE)


def window(text: Column, size: int = WINDOW_BYTES) -> Column:
    """The whole of a text of up to two windows, else its first and last window with a line break between."""
    data = text.cast("binary")
    ends = F.concat(F.substring(data, 1, size), F.lit("\n").cast("binary"), F.substring(data, -size, size))
    return F.when(F.octet_length(text) <= 2 * size, text).otherwise(F.make_valid_utf8(ends.cast("string")))


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a last line break."""
    return F.transform(F.split(F.regexp_replace(text, "\n$", ""), "\n"), lambda s: F.regexp_replace(s, "\r$", ""))


def trimmed(s: Column) -> Column:
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def email_signals(text: Column) -> Column:
    """The four families of signs that a document is a rendered message."""
    body_text = F.regexp_replace(text, "^\ufeff", "")
    return bound(F.struct(body_text.alias("text"), F.split(body_text, "\n").alias("raw")), signals_of_lines)


def signals_of_lines(x: Column) -> Column:
    """email_signals() of (text, raw): a text and its lines."""
    raw = x["raw"]
    fence = lambda s: F.contains(s, F.lit("---")) & (trimmed(s) == "---")
    closing = F.array_position(F.transform(F.slice(raw, F.lit(2), F.size(raw)), fence), True)
    # the closing fence counts lines from 1; 0 where there is no front matter
    end = F.when(fence(F.get(raw, F.lit(0))) & (closing > 0), closing + 1).otherwise(0).cast("int")

    def split_at(end: Column) -> Column:
        front = F.when(end > 0, F.transform(F.slice(raw, F.lit(2), F.greatest(end - 2, F.lit(0))), lambda s: F.regexp_replace(s, "\r+$", ""))).otherwise(F.expr("cast(array() as array<string>)"))
        body = F.when(end > 0, F.array_join(F.slice(raw, end + 1, F.size(raw)), "\n")).otherwise(x["text"])
        return F.struct(front.alias("front"), lines(body).alias("body"))

    def ready(y: Column) -> Column:
        keyed = F.filter(y["front"], lambda s: F.contains(s, F.lit(":")) & ~s.rlike("^[ \t#-]"))
        pairs = F.transform(keyed, lambda s: F.struct(trimmed(F.substring_index(s, ":", 1)).alias("k"), trimmed(F.substr(s, F.length(F.substring_index(s, ":", 1)) + 2, F.length(s))).alias("v")))
        top = F.transform(F.slice(y["body"], 1, TABLE_LINES), lambda s: ascii_lower(trimmed(s)))
        return F.struct(y["front"].alias("front"), y["body"].alias("body"), pairs.alias("pairs"), top.alias("top"), ascii_lower(x["text"]).alias("lower"))

    return bound(end, lambda e: bound(split_at(e), lambda y: bound(ready(y), families)))


def families(z: Column) -> Column:
    """email_signals() of (front, body, pairs, top, lower): lines, keys and values of the front matter, the beginning
    of the body and the whole text in lower case."""
    has = lambda *names: F.exists(z["pairs"], lambda p: p["k"].isin(*names))
    heads = sum((has(n).cast("int") for n in ("from", "to", "cc", "subject")), F.lit(0))
    from_file = F.exists(z["pairs"], lambda p: (p["k"] == "source") & F.endswith(ascii_lower(F.regexp_replace(p["v"], "^[\"']+|[\"']+$", "")), F.lit(".eml")))
    tagged = F.exists(z["front"], lambda s: F.exists(F.split(s, r"[\s,\[\]\"']"), lambda t: F.startswith(t, F.lit("mailbox/")) | F.startswith(t, F.lit("identity/"))))
    named = F.contains(z["lower"], F.lit("original file")) & F.exists(z["body"], lambda s: F.contains(ascii_lower(s), F.lit("original file")) & F.contains(ascii_lower(s), F.lit(".eml")))

    def labelled(name: str) -> Column:
        cell = lambda s: trimmed(F.substring_index(F.regexp_replace(s, r"^\|+", ""), "|", 1)) == f"**{name}**"
        return F.exists(z["top"], lambda s: F.when(F.startswith(s, F.lit("|")), cell(s)).otherwise(F.startswith(s, F.lit(f"**{name}:**")) | F.startswith(s, F.lit(f"**{name}**:"))))

    heads_at = r"(?:\A|\n)(" + "|".join(RAW_HEADERS) + ")"
    raw_seen = F.size(F.array_distinct(F.regexp_extract_all(z["lower"], F.lit(heads_at), F.lit(1))))
    return F.struct(
        (has("sender_domain") | (heads >= 2)).alias("frontmatter_headers"),
        (has("has_attachments", "uid", "also-in") | from_file | tagged | named).alias("provenance"),
        (sum((labelled(n).cast("int") for n in LABELS), F.lit(0)) >= 3).alias("header_table"),
        (raw_seen >= 3).alias("raw_headers"),
    )


def signal_count(signals: Column) -> Column:
    return sum((signals[n.replace("-", "_")].cast("int") for n in FAMILIES), F.lit(0))


def is_email_shaped(signals: Column) -> Column:
    return signal_count(signals) >= 2


def describe(signals: Column) -> Column:
    return F.concat_ws(", ", *[F.when(signals[n.replace("-", "_")], F.lit(n)) for n in FAMILIES])


def one_decimal(value: Column) -> Column:
    """To one decimal as C's printf rounds: by the exact value of the double, ties to even. Rounding first would go by its
    shortest text, and 167.65 is a little more than that."""
    return F.call_function("format_number", value, F.lit("0.0"))


def format_bytes(size: Column) -> Column:
    """Size in the largest unit that leaves at least 1, to one decimal; bytes whole."""
    found = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        found = F.when(size >= 1024**power, F.concat(one_decimal(size / float(1024**power)), F.lit(f" {unit}"))).otherwise(found)
    return found


def estimate_duration(messages: Column, per_minute: Column) -> Column:
    """How long messages take at a pace: whole minutes, or hours or days to one decimal."""
    minutes = messages.cast("double") / F.greatest(per_minute, F.lit(1))
    return (
        F.when(minutes < 60, F.concat(F.format_string("%.0f", F.bround(minutes, 0)), F.lit("m")))
        .when(minutes < 60 * 48, F.concat(one_decimal(minutes / 60), F.lit("h")))
        .otherwise(F.concat(one_decimal(minutes / 60 / 24), F.lit("d")))
    )


def elapsed(days: Column) -> Column:
    """A length in days as HH:MM:SS, hours without bound, less than nothing as nothing."""
    seconds = F.greatest(F.round(days * 86400), F.lit(0.0)).cast("long")
    two = lambda n: F.lpad(n.cast("string"), F.greatest(F.lit(2), F.length(n.cast("string"))), F.lit("0"))
    hours = F.floor(seconds / 3600)
    return F.concat(two(hours), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60))


def serial_date(serial: Column, epoch_1904: bool = False) -> Column:
    """A spreadsheet's serial day as a date, or date and time where it has one; fractions of a second are ignored."""
    days = F.floor(serial)
    seconds = F.floor((serial - days) * 86400 + 0.0005)
    start = F.lit("1904-01-01" if epoch_1904 else "1899-12-30").cast("date")
    day = F.date_add(start, days.cast("int"))
    moment = F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + seconds)
    return F.when(seconds == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"))


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def is_truncated(before: Column, after: Column) -> Column:
    """Did an encoding lose more of a recording than half a second and 2 %?"""
    return (before - after) > F.greatest(F.lit(0.5), 0.02 * F.abs(before))


def is_stale(on_disk: Column, current: Column) -> Column:
    return on_disk.isNotNull() & (on_disk != current)


#: Elements that draw, beginnings of files in hexadecimal.
DRAWING = ["path", "image", "text", "polygon", "polyline", "circle", "ellipse", "line"]
HEADERS = {"504B0304": "zip", "69636E73": "icns", "89504E47": "png", "0000000C6A502020": "jp2"}
#: How TLS libraries say that a server spoke in plain text.
PLAINTEXT = ["record overflow", "wrong version number"]


def draws_something(svg: Column) -> Column:
    """Does an SVG draw anything outside its definitions, other than the boxes that exporters put around shapes?"""
    body = F.regexp_replace(svg, r"(?s)<defs(?:[^>]*/>|.*?</defs>|.*$)", "")
    end = r"(?=[\s\p{Z}\x85/>]|$)"
    return body.rlike(f"<(?:{'|'.join(DRAWING)}){end}") | body.rlike(f'<rect{end}(?![^>]*class="BoundingBox")')


def header_kind(content: Column) -> Column:
    """What a file is by its first bytes: zip, icns, png or jp2, else null."""
    start = F.hex(F.substring(content, 1, 8))
    return F.coalesce(*[F.when(F.startswith(start, F.lit(h)), F.lit(kind)) for h, kind in HEADERS.items()])


def tls_hint(error: Column) -> Column:
    """What to try where a TLS handshake met plain text; null for other errors."""
    return F.when(contains_any(ascii_lower(error), PLAINTEXT), F.lit("the server answered in plain text: try security=starttls"))


def lacks_starttls(greeting: Column) -> Column:
    """Does a greeting list what the server can do, and not STARTTLS? A greeting without a list proves nothing."""
    listed = F.regexp_extract(greeting, r"(?i)^\* [A-Z]+ \[CAPABILITY ([^\]]*)\]", 1)
    return (listed != "") & ~F.array_contains(F.split(F.upper(listed), " +"), "STARTTLS")
