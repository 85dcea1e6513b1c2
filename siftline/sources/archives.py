"""Files that hold other files or tables: each reader turns rows (key, content) into rows, inside Spark's tasks.

Spark deals the files over tasks, and a task holds one file and one of its parts at a time. The parsing of a format is
a few lines over the standard library. Files that cannot be read become rows with an error and no content.
"""

from __future__ import annotations

import csv
import functools
import io
import plistlib
import posixpath
import re
import struct
import zipfile
from collections.abc import Callable, Iterable, Iterator
from email import message_from_bytes
from email.policy import EmailPolicy
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..session import settle, small_batches

#: Extracted bytes allowed for each byte of an archive, levels of archives in archives, bytes of a table.
EXPANSION, DEPTH, TABLE_BYTES = 100, 10, 512 << 20

PART = "key string, part string, position long, content binary, error string"
NAMES, TYPES = ["key", "part", "position", "content", "error"], [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
#: Bytes and rows of a batch of parts, about.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 1000
Parts = Iterator[tuple[str, bytes]]


def expand(files: DataFrame, parts: Callable[[bytes], Parts], carry: tuple[str, ...] = ()) -> DataFrame:
    """PART rows of files (key, content) by a reader that yields the name and bytes of each part.

    Parts leave a task in Arrow batches of about BATCH_BYTES; a part larger than that is a batch of its own. Columns named
    in `carry` (strings) come with each part of their file, so that no join has to bring them back.
    """
    names, types = [*NAMES, *carry], [*TYPES, *[pa.string()] * len(carry)]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for key, content, *more in zip(*batch.columns, strict=True):
                position, own, also = 0, key.as_py(), [c.as_py() for c in more]
                try:
                    for name, data in parts(content.as_py() or b""):
                        rows.append((own, name, position, data, None, *also))
                        position, held = position + 1, held + len(data)
                        if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                            yield table(rows)
                            rows, held = [], 0
                except Exception as error:  # noqa: BLE001  any damage of a file is that file's result
                    rows.append((own, None, position, None, f"{type(error).__name__}: {error}", *also))
        if rows:
            yield table(rows)

    small_batches(files.sparkSession)
    return files.select("key", F.col("content").cast("binary").alias("content"), *carry).mapInArrow(run, ", ".join([PART, *[f"{c} string" for c in carry]]))


def zip_members(content: bytes) -> Parts:
    """Members in order, without folders; reading stops counting on what a member says of its size: what is really
    extracted is measured, and once it is beyond the budget this and all later members that are not empty are dropped."""
    budget, total = EXPANSION * len(content), 0
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            with archive.open(info) as member:
                data = member.read(max(0, budget - total) + 1)
            total += len(data)
            if total <= budget or not data:
                yield info.filename, data


def members(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Members of zip files as PART rows keyed by archive!member, without what systems leave behind."""
    found = expand(files, zip_members, carry)
    kept = found.where(F.col("part").isNull() | ~paths.is_skippable_member(F.col("part")))
    return kept.select(F.when(F.col("part").isNull(), F.col("key")).otherwise(paths.member_key(F.col("key"), F.col("part"))).alias("key"), F.col("key").alias("archive"), "part", "position", "content", "error", *carry)


def all_members(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root_key, key, content, depth, error) of files and of what is in them, archives in archives included.

    Archives below the deepest level are rows with an error, so that their root is known not to be whole.
    """
    level = files.select(F.col("key").alias("root_key"), "key", "content", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("error"))
    found = level
    for n in range(1, depth + 1):
        zips = level.where(paths.is_zip(F.col("key")) & F.col("content").isNotNull())
        level = settle(members(zips, ("root_key",)).select("root_key", "key", "content", F.lit(n).alias("depth"), "error"))
        if level.isEmpty():
            break
        if n == depth:
            deep = paths.is_zip(F.col("key")) & F.col("content").isNotNull()
            level = level.withColumn("error", F.when(deep, f"ValueError: archives nest deeper than {depth} levels").otherwise(F.col("error")))
            level = level.withColumn("content", F.when(~deep, F.col("content")))
        found = found.unionByName(level)
    return found


#: Parsed header fields that a worker remembers, and characters of the longest of them.
FIELDS, FIELD = 1024, 1000


class Remembering(EmailPolicy):
    """The library's policy with header fields parsed once: it parses a field whenever one asks for it, eighteen times for
    the types in a message of two parts, and most fields are those of other messages."""

    def header_fetch_parse(self, name, value):
        return super().header_fetch_parse(name, value) if hasattr(value, "name") or len(value) > FIELD else field(name, value)


@functools.lru_cache(FIELDS)
def field(name: str, value: str):
    return EmailPolicy.header_fetch_parse(REMEMBERING, name, value)


REMEMBERING = Remembering()


def attachments(content: bytes) -> Parts:
    """Attachments of a message under safe names; of equal names the later ones get numbers."""
    taken: set[str] = set()
    for part in message_from_bytes(content, policy=REMEMBERING).iter_attachments():
        data = part.get_payload(decode=True)
        data = part.as_bytes() if data is None else data
        given = part.get_filename()
        if not data and not given:
            continue
        name = posixpath.basename((given or "attachment").rstrip("/")) or "file"
        stem, dot, end = name.rpartition(".") if "." in name[1:] else (name, "", "")
        choice, n = name, 1
        while choice in taken:
            n += 1
            choice = f"{stem}-{n}{dot}{end}"
        taken.add(choice)
        yield choice, data


def rows_to_csv(rows: Iterable[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    return out.getvalue().encode()


def tsv_to_csv(content: bytes) -> Parts:
    """A tab-separated table of rows of any width; a table without rows is an error."""
    if len(content) > TABLE_BYTES:
        raise ValueError("larger than a table may be")
    rows = [r for r in csv.reader(io.StringIO(content.decode(), newline=""), delimiter="\t") if r]
    if not rows:
        raise ValueError("is not a readable document: no rows to convert")
    yield "csv", rows_to_csv(rows)


def clipping(content: bytes) -> Parts:
    """The text of a text clipping, its UTF-8 form before the older one."""
    data = plistlib.loads(content).get("UTI-Data")
    for name in ("public.utf8-plain-text", "com.apple.traditional-mac-plain-text"):
        value = (data or {}).get(name)
        if isinstance(value, str | bytes):
            yield "txt", value.encode() if isinstance(value, str) else value.decode().encode()
            return
    raise ValueError("is not a readable text clipping")


def icon_places(content: bytes) -> Iterator[tuple[str, int, int]]:
    """Entry types of the PNG and JPEG 2000 images of an icon file, and where their bytes begin and end."""
    if content[:4] != b"icns":
        raise ValueError("is not a readable icns icon")
    at = 8
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack(">I", content[at + 4 : at + 8])[0]
        if content.startswith((b"\x89PNG", b"\x00\x00\x00\x0cjP  "), at + 8, at + size):
            yield kind.decode("latin-1"), at + 8, min(at + size, len(content))
        at += max(size, 8)


def icon_images(content: bytes) -> Parts:
    """The PNG and JPEG 2000 images of an icon file, named by their entry types."""
    for kind, start, end in icon_places(content):
        yield kind, content[start:end]


#: Nominal widths of an icon file's entries.
ICON_WIDTHS = {"icp4": 16, "icp5": 32, "icp6": 64, "ic07": 128, "ic08": 256, "ic09": 512, "ic10": 1024, "ic11": 32, "ic12": 64, "ic13": 256, "ic14": 512}


def largest_image(content: bytes) -> Parts:
    """The image of an icon file with the greatest nominal width, then the most bytes; the first of equal ones. Only this
    one is copied out of the file."""
    places = list(icon_places(content))
    if not places:
        raise ValueError("holds no PNG or JPEG 2000 image")
    kind, start, end = max(places, key=lambda place: (ICON_WIDTHS.get(place[0], 0), place[2] - place[1]))
    yield kind, content[start:end]


def largest_icons(files: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, part, content, error): the largest image of each icon file. Files that cannot be read, or hold no image that
    can be copied, have an error."""
    return expand(files, largest_image, carry).select("key", "part", "content", "error", *carry)


SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def sheets(content: bytes) -> Parts:
    """The sheets of a workbook that are not empty, each as CSV, named by position and title."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = set(book.namelist())
        tree = lambda name: ElementTree.fromstring(book.read(name))
        shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dated = date_styles(tree("xl/styles.xml")) if "xl/styles.xml" in names else set()
        workbook = tree("xl/workbook.xml")
        old = next((p.get("date1904") in ("1", "true") for p in workbook.iter(f"{SHEET}workbookPr")), False)
        targets = {r.get("Id"): posixpath.normpath(posixpath.join("xl", r.get("Target"))).lstrip("/") for r in tree("xl/_rels/workbook.xml.rels")}
        link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        for number, sheet in enumerate(workbook.iter(f"{SHEET}sheet"), 1):
            rows = [[cell_text(c, shared, dated, old) for c in filled(r)] for r in tree(targets[sheet.get(link)]).iter(f"{SHEET}row")]
            if any(any(r) for r in rows):
                width = max(map(len, rows))
                yield f"{number}:{sheet.get('name')}", rows_to_csv([[*r, *[""] * (width - len(r))] for r in rows])


def filled(row: ElementTree.Element) -> list[ElementTree.Element | None]:
    """The cells of a row with None where one is missing."""
    found: list = []
    for cell in row.iter(f"{SHEET}c"):
        letters = re.match("[A-Z]+", cell.get("r") or "")
        at = len(found)
        if letters:
            at = 0
            for letter in letters[0]:
                at = at * 26 + ord(letter) - 64
            at -= 1
        found += [None] * (at - len(found))
        found.append(cell)
    return found


def date_styles(styles: ElementTree.Element) -> set[int]:
    """Numbers of the cell styles that show dates; elapsed times are told by brackets."""
    formats = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{SHEET}numFmt")}
    is_date = lambda n: 14 <= n <= 22 or n in (45, 47) or bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\\.|\[[^hms\]]*\]', "", formats.get(n, "")).lower()))
    used = next(iter(styles.iter(f"{SHEET}cellXfs")), ())
    return {k for k, x in enumerate(used) if is_date(int(x.get("numFmtId") or 0))}


def cell_text(cell: ElementTree.Element | None, shared: list[str], dated: set[int], old: bool) -> str:
    """A cell as text: whole numbers without a point, dates in ISO form, booleans in lower case, errors empty."""
    if cell is None:
        return ""
    kind, value = cell.get("t"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    text = "" if value is None else value.text or ""
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return "true" if text == "1" else "false"
    if kind == "e" or not text or kind in ("str", "d"):
        return "" if kind == "e" else text
    number = float(text)
    if int(cell.get("s") or 0) in dated:
        day = pd.Timestamp("1904-01-01" if old else "1899-12-30") + pd.Timedelta(seconds=int(number * 86400 + 0.0005))
        return day.strftime("%Y-%m-%d") if day == day.normalize() else day.strftime("%Y-%m-%dT%H:%M:%S")
    return str(int(number)) if number == int(number) else repr(number) if "e" not in repr(number) else f"{number:.17f}".rstrip("0")


CONVERTERS: dict[str, Callable[[bytes], Parts]] = {"xlsx": sheets, "tsv": tsv_to_csv, "textclipping": clipping, "zip": zip_members, "eml": attachments, "icns": icon_images}
