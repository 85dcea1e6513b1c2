"""Zip archives read where they lie, of any size: members are rows, one archive is many tasks, no member is held whole.

1. `directory` reads the end and the central directory of each archive by seeks: a row a member, nothing extracted.
2. `within_budget` drops members by running sums over the directory, without opening one.
3. members are dealt over tasks by their compressed bytes, neighbours together; a task opens an archive once, seeks to
   each member and streams it in pieces: into a digest (`digests`), a file of its task (`spilled`), or a row (`contents`).

An archive may be a part of a file: `start` is its first byte there, and `size` its bytes. `tree` follows archives in archives:
inner ones that are stored as they are are read where they lie in the outer one, at any depth; those that are compressed are
streamed into a file a task in the shared folder, which goes when the tree is known.
What is extracted is measured: a member that gives more or less than the directory says, or another checksum, has an error,
and so have encrypted members and methods other than stored and deflated. An error is the member's own.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import runs
from ..session import settle, settle_each, shared_folder, small_batches
from .archives import DEPTH, EXPANSION
from .stores import PIECE, Pack, Part, batches_of, by_bytes, digests as file_digests, opened

MEMBER = "root_key string, key string, path string, start long, zip_size long, position long, part string, size long, packed long, offset long, method int, flags int, crc long, error string"
FIELDS = [f.split()[0] for f in MEMBER.split(", ")]
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
TYPES = [ARROW[f.split()[1]] for f in MEMBER.split(", ")]
#: Bytes of a member that may be one row's content.
WHOLE = 64 << 20
#: Signatures and record layouts of the format.
END, END_64, LOCATOR, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


def central_directory(file) -> tuple[int, int, int, int]:
    """(first byte, bytes, members, bytes put before the archive) of the central directory."""
    size = file.size()
    file.seek(max(0, size - 65_557))
    tail = file.read()
    at = tail.rfind(END)
    if at < 0 or len(tail) - at < 22:
        raise ValueError("is not a zip archive")
    n, length, first = struct.unpack("<HII", tail[at + 10 : at + 20])
    end = size - len(tail) + at
    if (n == 0xFFFF or 0xFFFFFFFF in (length, first)) and at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        file.seek(end - 20 - 56)
        record = file.read(56)
        if record[:4] == END_64:
            end -= 76
            n, length, first = struct.unpack("<QQQ", record[32:56])
    before = end - length - first
    if before < 0:
        raise ValueError("has a damaged directory")
    return first + before, length, n, before


def members_of(file) -> Iterator[dict]:
    """The members of an archive in the directory's order, folders left out."""
    first, length, n, before = central_directory(file)
    file.seek(first)
    held, left = b"", length
    for position in range(n):
        while len(held) < 46 or len(held) < 46 + sum(struct.unpack("<3H", held[28:34])):
            more = file.read(min(PIECE, left))
            if not more:
                raise ValueError("has a damaged directory")
            held, left = held + more, left - len(more)
        if held[:4] != ENTRY:
            raise ValueError("has a damaged directory")
        flags, method, crc, packed, size, n_name, n_extra, n_note = struct.unpack("<HH4xIIIHHH", held[8:34])
        (offset,) = struct.unpack("<I", held[42:46])
        name, extra = held[46 : 46 + n_name], held[46 + n_name : 46 + n_name + n_extra]
        held = held[46 + n_name + n_extra + n_note :]
        while len(extra) >= 4:
            kind, n_bytes = struct.unpack("<HH", extra[:4])
            if kind == 1:  # sizes and places that do not fit into 32 bits, in this order
                wide = iter(struct.unpack(f"<{n_bytes // 8}Q", extra[4 : 4 + n_bytes // 8 * 8]))
                size = next(wide) if size == 0xFFFFFFFF else size
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            extra = extra[4 + n_bytes :]
        text = name.decode("utf-8" if flags & 0x800 else "cp437", errors="replace").split("\0")[0]
        if not text.endswith("/"):
            yield {"position": position, "part": text, "size": size, "packed": packed, "offset": offset + before, "method": method, "flags": flags, "crc": crc}


def first_byte(file, member: dict) -> int:
    """Where a member's bytes begin in its archive: behind a header of its own."""
    file.seek(member["offset"])
    head = file.read(30)
    if head[:4] != LOCAL:
        raise ValueError("has no header where the directory says")
    return member["offset"] + 30 + sum(struct.unpack("<HH", head[26:30]))


def stream(file, member: dict) -> Iterator[bytes]:
    """A member's bytes in pieces, checked against what the directory says of them."""
    if member["flags"] & 1:
        raise ValueError("is encrypted")
    if member["method"] not in (0, 8):
        raise ValueError(f"is compressed by method {member['method']}, which is not read here")
    file.seek(first_byte(file, member))
    inflate = zlib.decompressobj(-15) if member["method"] == 8 else None
    left, size, crc = member["packed"], 0, 0

    def inflated() -> Iterator[bytes]:
        nonlocal left
        while left:
            raw = file.read(min(PIECE, left))
            if not raw:
                raise EOFError("ends too early")
            left -= len(raw)
            if inflate is None:
                yield raw
                continue
            while raw:
                yield inflate.decompress(raw, PIECE)
                raw = inflate.unconsumed_tail
        if inflate is not None:
            yield inflate.flush()

    for piece in inflated():
        size, crc = size + len(piece), zlib.crc32(piece, crc)
        if size > member["size"]:
            break
        if piece:
            yield piece
    if size != member["size"] or crc != member["crc"]:
        raise ValueError("is not what the directory says")


def directory(archives: DataFrame) -> DataFrame:
    """MEMBER rows of archives (key, path, start and size where they are parts of files, and root_key where it is not the key
    itself); an archive whose directory cannot be read is a row with an error."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for root, key, path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {"root_key": root, "key": key, "path": path, "start": start}
                try:
                    with opened(path) as whole:
                        file = whole if start is None else Part(whole, start, size)
                        for member in members_of(file):
                            yield own | {"zip_size": file.size()} | member
                except (OSError, ValueError, struct.error, StopIteration) as error:
                    yield own | {"error": f"{type(error).__name__}: {error}"}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of((tuple(map(row.get, FIELDS)) for row in listed(batches)), FIELDS, TYPES)

    small_batches(archives.sparkSession)
    root = F.col("root_key") if "root_key" in archives.columns else F.col("key")
    place = ["start", "size"] if "start" in archives.columns else [F.lit(None).cast("long").alias(c) for c in ("start", "size")]
    return archives.select(root.alias("root_key"), "key", "path", *place).mapInArrow(run, MEMBER)


def within_budget(members: DataFrame, times: int = EXPANSION) -> DataFrame:
    """MEMBER rows without those that systems leave behind, and without those beyond their archive's budget of extracted
    bytes: the sizes of all members ahead count, dropped ones too, and empty members always pass."""
    sound = members.where("error is null")
    kept = runs.within_budget(sound.withColumnRenamed("key", "archive"), times).where("kept").drop("kept").withColumnRenamed("archive", "key")
    return kept.where(~paths.is_skippable_member(F.col("part"))).select(*FIELDS).unionByName(members.where("error is not null"))


def each(members: DataFrame, work: Callable[[dict, object, Pack], dict], schema: str, folder: str = "") -> DataFrame:
    """work's row for each of the MEMBER rows, with OWN's columns; work gets a member, its archive and the task's file in
    folder. A task opens an archive once."""
    names, types = [f.split()[0] for f in schema.split(", ")], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    arrow = [types[f.split()[1]] for f in schema.split(", ")]

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        last, file = None, None
        with Pack(folder) as pack:
            try:
                for batch in batches:
                    for member in batch.to_pylist():
                        row = {n: member[n] for n in OWN}
                        try:
                            if member["path"] != last:
                                last, file = None, (file.close() if file else None)
                                file, last = opened(member["path"]), member["path"]
                            row |= work(member, file if member["start"] is None else Part(file, member["start"], member["zip_size"]), pack)
                        except (OSError, ValueError, EOFError, zlib.error, struct.error) as error:
                            row["error"] = f"{type(error).__name__}: {error}"
                        yield tuple(map(row.get, names))
            finally:
                if file:
                    file.close()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(told(batches), names, arrow)

    small_batches(members.sparkSession)
    broken = members.where("error is not null").select(*OWN)
    dealt = by_bytes(members.where("error is null").withColumn("packed", F.col("packed") + 1024), "packed", "key", "position")
    return dealt.withColumn("packed", F.col("packed") - 1024).mapInArrow(run, schema).unionByName(broken, allowMissingColumns=True)


#: What a member's row keeps whatever is done with it: its root, its archive's key, its name, place and error.
OWN = ("root_key", "key", "part", "position", "error")
KEPT = "root_key string, key string, part string, position long, error string"


def digests(members: DataFrame) -> DataFrame:
    """OWN, bytes and content_hash of each of the MEMBER rows."""

    def work(member: dict, file, _: Pack) -> dict:
        digest, size = hashlib.sha256(), 0
        for piece in stream(file, member):
            digest.update(piece)
            size += len(piece)
        return {"bytes": size, "content_hash": digest.hexdigest()}

    return each(members, work, f"{KEPT}, bytes long, content_hash string")


def contents(members: DataFrame) -> DataFrame:
    """OWN and content; a member of more than WHOLE bytes has an error, for rows hold it whole."""

    def work(member: dict, file, _: Pack) -> dict:
        if member["size"] > WHOLE:
            raise ValueError(f"is larger than {WHOLE >> 20} MiB")
        return {"content": b"".join(stream(file, member))}

    return each(members, work, f"{KEPT}, content binary")


def spilled(members: DataFrame, folder: str) -> DataFrame:
    """OWN and where each member lies as it is: a file (spill), the first byte (start) and the bytes (size). A member that is
    stored is read, for its checksum, and lies in its archive; others are streamed into a file a task in folder."""

    def work(member: dict, file, pack: Pack) -> dict:
        if member["method"] == 0:
            for _ in stream(file, member):
                pass
            place = member["path"], (member["start"] or 0) + first_byte(file, member), member["size"]
        else:
            place = pack.add(stream(file, member))
        return dict(zip(("spill", "start", "size"), place, strict=True))

    return each(members, work, f"{KEPT}, spill string, start long, size long", folder)


def full_key() -> Column:
    """archive!member, or the archive's key where a row stands for the archive."""
    return F.when(F.col("part").isNull(), F.col("key")).otherwise(paths.member_key(F.col("key"), F.col("part")))


def tree(files: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root_key, key, depth, bytes, content_hash, error) of files (key, path, size; start where they are parts of files, which
    archives alone may be) and of all that is in them.

    Archives in archives are opened to the given depth; those below are rows with an error. Archives have no digest of
    their own. Every level is written, so lost executors repeat little; of what is written only the rows stay.
    """
    return settle_each(files.sparkSession, [lambda: levels(files, depth)], "tree")


def levels(files: DataFrame, depth: int) -> DataFrame:
    """tree's rows, from tables and files in the shared folder."""
    folder = shared_folder(files.sparkSession, "inner")
    is_zip = paths.is_zip(F.col("key"))
    found = file_digests(files.where(~is_zip)).select(F.col("key").alias("root_key"), "key", F.lit(0).alias("depth"), "bytes", "content_hash", "error")
    level = files.where(is_zip).withColumn("root_key", F.col("key"))
    for n in range(1, depth + 1):
        every = settle(directory(level), "directory")  # to be dealt by ranges it would be read twice
        listed = settle(within_budget(every), "members")
        inner = F.coalesce(paths.is_zip(F.col("part")) & F.col("error").isNull(), F.lit(False))
        leaf = lambda rows, error="error": rows.select("root_key", full_key().alias("key"), F.lit(n).alias("depth"), *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in (("bytes", "long"), ("content_hash", "string"))], F.expr(error).alias("error"))  # noqa: B023, E731
        found = found.unionByName(leaf(digests(listed.where(~inner))))
        nested = listed.where(inner)
        if nested.isEmpty():
            break
        if n == depth:
            found = found.unionByName(leaf(nested, f"'ValueError: archives nest deeper than {depth} levels'"))
            break
        lying = settle(spilled(nested, folder), "inner")
        found = found.unionByName(leaf(lying.where("error is not null")))
        level = lying.where("error is null").select("root_key", full_key().alias("key"), F.col("spill").alias("path"), "start", "size")
    return found
