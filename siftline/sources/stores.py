"""Files of a store by reference: rows hold a path and a size, and tasks open, stream and close what lies there.

A path is a URI of any file system that Arrow knows, or a local path that all executors share. Nothing here holds a whole
file: contents pass in pieces of PIECE bytes. Work is dealt by bytes and not by rows, for a row of a hundred bytes may
stand for a hundred gigabytes.
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..session import settle, small_batches

#: Bytes held at a time, bytes that a task is to read or write about, and tasks at most.
PIECE, TASK_BYTES, MOST_TASKS = 1 << 20, 128 << 20, 20_000
#: Bytes that opening a file counts for, so that many small files are many tasks; rows of a batch.
FILE_BYTES, ROWS = 64 << 10, 1000


def system_of(path: str):
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    system, name = system_of(path)
    return system.open_input_file(name)


class Part:
    """So many bytes of an open file from a start on, read as a file of their own; closing it leaves the file open."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.bytes, self.at = file, start, size, 0

    def size(self) -> int:
        return self.bytes

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, most: int | None = None) -> bytes:
        left = max(0, self.bytes - self.at)
        self.file.seek(self.start + self.at)
        found = self.file.read(left if most is None else min(most, left))
        self.at += len(found)
        return found


class Pack:
    """A file in a folder for the contents that a task has, one after another; without a content it is not made.

    Its name is drawn in the task, so that an attempt that is repeated writes another; the folder is its user's to delete.
    """

    def __init__(self, folder: str):
        self.folder, self.path, self.out, self.at = folder, "", None, 0

    def __enter__(self) -> Pack:
        return self

    def __exit__(self, *_) -> None:
        if self.out:
            self.out.close()

    def add(self, pieces: Iterable[bytes]) -> tuple[str, int, int]:
        """(path, first byte, bytes) of a content; what there is of one that ends in an error is passed over. That the file
        cannot be written is no content's error but the task's."""
        start = self.at
        for piece in itertools.chain([b""], pieces):
            try:
                self.write(piece)
            except OSError as error:
                raise RuntimeError(f"{self.path or self.folder} cannot be written: {error}") from error
        return self.path, start, self.at - start

    def write(self, piece: bytes) -> None:
        if not self.out:
            system, folder = system_of(self.folder)
            system.create_dir(folder, recursive=True)
            name = uuid.uuid4().hex
            self.path, self.out = f"{self.folder}/{name}", system.open_output_stream(f"{folder}/{name}")
        self.out.write(piece)
        self.at += len(piece)


def pieces_of(file) -> Iterator[bytes]:
    while piece := file.read(PIECE):
        yield piece


def write_whole(path: str, pieces: Iterable[bytes], *, replace: bool = True) -> tuple[int, str]:
    """Writes pieces under a temporary name that becomes the path once all are there; (bytes, SHA-256).

    What was there is replaced, or kept with an error. If the pieces end in an error nothing is left behind.
    """
    from pyarrow import fs

    system, name = system_of(path)
    folder, _, base = name.rpartition("/")
    if not replace and system.get_file_info(name).type != fs.FileType.NotFound:
        raise FileExistsError(f"{base} exists")
    system.create_dir(folder, recursive=True)
    temp, size, digest = f"{folder}/.{uuid.uuid4().hex}.tmp", 0, hashlib.sha256()
    try:
        with system.open_output_stream(temp) as out:
            for piece in pieces:
                out.write(piece)
                size += len(piece)
                digest.update(piece)
        system.move(temp, name)
    except BaseException:
        if system.get_file_info(temp).type != fs.FileType.NotFound:
            system.delete_file(temp)
        raise
    return size, digest.hexdigest()


def by_bytes(rows: DataFrame, size: str, lane: str, order: str, *, task_bytes: int = TASK_BYTES) -> DataFrame:
    """rows dealt over tasks of about task_bytes: neighbours of a lane (an archive, a folder) share a task until it is full,
    and a lane beyond that is several tasks. Sorted by lane and order in each."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    tasks = max(1, min(MOST_TASKS, -(-total // task_bytes) * 2))
    summed = scans.running_sum(scans.deal(rows, [lane], [order]), "__ahead", F.col(size), [lane], [order], before=True)
    part = F.floor(F.col("__ahead") / task_bytes)
    dealt = scans.done(summed.withColumn("__part", part)).repartition(tasks, F.col(lane), F.col("__part")).sortWithinPartitions(lane, order)
    return dealt.select(*rows.columns)


def batches_of(rows: Iterable[tuple], names: list[str], types: Iterable[pa.DataType], *, most: int = ROWS, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches bounded by rows and by the bytes of their binary values."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= most or size >= most_bytes:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def digests(files: DataFrame) -> DataFrame:
    """files (key, path, size) with bytes, content_hash (SHA-256) and error of what lies at the path."""
    names = ["key", "bytes", "content_hash", "error"]

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size, digest, error = 0, hashlib.sha256(), None
                try:
                    with opened(path) as file:
                        for piece in pieces_of(file):
                            size += len(piece)
                            digest.update(piece)
                except OSError as found:
                    error = f"{type(found).__name__}: {found}"
                yield key, size if error is None else None, digest.hexdigest() if error is None else None, error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(told(batches), names, (pa.string(), pa.int64(), pa.string(), pa.string()))

    small_batches(files.sparkSession)
    lane = F.regexp_replace("path", "/[^/]*$", "").alias("lane")
    dealt = by_bytes(files.select("key", "path", (F.coalesce("size", F.lit(0)) + FILE_BYTES).alias("size"), lane), "size", "lane", "path")
    return dealt.select("key", "path").mapInArrow(run, "key string, bytes long, content_hash string, error string")


def copy(files: DataFrame, *, existing: str = "error") -> DataFrame:
    """Copies files (source, target, size) without their contents in rows: source, target, bytes, content_hash, outcome.

    Outcomes are written, kept (existing="skip" and the target has the source's size), or failed with the reason. A target
    appears when it is whole, with the digest of what was written; copies that were cut off leave nothing under its name.
    existing: "error", "skip" to resume, or "overwrite". A "skip" reads no content where sizes agree.
    """
    if existing not in ("error", "skip", "overwrite"):
        raise ValueError(f"no such way with existing objects: {existing}")
    names = ["source", "target", "bytes", "content_hash", "outcome"]
    types = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())

    def one(source: str, target: str) -> tuple:
        system, name = system_of(source)
        size = system.get_file_info(name).size
        if size is None:
            return 0, None, "failed: there is no such source"
        if existing == "skip":
            other, there = system_of(target)
            if other.get_file_info(there).size == size:
                return 0, None, "kept"
        with system.open_input_file(name) as file:
            done, digest = write_whole(target, pieces_of(file), replace=existing != "error")
        return done, digest, "written" if done == size else f"failed: {done} of {size} bytes"

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    yield source, target, *one(source, target)
                except OSError as error:
                    yield source, target, 0, None, f"failed: {error}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(told(batches), names, types)

    small_batches(files.sparkSession)
    lane = F.regexp_replace("source", "/[^/]*$", "").alias("lane")
    dealt = by_bytes(files.select("source", "target", (F.coalesce("size", F.lit(0)) + FILE_BYTES).alias("size"), lane), "size", "lane", "source")
    return settle(dealt.select("source", "target").mapInArrow(run, "source string, target string, bytes long, content_hash string, outcome string"), "copies")
