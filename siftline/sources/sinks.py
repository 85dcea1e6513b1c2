"""Writing objects: rows of (key, content) become files under a root, written by Spark's tasks where the rows are.

A file appears under a temporary name and is renamed when whole, so lost or repeated tasks leave the same files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, small_batches
from .stores import Pack

OUTCOME = "key string, bytes long, outcome string"


def put(objects: DataFrame, root: str, *, existing: str = "error", partitions: int | None = None) -> DataFrame:
    """Writes objects and returns what became of each: written, kept (it was there) or failed (it was there, or an error).

    existing: "error" for names that must be new, "skip" to resume, "overwrite". partitions bounds how many tasks write
    at a time, which is the concurrency of the upload.
    """
    if existing not in ("error", "skip", "overwrite"):
        raise ValueError(f"no such way with existing objects: {existing}")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            done = []
            for key, content in zip(batch["key"], batch["content"], strict=True):
                path = f"{base}/{key}"
                there = system.get_file_info(path).type != fs.FileType.NotFound
                if there and existing != "overwrite":
                    done.append((key, 0, "kept" if existing == "skip" else "failed: it exists"))
                    continue
                try:
                    folder = path.rpartition("/")[0]
                    system.create_dir(folder, recursive=True)
                    temp = f"{folder}/.{uuid.uuid4().hex}.tmp"
                    with system.open_output_stream(temp) as out:
                        out.write(content)
                    system.move(temp, path)
                    done.append((key, len(content), "written"))
                except OSError as error:
                    done.append((key, 0, f"failed: {error}"))
            yield pd.DataFrame(done, columns=["key", "bytes", "outcome"])

    small_batches(objects.sparkSession)
    rows = objects.select("key", "content")
    rows = rows.coalesce(partitions) if partitions else rows
    return settle(rows.mapInPandas(run, OUTCOME), "objects")


def packed(objects: DataFrame, root: str) -> DataFrame:
    """Writes objects (key, content) one after another into a file a task, for those that are too small for a file each:
    key, path, start and size of each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Pack(root) as pack:
            for batch in batches:
                places = [pack.add([content]) for content in batch.column("content").to_pylist()]
                if places:
                    columns = [pa.array(c, t) for c, t in zip(zip(*places, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", "path", "start", "size"])

    small_batches(objects.sparkSession)
    return settle(objects.select("key", "content").mapInArrow(run, "key string, path string, start long, size long"), "packed")


def copy(files: DataFrame, root: str, *, only: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Copies (key, content) rows, all or those whose keys are in `only`, over what is there."""
    chosen = files.join(only.select("key").distinct(), "key", "left_semi") if only is not None else files
    return put(chosen, root, existing="overwrite", partitions=partitions)


def transfer_summary(done: DataFrame) -> DataFrame:
    """One row: transfers, bytes and errors."""
    failed = F.startswith("outcome", F.lit("failed"))
    return done.agg(F.count_if(F.col("outcome") == "written").alias("transfers"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count_if(failed).alias("errors"))


def purge(spark, root: str, *, confirm: str) -> bool:
    """Deletes a folder and all in it for good; confirm must repeat its name. False if there was none."""
    if confirm != root:
        raise ValueError("a purge has to be confirmed by the name of what is to go")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    return bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))


def place_by_extension(files: DataFrame, root: str) -> None:
    """Tables rather than files: rows partitioned by extension, appended."""
    files.write.mode("append").partitionBy("extension").parquet(root)
