"""A journal of a run: what a stage has written is taken from there when the run starts again.

A stage is whole once its table and then its note are written; the note holds a fingerprint of what the stage was made of.
A run that was cut off makes only the stages that are not whole, or whose input has changed, and reads no content for
the others. The folder must be shared by driver and executors, and belongs to one job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.stores import system_of, write_whole


def fingerprint(rows: DataFrame) -> str:
    """The number of rows and two hashes of them that do not depend on their order; repeated rows count."""
    columns = sorted(rows.columns)
    hashed = lambda seed: F.xxhash64(*columns, F.lit(seed)).cast("decimal(38,0)")
    return ",".join(map(str, [*columns, *rows.agg(F.count("*"), F.sum(hashed(1)), F.sum(hashed(2))).first()]))


class Journal:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def note(self, stage: str) -> str | None:
        system, name = system_of(f"{self.folder}/{stage}.done")
        if not system.get_file_info(name).is_file:
            return None
        with system.open_input_file(name) as file:
            return file.read().decode()

    def step(self, stage: str, make: Callable[[], DataFrame], of: DataFrame) -> DataFrame:
        """The stage's table: as an earlier run left it if it was made of rows like `of`, else made and written now."""
        mark, path = fingerprint(of), f"{self.folder}/{stage}"
        if self.note(stage) != mark:
            make().write.mode("overwrite").parquet(path)
            write_whole(f"{self.folder}/{stage}.done", [mark.encode()])
        return self.spark.read.parquet(path)
