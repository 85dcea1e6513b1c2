"""The content index of earlier runs as a table in buckets of its digests, kept sorted in them.

A run adds a generation of files to the buckets and never rewrites older ones. A lookup deals only the run's own files by
digest, into as many parts as there are buckets: the index is read bucket by bucket and is not shuffled, however large it
has grown. The number of buckets is written beside the table, so every session reads it as it was written.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup
from .stores import system_of, write_whole

COLUMNS = ["content_hash", "index_key", "index_bucket", "line"]
#: Buckets of a new index.
BUCKETS = 64


@dataclass
class ContentIndex:
    """An index under a path that driver and executors share; `buckets` holds for a new one."""

    path: str
    buckets: int = BUCKETS

    def open(self, spark: SparkSession) -> str:
        """The name of the index as a table of this session; an index that is not there yet is empty."""
        system, note = system_of(f"{self.path.rstrip('/')}/_buckets")
        if system.get_file_info(note).is_file:
            with system.open_input_file(note) as file:
                self.buckets = int(file.read())
        else:
            write_whole(f"{self.path.rstrip('/')}/_buckets", [str(self.buckets).encode()])
        name = f"content_index_{hashlib.sha256(self.path.encode()).hexdigest()[:16]}"
        fields = "content_hash string, index_key string, index_bucket string, line bigint"
        place = self.path.replace("'", "\\'")
        spark.sql(f"create table if not exists {name} ({fields}) using parquet clustered by (content_hash) sorted by (content_hash) into {self.buckets} buckets location '{place}'")
        return name

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.open(spark))

    def append(self, rows: DataFrame) -> None:
        """Adds a generation (content_hash, index_key, index_bucket, line), a file a bucket."""
        spark = rows.sparkSession
        name = self.open(spark)
        dealt = rows.select("content_hash", "index_key", "index_bucket", F.col("line").cast("long").alias("line")).repartition(self.buckets, "content_hash")
        dealt.write.mode("append").format("parquet").bucketBy(self.buckets, "content_hash").sortBy("content_hash").saveAsTable(name)

    def lookup(self, hashed: DataFrame) -> DataFrame:
        """dedup.with_index against this index; the files are dealt into its buckets once, for all of its joins."""
        known = self.read(hashed.sparkSession)
        return dedup.with_index(hashed.repartition(self.buckets, "content_hash"), known)
