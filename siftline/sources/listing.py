"""Object listings as DataFrames: one or several sources, filtered by ending, empty where a source may be missing."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

LISTING = "path string, key string, size bigint, modified timestamp"


def listing(spark: SparkSession, root: str, *, recursive: bool = True, extensions: list[str] | None = None, missing_ok: bool = False) -> DataFrame:
    """Files under root: path, key (relative to root) and size. Contents are not read.

    The endings given are compared without regard to case. A missing root is an error unless missing_ok, which makes it
    an empty listing.
    """
    root = root.rstrip("/")
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root if recursive else f"{root}/*")
    except AnalysisException as error:
        if missing_ok and "PATH_NOT_FOUND" in str(error.getCondition()):
            return spark.createDataFrame([], LISTING)
        raise
    bare = root.split(":", 1)[-1].lstrip("/")
    key = F.regexp_replace(F.col("path"), "^.*?\\Q" + bare + "\\E/", "")
    found = files.select("path", key.alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return found.where(paths.has_extension(F.col("key"), *[e.lower() for e in extensions])) if extensions else found


def union_of(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources as one, each row with the alias of its source."""
    return reduce(DataFrame.unionByName, [rows.withColumn("bucket_alias", F.lit(alias)) for alias, rows in sources.items()])


def names(listed: DataFrame) -> DataFrame:
    """The distinct file names of a listing."""
    return listed.select(paths.basename(F.col("key")).alias("name")).distinct()


def contents(spark: SparkSession, root: str, *, most_bytes: int = 512 << 20) -> DataFrame:
    """Files with their bytes; larger ones are left out and come back from oversized()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") <= most_bytes).select("path", F.col("length").alias("size"), "content")


def oversized(spark: SparkSession, root: str, *, most_bytes: int = 512 << 20) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.where(F.col("length") > most_bytes).select("path", F.col("length").alias("size"), F.lit("larger than allowed").alias("error"))
