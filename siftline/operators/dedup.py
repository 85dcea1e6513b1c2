"""Keeping one copy of each identical file, placing it, and saying what happened to the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths
from ..session import settle


def order_of_keeping(*tail: str) -> list[Column]:
    """Dated keys before undated ones, then by key; the bucket decides between equal keys of several buckets."""
    return [paths.is_undated(F.col("original_key")).cast("int"), F.col("original_key"), *map(F.col, tail or ("bucket_alias",))]


def keepers(hashed: DataFrame) -> DataFrame:
    """content_hash with the key and bucket kept for it.

    The first of each hash is an aggregate, so copies are combined before the shuffle however many there are.
    """
    rank = F.struct(paths.is_undated(F.col("original_key")).cast("int").alias("undated"), "original_key", "bucket_alias", "extension")
    first = hashed.groupBy("content_hash").agg(F.min(rank).alias("first"))
    return first.select("content_hash", F.col("first.original_key").alias("kept_key"), F.col("first.bucket_alias").alias("kept_bucket"), F.col("first.extension").alias("kept_extension"))


def keep_first(hashed: DataFrame) -> DataFrame:
    """Every file with what is kept of its content, and whether it is that. hashed is read twice: settle what is dear."""
    joined = hashed.join(keepers(hashed), "content_hash")
    same = (F.col("original_key") == F.col("kept_key")) & (F.col("bucket_alias") == F.col("kept_bucket"))
    return joined.withColumn("is_kept", same)


def with_index(hashed: DataFrame, index: DataFrame) -> DataFrame:
    """keep_first, where the content index of earlier runs (content_hash, index_key, index_bucket) comes first:
    of a hash that it knows even the first file of this run is a duplicate."""
    latest = index.groupBy("content_hash").agg(F.max_by("index_key", "line").alias("index_key"), F.max_by("index_bucket", "line").alias("index_bucket"))
    joined = keep_first(hashed).join(latest, "content_hash", "left")
    known = F.col("index_key").isNotNull()
    return (
        joined.withColumn("is_kept", F.when(known, False).otherwise(F.col("is_kept")))
        .withColumn("kept_key", F.coalesce("index_key", "kept_key"))
        .withColumn("kept_bucket", F.coalesce("index_bucket", "kept_bucket"))
        .drop("index_key", "index_bucket")
    )


def merge_records(kept: DataFrame) -> DataFrame:
    """One report row for each file that another stands for."""
    place = F.concat(F.col("kept_extension"), F.lit("/"), paths.sanitize_filename(paths.basename(paths.after_zip_separator(F.col("kept_key")))))
    return kept.where(~F.col("is_kept")).select(
        F.col("original_key").alias("duplicate_key"),
        F.col("bucket_alias").alias("duplicate_bucket_alias"),
        place.alias("kept_path"),
        F.col("kept_key").alias("kept_original_key"),
        F.col("kept_bucket").alias("kept_bucket_alias"),
        "content_hash",
    )


def type_summary(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy(paths.extension_of(F.col("key")).alias("extension")).agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes"))


def pending(tasks: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """tasks that no checkpoint row names; a checkpoint row without a bucket names the key in every bucket."""
    exact = checkpoint.where(F.col("bucket_alias") != "").select("bucket_alias", "key").distinct()
    anywhere = checkpoint.where(F.col("bucket_alias") == "").select("key").distinct()
    return tasks.join(exact, ["bucket_alias", "key"], "left_anti").join(anywhere, "key", "left_anti")


def to_checkpoint(roots: DataFrame, tainted: DataFrame, placed: DataFrame) -> DataFrame:
    """Finished roots to write down: none of their descendants failed, and they were placed, or are archives, or
    resource forks that are skipped for good."""
    skipped = roots.where(paths.is_apple_double(F.col("key")))
    clean = roots.where(~paths.is_apple_double(F.col("key"))).join(tainted.select("bucket_alias", "key").distinct(), ["bucket_alias", "key"], "left_anti")
    zips = clean.where(paths.is_zip(F.col("key")))
    files = clean.where(~paths.is_zip(F.col("key"))).join(placed.select("bucket_alias", "key").distinct(), ["bucket_alias", "key"], "left_semi")
    return skipped.unionByName(zips).unionByName(files)


def tainted_roots(members: DataFrame) -> DataFrame:
    """Roots of which some descendant failed."""
    return members.groupBy("bucket_alias", "root_key").agg(F.bool_or("failed").alias("tainted")).where("tainted").select("bucket_alias", F.col("root_key").alias("key"))


def placed_names(files: DataFrame) -> DataFrame:
    """files with `placed`: extension/name, and from the second file of a name on a number before its extension.

    This is the plan for names that meet no other name so numbered; exact_names() is the one for any names.
    """
    name = paths.sanitize_filename(paths.basename(paths.after_zip_separator(F.col("original_key"))))
    named = files.withColumn("name", name).withColumn("extension", paths.extension_of(F.col("original_key")))
    number = F.row_number().over(W.partitionBy("extension", "name").orderBy(*order_of_keeping())).cast("bigint")
    dotted = F.col("name").rlike(r"(?s)^.+\.[^.]*$")
    stem = F.when(dotted, F.regexp_replace("name", r"(?s)\.[^.]*$", "")).otherwise(F.col("name"))
    end = F.when(dotted, F.concat(F.lit("."), F.substring_index("name", ".", -1))).otherwise("")
    numbered = F.concat(stem, F.lit("-"), number.cast("string"), end)
    return named.withColumn("n", number).withColumn("placed", F.concat("extension", F.lit("/"), F.when(F.col("n") == 1, F.col("name")).otherwise(numbered)))


def exact_names(files: DataFrame) -> DataFrame:
    """files with `placed` where a generated name may itself be taken: each name in order takes the first free number.

    Names can only meet names of their own family, that is with equal extension and equal stem once a number at its end
    is taken off. Where no generated name can be one that is given, numbers are ranks (as in placed_names); only
    families in which a name may meet a generated one are settled name by name, each with the next number to try.
    """
    import pandas as pd
    from pyspark.sql import types as T

    named = placed_names(files)
    dotted = F.col("name").rlike(r"(?s)^.+\.[^.]*$")
    end = F.when(dotted, F.concat(F.lit("."), F.substring_index("name", ".", -1))).otherwise("")
    stem = F.when(dotted, F.regexp_replace("name", r"(?s)\.[^.]*$", "")).otherwise(F.col("name"))
    family = F.regexp_replace(stem, r"(-[0-9]+)+$", "")
    ready = named.withColumn("family", family).withColumn("undated", paths.is_undated(F.col("original_key")))
    given = settle(ready.groupBy("extension", "name", "family").agg(F.count("*").alias("times")), "names")
    number = F.regexp_extract(stem, r"-([1-9][0-9]*)$", 1).try_cast("bigint")
    numbered = given.where(number > 1).select("extension", "family", F.concat(F.regexp_replace(stem, r"-[0-9]+$", ""), end).alias("name"), number.alias("number"))
    taken = numbered.groupBy("extension", "name", "family").agg(F.min("number").alias("least"), F.count("*").alias("others"))
    mixed = taken.join(given.where("times > 1"), ["extension", "name", "family"]).where(F.col("least") <= F.col("times") + F.col("others")).select("extension", "family").distinct()
    mixed = settle(mixed, "mixed")
    schema = T.StructType([f for f in ready.drop("n").schema.fields])

    def one_by_one(rows: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        following: dict[str, int] = {}
        placed = []
        rows = rows.sort_values(["undated", "original_key", "bucket_alias"], kind="stable")
        for name in rows["name"]:
            stem, dot, end = name.rpartition(".") if "." in name[1:] else (name, "", "")
            n, choice = following.get(name, 1), name if name not in following else f"{stem}-{following[name]}{dot}{end}"
            while choice in taken:
                n += 1
                choice = f"{stem}-{n}{dot}{end}"
            following[name] = n + 1
            taken.add(choice)
            placed.append(choice)
        return rows.assign(placed=[f"{e}/{p}" for e, p in zip(rows["extension"], placed, strict=True)])

    plain = ready.join(mixed, ["extension", "family"], "left_anti").select(*schema.names)
    met = ready.join(mixed, ["extension", "family"], "left_semi").select(*schema.names)
    return plain.unionByName(met.groupBy("extension", "family").applyInPandas(one_by_one, schema)).drop("family", "undated")
