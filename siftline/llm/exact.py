"""Operator 2: exact dedup by a tree-merge of sorted digest runs, with DataFrame operations only.

Every row belongs to one of RUNS runs (by a hash of its identifier), and a run is the sorted list of the distinct
digests of its rows, each with the identifier to keep and a count. Runs meet in binomial rounds: in a round, FAN
neighbouring runs are merged into one, digest by digest, and each digest retains one identifier and the sum of the
counts. What stands for a text is its SHA-256 together with its length in bytes and a second, independent hash, and
merging compares all three at every level, so an entry never takes in a text that differs from it. After the last
round one run is left, itself spread over the cluster by digest; its entries go down the tree again, level by
level, to the rows.

A group of copies of any size, a third of all rows for example, is RUNS entries at the leaves, FAN at each node
above: no task ever holds more than a part of it. Null text counts as empty; null identifiers are the last to be
kept; rows repeated with one identifier count each, and all of those with the kept identifier are "kept".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle, unused

RUNS, FAN = 64, 8
#: What stands for a text.
MARK = ("digest", "n_bytes", "check")


def mark(text: Column) -> list[Column]:
    """The columns that stand for a text: SHA-256, length in bytes, and a second hash."""
    return [
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    ]


def marked(rows: DataFrame, id_col: str, text: str) -> DataFrame:
    """id_col and MARK's columns for the text with A-Z lowered, as a table of a few dozen bytes a row."""
    folded = rows.select(F.col(id_col), ascii_lower(F.coalesce(F.col(text), F.lit(""))).alias("folded"))
    return settle(folded.select(id_col, *mark(F.col("folded"))), "digests")


def tree_merge(rows: DataFrame, id_col: str, *, largest: bool = False, runs: int = RUNS, fan: int = FAN) -> DataFrame:
    """rows (with MARK's columns) plus keep_id and group_size, merged up the tree of runs and sent down again."""
    choose = F.max if largest else F.min
    levels = [rows.withColumn("run", F.pmod(F.xxhash64(F.col(id_col), F.lit("run")), F.lit(runs)).cast("int"))]
    level, left = levels[0].groupBy(*MARK, "run").agg(choose(id_col).alias("keep_id"), F.count("*").alias("group_size")), runs
    ups = [level]
    while left > 1:
        left = -(-left // fan)
        level = (
            ups[-1]
            .withColumn("run", F.floor(F.col("run") / fan).cast("int"))
            .groupBy(*MARK, "run")
            .agg(choose("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
        ups.append(level)
    found = ups[-1]
    for below in reversed(ups[:-1]):
        parent = found.select(*MARK, F.col("run").alias("parent"), "keep_id", "group_size")
        found = below.select(*MARK, "run", F.floor(F.col("run") / fan).cast("int").alias("parent")).join(parent, [*MARK, "parent"]).drop("parent")
    return levels[0].join(found, [*MARK, "run"]).drop("run")


def groups(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256 of the text with A-Z lowered."""
    merged = tree_merge(marked(docs.select(F.col(id_col), F.col(text)), id_col, text), id_col, largest=largest)
    return merged.select(
        id_col,
        "keep_id",
        "group_size",
        F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", largest: bool = True) -> DataFrame:
    """docs with one row of each group of equal texts, all columns kept; of rows repeated with id and text, one copy stays."""
    row, other = unused(docs, "row", "other")
    numbered = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("text")))
    merged = settle(tree_merge(marked(numbered.select(row, text), row, text), row, largest=largest), "merged")
    losers = merged.where(F.col(row) != F.col("keep_id")).select(F.col(row).alias(other)).distinct()
    kept = numbered.join(losers, F.col(row) == F.col(other), "left_anti")
    repeated = merged.where(F.col(row) == F.col("keep_id")).groupBy(F.col(row).alias(other)).count().where("count > 1").drop("count")
    if not repeated.isEmpty():
        once = kept.join(repeated, F.col(row) == F.col(other), "left_anti")
        kept = once.unionByName(kept.join(repeated, F.col(row) == F.col(other), "left_semi").dropDuplicates([row]))
    return kept.drop(row)


ORACLE = """
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
from (
  select doc_id, sha256(folded) as text_sha256,
         max(doc_id) over (partition by folded) as keep_id,
         count(*) over (partition by folded) as group_size
  from (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as folded from documents)
)
"""
