"""What is still to be done: skip reasons, completeness of output groups, colliding names, undelivered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths
from ..session import settle
from . import scans


def skip_reason(done: Column) -> Column:
    """Why a key is not pulled, in the order of the tests; null: it is pulled."""
    key = F.col("key")
    return F.when(paths.is_apple_double(key), "apple_double").when(paths.is_lock_stub(key), "lock_stub").when(done, "already_done")


def needing_pull(keys: DataFrame, complete: DataFrame) -> DataFrame:
    """keys (key, group) with their skip_reason; complete has the groups whose outputs are all there."""
    done = complete.select("grp").distinct().withColumn("done", F.lit(True))
    return keys.join(done, "grp", "left").withColumn("skip_reason", skip_reason(F.col("done").isNotNull())).drop("done")


def dispatch(arrivals: DataFrame, complete: DataFrame) -> DataFrame:
    """arrivals (key, grp, position) with `outcome`: a skip reason, already_dispatched behind the key's first arrival, or
    queued. Every source may report a key, so it can arrive many times; positions of one key differ."""
    first = arrivals.groupBy("key").agg(F.min("position").alias("first"))
    done = complete.select("grp").distinct().withColumn("done", F.lit(True))
    seen = arrivals.join(first, "key").join(done, "grp", "left")
    later = F.when(F.col("position") != F.col("first"), "already_dispatched").otherwise("queued")
    return seen.withColumn("outcome", F.coalesce(skip_reason(F.col("done").isNotNull()), later)).drop("first", "done")


def group_states(names: DataFrame) -> DataFrame:
    """(grp, complete) from destination names: an output without a marker completes its group; otherwise all markers
    must agree on the total and each of its indices must be there."""
    stem = F.regexp_replace("name", r"(?s)\.[^.]*$", "")
    # outer, for Spark would work the groups out a second time to see whether there are any
    found = names.select(F.explode_outer(paths.candidate_groups(stem)).alias("c")).where("c is not null").select("c.grp", "c.rest")
    # distinct markers first, as two numbers, so that a group is counted from at most as many rows as it has different outputs
    marked = found.where((F.col("rest") == "") | F.startswith("rest", F.lit("-"))).select("grp", (F.col("rest") == "").alias("plain"), paths.marker_text(F.col("rest")).alias("mark"))
    m = paths.marker_numbers(F.col("mark"))
    marks = marked.select("grp", "plain", m["index"].alias("i"), m["total"].alias("n")).distinct()
    # where all agree on the total, each index is one row; other markers are left out last, for a test before would read them twice
    state = marks.groupBy("grp").agg(F.bool_or("plain").alias("plain"), F.count("i").alias("k"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("plain or k > 0")
    return state.select("grp", (F.col("plain") | F.coalesce((F.col("lo") == F.col("hi")) & (F.col("k") == F.col("hi")), F.lit(False))).alias("complete"))


def collision_groups(keys: DataFrame) -> DataFrame:
    """(fold, members, n) of the keys that a case-blind file system takes for one."""
    grouped = keys.select("key").distinct().groupBy(paths.local_fold(F.col("key")).alias("fold"))
    return grouped.agg(F.array_sort(F.collect_set("key")).alias("members")).where(F.size("members") > 1).withColumn("n", F.size("members").cast("bigint"))


def colliding(keys: DataFrame) -> DataFrame:
    """The keys with their fold and the number of keys that share it, without gathering any group."""
    folded = keys.select("key").distinct().withColumn("fold", paths.local_fold(F.col("key")))
    return folded.join(folded.groupBy("fold").count().where("count > 1").select("fold", F.col("count").alias("n")), "fold")


def split_variants(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys that go in bulk, keys that collide)."""
    clash = colliding(keys).select("key")
    return keys.join(clash, "key", "left_anti"), keys.join(clash, "key", "left_semi")


def variant_slots(keys: DataFrame) -> DataFrame:
    """key and slot of colliding keys: in order, each goes to the first slot in which every beginning of its path is
    free or taken in the same spelling.

    That rule has a closed form. Spellings of one name below one path exclude each other whole, and come one after the
    other in the order of keys, so the second one's keys begin where the first one's slots end. Names that fold apart do not
    meet. A path therefore needs as many slots as the neediest of the names below it, a name as many as its spellings
    together, and a key's slot is the sum, along its path, of what the spellings before each of its parts need. The
    needs are summed up level by level from the deepest paths, with joins and aggregates on all cores, however many keys
    lie below one folder.
    """
    chosen = colliding(keys).select("key").distinct()
    parts = F.split("key", "/", -1)
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("head"), F.array_join(F.slice(parts, F.lit(1), n - 1), "/").alias("parent"), F.element_at(parts, n).alias("name")))
    paths_of = settle(chosen.select("key", F.explode(heads).alias("p")).select("key", "p.*"), "paths")
    nodes = paths_of.select("depth", "head", "parent", "name").distinct()
    nodes = settle(nodes.withColumn("fold", paths.local_fold(F.col("name"))).drop("name"), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    needs, below = [], None
    for depth in range(deepest, 0, -1):
        level = nodes.where(F.col("depth") == depth)
        level = level.withColumn("need", F.lit(1).cast("long")) if below is None else level.join(below, "head", "left").withColumn("need", F.greatest(F.lit(1).cast("long"), F.coalesce("inner", F.lit(0))))
        level = settle(level.select("depth", "head", "parent", "fold", "need"), "needs")
        needs.append(level)
        names = level.groupBy("parent", "fold").agg(F.sum("need").alias("need"))
        below = names.groupBy(F.col("parent").alias("head")).agg(F.max("need").alias("inner"))
    if not needs:
        return chosen.select("key", F.lit(0).cast("long").alias("slot"))
    every = needs[0]
    for more in needs[1:]:
        every = every.unionByName(more)
    lane = ["depth", "parent", "fold"]
    ahead = scans.done(scans.running_sum(scans.deal(every, lane, ["head"]), "ahead", F.col("need"), lane, ["head"], before=True))
    placed = paths_of.select("key", "depth", "head").join(ahead.where("ahead > 0").select("depth", "head", "ahead"), ["depth", "head"], "left")
    return placed.groupBy("key").agg(F.coalesce(F.sum("ahead"), F.lit(0)).cast("long").alias("slot"))


def undelivered(intended: DataFrame, dispatched: DataFrame, failures: DataFrame, variants: DataFrame) -> DataFrame:
    """Intended keys that were never dispatched, with the reason as far as it is known."""
    missing = intended.join(dispatched.select("key").distinct(), "key", "left_anti")
    failed = failures.groupBy("key").agg(F.min("error").alias("error"))
    joined = missing.join(failed, "key", "left").join(variants.select("key").distinct().withColumn("variant", F.lit(True)), "key", "left")
    detail = F.when(F.col("error").isNotNull(), F.concat(F.lit("pulled apart for its colliding name, and that pull failed: "), "error")).when(F.col("variant"), "pulled apart for its colliding name, without an error or a result").otherwise("in the pull set, but never reported as copied")
    return joined.select("key", detail.alias("detail"))


def group_outputs(names: DataFrame, group: str) -> DataFrame:
    """Names that belong to a group, in order."""
    return names.where(F.startswith("name", F.lit(f"{group}.")) | F.startswith("name", F.lit(f"{group}-"))).orderBy("name")


def sheet_names(sheets: DataFrame, extension: str = "csv") -> DataFrame:
    """Destination names of a workbook's sheets (grp, position, title), numbered in order."""
    index = F.row_number().over(W.partitionBy("grp").orderBy("position")).cast("bigint")
    total = F.count("*").over(W.partitionBy("grp"))
    return sheets.withColumn("i", index).withColumn("n", total).withColumn("name", paths.sheet_name(F.col("grp"), F.col("i"), F.col("n"), F.col("title"), extension))
