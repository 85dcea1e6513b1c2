"""Mailboxes against the ledger of what was taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import scans

KEY = ["mailbox", "uidvalidity", "uid"]
TOTAL = "*"


def earliest(rows: DataFrame) -> DataFrame:
    """The ledger as a table: of repeated keys the earliest text of ingested_at."""
    return rows.groupBy(*KEY).agg(F.min("ingested_at").alias("ingested_at"))


def merge(ledger: DataFrame, more: DataFrame) -> DataFrame:
    return earliest(ledger.select(*KEY, "ingested_at").unionByName(more.select(*KEY, "ingested_at")))


def parse(text: DataFrame) -> DataFrame:
    """Ledger rows from lines; blank lines, comments and lines that do not parse are left out."""
    part = F.split("value", "\t")
    row = text.where((F.size(part) == 4) & ~F.startswith("value", F.lit("#"))).select(
        part[0].alias("mailbox"), part[1].try_cast("bigint").alias("uidvalidity"), part[2].try_cast("bigint").alias("uid"), part[3].alias("ingested_at")
    )
    number = lambda c: F.col(c).between(0, (1 << 32) - 1)
    return row.where(number("uidvalidity") & number("uid"))


def serialize(ledger: DataFrame) -> DataFrame:
    return line(ledger.orderBy(*KEY))


def line(ledger: DataFrame) -> DataFrame:
    """Rows as lines, in the order they have."""
    return ledger.select(F.concat_ws("\t", "mailbox", F.col("uidvalidity").cast("string"), F.col("uid").cast("string"), "ingested_at").alias("value"))


def missing(server: DataFrame, ledger: DataFrame) -> DataFrame:
    """Messages on the server that the ledger does not have under the mailbox's present validity."""
    return server.join(ledger.select(*KEY).distinct(), KEY, "left_anti")


def missing_by_uid(server: DataFrame, delivered: DataFrame) -> DataFrame:
    """The same against records that know no validity."""
    return server.join(delivered.select("mailbox", "uid").distinct(), ["mailbox", "uid"], "left_anti")


def sum_or_unknown(value: Column) -> Column:
    """A sum that is unknown as soon as one value is; the sum of nothing is 0."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.coalesce(F.sum(value), F.lit(0)))


def scan(server: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per mailbox: messages on the server, taken in, new, and gone from the server. Both sides have (mailbox, uid)."""
    sides = server.select("mailbox", "uid", F.lit(1).alias("s"), F.lit(0).alias("i")).unionByName(ledger.select("mailbox", "uid", F.lit(0).alias("s"), F.lit(1).alias("i")))
    seen = sides.groupBy("mailbox", "uid").agg(F.max("s").alias("s"), F.max("i").alias("i"))
    count = lambda c: F.sum(c.cast("bigint"))
    s, i = F.col("s"), F.col("i")
    return seen.groupBy("mailbox").agg(count(s).alias("server_messages"), count(i).alias("ingested"), count(s * (1 - i)).alias("new_messages"), count(i * (1 - s)).alias("removed_on_server"))


def with_total(rows: DataFrame) -> DataFrame:
    """rows and their total under the name "*"; an unknown number of attachments makes the total unknown."""
    plain = ["server_messages", "ingested", "new_messages", "removed_on_server"]
    total = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in plain], sum_or_unknown(F.col("new_attachments")).alias("new_attachments")).withColumn("mailbox", F.lit(TOTAL))
    return rows.select("mailbox", *plain, "new_attachments").unionByName(total)


def carry_forward(current: DataFrame, previous: DataFrame) -> DataFrame:
    """current with last_in_sync_at: now if nothing is new, else as it was; of repeated previous rows the last holds."""
    before = previous.groupBy("mailbox").agg(F.max_by("last_in_sync_at", "line").alias("before"))
    return current.join(before, "mailbox", "left").withColumn("last_in_sync_at", F.when(F.col("new_messages") == 0, F.col("last_scanned_at")).otherwise(F.col("before"))).drop("before")


def attachments_within_cap(rows: DataFrame, cap: int = 5000) -> DataFrame:
    """new_attachments, unknown for every mailbox of an identity that has more new messages than the cap."""
    totals = rows.groupBy("identity").agg(F.sum("new_messages").alias("all_new"))
    return rows.join(totals, "identity").withColumn("new_attachments", F.when(F.col("all_new") <= cap, F.col("new_attachments"))).drop("all_new")


def seed(listing: DataFrame, mailboxes: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, ambiguous paths) from the keys of messages delivered earlier: a path stands for the mailbox that
    owns it only if no other mailbox does."""
    owned = mailboxes.groupBy("relpath").agg(F.count("*").alias("owners"), F.min("mailbox").alias("mailbox"), F.min("uidvalidity").alias("uidvalidity"))
    folder = F.when(F.contains("key", F.lit("/")), F.regexp_replace("key", "/[^/]*$", "")).otherwise("")
    uid = F.regexp_extract(paths.basename(F.col("key")), r"^\+?([0-9]+)\.eml$", 1).try_cast("bigint")
    files = listing.select(folder.alias("relpath"), uid.alias("uid")).where(F.col("uid").between(0, (1 << 32) - 1))
    joined = files.join(owned, "relpath")
    rows = joined.where("owners = 1").select(*KEY).distinct().withColumn("ingested_at", F.lit(at))
    return rows, joined.where("owners > 1").select("relpath").distinct()


def reset_epoch(rows: DataFrame, current: DataFrame) -> DataFrame:
    """Checkpoint rows without those of mailboxes whose validity has changed since; rows without one stay."""
    now = current.select("mailbox", F.col("uidvalidity").alias("now"))
    return rows.join(now, "mailbox", "left").where(~((F.col("uidvalidity") != F.col("now")) & F.col("uidvalidity").isNotNull() & F.col("now").isNotNull())).drop("now")


def batches(pending: DataFrame, size: int = 20) -> DataFrame:
    """(mailbox, batch, uids): ascending uids in batches of fixed size; the last may be smaller."""
    size = max(size, 1)
    numbered = scans.running_count(scans.deal(pending.select("mailbox", "uid"), ["mailbox"], ["uid"]), "place", ["mailbox"], ["uid"])
    dealt = numbered.withColumn("batch", F.floor((F.col("place") - 1) / size))
    return dealt.groupBy("mailbox", "batch").agg(F.array_sort(F.collect_list("uid")).alias("uids"))


def round_robin(batched: DataFrame) -> DataFrame:
    """Batches (identity, position) with `turn`: every identity's first, then every identity's second, and so on."""
    return scans.done(scans.running_count(scans.deal(batched, ["identity"], ["position"]), "turn", ["identity"], ["position"]))


def identity_summary(pending: DataFrame) -> DataFrame:
    return pending.groupBy("identity").agg(F.countDistinct("mailbox").alias("mailboxes"), F.count("*").alias("messages"))
