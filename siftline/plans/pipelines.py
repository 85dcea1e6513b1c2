"""The jobs as wholes, each a composition of operators: what goes in and what comes out are DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kinds, paths, text
from ..journal import Journal
from ..operators import dedup, ledger, reports, runs, select
from ..session import settle
from ..sources import archives, bodystructure, sinks, vobject, zips
from ..sources.content_index import ContentIndex


def deduplicate(files: DataFrame, checkpoint: DataFrame, index: DataFrame | ContentIndex | None = None, journal: Journal | None = None) -> dict[str, DataFrame]:
    """files (bucket_alias, key, size, and content or path) to kept files with their places, merge records, failures and
    the new checkpoint rows. Archives are opened to any level up to ten; a root with a failure in it is not checkpointed.

    Files with a path are read where they lie, archives of any size included, and no content is ever a row's. With a
    journal, a run that starts again goes on where an earlier one was cut off: digests are not made a second time.
    """
    keep = journal.step if journal else lambda stage, make, of: settle(make(), stage)
    tasks = dedup.pending(files, checkpoint)
    wanted = tasks.where(~paths.is_apple_double(F.col("key")))
    split = lambda c: (F.substring_index(c, "\x01", 1), F.substring_index(c, "\x01", -1))
    tag = F.concat_ws("\x01", "bucket_alias", "key").alias("key")

    def opened() -> DataFrame:
        if "path" in files.columns:
            found = zips.tree(wanted.select(tag, "path", "size"))
        else:
            found = archives.all_members(wanted.select(tag, "content")).withColumn("content_hash", F.sha2("content", 256))
        alias, root = split(F.col("root_key"))
        return found.select(alias.alias("bucket_alias"), root.alias("root_key"), split(F.col("key"))[1].alias("original_key"), "content_hash", "error")

    leaves = keep("leaves", opened, wanted.select("bucket_alias", "key", "size"))
    hashed = leaves.where(F.col("content_hash").isNotNull() & ~paths.is_zip(F.col("original_key"))).select("bucket_alias", "root_key", "original_key", paths.extension_of(F.col("original_key")).alias("extension"), "content_hash")
    first = lambda: dedup.keep_first(hashed) if index is None else index.lookup(hashed) if isinstance(index, ContentIndex) else dedup.with_index(hashed, index)
    kept = keep("kept", first, hashed)
    placed = keep("placed", lambda: dedup.exact_names(kept.where("is_kept").select("bucket_alias", "original_key", "content_hash")), kept.select("bucket_alias", "original_key", "content_hash", "is_kept"))
    failed = leaves.where(F.col("error").isNotNull())
    tainted = dedup.tainted_roots(failed.select("bucket_alias", "root_key", F.lit(True).alias("failed")))
    done = dedup.to_checkpoint(tasks.select("bucket_alias", "key"), tainted, kept.select("bucket_alias", F.col("root_key").alias("key")))
    return {
        "summary": dedup.type_summary(tasks),
        "placed": placed.select("bucket_alias", "original_key", "content_hash", "extension", "placed"),
        "merged": dedup.merge_records(kept),
        "failures": failed.select("bucket_alias", F.col("original_key").alias("key"), "error"),
        "checkpoint": done,
    }


def transform(files: DataFrame, destination: DataFrame, kind: str, source: str) -> dict[str, DataFrame]:
    """files (key, content) of one kind to output rows (key, name, content) and one outcome a key.

    What is already complete at the destination, resource forks, lock stubs and message-shaped Markdown are left out
    with a reason. Kinds that need an external program are left to it, and kinds without a reader here have none; both
    come out as failed. Only files that already have their output's ending are copied as they are.
    """
    entry = next(k for k in kinds.KINDS if k[0] == kind)
    _, endings, output, family, tool = entry
    strict = family == "spreadsheet"
    mine = files.where(paths.has_extension(F.col("key"), *([endings] if kind == "procreate-2" else endings.split(" "))))
    keyed = mine.withColumn("grp", paths.group_key(F.lit(source), F.col("key"), strict))
    complete = select.group_states(destination).where("complete")
    chosen = settle(select.needing_pull(keyed, complete))
    pulled = chosen.where(F.col("skip_reason").isNull())
    if kind == "md":
        shaped = text.is_email_shaped(text.email_signals(text.window(F.make_valid_utf8(F.col("content").cast("string")))))
        signals = text.email_signals(text.window(F.make_valid_utf8(F.col("content").cast("string"))))
        pulled = settle(pulled.withColumn("shaped", shaped).withColumn("why", F.concat(F.lit("email-shaped: "), text.describe(signals))))
        told = pulled.where("shaped").select("key", F.lit("email_shaped").alias("shape"), "why")
        chosen = chosen.join(told, "key", "left").withColumn("skip_reason", F.coalesce("skip_reason", "shape")).drop("shape")
        pulled = pulled.where(~F.col("shaped")).drop("shaped", "why")
    single = lambda rows: rows.select("key", "grp", F.lit(None).cast("string").alias("part"), "content", F.lit(None).cast("string").alias("error"))
    if kind == "icns":
        parts = archives.largest_icons(pulled, ("grp",)).select("key", "grp", F.lit(None).cast("string").alias("part"), "content", "error")
    elif kind in archives.CONVERTERS and kind not in ("zip", "eml"):
        parts = archives.expand(pulled, archives.CONVERTERS[kind], ("grp",)).select("key", "grp", F.when(F.col("error").isNull() & F.lit(kind == "xlsx"), F.col("part")).alias("part"), "content", "error")
    elif kind in ("ics", "vcf"):
        shown = (vobject.calendar_text if kind == "ics" else vobject.contact_text)(pulled.select("key", "content"))
        why = F.when(F.octet_length(pulled["content"]) > vobject.MOST_BYTES, f"is larger than {vobject.MOST_BYTES >> 20} MiB").when(F.col("text").isNull(), f"is not {'an iCalendar' if kind == 'ics' else 'a vCard'} file")
        parts = pulled.join(shown, "key", "left").select("key", "grp", F.lit(None).cast("string").alias("part"), F.col("text").cast("binary").alias("content"), why.alias("error"))
    elif not tool and output in endings.split(" "):
        parts = single(pulled)
    elif not tool:
        parts = single(pulled).withColumn("content", F.lit(None).cast("binary")).withColumn("error", F.lit(f"no reader for {kind} files is here"))
    else:
        needs = F.lit(f"needs {tool}, which is not here")
        if kind == "key":  # often the ending of a private key
            needs = F.when(F.coalesce(text.header_kind(F.col("content")) != "zip", F.lit(True)), "is not a Keynote presentation: it does not begin as a zip container").otherwise(needs)
        parts = single(pulled).withColumn("error", needs).withColumn("content", F.lit(None).cast("binary"))
    parts = settle(parts)
    sheets = select.sheet_names(parts.where("part is not null").select("key", "grp", "content", F.split_part("part", F.lit(":"), F.lit(1)).cast("int").alias("position"), F.regexp_replace("part", "^[0-9]+:", "").alias("title")), output)
    plain = parts.where("part is null and error is null").select("key", F.concat("grp", F.lit(f".{output}")).alias("name"), "content")
    outputs = sheets.select("key", "name", "content").unionByName(plain)
    state = parts.groupBy("key").agg(F.max("error").alias("error"))
    outcome = F.when(F.col("error").isNotNull(), "failed").when(F.col("skip_reason").isNotNull(), "skipped").otherwise("copied" if not tool and output in endings.split(" ") else "transcoded")
    why = F.col("why") if "why" in chosen.columns else F.lit(None).cast("string")
    joined = chosen.select("key", "skip_reason", why.alias("why")).join(state, "key", "left")
    outcomes = joined.select("key", "skip_reason", F.coalesce("error", "why").alias("error"), outcome.alias("outcome"), F.when(F.col("error").isNotNull(), "transcode").alias("stage"))
    return {"outputs": outputs, "outcomes": outcomes, "collisions": select.collision_groups(mine)}


def email_scan(server: DataFrame, known: DataFrame, previous: DataFrame, at: str) -> DataFrame:
    """Status of every mailbox and of all: server and known have (mailbox, uidvalidity, uid), server also
    attachments or the structure that they are counted from; a structure that cannot be parsed counts as none."""
    if "structure" in server.columns:
        server = settle(server.withColumn("attachments", F.coalesce(bodystructure.attachments(F.col("structure")), F.lit(0))).drop("structure"))
    present = server.select("mailbox", "uidvalidity").distinct()
    valid = known.join(present, ["mailbox", "uidvalidity"], "left_semi")
    fresh = ledger.missing(server, valid).groupBy("mailbox").agg(ledger.sum_or_unknown(F.col("attachments")).alias("new_attachments"))
    rows = ledger.scan(server, valid).join(fresh.withColumn("has", F.lit(True)), "mailbox", "left").withColumn("new_attachments", F.when(F.col("has"), F.col("new_attachments")).otherwise(0)).drop("has")
    return ledger.carry_forward(ledger.with_total(rows).withColumn("last_scanned_at", F.lit(at)), previous)


def email_import(messages: DataFrame, known: DataFrame, identity: str, at: str, batch_size: int = 20, per_minute: int = 120) -> dict[str, DataFrame]:
    """messages (mailbox, uidvalidity, uid, content) to the objects to write, the merged ledger, the schedule, and the
    messages whose attachments could not be unpacked (key, error): these are delivered as they came, and told."""
    new = settle(ledger.missing(messages, known))
    box = paths.sanitize_mailbox(F.col("mailbox"), "/")
    raw = new.select(paths.message_key(F.lit(identity), box, F.col("uid")).alias("key"), "content")
    parts = settle(archives.expand(raw, archives.attachments), "attachments")
    attached = parts.where(F.col("error").isNull()).select(F.concat(F.regexp_replace("key", r"\.eml$", ""), F.lit("/attachments/"), paths.sanitize_filename(F.col("part"))).alias("key"), "content")
    batched = ledger.batches(new.select("mailbox", "uid"), batch_size)
    requests = batched.select(F.lit(identity).alias("lane"), F.struct("mailbox", "batch").alias("i"), F.lit(0.0).alias("at"), F.size("uids").alias("n"), "mailbox", "batch")
    return {"objects": raw.unionByName(attached), "unpack_failed": parts.where(F.col("error").isNotNull()).select("key", "error"), "ledger": ledger.merge(known, new.select(*ledger.KEY, F.lit(at).alias("ingested_at"))), "schedule": runs.schedule(requests, per_minute).select("mailbox", "batch", "start")}


def deliver(messages: DataFrame, known: DataFrame, identity: str, at: str, root: str, ledger_path: str) -> DataFrame:
    """Imports messages and writes down those that arrived: (key, bytes, outcome) of the objects.

    A message enters the ledger only after it and all its attachments are there; objects are written whole or not at
    all, and again under the same names by a later run if this one ends before the ledger does.
    """
    new = settle(ledger.missing(messages, known))
    done = sinks.put(email_import(new, known, identity, at)["objects"], root, existing="overwrite")
    message = lambda key: F.regexp_replace(key, r"(?s)(/attachments/.*|\.eml)$", "")
    broken = done.where(F.startswith("outcome", F.lit("failed"))).select(message(F.col("key")).alias("message")).distinct()
    name = message(paths.message_key(F.lit(identity), paths.sanitize_mailbox(F.col("mailbox"), "/"), F.col("uid")))
    arrived = new.withColumn("message", name).join(broken, "message", "left_anti").select(*ledger.KEY, F.lit(at).alias("ingested_at"))
    ledger.line(arrived).write.mode("append").text(ledger_path)
    return done


def report(result: dict[str, DataFrame], job: str, root: str, prefix: str) -> dict[str, str]:
    """Writes the report of deduplicate() or transform() under the run's folder; what could not be written, by name."""
    if "merged" in result:
        lines = reports.dedup_lines(result["merged"], result["failures"])
    elif "outcomes" in result:
        lines = reports.transform_lines(result["outcomes"], result["outputs"], result.get("collisions"))
    else:
        raise ValueError(f"{job} has no report of its own: write reports.summary_lines")
    return reports.publish({f"{job}-report": lines}, root, prefix)
