"""Operator 7: a deterministic sharded WARC writer, and the reader that takes its files apart again.

Records are sorted by identifier in ranges of about SHARD_BYTES of payload; each range is written by one task, which
begins a new file whenever the compressed size passes FILE_BYTES. Headers and digests are made anew from the
payload, dates and record ids are fixed by the inputs, so that a rerun gives the same bytes. Files appear under
temporary names and are renamed when whole; a manifest of all files is written last.

Of records with equal payloads of at least LEAST_BYTES the one with the largest identifier is a response, the others
are revisits that refer to it and carry no payload. Smaller records are all responses. Which is which is found on
digests alone, through the tree of runs of exact dedup, so a payload that a third of the pages share is no hot spot.

Null html is an empty payload, null url an empty target. Null identifiers come first and are never referred to
unless all of a group are null. Repeated rows are records each. An empty table gives no files and an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact
from .common import fresh_dir, settle, small_batches
from .files import Commit, cleaning, store
from .order import ranges

LEAST_BYTES = 1000
#: Payload bytes of a task's range; compressed bytes after which a file is full; zlib's level.
SHARD_BYTES, FILE_BYTES, LEVEL = 16 << 20, 8 << 20, 4
DATE = "2024-01-01T00:00:00Z"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:siftline:warc")
#: Fixed values of the WARC 1.1 standard.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [VERSION, f"WARC-Type: {kind}", f"WARC-Date: {DATE}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def page_record(page_id: int | None, url: str, payload: bytes, refers_to: tuple[int | None] | None) -> bytes:
    """A response, or with refers_to (the identifier of the response, in a tuple) a revisit."""
    digest = hashlib.sha1(payload).hexdigest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = {"WARC-Record-ID": record_id(page_id, digest), "WARC-Target-URI": "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)}
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to[0], digest), "X-Refers-To-Page-ID": str(refers_to[0])}
    fields |= {"WARC-Payload-Digest": base32(digest), "WARC-Block-Digest": base32(hashlib.sha1(block).hexdigest()), "Content-Type": "application/http;msgtype=response"}
    return record("revisit" if refers_to else "response", fields, block)


def verdicts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, digest (binary SHA-1), n_bytes and keep_id of every page."""
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    marked = settle(
        pages.select(F.col(key).cast("long").alias(key), body.alias("body")).select(
            key, F.unhex(F.sha1("body")).alias("digest"), F.octet_length("body").cast("long").alias("n_bytes"), F.xxhash64("body").alias("check")
        ),
        "payloads",
    )
    return settle(exact.tree_merge(marked, key, largest=True).select(key, "digest", "n_bytes", "keep_id"), "verdicts")


def write(pages: DataFrame, folder: str, *, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> list[str]:
    """Writes the files and the manifest; returns the files' paths in order."""
    spark = pages.sparkSession
    small_batches(spark)
    found = verdicts(pages, key, html)
    parts = ranges(found.withColumn("w", F.col("n_bytes") + 300), key, "w", shard_bytes)
    if not len(parts):
        return []
    # verdicts of revisits travel in front of the pages they are about: one exchange, and no join of payloads
    revisits = found.where((F.col("n_bytes") >= least_bytes) & ~F.col(key).eqNullSafe(F.col("keep_id"))).distinct()
    told = revisits.select(F.col(key).alias("k"), F.lit(0).alias("kind"), "digest", F.col("keep_id").alias("refers_to"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    sent = pages.select(F.col(key).cast("long").alias("k"), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = told.unionByName(sent).withColumn("shard", parts.of(F.col("k")))
    ordered = rows.repartitionById(len(parts), F.col("shard")).sortWithinPartitions("shard", F.col("k").asc_nulls_first(), "kind", "url", F.xxhash64("html"))

    def run(batches: Iterable[pa.RecordBatch], opened: list[Commit]) -> Iterator[pa.RecordBatch]:
        out, shard, n, known, about = None, None, 0, {}, object()

        def close() -> pa.RecordBatch:
            path, records = current
            return pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "records": records, "bytes": out.commit()}], schema)

        current = ("", 0)
        for batch in batches:
            columns = {name: batch.column(batch.schema.get_field_index(name)) for name in ("shard", "k", "kind", "digest", "refers_to", "url", "html")}
            for i in range(batch.num_rows):
                s, k = columns["shard"][i].as_py(), columns["k"][i].as_py()
                if k != about:
                    about, known = k, {}
                if columns["kind"][i].as_py() == 0:
                    known[columns["digest"][i].as_py()] = columns["refers_to"][i].as_py()
                    continue
                if out and (s != shard or out.size >= file_bytes):
                    yield close()
                    out = None
                if s != shard:
                    shard, n = s, 0
                if out is None:
                    path = f"{folder}/pages-{shard:06d}-{n:04d}.warc.gz"
                    out, n, current = Commit(path), n + 1, (path, 0)
                    opened[:] = [out]
                    out.write(record("warcinfo", {"WARC-Record-ID": record_id(None, path.rpartition("/")[2]), "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                payload = (columns["html"][i].as_py() or "").encode()
                refers = known.get(hashlib.sha1(payload).digest(), about) if known else about
                out.write(page_record(k, columns["url"][i].as_py() or "", payload, None if refers is about else (refers,)))
                current = (current[0], current[1] + 1)
        if out:
            yield close()

    schema = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    manifest = ordered.select("shard", "k", "kind", "digest", "refers_to", "url", "html").mapInArrow(cleaning(run), "shard int, path string, records long, bytes long")
    manifest.write.parquet(f"{folder}/manifest")
    return [r["path"] for r in spark.read.parquet(f"{folder}/manifest").orderBy("path").collect()]


def members(path: str, step: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one in memory at a time."""
    fs, inner = store(path)
    with fs.open_input_stream(inner, compression=None) as f:
        rest = f.read(step)
        while rest:
            unzip, parts = zlib.decompressobj(31), []
            while not unzip.eof:
                if not rest:
                    rest = f.read(step)
                    if not rest:
                        raise ValueError(f"{path} ends inside a record")
                parts.append(unzip.decompress(rest))
                rest = unzip.unused_data
            yield b"".join(parts)
            rest = rest or f.read(step)


def parse(member: bytes) -> tuple[str, dict[str, str], bytes]:
    """Type, header fields and block of a record, with its block digest checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if (told := fields.get("WARC-Block-Digest")) and told != base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not hold")
    return fields["WARC-Type"], fields, block


def page(kind: str, fields: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a page's record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(line[16:] for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")))
    told = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != told):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not hold")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), size, told, kind, number("X-Refers-To-Page-ID")


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page record in the files."""
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows: list[tuple] = []
                for kind, fields, block in map(parse, members(path)):
                    if kind != "warcinfo":
                        rows.append(page(kind, fields, block))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return files.repartition(max(1, len(paths))).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes pages into a fresh folder and reads the archives back."""
    spark = pages.sparkSession
    return read(spark, write(pages, fresh_dir(spark, "warc"), **options))


ORACLE = """
select page_id, payload_bytes, payload_digest,
       case when refers_to is null then 'response' else 'revisit' end as record_type, refers_to
from (
  select page_id, payload_bytes, payload_digest,
         case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
  from (
    select page_id, strlen(body)::bigint as payload_bytes, sha1(body) as payload_digest,
           max(page_id) over (partition by body) as last
    from (select page_id, coalesce(html, '') as body from pages)
  )
)
"""
