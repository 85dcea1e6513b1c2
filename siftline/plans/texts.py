"""Queries on texts and kinds of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kinds, paths, text
from .registry import query
from .views import BASE, EXTENSION, OBJECTS, objects, table

MESSAGES = r"""
c as (select conv_id, turn, role, case (conv_id + turn) % 4
  when 0 then '---' || chr(10) || 'from: a@example.com' || chr(10) || 'subject: "x"' || chr(10) || 'uid: 5' || chr(10) || '---' || chr(10) || text
  when 1 then '| **From** | x |' || chr(10) || '| **To** | y |' || chr(10) || '| **Date** | z |' || chr(10) || 'Original file: mail/5.EML' || chr(10) || text
  when 2 then 'Message-ID: <1>' || chr(10) || 'Received: x' || chr(10) || 'MIME-Version: 1.0' || chr(10) || chr(10) || text
  else text end as body from conversations)"""


@query("email_shape", f"""with {MESSAGES} select conv_id, turn, body is not null and (conv_id + turn) % 4 in (0, 1) as shaped,
case (conv_id + turn) % 4 when 0 then 'frontmatter-headers, provenance' when 1 then 'provenance, header-table' when 2 then 'raw-headers' else '' end as families from c""")
def email_shape(spark, sf_dir):
    """Turns of conversations, three quarters of them dressed as messages in one way each."""
    c = table(spark, sf_dir, "conversations")
    k = (F.col("conv_id") + F.col("turn")) % 4
    body = (
        F.when(k == 0, F.concat(F.lit('---\nfrom: a@example.com\nsubject: "x"\nuid: 5\n---\n'), "text"))
        .when(k == 1, F.concat(F.lit("| **From** | x |\n| **To** | y |\n| **Date** | z |\nOriginal file: mail/5.EML\n"), "text"))
        .when(k == 2, F.concat(F.lit("Message-ID: <1>\nReceived: x\nMIME-Version: 1.0\n\n"), "text"))
        .otherwise(F.col("text"))
    )
    seen = c.select("conv_id", "turn", text.email_signals(text.window(body)).alias("s"))
    return seen.select("conv_id", "turn", text.is_email_shaped(F.col("s")).alias("shaped"), text.describe(F.col("s")).alias("families"))


@query("text_window", """with h as (select doc_id, text, strlen(text) as n, hex(encode(text)) as x from documents),
c as (select *, x[1:512] as head, right(x, 512) as tail from h),
k as (select *, regexp_extract(head, '^((?:..)*?)(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$', 1) as whole,
  regexp_matches(head, '^(?:..)*(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$') as torn, length(regexp_extract(tail, '^((?:[89AB][0-9A-F])*)', 1)) as stray from c)
select doc_id, case when n <= 512 then sha256(text) else sha256(unhex(case when torn then whole || 'EFBFBD' else head end || '0A' || repeat('EFBFBD', (stray // 2)::int) || tail[stray + 1:])) end as seen from k""")
def text_window(spark, sf_dir):
    """Digest of what is seen of each text through a small window, whose ends may tear a character."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.window(F.col("text"), 256), 256).alias("seen"))


@query("kind_dimension", f"""with {OBJECTS}, k as (select *, {EXTENSION} as ending from objects)
select key, case ending when 'txt' then 'txt' when 'md' then 'md' end as kind, case when ending in ('txt', 'md') then 'txt' end as output, case ending when 'txt' then true when 'md' then false end as copied from k""")
def kind_dimension(spark, sf_dir):
    files = objects(spark, sf_dir).withColumn("ending", paths.extension_of(F.col("key")))
    return files.join(kinds.dimension(spark), "ending", "left").select("key", "kind", "output", "copied")


@query("kind_names", """select doc_id, ['jpeg', 'md', 'png', 'jpeg', 'procreate-2'][doc_id % 5 + 1] as kind from documents""")
def kind_names(spark, sf_dir):
    given = F.element_at(F.array(*[F.lit(x) for x in ("JPG", "Markdown", "png", "jpeg", "procreate 2")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", kinds.parse_kind(given).alias("kind"))


@query("safe_names", f"""with {OBJECTS}, n as (select key, repeat('x', (doc_id % 130)::int) || {BASE} as base, {EXTENSION} as ext from objects)
select key, case when length(base) <= 100 then base when ext <> '(none)' then substr(base, 1, 100 - length(split_part(base, '.', -1)) - 1)[1:least(100 - length(split_part(base, '.', -1)) - 1, length(base) - length(split_part(base, '.', -1)) - 1)] || '.' || split_part(base, '.', -1)
else substr(base, 1, 100) end as name from n""")
def safe_names(spark, sf_dir):
    long = F.concat(F.lit("d/"), F.expr("repeat('x', cast(doc_id % 130 as int))"), paths.basename(F.col("key")))
    return objects(spark, sf_dir).select("key", paths.sanitize_filename(long).alias("name"))


@query("content_hashes", "select page_id, sha256(html) as sha256, strlen(html)::bigint as size, sha256(html) = sha256(html) as same from pages")
def content_hashes(spark, sf_dir):
    """Copy-through leaves the bytes as they are: equal hashes before and after."""
    p = table(spark, sf_dir, "pages")
    data = F.col("html").cast("binary")
    return p.select("page_id", F.sha2(data, 256).alias("sha256"), F.octet_length(data).cast("bigint").alias("size"), (F.sha2(data, 256) == F.sha2("html", 256)).alias("same"))


@query("serial_dates", """with s as (select event_id, (event_id % 60000) + case when event_id % 2 = 0 then 0.0 else 0.25 end as serial from events)
select event_id, case when event_id % 2 = 0 then strftime(date '1899-12-30' + (event_id % 60000)::int, '%Y-%m-%d') else strftime(date '1899-12-30' + (event_id % 60000)::int, '%Y-%m-%d') || 'T06:00:00' end as rendered from s""")
def serial_dates(spark, sf_dir):
    serial = (F.col("event_id") % 60000) + F.when(F.col("event_id") % 2 == 0, 0.0).otherwise(0.25)
    return table(spark, sf_dir, "events").select("event_id", text.serial_date(serial).alias("rendered"))


SHAPES = ['<svg><defs id="d"><path d="x"/></defs><rect class="BoundingBox" x="1"/></svg>', "<svg><defs/><text>x</text></svg>", "<svg><defs><path/><g/>", "<svg><rectangle/><textPath/></svg>", '<svg><rect class="x" y="1"/></svg>', "<svg><defs><path/></defs><defs/><line\n/></svg>"]


@query("svg_draws", f"""with s as (select page_id, [{', '.join("'" + s + "'" for s in SHAPES)}][page_id % 6 + 1] || case when page_id % 4 = 0 then html else '' end as svg from pages),
b as (select page_id, regexp_replace(svg, '(?s)<defs(?:[^>]*/>|.*?</defs>|.*$)', '', 'g') as body from s)
select page_id, regexp_matches(body, '<(path|image|text|polygon|polyline|circle|ellipse|line)[\\s/>]') or len(list_filter(regexp_extract_all(body, '<rect[\\s/>][^>]*'), lambda r: not contains(r, 'class="BoundingBox"'))) > 0 as draws from b""")
def svg_draws(spark, sf_dir):
    """Drawings that draw and drawings that do not, some with a whole page behind them."""
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("page_id") % 6 + 1).cast("int"))
    svg = F.concat(shape, F.when(F.col("page_id") % 4 == 0, F.col("html")).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", text.draws_something(svg).alias("draws"))


@query("header_kinds", """select doc_id, case doc_id % 6 when 0 then 'zip' when 1 then 'icns' when 2 then 'png' when 3 then 'jp2' end as kind from documents""")
def header_kinds(spark, sf_dir):
    """Documents behind the first bytes of other files; every sixth behind half of such a header."""
    starts = [b"PK\x03\x04", b"icns", b"\x89PNG", b"\x00\x00\x00\x0cjP  ", b"PK\x03", b""]
    start = F.element_at(F.array(*[F.lit(s) for s in starts]), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", text.header_kind(F.concat(start, F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("kind"))
