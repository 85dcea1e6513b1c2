"""Queries on documents that hold other documents, built in the query from the given tables; and on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import small_batches, spread
from ..sources import archives, vobject
from ..streaming import logs
from .registry import query
from .views import table


#: Contents of a batch.
MADE = 100


def made(rows, function):
    """Rows (key, ...) with a content made by a Python function of the other columns. The rows are dealt by key first, for a
    table may be one file, and what is made and done with it is much more work than the row's bytes tell."""
    names = [c for c in rows.columns if c != "key"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            for at in range(0, batch.num_rows, MADE):
                contents = [function(*r) for r in zip(*[c[at : at + MADE] for c in columns], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(at, MADE), pa.array(contents, pa.binary())], ["key", "content"])

    small_batches(rows.sparkSession)
    return spread(rows, "key").mapInArrow(run, "key string, content binary")


def zipped(text: str, name: str) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for member in (f"{name}.txt", "__MACOSX/x", f"a/{name}-2.txt"):
            z.writestr(zipfile.ZipInfo(member), text)
    return out.getvalue()


def nested(text: str, number: int) -> bytes:
    """An archive with a note, an archive of an archive of a note, and for every seventh a damaged archive."""
    import io
    import zipfile

    def packed(**members: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in members.items():
                z.writestr(zipfile.ZipInfo(name.replace("_", ".")), data)
        return out.getvalue()

    damaged = {"bad_zip": b"damaged"} if number % 7 == 0 else {}
    return packed(a_txt=text.encode(), b_zip=packed(c_zip=packed(d_txt=text[::-1].encode())), **damaged)


@query("tsv_to_csv", """select c_custkey, '"' || c_name || ', ' || c_mktsegment || '",' || c_nationkey::varchar || chr(10) as csv from customer""")
def tsv_to_csv(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    line = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit("\t"), F.col("c_nationkey").cast("string"), F.lit("\n"))
    files = c.select(F.col("c_custkey").cast("string").alias("key"), F.encode(line, "UTF-8").alias("content"))
    return archives.expand(files, archives.tsv_to_csv).select(F.col("key").cast("bigint").alias("c_custkey"), F.decode("content", "UTF-8").alias("csv"))


@query("eml_attachments", """select doc_id, 'note-' || doc_id::varchar || '.txt' as name, strlen(coalesce(text, ''))::bigint as size from documents""")
def eml_attachments(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    data = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "(.{76})", "$1\n")
    message = F.concat(
        F.lit("Subject: no. "), "key", F.lit('\nFrom: a@example.com\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary="==part=="\n\n'),
        F.lit('--==part==\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: 7bit\n\nsee attached\n\n'),
        F.lit('--==part==\nContent-Type: application/octet-stream\nContent-Transfer-Encoding: base64\nContent-Disposition: attachment; filename="x/note-'), "key", F.lit('.txt"\nMIME-Version: 1.0\n\n'),
        data, F.lit("\n\n--==part==--\n"),
    )
    files = spread(d, "key").select("key", F.encode(message, "UTF-8").alias("content"))
    found = archives.expand(files, archives.attachments)
    return found.select(F.col("key").cast("bigint").alias("doc_id"), F.col("part").alias("name"), F.octet_length("content").cast("bigint").alias("size"))


@query("textclipping", "select doc_id, sha256(text) as content_hash from documents")
def textclipping(spark, sf_dir):
    import plistlib

    files = made(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), "text"), lambda t: plistlib.dumps({"UTI-Data": {"public.utf8-plain-text": t}}, fmt=plistlib.FMT_BINARY))
    return archives.expand(files, archives.clipping).select(F.col("key").cast("bigint").alias("doc_id"), F.sha2("content", 256).alias("content_hash"))


def entry(kind, data):
    """An entry of an icon file, which an icon file is too: type, length in four bytes, data."""
    return F.concat(F.encode(F.lit(kind), "UTF-8"), F.unhex(F.lpad(F.hex(F.octet_length(data) + 8), 8, "0")), data)


def icons(rows):
    """Icon files of rows (key, text, doc_id): a small image, a large one twice, and one in a form that is not copied; every
    ninth, or without a number, has none. They are made by expressions, so that a task has only the Python worker that reads them."""
    png = F.concat(F.unhex(F.lit("89504E47")), F.col("text").cast("binary"))
    images = F.concat(entry("ic07", F.concat(png, F.encode(F.lit("small and long"), "UTF-8"))), entry("ic09", png), entry("ic14", png))
    held = F.when(F.col("doc_id") % 9 != 0, images).otherwise(F.unhex(F.lit("")))
    return spread(rows, "key").select("key", entry("icns", F.concat(held, entry("ic10", F.encode(F.lit("raw"), "UTF-8")))).alias("content"))


@query("icon_images", """select doc_id, case when doc_id % 9 <> 0 then 'ic09' end as part, case when doc_id % 9 <> 0 then sha256('\\x89PNG'::blob || encode(coalesce(text, ''))) end as content_hash from documents""")
def icon_images(spark, sf_dir):
    """The largest image of icon files made from documents; the first of two of equal size."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("text"), "doc_id")
    found = archives.largest_icons(icons(d))
    return found.select(F.col("key").cast("bigint").alias("doc_id"), "part", F.when(F.col("error").isNull(), F.sha2("content", 256)).alias("content_hash"))


def book(name: str, segment: str, number: int) -> bytes:
    """A workbook of three sheets: text, numbers, a gap and a boolean; an empty one; shared strings."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda place, kind, value: f'<c r="{place}" t="{kind}">{value}</c>'
    first = cell("A1", "inlineStr", f"<is><t>{escape(name)}</t></is>") + cell("C1", "n", f"<v>{number}</v>") + cell("D1", "b", f"<v>{number % 2}</v>")
    sheet = lambda rows: f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>"
    files = {
        "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="Data" r:id="r1"/><sheet name="Empty" r:id="r2"/><sheet name="More" r:id="r3"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>",
        "xl/sharedStrings.xml": f"<sst {main}><si><t>no</t></si><si><t>{escape(segment)}</t></si></sst>",
        "xl/worksheets/s1.xml": sheet(f"<row>{first}</row>"),
        "xl/worksheets/s2.xml": sheet(""),
        "xl/worksheets/s3.xml": sheet(f"<row>{cell('A1', 's', '<v>1</v>')}</row><row>{cell('B2', 's', '<v>0</v>')}</row>"),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for place, data in files.items():
            z.writestr(zipfile.ZipInfo(place), data)
    return out.getvalue()


@query("workbook_sheets", """select c_custkey, s.part, case s.part when '1:Data' then c_name || ',,' || c_custkey::varchar || ',' || case when c_custkey % 2 = 1 then 'true' else 'false' end || chr(10)
else c_mktsegment || ',' || chr(10) || ',no' || chr(10) end as csv from customer, (values ('1:Data'), ('3:More')) s(part)""")
def workbook_sheets(spark, sf_dir):
    """The sheets of workbooks made from customers, without the empty ones."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name", "c_mktsegment", "c_custkey")
    return archives.expand(made(c, book), archives.sheets).select(F.col("key").cast("bigint").alias("c_custkey"), "part", F.decode("content", "UTF-8").alias("csv"))


@query("ics_text", """select o_orderkey, 'Calendar' || chr(10) || chr(10) || 'Event 1 of 1' || chr(10) || 'Summary: Order, ' || o_orderkey::varchar || chr(10) || 'When: ' || strftime(o_orderdate, '%Y-%m-%d')
|| ' (Europe/Berlin)' || chr(10) || 'Status: ' || o_orderstatus || chr(10) as text from orders""")
def ics_text(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    start = F.concat(F.lit("DTSTART;TZID=Europe/Berlin:"), F.date_format("o_orderdate", "yyyyMMdd"))
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nSUMMARY:Order\\, \r\n "), F.col("o_orderkey").cast("string"), F.lit("\r\n"), start, F.lit("\r\nSTATUS:"), "o_orderstatus", F.lit("\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nEND:VALARM\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n"))
    files = o.select(F.col("o_orderkey").cast("string").alias("key"), F.encode(body, "UTF-8").alias("content"))
    return vobject.calendar_text(files).select(F.col("key").cast("bigint").alias("o_orderkey"), "text")


@query("vcf_text", """select c_custkey, 'Contact 1 of 1' || chr(10) || 'Name: ' || c_name || chr(10) || 'Phone (home): +' || c_custkey::varchar || chr(10) || 'Note:' || chr(10) || '  ' || c_mktsegment || chr(10) || '  x' || chr(10) as text from customer""")
def vcf_text(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.concat(F.lit("BEGIN:VCARD\nN:Doe;J;;;\nFN:"), "c_name", F.lit("\nTEL;TYPE=HOME,pref:+"), F.col("c_custkey").cast("string"), F.lit("\nPHOTO;ENCODING=b:AAAA\nNOTE:"), "c_mktsegment", F.lit("\\nx\nEND:VCARD\n"))
    files = c.select(F.col("c_custkey").cast("string").alias("key"), F.encode(body, "UTF-8").alias("content"))
    return vobject.contact_text(files).select(F.col("key").cast("bigint").alias("c_custkey"), "text")


def gathered(rows, key: str, order: str, piece):
    """One text a key of the pieces of its rows, in order."""
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, piece.alias("piece")))).alias("pieces"))
    return listed.select(F.col(key).cast("string").alias("key"), F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("text"))


@query("ics_events", """with o as (select *, row_number() over (partition by o_custkey order by o_orderkey) as i, count(*) over (partition by o_custkey) as n, o_orderkey % 3 = 0 as task from orders)
select o_custkey, 'Calendar: Orders of ' || o_custkey::varchar || chr(10) || string_agg(chr(10) || case when task then 'Task ' else 'Event ' end || i::varchar || ' of ' || n::varchar || chr(10) || 'Summary: Order ' || o_orderkey::varchar || chr(10)
|| 'When: ' || strftime(o_orderdate, '%Y-%m-%d') || case when task then '' else ' 08:30 (UTC), lasting PT1H' end || chr(10)
|| case when o_orderkey % 2 = 0 then 'Attendee: Al Ba <a@x.org> (needs action)' || chr(10) || 'Attendee: b@x.org' || chr(10) else '' end || 'Repeats: FREQ=DAILY' || chr(10), '' order by i) as text from o group by o_custkey""")
def ics_events(spark, sf_dir):
    """Calendars of all orders of a customer: events and tasks in turn, with alarms in them, attendees, times in UTC."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyyMMdd")
    kind = F.when(k % 3 == 0, "VTODO").otherwise("VEVENT")
    time = F.when(k % 3 == 0, F.concat(F.lit("DUE;VALUE=DATE:"), day)).otherwise(F.concat(F.lit("DTSTART:"), day, F.lit("T083000Z\r\nDURATION:PT1H")))
    people = F.when(k % 2 == 0, 'ATTENDEE;CN="Al Ba";PARTSTAT=NEEDS-ACTION:mailto:a@x.org\r\nATTENDEE:MAILTO:b@x.org\r\n').otherwise("")
    piece = F.concat(F.lit("BEGIN:"), kind, F.lit("\r\nSUMMARY:Order "), k.cast("string"), F.lit("\r\nBEGIN:VALARM\r\nSUMMARY:no\r\nATTENDEE:mailto:no@x.org\r\nEND:VALARM\r\n"), time, F.lit("\r\n"), people, F.lit("RRULE:FREQ=DAILY\r\nEND:"), kind, F.lit("\r\n"))
    files = gathered(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", piece)
    body = F.concat(F.lit("BEGIN:VCALENDAR\r\nX-WR-CALNAME:Orders of "), "key", F.lit("\r\n"), "text", F.lit("END:VCALENDAR\r\n"))
    found = vobject.calendar_text(files.select("key", F.encode(body, "UTF-8").alias("content")))
    return found.select(F.col("key").cast("bigint").alias("o_custkey"), "text")


@query("vcf_cards", """with c as (select *, row_number() over (partition by c_nationkey order by c_custkey) as i, count(*) over (partition by c_nationkey) as n from customer)
select c_nationkey::bigint as c_nationkey, string_agg('Contact ' || i::varchar || ' of ' || n::varchar || chr(10) || case when c_custkey % 5 = 0 then '(no details)' || chr(10) else 'Name: ' || c_name || chr(10) || 'Phone (Work): +' || c_custkey::varchar || chr(10)
|| 'Phone (cell): +0' || chr(10) || 'Email (home): c' || c_custkey::varchar || '@x.org' || chr(10) end, chr(10) order by i) as text from c group by c_nationkey""")
def vcf_cards(spark, sf_dir):
    """Contact files of all customers of a nation: labels of groups, types, and cards without anything to show."""
    k = F.col("c_custkey").cast("string")
    full = F.concat(F.lit("FN:"), "c_name", F.lit("\nitem1.TEL;TYPE=HOME:+"), k, F.lit("\nitem1.X-ABLabel:_$!<Work>!$_\nTEL;CELL;PREF:+0\nitem2.EMAIL;type=INTERNET;type=HOME:c"), k, F.lit("@x.org\n"))
    piece = F.concat(F.lit("BEGIN:VCARD\nVERSION:3.0\n"), F.when(F.col("c_custkey") % 5 == 0, "UID:1\n").otherwise(full), F.lit("END:VCARD\n"))
    files = gathered(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", piece)
    found = vobject.contact_text(files.select("key", F.encode("text", "UTF-8").alias("content")))
    return found.select(F.col("key").cast("bigint").alias("c_nationkey"), "text")


@query("log_tail_stream", """with e as (select 'lane=' || (user_id % 16)::varchar as lane, event_id, event_type, value, json_extract_string(props, '$.k') as msg from events),
x as (select *, case when lag(event_id) over w is null or lag(msg) over w is distinct from msg then 1 else 0 end as begins from e where event_type = 'error' window w as (partition by lane order by event_id)),
i as (select lane, sum(begins) over (partition by lane order by event_id) as island from x),
s as (select lane, count(*) as streaks from (select lane, island from i group by lane, island having count(*) > 1) group by lane)
select e.lane, greatest(coalesce(arg_max(floor(value)::bigint, event_id), 0), 0) as bytes, 1::bigint as transfers, 0::bigint as errors, 0::bigint as deletes, coalesce(max(s.streaks), 0)::int as streaks
from e left join s on e.lane = s.lane group by e.lane""")
def log_tail_stream(spark, sf_dir):
    """The events written as logs of sixteen lanes, and these followed by a stream: all that there is now."""
    from ..session import shared_folder

    events = table(spark, sf_dir, "events")
    stats = F.struct(F.floor("value").cast("long").alias("bytes"), F.lit(1).alias("transfers"), F.lit(0).alias("deletes"))
    line = F.to_json(F.struct(F.col("event_type").alias("level"), F.get_json_object("props", "$.k").alias("msg"), F.col("event_id").cast("string").alias("object"), stats.alias("stats")))
    folder = shared_folder(spark, "log-tail")
    written = events.select((F.col("user_id") % 16).alias("lane"), "event_id", line.alias("value")).repartition(16, "lane").sortWithinPartitions("lane", "event_id")
    written.select("lane", "value").write.partitionBy("lane").text(f"{folder}/log")
    found = logs.follow(logs.lines(spark, f"{folder}/log"), folder)
    return found.groupBy("lane").agg(*[F.sum(c).alias(c) for c in logs.COUNTERS], F.count_if(F.col("kind") == "streak").cast("int").alias("streaks"))
