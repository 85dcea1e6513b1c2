"""Calendars (ics) and contacts (vcf) as property rows and as readable text, with DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.paths import bound

#: The largest file read; properties of a card that are not shown; uninformative types.
MOST_BYTES = 64 << 20
#: Bytes of files that one task parses, about: their properties take some thirty times as much, and all are sorted.
TASK_BYTES = 8 << 20
HIDDEN = ["PHOTO", "LOGO", "SOUND", "KEY", "PRODID", "REV", "UID"]
DULL_TYPES = ["INTERNET", "PREF", "X400"]
#: Properties of calendars, and of events and tasks, that are shown; those of which all are.
OF_CALENDARS = ["X-WR-CALNAME", "METHOD"]
OF_ITEMS = ["SUMMARY", "DTSTART", "DTEND", "DUE", "DURATION", "LOCATION", "ORGANIZER", "ATTENDEE", "STATUS", "RRULE", "URL", "DESCRIPTION"]
REPEATED = ["ATTENDEE", "RRULE"]
ENCODINGS = ["BASE64", "B", "QUOTED-PRINTABLE", "Q", "7BIT", "8BIT"]

PART = r'(?:[^";]++|"[^"]*+")++'
SPACE = " \t\n\x0b\f\r"


def unfold(text: Column) -> Column:
    """One line a property: folded lines joined, and the soft breaks of quoted-printable values taken out."""
    bare = F.replace(F.regexp_replace(text, "^\ufeff", ""), F.lit("\r\n"), F.lit("\n"))
    soft = F.regexp_replace(bare, r"(?im)((?:^[^\n:]*QUOTED-PRINTABLE[^\n:]*:|\G(?!\A))[^\r\n]*?)=\n", "$1")
    return F.regexp_replace(F.when(F.contains(bare, F.lit("=\n")), soft).otherwise(bare), r"\n[ \t]", "")


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def unescape(value: Column) -> Column:
    r"""\n and \N as line breaks, \, \; \: and \\ as the character itself."""
    hidden = F.replace(value, F.lit("\\\\"), F.lit("\x00"))
    lines = F.regexp_replace(hidden, r"\\[nN]", "\n")
    plain = F.replace(F.regexp_replace(lines, r"\\([,;:])", "$1"), F.lit("\x00"), F.lit("\\"))
    return F.when(F.contains(value, F.lit("\\")) | F.contains(value, F.lit("\x00")), plain).otherwise(value)


def unquote_printable(value: Column) -> Column:
    """Bytes written as =XX; what is then not UTF-8 is Latin-1."""
    steps = F.regexp_extract_all(value, F.lit(r"=[0-9A-Fa-f]{2}|[^=]+|="), F.lit(0))
    pieces = F.transform(steps, lambda s: F.when(s.rlike("^=[0-9A-Fa-f]{2}$"), F.substring(s, 2, 2)).otherwise(F.hex(F.encode(s, "UTF-8"))))
    data = F.unhex(F.array_join(pieces, ""))
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def parsed(files: DataFrame) -> DataFrame:
    """Lines of files (key, content) with a colon: key, pos, grp, name, head (what is before the colon) and raw (behind it).

    Files are dealt by key before they are parsed: their bytes are fewer than their properties', and all that follows
    by key stays where it is, from one exchange however often the rows are used. The number of tasks follows the bytes,
    so that a task sorts no more however many files there are.
    """
    files = files.where(F.octet_length("content") <= MOST_BYTES).select("key", "content")
    total = files.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    text = unfold(F.make_valid_utf8(F.col("content").cast("string")))
    dealt = files.repartition(tasks, "key")
    lines = dealt.select("key", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    split = lines.select("key", "pos", "line", F.regexp_extract("line", r'^((?:[^":]++|"[^"]*+")+):', 1).alias("head")).where("head != ''")
    part = F.when(F.contains("head", F.lit(";")) | F.contains("head", F.lit('"')), F.nullif(F.regexp_extract("head", PART, 0), F.lit(""))).otherwise(F.col("head"))
    first = F.upper(trim(part))
    named = split.select("key", "pos", "head", first.alias("first"), F.substr("line", F.length("head") + 2, F.length("line")).alias("raw"))
    grouped = F.contains("first", F.lit("."))
    group = F.substring_index("first", ".", 1)
    return named.select("key", "pos", F.when(grouped, group).alias("grp"), F.when(grouped, F.substr("first", F.length(group) + 2, F.length("first"))).otherwise(F.col("first")).alias("name"), "head", "raw")


def params_of(head: Column) -> Column:
    """Name and value of the parameters before a line's colon, in order."""
    parts = F.regexp_extract_all(head, F.lit(PART), F.lit(0))
    bare = lambda v: F.regexp_replace(v, '^"|"$', "")

    def param(p: Column) -> Column:
        named = F.contains(p, F.lit("="))
        name = F.when(named, F.upper(trim(F.substring_index(p, "=", 1)))).when(F.upper(p).isin(ENCODINGS), "ENCODING").otherwise("TYPE")
        value = F.when(named, F.substr(p, F.length(F.substring_index(p, "=", 1)) + 2, F.length(p))).otherwise(p)
        return F.transform(F.when(name == "TYPE", F.split(value, ",")).otherwise(F.array(value)), lambda v: F.struct(name.alias("k"), bare(trim(v)).alias("v")))

    return F.flatten(F.transform(bound(parts, lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))), param))


def value_of(raw: Column, params: Column) -> Column:
    """What stands behind a line's colon, decoded."""
    quoted = F.exists(params, lambda p: (p["k"] == "ENCODING") & F.upper(p["v"]).isin("QUOTED-PRINTABLE", "Q"))
    return F.when(quoted, unquote_printable(raw)).otherwise(raw)


def properties(files: DataFrame) -> DataFrame:
    """Property rows of files (key, content): key, pos, grp, name, params (name and value in order) and value."""
    rows = parsed(files).withColumn("params", params_of(F.col("head")))
    return rows.select("key", "pos", "grp", "name", "params", value_of(F.col("raw"), F.col("params")).alias("value"))


def param_value(params: Column, name: str) -> Column:
    """The first value of a parameter."""
    return F.get(F.filter(params, lambda p: p["k"] == name), F.lit(0))["v"]


def leveled(rows: DataFrame, **wanted: list[str]) -> DataFrame:
    """Lines (key, pos, name, value of BEGIN and END, ...) with a column for each group of wanted kinds: kind and number in
    the file of the component in which a property stands directly, null elsewhere. One sort serves all groups."""
    before = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("key").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    begin, end, kind = F.col("name") == "BEGIN", F.col("name") == "END", F.col("marker")
    marked = rows.withColumn("marker", F.when(begin | end, F.upper(trim(F.col("value")))))
    marked = marked.withColumn("depth", F.coalesce(F.sum(begin.cast("int") - end.cast("int")).over(before), F.lit(0)))
    found = {}
    for label, kinds in wanted.items():
        opened = F.last(F.when(begin & kind.isin(*kinds), F.struct("depth", kind.alias("kind"))), ignorenulls=True).over(upto)
        item, closed = F.sum((begin & kind.isin(*kinds)).cast("int")).over(upto), F.coalesce(F.sum((end & kind.isin(*kinds)).cast("int")).over(before), F.lit(0))
        found |= {f"{label}_opened": opened, f"{label}_item": item, f"{label}_closed": closed}
    counted = marked.withColumns(found)
    for label in wanted:
        opened, item = F.col(f"{label}_opened"), F.col(f"{label}_item")
        inside = (F.col("depth") == opened["depth"] + 1) & (item > F.col(f"{label}_closed")) & ~begin & ~end
        counted = counted.withColumn(label, F.when(inside, F.struct(opened["kind"].alias("kind"), item.alias("item"))))
    return counted.select(*rows.columns, *wanted)


def components(rows: DataFrame, *wanted: str) -> DataFrame:
    """The properties that stand directly in a component of a wanted kind, with kind and its number in the file."""
    inside = leveled(rows, place=list(wanted)).where("place is not null")
    return inside.select("key", "place.kind", "place.item", "pos", "grp", "name", "params", "value")


def field(label: Column | str, value: Column) -> Column:
    """"label: value", a value of several lines indented below its label, nothing for a blank value."""
    label = F.lit(label) if isinstance(label, str) else label
    body = F.rtrim(value, F.lit(SPACE))
    lines = F.array_join(F.transform(F.split(body, "\n"), lambda s: F.when(trim(s) == "", F.lit("")).otherwise(F.concat(F.lit("  "), F.regexp_replace(s, r"\s+$", "")))), "\n")
    shown = F.when(F.contains(body, F.lit("\n")), F.concat(label, F.lit(":\n"), lines, F.lit("\n"))).otherwise(F.concat(label, F.lit(": "), trim(body), F.lit("\n")))
    return F.when(trim(F.coalesce(value, F.lit(""))) == "", F.lit("")).otherwise(shown)


def first_of(name: str, what: Column) -> Column:
    """Of a group of properties, `what` of the first one of a name; it is worked out for those of that name only."""
    own = F.col("name") == name
    return F.min_by(F.when(own, what), F.when(own, F.col("pos")))


def all_of(name: str, what: Column) -> Column:
    """Of a group of properties, `what` of all of a name, joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("pos", what.alias("t"))))), lambda s: s["t"]), "")


def time_text(value: Column, params: Column) -> Column:
    """(time, zone) of a date or time in basic form; anything else as it is written."""
    raw = trim(value)
    body = F.regexp_replace(raw, "[Zz]$", "")
    tz = param_value(params, "TZID")
    date = F.concat_ws("-", F.substring(body, 1, 4), F.substring(body, 5, 2), F.substring(body, 7, 2))
    clock = F.concat(F.substring(body, 10, 2), F.lit(":"), F.substring(body, 12, 2), F.when(F.substring(body, 14, 2) != "00", F.concat(F.lit(":"), F.substring(body, 14, 2))).otherwise(""))
    is_date, is_time = body.rlike("^[0-9]{8}$"), body.rlike("^[0-9]{8}[Tt][0-9]{6}$")
    shown = F.when(is_date, date).when(is_time, F.concat(date, F.lit(" "), clock)).otherwise(raw)
    zone = F.when(is_time, F.coalesce(tz, F.when(raw.rlike("[Zz]$"), "UTC"))).otherwise(tz)
    return F.struct(shown.alias("t"), zone.alias("z"))


def with_zone(time: Column) -> Column:
    return F.concat(time["t"], F.coalesce(F.concat(F.lit(" ("), time["z"], F.lit(")")), F.lit("")))


def person(value: Column, params: Column) -> Column:
    """Name <address> (status)."""
    address = trim(F.regexp_replace(unescape(value), "(?i)^mailto:", ""))
    name = F.nullif(trim(param_value(params, "CN")), F.lit(""))
    who = F.when(name.isNotNull() & (address != "") & (name != address), F.concat(name, F.lit(" <"), address, F.lit(">"))).otherwise(F.coalesce(name, address))
    status = F.replace(F.lower(param_value(params, "PARTSTAT")), F.lit("-"), F.lit(" "))
    return F.concat(who, F.coalesce(F.concat(F.lit(" ("), status, F.lit(")")), F.lit("")))


def calendar_text(files: DataFrame) -> DataFrame:
    """(key, text) of calendar files; files without a calendar are left out.

    The lines are sorted once. What is shown of a component is gathered as it is written, and read when it is put together.
    """
    rows = parsed(files)
    name = F.col("name")
    kept = F.when(name.isin("BEGIN", "END", *OF_CALENDARS, *OF_ITEMS), F.col("raw"))
    rows = rows.select("key", "pos", "name", F.when(kept.isNotNull(), F.col("head")).alias("head"), kept.alias("raw"))
    marks = F.when(name.isin("BEGIN", "END"), value_of(F.col("raw"), params_of(F.col("head"))))
    lines = leveled(rows.withColumn("value", marks), calendar=["VCALENDAR"], own=["VEVENT", "VTODO"])
    whole = (name == "BEGIN") & (F.upper(trim(F.col("value"))) == "VCALENDAR")
    titled = F.col("calendar").isNotNull() & name.isin(OF_CALENDARS)
    shown = whole | titled | (F.col("own").isNotNull() & name.isin(OF_ITEMS))
    lines = lines.where(F.col("own").isNotNull() | whole | titled)
    items = lines.groupBy("key", "own").agg(F.array_sort(F.collect_list(F.when(shown, F.struct("pos", "name", "head", "raw")))).alias("lines"))
    every = lambda n: F.filter("lines", lambda p: p["name"] == n)
    read = items.select("key", "own", "lines", *[F.get(every(n), F.lit(0)).alias(n) for n in [*OF_CALENDARS, *OF_ITEMS] if n not in REPEATED])
    params = {n: F.when(F.contains(F.col(f"{n}.head"), F.lit(";")), params_of(F.col(f"{n}.head"))) for n in OF_ITEMS if n not in REPEATED}
    read = read.withColumns({f"{n}_params": p for n, p in params.items()})
    read = read.withColumns({f"{n}_value": value_of(F.col(f"{n}.raw"), F.col(f"{n}_params")) for n in params})
    value, plain = lambda n: F.col(f"{n}_value"), lambda n: unescape(F.col(f"{n}_value"))
    time = lambda n: F.when(F.col(n).isNotNull(), time_text(value(n), F.col(f"{n}_params")))

    def all_lines(n: str, what) -> Column:
        decoded = F.transform(F.transform(every(n), lambda p: F.struct(p["raw"].alias("raw"), params_of(p["head"]).alias("params"))), lambda p: F.struct(value_of(p["raw"], p["params"]).alias("value"), p["params"].alias("params")))
        return F.array_join(F.transform(decoded, what), "")

    read = read.withColumns({
        "s": time("DTSTART"), "e": F.coalesce(time("DTEND"), time("DUE")), "lasting": trim(value("DURATION")), "organizer": F.when(F.col("ORGANIZER").isNotNull(), person(value("ORGANIZER"), F.col("ORGANIZER_params"))),
        "attendees": all_lines("ATTENDEE", lambda p: field("Attendee", person(p["value"], p["params"]))), "rules": all_lines("RRULE", lambda p: field("Repeats", p["value"])),
        "summary": plain("SUMMARY"),
    })
    s, e = F.col("s"), F.col("e")
    span = F.when(s["z"].eqNullSafe(e["z"]), with_zone(F.struct(F.concat(s["t"], F.lit(" – "), e["t"]).alias("t"), s["z"].alias("z")))).otherwise(F.concat(with_zone(s), F.lit(" – "), with_zone(e)))
    when = F.when(s.isNotNull() & e.isNotNull(), span).otherwise(with_zone(F.coalesce(s, e)))
    when = F.when(e.isNull() & F.col("lasting").isNotNull(), F.concat(when, F.lit(", lasting "), "lasting")).otherwise(when)
    summary = F.when(trim(F.coalesce("summary", F.lit(""))) == "", F.lit("(untitled)")).otherwise(F.col("summary"))
    text = F.concat(field("Summary", summary), field("When", when), field("Where", plain("LOCATION")), field("Organizer", F.col("organizer")), "attendees", field("Status", plain("STATUS")), "rules", field("URL", plain("URL")), field("Description", plain("DESCRIPTION")))
    told = F.when(F.col("own").isNotNull(), F.struct(F.col("own.item").alias("item"), F.when(F.col("own.kind") == "VTODO", "Task").otherwise("Event").alias("noun"), text.alias("text")))
    listed = read.select("key", told.alias("told"), F.size(every("BEGIN")).alias("whole"), *OF_CALENDARS).groupBy("key").agg(
        F.array_sort(F.collect_list("told")).alias("items"), F.max("whole").alias("whole"), *[F.min(n).alias(n) for n in OF_CALENDARS]).where("whole > 0")
    body = F.array_join(F.transform("items", lambda x, i: F.concat(F.lit("\n"), x["noun"], F.lit(" "), (i + 1).cast("string"), F.lit(" of "), F.size("items").cast("string"), F.lit("\n"), x["text"])), "")
    title, method = [F.when(F.col(n).isNotNull(), unescape(value_of(F.col(f"{n}.raw"), params_of(F.col(f"{n}.head"))))) for n in OF_CALENDARS]
    title = F.when(trim(F.coalesce(title, F.lit(""))) == "", F.lit("Calendar\n")).otherwise(field("Calendar", title))
    return listed.select("key", F.concat(title, field("Method", method), F.when(F.size("items") > 0, body).otherwise(F.lit("\nNo events.\n"))).alias("text"))


def parts_of(value: Column, order: list[int] | None, separator: str) -> Column:
    """Unescaped parts of a value between semicolons that are not escaped, blank ones left out, joined."""
    hidden = F.replace(F.replace(value, F.lit("\\\\"), F.lit("\x00")), F.lit("\\;"), F.lit("\x01"))
    parts = F.transform(F.split(hidden, ";"), lambda s: trim(unescape(F.replace(F.replace(s, F.lit("\x01"), F.lit(";")), F.lit("\x00"), F.lit("\\\\")))))
    chosen = F.array(*[F.get(parts, F.lit(k)) for k in order]) if order else parts
    return F.array_join(F.filter(chosen, lambda s: s.isNotNull() & (s != "")), separator)


def contact_text(files: DataFrame) -> DataFrame:
    """(key, text) of contact files, every card of a file in turn."""
    rows = components(properties(files), "VCARD")
    label = F.regexp_replace(trim(unescape(F.col("value"))), r"^_\$!<(.*)>!\$_$", "$1")
    labels = rows.where((F.col("name") == "X-ABLABEL") & F.col("grp").isNotNull()).groupBy("key", "item", "grp").agg(F.min_by(label, "pos").alias("own_label"))
    encoded = F.exists("params", lambda p: (p["k"] == "ENCODING") & F.upper(p["v"]).isin("BASE64", "B"))
    shown = ~encoded & ~F.startswith("name", F.lit("X-")) & ~F.col("name").isin(HIDDEN)
    labelled = rows.join(labels, ["key", "item", "grp"], "left")
    types = F.filter("params", lambda p: (p["k"] == "TYPE") & ~F.upper(p["v"]).isin(DULL_TYPES))
    tag = F.coalesce(F.nullif("own_label", F.lit("")), F.nullif(F.array_join(F.transform(types, lambda p: F.lower(p["v"])), ", "), F.lit("")))
    labelled = labelled.withColumn("tag", tag).withColumn("name", F.when(shown, F.col("name")).otherwise("")).withColumn("plain", unescape(F.col("value")))

    def lines(name: str, noun: str) -> Column:
        value = parts_of(F.col("value"), None, ", ") if name == "ADR" else F.col("plain")
        title = F.concat(F.lit(noun), F.coalesce(F.concat(F.lit(" ("), "tag", F.lit(")")), F.lit("")))
        return all_of(name, field(title, F.replace(value, F.lit("\n"), F.lit(", "))))

    full = F.nullif(trim(first_of("FN", F.col("plain"))), F.lit(""))
    cards = labelled.groupBy("key", "item").agg(
        F.concat(
            field("Name", F.coalesce(full, first_of("N", parts_of(F.col("value"), [3, 1, 2, 0, 4], " ")))), field("Organization", first_of("ORG", parts_of(F.col("value"), None, ", "))), field("Title", first_of("TITLE", F.col("plain"))),
            lines("TEL", "Phone"), lines("EMAIL", "Email"), lines("ADR", "Address"), lines("URL", "URL"),
            field("Birthday", first_of("BDAY", F.col("plain"))), field("Categories", first_of("CATEGORIES", F.col("plain"))), field("Note", first_of("NOTE", F.col("plain"))),
        ).alias("text")
    )
    listed = cards.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("item", "text"))).alias("cards"))
    body = lambda c: F.when(c["text"] == "", F.lit("(no details)\n")).otherwise(c["text"])
    text = F.array_join(F.transform("cards", lambda c, i: F.concat(F.lit("Contact "), (i + 1).cast("string"), F.lit(" of "), F.size("cards").cast("string"), F.lit("\n"), body(c))), "\n")
    return listed.select("key", text.alias("text"))
