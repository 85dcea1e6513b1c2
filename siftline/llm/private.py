"""Operator 6: personal data and what gives it away, with DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. The patterns are the plain ones with
possessive repetition and a look-behind added, which change no match but keep the time in proportion to the text; that
of cards asks for twelve digits at once.

Replacing the spans is not enough where other words of the corpus tell what stood there. A protected entity is the
value of a base span; its terms are the words of the documents that hold it, wherever they stand, but for those that
are part of a base span themselves. Over the whole corpus the operator counts the documents with an entity (n_e), with
a term (n_t), and with both (n_te), and takes from the counts what the term tells of the entity: pointwise mutual
information, with one document taken off as what chance may have brought together,
log2((n_te - 1) * n / (n_t * n_e)), against the entity's own information log2(n / n_e). A term whose share is
DISCLOSURE or more discloses the entity: all its occurrences in the documents with the entity become spans of kind
"term", to be generalised or removed with the rest. No share can be large where a term has more documents than
n_e * (n / n_e) ** (1 - DISCLOSURE), so only rarer terms are counted with an entity, which loses none.

What is counted together are classes: entities that have equal documents are one, and so are terms. A text that shares a
list of addresses and a list of words with another makes one pair, however long the lists are.

Offsets are code points, ends exclusive. Null text counts as empty. Rows that share identifier and text share their
spans; each counts as a document. An empty table gives no rows. An entity in a third of all rows is counted with
partial sums and never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import settle, unused

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: The least share of an entity's information that discloses it, and the least letters of a term (from 1 on).
DISCLOSURE, LETTERS = 0.75, 2
LABELS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

LOCATED = "array<struct<start:bigint,end:bigint,text:string>>"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """The sums of an array's first 1, 2, ... numbers: sums of stretches first, so that n numbers take n ** 1.5 steps."""
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)

    def within(v: Column) -> Column:
        n, c = v["n"], v["c"]
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / c).cast("int")), lambda k: total(F.slice(v["sizes"], k * c + 1, c)))
        offsets = let(sums, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1), lambda k: total(F.slice(s, F.lit(1), k))))
        stretch = lambda i: F.floor(i / c).cast("int")
        return let(offsets, lambda o: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(o, stretch(i)) + total(F.slice(v["sizes"], stretch(i) * c + 1, i - stretch(i) * c + 1))))

    return let(sizes, lambda x: let(F.struct(x.alias("sizes"), F.size(x).alias("n"), F.ceil(F.sqrt(F.size(x))).cast("int").alias("c")), within))


def located(matches: Column, gaps: Column) -> Column:
    """Start, end and text of matches, from the texts between them."""
    sizes = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: (F.length(g) + F.length(m)).cast("long"))
    found = F.zip_with(matches, running(sizes), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))
    return F.when(F.size(matches) > 0, found).otherwise(F.expr(f"cast(array() as {LOCATED})"))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Do the digits pass the Luhn test?"""

    def add(total: Column, k: Column) -> Column:
        d = F.substr(number, -k, F.lit(1)).cast("int")
        return total + F.when(k % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def sound(kind: str, text: Column) -> Column:
    """Does a match of the kind's pattern count?"""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9][0-9]?)$"))
    if kind == "card":
        number = digits(text)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def entity(kind: str, text: Column) -> Column:
    """The protected value of a span, however it is written."""
    value = F.lower(text) if kind == "email" else text if kind == "ip" else digits(text)
    return F.concat(F.lit(f"{kind}:"), value)


def base_spans(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark (a hash of the text), spans (start, rank of the kind, end, kind, entity), and t: the text if it has spans."""
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("t"))
    nothing = F.expr("cast(array() as array<string>)")
    for kind in KINDS:
        need = F.contains(F.col("t"), F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        rows = rows.withColumn(f"m_{kind}", F.when(need, F.regexp_extract_all("t", F.lit(PATTERNS[kind]), F.lit(0))).otherwise(nothing))
    for kind in KINDS:
        rows = rows.withColumn(f"g_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("t", PATTERNS[kind], -1)).otherwise(nothing))
    rows = rows.select(key, "t", F.xxhash64("t").alias("mark"), *[located(F.col(f"m_{k}"), F.col(f"g_{k}")).alias(f"l_{k}") for k in KINDS])

    def described(kind: str) -> Column:
        rank = KINDS.index(kind)
        good = F.filter(F.col(f"l_{kind}"), lambda x: sound(kind, x["text"]))
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), entity(kind, x["text"]).alias("entity")))

    rows = rows.select(key, "mark", "t", F.array_sort(F.concat(*[described(k) for k in KINDS])).alias("spans"))
    return rows.select(key, "mark", "spans", F.when(F.size("spans") > 0, F.col("t")).alias("t"))


def term_pattern(letters: int = LETTERS) -> str:
    """Words of at least so many letters."""
    return rf"\p{{L}}[\p{{L}}\p{{M}}'-]{{{letters - 1},}}+"


def terms(text: Column, letters: int = LETTERS) -> Column:
    """The distinct words of a text outside of e-mail addresses, lower-cased."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(term_pattern(letters)), F.lit(0)))


def disclosing(docs: DataFrame, held: DataFrame, key: str, text: str, disclosure: float = DISCLOSURE, letters: int = LETTERS) -> DataFrame:
    """key, mark and term of the words that disclose an entity of their document, by counts over the whole corpus.

    held has key, mark, spans and t of the documents with spans.
    """
    n = docs.count()
    entities = settle(held.select(key, "mark", F.explode(F.array_distinct(F.transform("spans", lambda s: s["entity"]))).alias("entity")), "entities")
    n_e = entities.groupBy("entity").agg(F.count("*").alias("n_e")).where("n_e > 1")
    limit = F.col("n_e") * F.pow(F.lit(float(n)) / F.col("n_e"), F.lit(1 - disclosure))
    known = settle(entities.join(n_e, "entity").withColumn("limit", limit), "known")
    most = known.agg(F.max("limit")).first()[0]
    if most is None:
        return known.select(key, "mark", F.col("entity").alias("term"))
    open_docs = known.groupBy(F.col(key).alias("__key"), F.col("mark").alias("__mark")).agg(F.max("limit").alias("most"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("mark") == F.col("__mark"))
    words = held.join(open_docs, same).select(key, "mark", "most", F.explode(terms(F.col("t"), letters)).alias("term"))
    # every word of the corpus is counted: partial counts keep the shuffle to distinct words
    every = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")), letters)).alias("term"))
    n_t = settle(every.groupBy("term").agg(F.count("*").alias("n_t")).where((F.col("n_t") > 1) & (F.col("n_t") <= most)), "terms")
    rare = words.join(n_t, "term").where(F.col("n_t") <= F.col("most")).select(key, "mark", "term", "n_t")
    # Entities with equal documents tell and are told alike, and so do terms: their classes are paired, not they themselves.
    rare = settle(with_class(rare, "term", ["n_t"], "t_class", key), "rare")
    known = settle(with_class(known.select(key, "mark", "entity", "n_e", "limit"), "entity", ["n_e", "limit"], "e_class", key), "classes")
    side = rare.select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), "t_class", "n_t").distinct()
    met = known.select(key, "mark", "e_class", "n_e", "limit").distinct().join(side, same & (F.col("n_t") <= F.col("limit")))
    both = settle(met.select(key, "mark", "e_class", "t_class", "n_e", "n_t"), "both")
    n_te = both.groupBy("e_class", "t_class").agg(F.count("*").alias("n_te"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t")).where("n_te > 1")
    told = F.log2((F.col("n_te") - 1) * F.lit(float(n)) / (F.col("n_t") * F.col("n_e")))
    own = F.log2(F.lit(float(n)) / F.col("n_e"))
    shared = n_te.where((own > 0) & (told >= F.lit(disclosure) * own)).select("e_class", "t_class")
    telling = both.join(shared, ["e_class", "t_class"], "left_semi").select(F.col(key).alias("__key"), F.col("mark").alias("__mark"), F.col("t_class").alias("__class")).distinct()
    return rare.join(telling, same & (F.col("t_class") == F.col("__class")), "left_semi").select(key, "mark", "term")


def with_class(rows: DataFrame, name: str, also: list[str], out: str, key: str) -> DataFrame:
    """rows (key, mark, name, ...) with `out`, equal for names that have equal documents and equal other columns.

    A set of documents is told by their number and two 64-bit hashes of them, each xored over the set, so that partial
    aggregates do and no set is gathered.
    """
    doc = lambda n: F.bit_xor(F.xxhash64(key, "mark", F.lit(f"class {n}")))
    sets = rows.groupBy(name, *also).agg(F.count("*").alias("__n"), doc(1).alias("__a"), doc(2).alias("__b"))
    named = sets.select(name, F.struct("__n", "__a", "__b", *also).alias(out))
    return rows.join(named, name)


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, letters: int = LETTERS) -> DataFrame:
    """Per row of docs: key, mark, spans (base) and terms (of the method), each of kind, start and end in order."""
    spans = settle(base_spans(docs, key, text), "spans")
    held = spans.where(F.size("spans") > 0).dropDuplicates([key, "mark"])
    told = settle(disclosing(docs, held, key, text, disclosure, letters), "told")
    named = [F.col(key).alias("__key"), F.col("mark").alias("__mark")]
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("mark") == F.col("__mark"))
    marked = settle(held.join(told.select(*named).distinct(), same, "left_semi"), "marked")
    either = f"{PATTERNS['email']}|{term_pattern(letters)}"  # words inside of addresses are passed over with them
    words = marked.select(key, "mark", F.explode(located(F.regexp_extract_all("t", F.lit(either), F.lit(0)), F.split("t", either, -1))).alias("x"))
    words = words.select(key, "mark", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lower("x.text").alias("word"))
    chosen = words.join(told.select(*named, "term"), same & (F.col("word") == F.col("term")), "left_semi").select(key, "mark", "start", "end", F.lit(False).alias("mail"))
    mails = marked.select(key, "mark", F.explode(F.filter("spans", lambda s: s["kind"] == "email")).alias("x")).select(key, "mark", "x.start", "x.end", F.lit(True).alias("mail"))
    # a chosen word that runs into an address is none of its own: the addresses around it are found in one pass a text
    of_text = W.partitionBy(key, "mark").orderBy("start", F.desc("mail"))
    mail = lambda c: F.when(F.col("mail"), F.col(c))
    around = chosen.unionByName(mails).select("*", F.max(mail("end")).over(of_text.rowsBetween(W.unboundedPreceding, -1)).alias("before"), F.min(mail("start")).over(of_text.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    outside = around.where(~F.col("mail") & (F.coalesce(F.col("before"), F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end"))))
    term = F.struct("start", F.lit(len(KINDS)).alias("rank"), "end", F.lit("term").alias("kind"))
    hits = outside.groupBy(*named).agg(F.array_sort(F.collect_list(term)).alias("terms"))
    brief = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return spans.drop("t").join(hits, same, "left").select(key, "mark", brief.alias("spans"), F.coalesce("terms", F.expr("cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)")).alias("terms"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every row."""
    found = find(docs, key=key, text=text, **options)
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        key,
        *[number(k) for k in KINDS],
        F.sha2(written(F.col("spans")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("spans", "terms"))).alias("spans"),
    )


def sanitise(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs with base spans and disclosing terms generalised to their kinds; overlapping spans become the first's."""
    m, k, n, spans = unused(docs, "m", "k", "n", "spans")
    found = find(docs, key=key, text=text, **options).dropDuplicates([key, "mark"])
    marked = docs.withColumn(m, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    plan = found.where((F.size("spans") > 0) | (F.size("terms") > 0)).select(F.col(key).alias(k), F.col("mark").alias(n), F.array_sort(F.concat("spans", "terms")).alias(spans))
    joined = marked.join(plan, F.col(key).eqNullSafe(F.col(k)) & (F.col(m) == F.col(n)), "left")
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        more = F.concat(acc["out"], F.substr(F.col(text), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int")), F.element_at(label, s["kind"]))
        inside = s["start"] < acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(inside, acc["out"]).otherwise(more).alias("out"))

    whole = F.aggregate(F.col(spans), first, step, lambda acc: F.concat(acc["out"], F.substr(F.col(text), (acc["pos"] + 1).cast("int"), F.length(text))))
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), whole).otherwise(F.col(text))).select(*docs.columns)
