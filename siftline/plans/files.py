"""Queries on files: copies, checkpoints, placement, selection and names."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import paths, text
from ..operators import dedup, select
from ..session import shared_folder
from ..sources.content_index import ContentIndex
from .registry import query
from .views import BASE, DEST, EXTENSION, OBJECTS, PARTS, dest_names, objects, parts, table

UNDATED = f"case when {BASE} like '0000-00-00-%' then 1 else 0 end"
KEPT = f"""
ranked as (
  select *, row_number() over w as rn, first_value(key) over w as kept_key, first_value(bucket_alias) over w as kept_bucket
  from objects window w as (partition by content_hash order by {UNDATED}, key, bucket_alias)
)"""


@query("dedup_keep_first", f"with {OBJECTS}, {KEPT} select key, bucket_alias, content_hash, kept_key, kept_bucket from ranked where rn > 1")
def dedup_keep_first(spark, sf_dir):
    kept = dedup.keep_first(objects(spark, sf_dir).withColumn("extension", paths.extension_of(F.col("key"))))
    return kept.where(~F.col("is_kept")).select("key", "bucket_alias", "content_hash", "kept_key", "kept_bucket")


@query("dedup_merge_report", f"""with {OBJECTS}, {KEPT},
k as (select *, {EXTENSION.replace('key', 'kept_key')} || '/' || {BASE.replace('key', 'kept_key')} as kept_path from ranked)
select key as duplicate_key, bucket_alias as duplicate_bucket_alias, kept_path, kept_key as kept_original_key, kept_bucket as kept_bucket_alias, content_hash from k where rn > 1""")
def dedup_merge_report(spark, sf_dir):
    return dedup.merge_records(dedup.keep_first(objects(spark, sf_dir).withColumn("extension", paths.extension_of(F.col("key")))))


@query("dedup_report_totals", f"with {OBJECTS}, {KEPT} select count(*) filter (rn = 1) as kept, count(*) filter (rn > 1) as duplicates, count(distinct content_hash) as contents from ranked")
def dedup_report_totals(spark, sf_dir):
    kept = dedup.keep_first(objects(spark, sf_dir).withColumn("extension", F.lit("")))
    return kept.groupBy("content_hash").agg(F.count_if("is_kept").alias("k"), F.count_if(~F.col("is_kept")).alias("d")).agg(F.sum("k").alias("kept"), F.sum("d").alias("duplicates"), F.count("*").alias("contents"))


@query("type_summary", f"with {OBJECTS} select {EXTENSION} as extension, count(*) as files, sum(size)::bigint as total_bytes from objects group by 1")
def type_summary(spark, sf_dir):
    return dedup.type_summary(objects(spark, sf_dir))


@query("multi_source_union", """select 'documents' as bucket_alias, 'd/' || doc_id::varchar as key, n_chars as size from documents
union all select 'pages', 'p/' || page_id::varchar, strlen(html)::bigint from pages""")
def multi_source_union(spark, sf_dir):
    from ..sources.listing import union_of

    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("key"), F.col("n_chars").alias("size"))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string")).alias("key"), F.octet_length("html").cast("bigint").alias("size"))
    return union_of({"documents": d, "pages": p})


CHECKPOINT = """
ck as (select case when l.quality = 1 then d.bucket_alias else '' end as bucket_alias, d.key from labels l join objects d using (doc_id) where l.toxic = 0)"""


def checkpoint(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("toxic = 0")
    return labels.join(objects(spark, sf_dir), "doc_id").select(F.when(F.col("quality") == 1, F.col("bucket_alias")).otherwise("").alias("bucket_alias"), "key")


@query("checkpoint_anti", f"""with {OBJECTS}, {CHECKPOINT} select bucket_alias, key, size from objects o
where not exists (select 1 from ck where ck.key = o.key and ck.bucket_alias in (o.bucket_alias, ''))""")
def checkpoint_anti(spark, sf_dir):
    return dedup.pending(objects(spark, sf_dir), checkpoint(spark, sf_dir)).select("bucket_alias", "key", "size")


@query("content_index_lookup", f"""with {OBJECTS}, {KEPT},
idx as (select sha256(text) as content_hash, max_by('index/' || doc_id::varchar, doc_id) as k from documents where doc_id % 4 = 0 group by 1)
select key, coalesce(k, kept_key) as kept_key, case when k is not null then false else rn = 1 end as is_kept from ranked left join idx using (content_hash)""")
def content_index_lookup(spark, sf_dir):
    """Files against an index in buckets that two earlier runs have written."""
    files = objects(spark, sf_dir).withColumn("extension", paths.extension_of(F.col("key")))
    rows = files.where(F.col("doc_id") % 4 == 0).select("content_hash", F.concat(F.lit("index/"), F.col("doc_id").cast("string")).alias("index_key"), F.lit("index").alias("index_bucket"), F.col("doc_id").alias("line"))
    index = ContentIndex(shared_folder(spark, "index"), 8)
    for generation in (0, 4):
        index.append(rows.where(F.col("line") % 8 == generation))
    return index.lookup(files).select("key", "kept_key", "is_kept")


@query("checkpoint_commit", f"""with {OBJECTS},
roots as (select bucket_alias, key || case when doc_id % 6 = 0 then '.zip' else '' end as key, doc_id from objects),
tainted as (select r.bucket_alias, r.key from roots r join labels l using (doc_id) group by all having bool_or(l.toxic = 1)),
placed as (select r.bucket_alias, r.key from roots r join labels l using (doc_id) where l.quality = 1)
select bucket_alias, key from roots r where not exists (select 1 from tainted t where t.bucket_alias = r.bucket_alias and t.key = r.key)
and (key like '%.zip' or exists (select 1 from placed p where p.bucket_alias = r.bucket_alias and p.key = r.key))""")
def checkpoint_commit(spark, sf_dir):
    ends = F.when(F.col("doc_id") % 6 == 0, ".zip").otherwise("")
    roots = objects(spark, sf_dir).select("bucket_alias", F.concat("key", ends).alias("key"), "doc_id")
    labelled = roots.join(table(spark, sf_dir, "labels"), "doc_id")
    tainted = dedup.tainted_roots(labelled.select("bucket_alias", F.col("key").alias("root_key"), (F.col("toxic") == 1).alias("failed")))
    return dedup.to_checkpoint(roots.select("bucket_alias", "key"), tainted, labelled.where("quality = 1"))


@query("placement_path", f"""with {OBJECTS},
n as (select *, {EXTENSION} as ext, 'doc-' || (doc_id % 40)::varchar || '.txt' as name from objects),
r as (select *, row_number() over (partition by name order by key, bucket_alias) as rn from (select key || '/' || name as key, bucket_alias, name from n))
select key as original_key, bucket_alias, 'txt/' || case when rn = 1 then name else 'doc-' || regexp_extract(name, '([0-9]+)', 1) || '-' || rn::varchar || '.txt' end as placed from r""")
def placement_path(spark, sf_dir):
    name = F.concat(F.lit("doc-"), (F.col("doc_id") % 40).cast("string"), F.lit(".txt"))
    files = objects(spark, sf_dir).select(F.concat("key", F.lit("/"), name).alias("original_key"), "bucket_alias")
    return dedup.placed_names(files).select("original_key", "bucket_alias", "placed")


@query("placement_exact")
def placement_exact(spark, sf_dir):
    """Names that can meet generated ones: doc-3.txt, and doc-3-2.txt as a name of its own."""
    name = F.concat(F.lit("doc-"), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 5 == 0, "-2").otherwise(""), F.lit(".txt"))
    files = objects(spark, sf_dir).select(F.concat("key", F.lit("/"), name).alias("original_key"), "bucket_alias")
    return dedup.exact_names(files).select("original_key", "bucket_alias", "placed")


@query("key_functions", f"""with {OBJECTS},
k as (select *, 'a!b.zip!' || key as key2 from objects)
select key2 as key, key as member, {EXTENSION} as extension, {BASE} like '0000-00-00-%' as undated, lower(split_part(key, '/', 1)) as top,
array_to_string(list_transform(range(1, len(string_split(key, '/')) + 1), lambda i: array_to_string(string_split(key, '/')[1:i], '/')), ' ') as prefixes from k""")
def key_functions(spark, sf_dir):
    k = objects(spark, sf_dir).select(F.col("key").alias("inner"), paths.member_key(F.lit("a!b.zip"), F.col("key")).alias("whole"))
    member = paths.after_zip_separator(F.col("whole"))
    return k.select(
        F.col("whole").alias("key"), member.alias("member"), paths.extension_of(F.col("whole")).alias("extension"), paths.is_undated(F.col("whole")).alias("undated"),
        F.lower(F.get(paths.path_prefixes(F.col("inner")), F.lit(0))).alias("top"), F.array_join(paths.path_prefixes(F.col("inner")), " ").alias("prefixes"),
    )


MEMBERS = "['__MACOSX/a.txt', 'x/._a', 'x/.DS_Store', '.git/config', 'a/node_modules/b.js', 'a/b.gitignore', 'ok.txt', '~$book.xlsx']"


@query("member_filter", f"""with m as (select doc_id, {MEMBERS}[doc_id % 8 + 1] as name from documents)
select doc_id, name, name like '\\_\\_MACOSX/%' escape '\\' or split_part(name, '/', -1) like '.\\_%' escape '\\' or split_part(name, '/', -1) = '.DS_Store'
or list_has_any(string_split(name, '/'), ['.git', 'node_modules']) as skipped, starts_with(split_part(name, '/', -1), '~$') as lock_stub from m""")
def member_filter(spark, sf_dir):
    names = ["__MACOSX/a.txt", "x/._a", "x/.DS_Store", ".git/config", "a/node_modules/b.js", "a/b.gitignore", "ok.txt", "~$book.xlsx"]
    m = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 8 + 1).cast("int")).alias("name"))
    return m.select("doc_id", "name", paths.is_skippable_member(F.col("name")).alias("skipped"), paths.is_lock_stub(F.col("name")).alias("lock_stub"))


@query("case_collisions", f"with {PARTS} select lower(nfc_normalize(key)) as fold, array_to_string(list_sort(list(distinct key)), ' | ') as members, count(distinct key) as n from parts group by 1 having count(distinct key) > 1")
def case_collisions(spark, sf_dir):
    return select.collision_groups(parts(spark, sf_dir)).withColumn("members", F.array_join("members", " | "))


@query("bulk_variant_split", f"""with {PARTS}, k as (select distinct key from parts),
c as (select lower(key) as fold from k group by 1 having count(*) > 1)
select p.key, lower(p.key) in (select fold from c) as variant from parts p""")
def bulk_variant_split(spark, sf_dir):
    bulk, variants = select.split_variants(parts(spark, sf_dir))
    return bulk.withColumn("variant", F.lit(False)).unionByName(variants.withColumn("variant", F.lit(True)))


@query("variant_slots", f"""with {PARTS}, v as (select distinct case when ascii(right(key, 1)) % 3 = 0 then lower(split_part(key, '/', 1)) else split_part(key, '/', 1) end || '/' || split_part(key, '/', 2) as key from parts),
c as (select key, split_part(key, '/', 1) as top, lower(split_part(key, '/', 1)) as fold, lower(key) as whole from v qualify count(*) over (partition by lower(key)) > 1),
inner_slots as (select *, row_number() over (partition by top, whole order by key) - 1 as inner_slot from c),
tops as (select fold, top, max(inner_slot) + 1 as need from inner_slots group by all),
offsets as (select top, coalesce(sum(need) over (partition by fold order by top rows between unbounded preceding and 1 preceding), 0)::bigint as before from tops)
select key, inner_slot + before as slot from inner_slots join offsets using (top)""")
def variant_slots(spark, sf_dir):
    """Names of parts below their brands, both spelt in several ways."""
    top, name = F.split_part("key", F.lit("/"), F.lit(1)), F.split_part("key", F.lit("/"), F.lit(2))
    low = F.ascii(F.right("key", F.lit(1))) % 3 == 0
    return select.variant_slots(parts(spark, sf_dir).select(F.concat(F.when(low, F.lower(top)).otherwise(top), F.lit("/"), name).alias("key")))


@query("destination_name", f"""with {OBJECTS},
s as (select *, case when regexp_matches({BASE}, '^.+\\.[^.]*$') then regexp_replace({BASE}, '\\.[^.]*$', '') else {BASE} end as stem from objects)
select key, bucket_alias, stem || '-' || substr(sha256(bucket_alias || chr(1) || key), 1, 16) || '.txt' as name from s""")
def destination_name(spark, sf_dir):
    return objects(spark, sf_dir).select("key", "bucket_alias", paths.destination_name(F.col("bucket_alias"), F.col("key"), "txt").alias("name"))


@query("sheet_names", """with s as (select 'order-' || l_orderkey::varchar as grp, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i,
count(*) over (partition by l_orderkey) as n, l_returnflag || ' & ' || l_linestatus || ' ' || l_linenumber::varchar as title from lineitem)
select grp, i, n, grp || '-' || lpad(i::varchar, greatest(2, length(i::varchar))::int, '0') || 'of' || lpad(n::varchar, greatest(2, length(n::varchar))::int, '0') || '-' ||
regexp_replace(title, '[^A-Za-z0-9._-]+', '-', 'g') || '.csv' as name from s""")
def sheet_names(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sheets = li.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("grp"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("position"), F.concat("l_returnflag", F.lit(" & "), "l_linestatus", F.lit(" "), F.col("l_linenumber").cast("string")).alias("title"))
    return select.sheet_names(sheets).select("grp", "i", "n", "name")


GROUPS = f"""{DEST},
states as (select grp, bool_or(plain) or (min(n) = max(n) and count(distinct i) = max(n)) as complete from marks group by grp)"""


@query("group_completeness", f"with {GROUPS} select * from states")
def group_completeness(spark, sf_dir):
    return select.group_states(dest_names(spark, sf_dir))


@query("needing_pull", f"""with {GROUPS},
k as (select o_orderkey, case when o_orderkey % 17 = 0 then 'x/._o' when o_orderkey % 19 = 0 then 'x/~$o' else 'x/o' end || o_orderkey::varchar as key,
'doc-' || substr(sha256(o_orderkey::varchar), 1, 16) as grp from orders)
select coalesce(case when o_orderkey % 17 = 0 then 'apple_double' when o_orderkey % 19 = 0 then 'lock_stub' when s.complete then 'already_done' end, 'pulled') as reason, count(*) as n
from k left join states s using (grp) group by 1""")
def needing_pull(spark, sf_dir):
    o = F.col("o_orderkey")
    head = F.when(o % 17 == 0, "x/._o").when(o % 19 == 0, "x/~$o").otherwise("x/o")
    keys = table(spark, sf_dir, "orders").select(F.concat(head, o.cast("string")).alias("key"), F.concat(F.lit("doc-"), F.substring(F.sha2(o.cast("string"), 256), 1, 16)).alias("grp"))
    complete = select.group_states(dest_names(spark, sf_dir)).where("complete")
    return select.needing_pull(keys, complete).groupBy(F.coalesce("skip_reason", F.lit("pulled")).alias("reason")).agg(F.count("*").alias("n"))


@query("undelivered", f"""with {OBJECTS}
select o.key, case when l.toxic = 1 then 'pulled apart for its colliding name, and that pull failed: dial tcp'
when o.doc_id % 3 = 0 then 'pulled apart for its colliding name, without an error or a result' else 'in the pull set, but never reported as copied' end as detail
from objects o left join labels l using (doc_id) where l.doc_id is null or l.quality = 0""")
def undelivered(spark, sf_dir):
    files = objects(spark, sf_dir)
    labelled = files.join(table(spark, sf_dir, "labels"), "doc_id")
    failures = labelled.where("toxic = 1").select("key", F.lit("dial tcp").alias("error"))
    return select.undelivered(files.select("key"), labelled.where("quality = 1"), failures, files.where(F.col("doc_id") % 3 == 0))


@query("existing_group_outputs", f"with {DEST} select distinct name from (select case when plain then grp || '.csv' else grp || '-' || lpad(i::varchar, 2, '0') || 'of' || lpad(n::varchar, 2, '0') || '-line.csv' end as name, grp from marks) where grp = 'doc-' || substr(sha256('5'), 1, 16)")
def existing_group_outputs(spark, sf_dir):
    import hashlib

    return select.group_outputs(dest_names(spark, sf_dir).distinct(), "doc-" + hashlib.sha256(b"5").hexdigest()[:16])


@query("slugs", """select p_partkey, coalesce(nullif(trim(substr(regexp_replace(regexp_replace(p_name || ' (' || p_type || ')', '^[^A-Za-z0-9._-]+', ''), '[^A-Za-z0-9._-]+', '-', 'g'), 1, 40), '-'), ''), 'sheet') as slug,
regexp_replace(lower(substr(regexp_replace(regexp_replace(p_brand || '__' || p_type, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+', '-', 'g'), 1, 100)), '-$', '') as segment from part""")
def slugs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", paths.sheet_slug(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("slug"), paths.sanitize_segment(F.concat("p_brand", F.lit("__"), "p_type")).alias("segment"))


@query("aliases", """with c as (select c_custkey, c_name || '.' || c_mktsegment || '@mail.example.com' as email from customer)
select c_custkey, regexp_replace(lower(regexp_replace(split_part(email, '@', 1), '[^A-Za-z0-9]+', '-', 'g')), '-$', '') as alias,
upper(regexp_replace(email, '[^A-Za-z0-9]', '_', 'g')) as variable from c""")
def aliases(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit("."), "c_mktsegment", F.lit("@mail.example.com")).alias("email"))
    return c.select("c_custkey", paths.sanitize_alias(F.col("email")).alias("alias"), paths.secret_variable(F.col("email")).alias("variable"))


@query("mailbox_paths", """select page_id, array_to_string(list_filter(list_transform(string_split(url, '/'), lambda s: regexp_replace(lower(regexp_replace(regexp_replace(s, '^[^A-Za-z0-9]+', ''), '[^A-Za-z0-9]+', '-', 'g')), '-$', '')), lambda s: s <> ''), '/') as relpath from pages""")
def mailbox_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", paths.sanitize_mailbox(F.col("url"), "/").alias("relpath"))


@query("remote_target_parse", """with t as (select page_id, replace(url, '..', '.') as url from pages),
p as (select page_id, split_part(url, ':', 1) as alias, trim(substr(url, length(split_part(url, ':', 1)) + 2), '/') as prefix from t)
select page_id, alias, case when prefix <> '' then prefix || '/' end as prefix from p""")
def remote_target_parse(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", paths.remote_target(F.replace("url", F.lit(".."), F.lit("."))).alias("t"))
    return t.select("page_id", "t.alias", "t.prefix")


@query("sized_names", f"""with {OBJECTS}
select key, case when b < 1024 then b::varchar || ' B' when b < 1024 ** 2 then printf('%.1f KB', b / 1024.0) when b < 1024 ** 3 then printf('%.1f MB', b / 1024.0 ** 2)
when b < 1024 ** 4 then printf('%.1f GB', b / 1024.0 ** 3) else printf('%.1f TB', b / 1024.0 ** 4) end as size_text,
regexp_replace(key, '[/\\\\:]', '-', 'g') as log_name from (select key, size * (1024 ** (doc_id % 5))::bigint as b from objects)""")
def sized_names(spark, sf_dir):
    """Sizes of documents, taken for bytes, KB, MB, GB or TB."""
    size = F.col("size") * F.pow(F.lit(1024), F.col("doc_id") % 5).cast("bigint")
    return objects(spark, sf_dir).select("key", text.format_bytes(size).alias("size_text"), paths.flat_log_name(F.col("key")).alias("log_name"))


@query("largest_in_group", f"with {OBJECTS} select bucket_alias, max_by(key, [size, -doc_id]) as key, max(size) as size, count(*) as n from objects group by 1")
def largest_in_group(spark, sf_dir):
    """Top one of each group by size, the first of equal ones; the shape of picking an icon's largest image."""
    o = objects(spark, sf_dir)
    return o.groupBy("bucket_alias").agg(F.max_by("key", F.struct("size", -F.col("doc_id"))).alias("key"), F.max("size").alias("size"), F.count("*").alias("n"))


@query("listing_filter", f"with {OBJECTS} select key, size from objects where {EXTENSION} in ('txt', 'md')")
def listing_filter(spark, sf_dir):
    o = objects(spark, sf_dir)
    return o.where(paths.has_extension(F.col("key"), "txt", "md")).select("key", "size")


@query("first_in_bucket", f"with {OBJECTS} select bucket_alias, key, rn from (select bucket_alias, key, row_number() over (partition by bucket_alias order by key) as rn from objects) where rn <= 10")
def first_in_bucket(spark, sf_dir):
    """The first ten names of each bucket, as a log line shows them."""
    ranked = objects(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("bucket_alias").orderBy("key")).cast("bigint"))
    return ranked.where("rn <= 10").select("bucket_alias", "key", "rn")
