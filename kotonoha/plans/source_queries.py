"""Registered queries for sources, catalogue, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.operators import evaluate, results
from kotonoha.functions.tables import small_table, written
from kotonoha.plans import archives, inputs, lookup_queries, model_queries  # noqa: F401
from kotonoha.plans.oracle import cte, sql
from kotonoha.plans.registry import query
from kotonoha.session import scratch_dir
from kotonoha.sources import banks, catalog, store
from kotonoha.streaming import jobs

# one bank document per corpus document; its rows are the distinct words
cte("doc_words", "select distinct doc_id, w from words", "words")
_ROW = {
    "term": """case length(w) % 6 when 0 then '["' || w || '","r",["n",3,"adj"],"v5"]' when 1 then '[5,"' || w || '","n","v1",3,["x"]]'
 when 2 then '["' || w || '","r' || w || '","n","v1 vt",' || cast(length(w) as varchar(9)) || ',{"b":1.50,"a":["' || w || '"]},7,"common"]'
 when 3 then '["' || w || '","",["n",3,"adj"],["v5","vi"],2.5,"bare ' || w || '"]'
 when 4 then '["' || w || '","r","n","v5","4"]' else '{"not":"a row"}' end""",
    "kanji": """case length(w) % 4 when 0 then '["' || w || '","ON","kun",8]' when 1 then '["' || w || '","","",["a","b"],["m ' || w || '"],{"jlpt":"3","x":1}]'
 when 2 then '["' || w || '","ON on","","",["m"],{"jlpt":2}]' else '["' || w || '","ON","kun"]' end""",
    "term_meta": """case length(w) % 5 when 0 then '["' || w || '","freq",12]' when 1 then '["' || w || '","pitch",{"reading":"r' || w || '","pitches":[{"position":1.0}]}]'
 when 2 then '["","pitch",{"reading":"r","pitches":[]}]' when 3 then '["' || w || '","pitch",{"pitches":[]}]' else '["' || w || '","pitch"]' end""",
    "tag": """case length(w) % 3 when 0 then '["' || w || '","cat",' || cast(length(w) as varchar(9)) || ',"note",-1]' when 1 then '["' || w || '",5,"x","",2.5]' else '["' || w || '"]' end""",
}


def _doc_words(spark, d):
    """The distinct words of each document, in order."""
    # a text's words are made distinct in its own row; texts that share an id meet afterwards
    texts = inputs.table(spark, d, "documents").select("doc_id", F.array_remove(F.array_distinct(F.split(F.lower("text"), "[^a-z]+")), "").alias("ws"))
    # little to shuffle and much to do with it: as many tasks as the session has, not as few as the bytes fill
    dealt = texts.filter(F.size("ws") > 0).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return dealt.groupBy("doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ws")))).alias("ws"))


def _documents(spark, d, kind, words=None):
    doc = inputs.table(spark, d, "documents").select("doc_id", "lang")
    rows = _doc_words(spark, d) if words is None else words
    per = rows.join(doc, "doc_id").select(
        F.concat(F.lit("dict-"), "lang").alias("archive"), F.concat(F.lit("dict-"), "lang").alias("title"), F.lit(kind).alias("kind"),
        F.col("doc_id").alias("bank_ord"), F.concat(F.lit(f"{kind}_bank_"), F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), "ws",
    )
    body = F.expr(f"transform(ws, w -> {_ROW[kind]})")
    return per.withColumn("text", F.concat(F.lit("["), F.array_join(body, ","), F.lit("]"))).drop("ws")


def _ingested(spark, d):
    """Terms, which are published once, and kanji and tags, which are published several times and so are read and written once before."""
    words = written(_doc_words(spark, d), "doc-words")
    terms = banks.ingest_term_banks(_documents(spark, d, "term", words))
    kanji = written(banks.ingest_kanji_banks(_documents(spark, d, "kanji", words)), "kanji-rows")
    return terms, kanji, written(banks.ingest_tag_banks(_documents(spark, d, "tag", words)), "tag-rows")


cte("bank_rows", "select 'dict-' || lang archive, doc_id bank_ord, w, row_number() over (partition by doc_id order by w) - 1 row from doc_words join documents using (doc_id)", "doc_words")


@query("s02_term_banks", sql("""select archive, bank_ord, bank_ord * 4294967296 + row id, w kanji, case length(w) % 6 when 2 then 'r' || w when 3 then '' else 'r' end reading,
 case length(w) % 6 when 2 then '{"b":1.5,"a":["' || w || '"]}' when 3 then '"bare ' || w || '"' else '' end definitions,
 case length(w) % 6 when 2 then 'n | v1 vt | common' when 3 then 'n adj | v5 vi' else 'n | v5' end rules,
 case length(w) % 6 when 2 then length(w) else 0 end popularity from bank_rows where length(w) % 6 in (2, 3, 4)""", "bank_rows"))
def term_banks(spark, d):
    e = banks.ingest_term_banks(_documents(spark, d, "term"))
    return e.select("archive", "bank_ord", "id", "kanji", "reading", "definitions", "rules", "popularity")


@query("s03_kanji_banks", sql("""select archive, bank_ord, bank_ord * 4294967296 + row id, w kanji, case length(w) % 4 when 0 then 'ON' when 1 then '' else 'ON on' end reading,
 case length(w) % 4 when 0 then '' when 1 then '["m ' || w || '"]' else '["m"]' end definitions,
 case length(w) % 4 when 0 then 'grade:8' when 1 then 'grade:a b' else 'grade:' end rules,
 case length(w) % 4 when 0 then 'ON' when 2 then 'ON on' end onyomi, case length(w) % 4 when 0 then 'kun' end kunyomi,
 case length(w) % 4 when 1 then '3' end jlpt from bank_rows where length(w) % 4 < 3""", "bank_rows"))
def kanji_banks(spark, d):
    e = banks.ingest_kanji_banks(_documents(spark, d, "kanji"))
    return e.select("archive", "bank_ord", "id", "kanji", "reading", "definitions", "rules", "onyomi", "kunyomi", "jlpt")


@query("s04_term_meta_banks", sql("""select archive, bank_ord, w kanji, 'r' || w reading, '{"reading":"r' || w || '","pitches":[{"position":1.0}]}' definitions
 from bank_rows where length(w) % 5 = 1""", "bank_rows"))
def term_meta_banks(spark, d):
    return banks.ingest_term_meta_banks(_documents(spark, d, "term_meta")).select("archive", "bank_ord", "kanji", "reading", "definitions")


@query("s05_tag_banks", sql("""select archive, bank_ord, w "name", case when length(w) % 3 = 0 then 'cat' else '' end category, case when length(w) % 3 = 0 then length(w) else 0 end order_val,
 case when length(w) % 3 = 0 then 'note' else '' end notes, case when length(w) % 3 = 0 then -1 else 0 end popularity from bank_rows where length(w) % 3 < 2""", "bank_rows"))
def tag_banks(spark, d):
    return banks.ingest_tag_banks(_documents(spark, d, "tag")).drop("row")


@query("s07_import_report", sql("""select *, sum(n_entries) over w entries_imported, count(*) over w banks_done, count(*) over (partition by archive) banks_total from (
 select archive, bank_ord, 'term' kind, count(case when length(w) % 6 in (2, 3, 4) then 1 end) n_entries from bank_rows group by archive, bank_ord)
 window w as (partition by archive order by bank_ord rows between unbounded preceding and current row)""", "bank_rows"))
def import_report(spark, d):
    docs = _documents(spark, d, "term")
    return banks.import_report(docs, banks.ingest_term_banks(docs))


@query("s01_bank_documents", sql("""select 'dict-' || lang title, 'term' kind, 0 bank_ord, 'term_bank_' || doc_id || '.json' "name", n + sum_len + n - 1 + 2 + length_rows n_chars from (
 select lang, doc_id, count(*) n, 0 sum_len, sum(length(r)) - count(*) length_rows from (select doc_id, ROWEXPR r from doc_words) join documents using (doc_id) group by all)
union all select 'dict-' || lang, 'tag', 1, 'tag_bank_1.json', 2 from documents where doc_id in (select doc_id from doc_words)""".replace("ROWEXPR", _ROW["term"]), "doc_words"))
def bank_documents(spark, d):
    path = scratch_dir(spark, "archives")
    zipped = _documents(spark, d, "term").select("title", "name", "text").mapInPandas(archives.zipped, "name string, content binary")
    zipped.mapInPandas(archives.landing(path), "name string").write.format("noop").mode("overwrite").save()
    docs = banks.read_bank_documents(spark, path)
    return docs.select("title", "kind", "bank_ord", "name", F.length("text").alias("n_chars"))


@query("s01_large_archives", sql("""select 'dict-' || lang title, 'term' kind, row_number() over (partition by lang order by doc_id) - 1 bank_ord,
 'term_bank_' || doc_id || '.json' "name", n + n - 1 + 2 + length_rows n_chars from (
 select lang, doc_id, count(*) n, sum(length(r)) - count(*) length_rows from (select doc_id, ROWEXPR r from doc_words) join documents using (doc_id) group by all)""".replace("ROWEXPR", _ROW["term"]), "doc_words"))
def large_archives(spark, d):
    # one archive a language, with all its documents as banks
    path = scratch_dir(spark, "archives")
    members = _documents(spark, d, "term").select("title", "name", "text").mapInPandas(archives.deflated, archives.MEMBERS)
    # a file is written from its start to its end: members pass through, in order
    ordered = members.repartition("title").sortWithinPartitions("title", "name")
    ordered.mapInPandas(archives.landing_members(path), "name string").write.format("noop").mode("overwrite").save()
    docs = banks.read_bank_documents(spark, path, range_bytes=1 << 16)
    return docs.select("title", "kind", "bank_ord", "name", F.length("text").alias("n_chars"))


@query("s06_publish_dictionary", sql("""select 'second' title, 0 priority, true built_in, 2 id, count(*) n_entries from bank_rows where length(w) % 4 < 3
 union all select 'first', 1, false, 3, count(*) from bank_rows where length(w) % 6 in (2, 3, 4)""", "bank_rows"))
def publish_dictionary(spark, d):
    path = scratch_dir(spark, "store")
    terms, kanji, tags = _ingested(spark, d)
    store.publish_dictionary(spark, path, "first", kanji, tags)
    store.publish_dictionary(spark, path, "second", kanji, tags, "cat-2", True)
    # publishing the first title again replaces it and moves it to the end
    first = store.publish_dictionary(spark, path, "first", terms, tags)
    assert first == 3
    listing = store.dictionary_listing(store.read_meta(spark, path), store.read_entries(spark, path))
    low = listing.agg(F.min("priority")).first()[0]
    return listing.select(F.col("name").alias("title"), (F.col("priority") - low).alias("priority"), "built_in", F.col("id").cast("int").alias("id"), "n_entries")


# suppliers as catalogue entries, with every kind of mistake
cte("catalog", """select s_suppkey file_order, 'cat-' || (s_suppkey % 90) id, case when s_suppkey % 9 = 0 then 0 else s_suppkey * 10 end bytes,
 case when s_suppkey % 7 = 0 then upper(sha256(s_name)) else sha256(s_name) end sha256,
 case when s_suppkey % 5 = 0 then 'http' else 'https' end || '://x.example/' || case when s_suppkey % 8 = 0 then 'releases/latest/' else 'v1/' end || s_name url,
 'Title ' || (s_suppkey % 40) title from supplier""")


def _catalog(spark, d):
    s, k = inputs.table(spark, d, "supplier"), F.col("s_suppkey")
    sha = F.sha2(F.col("s_name").cast("binary"), 256)
    return s.select(
        k.alias("file_order"), F.concat(F.lit("cat-"), (k % 90).cast("string")).alias("id"), F.when(k % 9 == 0, 0).otherwise(k * 10).alias("bytes"),
        F.when(k % 7 == 0, F.upper(sha)).otherwise(sha).alias("sha256"),
        F.concat(F.when(k % 5 == 0, "http").otherwise("https"), F.lit("://x.example/"), F.when(k % 8 == 0, "releases/latest/").otherwise("v1/"), F.col("s_name")).alias("url"),
        F.concat(F.lit("Title "), (k % 40).cast("string")).alias("title"),
    )


@query("s08_audit_catalog", sql("""select id, 'duplicate id' problem from catalog group by id having count(*) > 1
 union all select id, 'bytes must be positive' from catalog where bytes = 0 union all select id, 'invalid sha256' from catalog where not regexp_full_match(sha256, '[0-9a-f]{64}')
 union all select id, 'url is not https' from catalog where not starts_with(url, 'https://') union all select id, 'url points at latest' from catalog where contains(url, '/releases/latest/')""", "catalog"))
def audit_catalog(spark, d):
    return catalog.audit_catalog(_catalog(spark, d))


@query("s09_verify_files", sql("""select doc_id "name", doc_id % 4 in (0, 1) and doc_id % 7 > 0 size_ok, doc_id % 4 in (0, 3) and doc_id % 7 > 0 sha_ok,
 case when doc_id % 7 = 0 then 'not pinned' when doc_id % 4 in (2, 3) then 'size mismatch' when doc_id % 4 = 1 then 'sha256 mismatch' else 'ok' end verdict from documents"""))
def verify_files(spark, d):
    docs, k = inputs.table(spark, d, "documents"), F.col("doc_id") % 4
    files = docs.select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    pins = docs.filter("doc_id % 7 > 0").select(
        F.col("doc_id").alias("name"), (F.octet_length("text") + F.when(k.isin(0, 1), 0).otherwise(1)).cast("bigint").alias("bytes"),
        F.sha2(F.concat(F.col("text"), F.when(k.isin(0, 3), "").otherwise("!")).cast("binary"), 256).alias("sha256"),
    )
    return catalog.verify_files(files, pins)


# customers as installed dictionaries
cte("installed", """select c_custkey id, ' Title ' || (c_custkey % 60) || case when c_custkey % 3 = 0 then ' [2026-01]' when c_custkey % 3 = 1 then ' ' else '' end "name",
 c_custkey % 5 = 0 built_in, case when c_custkey % 2 = 0 then 'cat-' || (c_custkey % 120) end catalog_id, c_custkey priority, c_custkey % 3 > 0 enabled from customer""")


def _installed(spark, d):
    k = F.col("c_custkey")
    tail = F.when(k % 3 == 0, " [2026-01]").when(k % 3 == 1, " ").otherwise("")
    return inputs.table(spark, d, "customer").select(
        k.alias("id"), F.concat(F.lit(" Title "), (k % 60).cast("string"), tail).alias("name"), (k % 5 == 0).alias("built_in"),
        F.when(k % 2 == 0, F.concat(F.lit("cat-"), (k % 120).cast("string"))).alias("catalog_id"), k.alias("priority"), (k % 3 > 0).alias("enabled"),
    )


@query("s10_match_installed", sql("""select i.id, i."name", coalesce((select min(id) from catalog c where c.id = i.catalog_id),
 (select min_by(id, file_order) from catalog c where c.title = trim(case when instr(trim(i."name"), ' [') > 1 then left(trim(i."name"), instr(trim(i."name"), ' [') - 1) else i."name" end))) matched_id
 from installed i""", "installed", "catalog"))
def match_installed(spark, d):
    return catalog.match_installed(_installed(spark, d), _catalog(spark, d))


@query("s10_bundled_install", sql("""select s.id, not coalesce(bool_or(i.built_in), false) and not coalesce(bool_or(i.id is not null and i.catalog_id is distinct from s.id), false) needed
 from (select distinct id, title from catalog) s left join installed i on split_part(trim(i."name"), ' [', 1) = s.title group by s.id""", "installed", "catalog"))
def bundled_install(spark, d):
    specs = _catalog(spark, d).select("id", F.col("title").alias("family")).distinct()
    return catalog.bundled_install_needed(_installed(spark, d), specs)


cte("changes", """select o_orderkey seq, o_custkey id, ['rename','enable','priority','delete'][o_orderkey % 4 + 1] op,
 case o_orderkey % 4 when 0 then 'name ' || o_orderkey when 1 then case when o_orderkey % 8 = 1 then 'true' else 'false' end else cast(o_orderkey as varchar) end "value"
 from orders where not (o_orderkey % 4 = 3 and o_custkey % 4 > 0)""")


@query("s11_apply_changes", sql("""select i.id, coalesce(max_by("value", seq) filter (op = 'rename'), any_value(i."name")) "name",
 coalesce(cast(max_by("value", seq) filter (op = 'priority') as bigint), any_value(i.priority)) priority,
 coalesce(cast(max_by("value", seq) filter (op = 'enable') as boolean), any_value(i.enabled)) enabled, any_value(i.built_in) built_in, any_value(i.catalog_id) catalog_id
 from installed i left join changes c on c.id = i.id where i.built_in or i.id not in (select id from changes where op = 'delete') group by i.id""", "installed", "changes"))
def apply_changes(spark, d):
    o = inputs.table(spark, d, "orders")
    k = F.col("o_orderkey")
    changes = o.filter("not (o_orderkey % 4 = 3 and o_custkey % 4 > 0)").select(
        k.alias("seq"), F.col("o_custkey").alias("id"), F.get(F.array(*map(F.lit, ["rename", "enable", "priority", "delete"])), (k % 4).cast("int")).alias("op"),
        F.when(k % 4 == 0, F.concat(F.lit("name "), k.cast("string"))).when(k % 8 == 1, "true").when(k % 4 == 1, "false").otherwise(k.cast("string")).alias("value"),
    )
    return store.apply_dictionary_changes(_installed(spark, d), changes)


@query("s11_move_dictionary", sql("""select i.id, case when i.id = 7 then 6 when i.id = 6 then 7 else i.priority end priority from installed i""", "installed"))
def move_dictionary(spark, d):
    return store.move_dictionary(_installed(spark, d), 7, up=True).select("id", "priority")


@query("s11_store_changes", sql("""select 'renamed' "name", 0 place, false enabled, count(*) n_entries from bank_rows where length(w) % 6 in (2, 3, 4)
 union all select 'kept', 1, true, count(*) from bank_rows where length(w) % 4 < 3""", "bank_rows"))
def store_changes(spark, d):
    path = scratch_dir(spark, "store")
    terms, kanji, tags = _ingested(spark, d)
    gone = store.publish_dictionary(spark, path, "gone", kanji, tags)
    kept = store.publish_dictionary(spark, path, "kept", kanji, tags, "cat-2", True)
    named = store.publish_dictionary(spark, path, "named", terms, tags)
    # a built-in dictionary is not deleted; the last rename wins
    feed = [(1, gone, "delete", ""), (2, kept, "delete", ""), (3, named, "rename", "first"), (4, named, "rename", "renamed"), (5, named, "enable", "false")]
    changes = small_table(spark, feed, "seq int, id bigint, op string, value string")
    meta = store.change_dictionaries(spark, path, changes, [(named, True)])
    assert store.remove_unused(spark, path) == [gone]
    low = meta.agg(F.min("priority")).first()[0]
    listing = store.dictionary_listing(meta, store.read_entries(spark, path))
    return listing.select("name", (F.col("priority") - low).alias("place"), "enabled", "n_entries")


@query("s12_evolve_schema", sql("""select id, "name", built_in and catalog_id = 'kanjium-pitch-accents' is true built_in, catalog_id from (
 select id, "name", built_in, case when id % 10 = 0 then 'kanjium-pitch-accents' else catalog_id end catalog_id from installed)""", "installed"))
def evolve_schema(spark, d):
    old = _installed(spark, d).withColumn("catalog_id", F.when(F.col("id") % 10 == 0, "kanjium-pitch-accents").otherwise(F.col("catalog_id")))
    return store.evolve_schema(old).select("id", "name", "built_in", "catalog_id")


@query("s13_line_dataset", sql("select 'ocr_line_' || page_id || '_' || line_idx \"name\", page_id, line_idx, text from lines", "lines"))
def line_dataset(spark, d):
    path = scratch_dir(spark, "line-dataset")
    store.export_line_dataset(inputs.lines(spark, d), path)
    return spark.read.parquet(path).drop("bucket")


@query("s13_corrected_dataset", sql("""select 'ocr_line_' || page_id || '_' || line_idx "name", page_id, line_idx,
 case when fixed is null then text else array_to_string(list_transform(string_split(text, ''), lambda x, i: coalesce(fixed[i - 1], x)), '') end as text
from lines left join (select page_id, line_idx, map_from_entries(list({'k': idx, 'v': ch})) fixed from (
 select page_id, line_idx, idx, max_by(ch, version) ch from (select conv_id page_id, turn line_idx, k * (turn + 3) idx, k * 7 % 5 version, ['甲','乙','丙'][k % 3 + 1] ch
  from (select conv_id, turn, unnest([1, 2, 3, 4, 6, 9, 400]) k from conversations where conv_id % 3 = 0) union all
  select conv_id, turn, turn + 3, 9, '丁' from conversations where conv_id % 3 = 0) group by all) group by page_id, line_idx) c using (page_id, line_idx)""", "lines"))
def corrected_dataset(spark, d):
    path = scratch_dir(spark, "line-dataset")
    store.export_line_dataset(inputs.lines(spark, d), path)
    # the pages of every third conversation are corrected, in two rounds, the second with the later versions
    c = inputs.table(spark, d, "conversations").filter("conv_id % 3 = 0").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_idx"))
    k = F.col("k")
    some = c.withColumn("k", F.explode(F.array(*map(F.lit, [1, 2, 3, 4, 6, 9, 400])))).select(
        "page_id", "line_idx", (k * (F.col("line_idx") + 3)).alias("idx"), (k * 7 % 5).alias("version"), F.get(F.array(*map(F.lit, "甲乙丙")), k % 3).alias("ch")
    )
    last = c.select("page_id", "line_idx", (F.col("line_idx") + 3).alias("idx"), F.lit(9).alias("version"), F.lit("丁").alias("ch"))
    store.correct_line_dataset(spark, path, some)
    store.correct_line_dataset(spark, path, last)
    return spark.read.parquet(path).drop("bucket")


# -- evaluation -----------------------------------------------------------------------


@query("e01_parity_report", sql("""select l_orderkey % 50 case_id, count(case when g and w then 1 end) n_compared,
 count(case when g and w and (bad_flag or abs(gx - wx) > 2 or abs(gr - wr) / greatest(abs(wr), 1e-12) > 1e-4) then 1 end) n_bad,
 count(case when not g then 1 end) n_missing, count(case when not w then 1 end) n_extra,
 max(case when g and w then abs(gx - wx) end) worst_x, round(max(case when g and w then abs(gr - wr) / greatest(abs(wr), 1e-12) end), 9) worst_r
from (select l_orderkey, l_partkey % 10 > 0 g, l_partkey % 11 > 0 w, l_partkey % 13 = 0 bad_flag, l_quantity gx, l_quantity + l_suppkey % 4 wx,
  l_extendedprice gr, l_extendedprice * (1 + (l_partkey % 3) * 0.00009) wr from lineitem) where g or w group by case_id"""))
def parity_report(spark, d):
    li = inputs.table(spark, d, "lineitem").withColumns({"case_id": F.col("l_orderkey") % 50})
    keys = ["case_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    got = li.filter("l_partkey % 10 > 0").select(*keys, F.lit("a").alias("s"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("r"))
    want = li.filter("l_partkey % 11 > 0").select(
        *keys, F.when(F.col("l_partkey") % 13 == 0, "b").otherwise("a").alias("s"), (F.col("l_quantity") + F.col("l_suppkey") % 4).alias("x"),
        (F.col("l_extendedprice") * (1 + (F.col("l_partkey") % 3) * 0.00009)).alias("r"),
    )
    out = evaluate.parity_report(got, want, keys, exact=("s",), within={"x": 2.0}, relative=("r",))
    return out.withColumn("worst_r", F.round("worst_r", 9))


@query("e02_placement_metrics", sql("""select case_id, count(*) n, round(avg(err), 6) centre_err_mean, round(quantile_cont(err, 0.9), 6) centre_err_p90,
 round(avg(case when tm between lo - 0.5 and hi + 0.5 then 1.0 else 0.0 end), 6) cover_rate, round(avg(case when m between tlo - 0.5 and thi + 0.5 then 1.0 else 0.0 end), 6) tap_rate,
 round(avg((hi - lo) - (thi - tlo)), 6) width_delta_mean
from (select *, (lo + hi) / 2 m, (tlo + thi) / 2 tm, abs((lo + hi) / 2 - (tlo + thi) / 2) err from (
 select user_id % 20 case_id, value lo, value + 12 hi, value + event_id % 17 - 8 tlo, value + event_id % 17 - 8 + event_id % 13 thi from events) where thi > tlo) group by case_id"""))
def placement_metrics(spark, d):
    e = inputs.table(spark, d, "events").withColumn("case_id", F.col("user_id") % 20)
    keys = ["case_id", "event_id"]
    boxes = e.select(*keys, F.col("value").alias("lo"), (F.col("value") + 12).alias("hi"))
    true_lo = F.col("value") + F.col("event_id") % 17 - 8
    gold = e.select(*keys, true_lo.alias("true_lo"), (true_lo + F.col("event_id") % 13).alias("true_hi"))
    out = evaluate.placement_metrics(boxes, gold, keys)
    return out.select("case_id", "n", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("case_id", "n")])


# -- streams ----------------------------------------------------------------------------


def _stream(rows, path, *keys):
    """``rows`` landed in five files and streamed one file per batch."""
    rows.repartition(5, *keys).write.parquet(f"{path}/landing")
    spark = rows.sparkSession
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/landing")


@query("t01_stream_lines", sql("""select page_id, count(*) n_chars, max(gidx) last_gidx from (
 select page_id, unnest(range(0, length(t))) gidx from (select page_id, string_agg(text || 'き', '' order by line_idx) t from lines group by page_id)) group by page_id""", "lines"))
def stream_lines(spark, d):
    path = scratch_dir(spark, "line-stream")
    conv = inputs.table(spark, d, "conversations")
    kana = F.translate(F.lower("text"), inputs.LETTERS + " .,", inputs.KANA + "　。、")
    rows = conv.select(
        F.col("conv_id").alias("page_id"), F.col("turn").alias("line_idx"), F.explode(F.array(F.lit(2), F.lit(1))).alias("version"), kana.alias("k"),
        (F.col("turn") % 2 == 1).alias("is_vertical"),
    ).withColumn("text", F.concat("k", F.when(F.col("version") == 2, "き").otherwise("ああ"))).drop("k")
    # a line's two versions arrive in different batches, the older one often later
    jobs.stream_line_results(_stream(rows, path, "page_id", "line_idx", "version"), f"{path}/store", f"{path}/checkpoint")
    chars = jobs.current_chars(spark, f"{path}/store")
    return chars.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_chars"), F.max("gidx").alias("last_gidx"))


@query("t02_stream_banks", sql("""select archive, count(distinct bank_ord) n_banks, count(case when length(w) % 6 in (2, 3, 4) then 1 end) n_entries from bank_rows group by archive""", "bank_rows"))
def stream_banks(spark, d):
    path = scratch_dir(spark, "bank-stream")
    _documents(spark, d, "term").write.parquet(f"{path}/landing")
    docs = spark.read.parquet(f"{path}/landing")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/landing")
    jobs.stream_banks(stream, f"{path}/store", f"{path}/checkpoint")
    report = spark.read.parquet(f"{path}/store/report")
    return report.groupBy("archive").agg(F.count(F.lit(1)).alias("n_banks"), F.sum("n_entries").alias("n_entries"))


@query("t02_published_dictionaries", sql("""select archive title, count(distinct bank_ord) n_banks, count(case when length(w) % 6 in (2, 3, 4) then 1 end) n_entries, 1 n_rows from bank_rows group by archive""", "bank_rows"))
def published_dictionaries(spark, d):
    path = scratch_dir(spark, "library-stream")
    docs = _documents(spark, d, "term")
    total = docs.groupBy("archive").agg(F.count(F.lit(1)).alias("banks"))
    docs = docs.join(total, "archive")
    # banks of all archives land mixed, and a quarter of them twice
    twice = docs.withColumn("landing", F.explode(F.when(F.xxhash64("name") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    twice.repartition(8, F.xxhash64("name", "landing")).drop("landing").write.parquet(f"{path}/landing")
    landing = spark.read.parquet(f"{path}/landing")
    stream = spark.readStream.schema(landing.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/landing")
    jobs.stream_banks(stream, f"{path}/store", f"{path}/checkpoint", library=f"{path}/library")
    meta, entries = store.read_meta(spark, f"{path}/library"), store.read_entries(spark, f"{path}/library")
    counts = entries.groupBy("dictionary_id").agg(F.count(F.lit(1)).alias("n_entries"))
    listed = meta.join(counts, meta["id"] == counts["dictionary_id"]).groupBy(F.col("name").alias("title")).agg(
        F.sum("n_entries").alias("n_entries"), F.count(F.lit(1)).alias("n_rows"))
    return listed.join(total.withColumnRenamed("archive", "title"), "title").select("title", F.col("banks").alias("n_banks"), "n_entries", "n_rows")


@query("t03_stream_ngrams", sql("select ngram, n, cnt from ngrams", "ngrams"))
def stream_ngrams(spark, d):
    path = scratch_dir(spark, "ngram-stream")
    docs = inputs.table(spark, d, "documents").select("doc_id", F.translate(F.lower("text"), inputs.LETTERS, inputs.KANA).alias("text"))
    jobs.stream_ngrams(_stream(docs, path, "doc_id").select("text"), f"{path}/store", f"{path}/checkpoint")
    return jobs.published_ngrams(spark, f"{path}/store")


@query("l15_conversation_coverage")
def conversation_coverage(spark, d):
    """The whole of ``conversations``; SQL is too slow on it."""
    return results.page_coverage(inputs.lines(spark, d), inputs.entries(spark, d), inputs.meta(spark, d), inputs.rules(spark))
