import json

from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table
from kotonoha.session import scratch_dir
from kotonoha.sources import banks, store
from kotonoha.streaming import jobs

DOC = "archive string, title string, kind string, bank_ord bigint, name string, text string"


def test_term_rows(spark):
    nbsp = " "
    text = json.dumps([
        ["a", "b", "t", "r"], [1, "b", "t", "r", 0], ["a", "b", f"x{nbsp}y z", ["v1", 5, "vt"], "7", ['q"z', {"b": 1, "a": 2}], 0, ""],
        ["c", "", None, "", 3, "bare", 0, ["p", "q"]], ["d", "e", "", "", 2.0],
    ])
    docs = spark.createDataFrame([("z", "z", "term", 0, "term_bank_1.json", text), ("z", "z", "term", 1, "term_bank_2.json", "{oops")], DOC)
    rows = banks.ingest_term_banks(docs).orderBy("id").collect()
    assert [(r.kanji, r.rules, r.popularity, r.definitions) for r in rows] == [
        ("a", f"x{nbsp}y z | v1 vt", 0, '["q\\"z",{"b":1,"a":2}]'), ("c", " |  | p q", 3, '"bare"'), ("d", " | ", 0, ""),
    ]
    assert [r.bank_ord for r in banks.malformed_documents(docs).collect()] == [1]


def test_bank_names(spark):
    names = ["term_bank_12.json", "kanji_bank_x.json", "term_meta_bank_3.json", "tag_bank_1.json", "index.json", "term_bank_1.txt"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(banks.bank_kind(F.col("n")).alias("k"), banks.bank_number(F.col("n")).alias("b"))
    assert [(r.k, r.b) for r in df.collect()] == [("term", 12), ("kanji", 0), ("term_meta", 3), ("tag", 1), (None, 0), (None, 0)]


def test_revised_lines_in_any_order(spark):
    path = scratch_dir(spark, "t01")
    schema = "page_id long, line_idx long, version int, text string, is_vertical boolean"
    final = {(1, 0): "ab", (1, 1): "c", (2, 0): "zz"}
    batches = [[(1, 1, 1, "c", False), (1, 0, 1, "a", False)], [(2, 0, 3, "zz", False), (1, 0, 2, "ab", False)], [(2, 0, 1, "old", False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{path}/in")
        jobs.stream_line_results(stream, f"{path}/store", f"{path}/checkpoint")
    lines = {(r.page_id, r.line_idx): r.text for r in jobs.current_lines(spark, f"{path}/store").collect()}
    assert lines == final
    chars = jobs.current_chars(spark, f"{path}/store").orderBy("page_id", "gidx").collect()
    assert [(r.page_id, r.gidx, r.ch) for r in chars] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z"), (2, 1, "z")]


def test_listing_skips_own_samples(spark):
    df = spark.createDataFrame([("/a/x.PNG",), ("/a/ocr_line_1.png",), ("/a/y.txt",), ("/a/png",)], "path string")
    assert [r.path for r in store.list_inputs(df).collect()] == ["/a/x.PNG"]


def test_moves_and_old_meta(spark):
    meta = small_table(spark, [(1, "a", 0, True), (2, "b", 5, True), (3, "c", 9, True)], "id bigint, name string, priority int, enabled boolean")
    up = {r.id: r.priority for r in store.move_dictionary(meta, 2, True).collect()}
    assert up == {1: 5, 2: 0, 3: 9}
    assert {r.id: r.priority for r in store.move_dictionary(meta, 1, True).collect()} == {1: 0, 2: 5, 3: 9}
    assert store.evolve_schema(meta).filter("built_in or catalog_id is not null").count() == 0


def test_rule_files(spark, tmp_path):
    import json

    from kotonoha.functions.tables import small_table
    from kotonoha.plans import inputs
    from kotonoha.sources import rules

    rule = lambda a, b, out, **more: {"kanaIn": a, "kanaOut": b, "rulesIn": [], "rulesOut": out, **more}
    (tmp_path / "keyed.json").write_text(json.dumps({"past": [rule("た", "る", ["v1"]), rule("んだ", "む", ["v5"])], "adv": [rule("く", "い", ["adj-i"], reason="other")]}, ensure_ascii=False))
    (tmp_path / "plain.json").write_text(json.dumps([rule("ます", "る", ["v1"], reason="polite"), rule("た", "る", [])], ensure_ascii=False))
    get = lambda name: [(r.group_ord, r.rule_ord, r.suffix_in, r.suffix_out, r.reason, list(r.types)) for r in rules.load_rules(spark, str(tmp_path / name)).orderBy("group_ord", "rule_ord").collect()]
    assert get("keyed.json") == [(0, 0, "た", "る", "past", ["v1"]), (0, 1, "んだ", "む", "past", ["v5"]), (1, 0, "く", "い", "adv", ["adj-i"])]
    assert rules.load_rules(spark, str(tmp_path / "plain.json")).dtypes == small_table(spark, inputs.RULES, inputs.RULES_SCHEMA).dtypes
    assert get("plain.json") == [(0, 0, "ます", "る", "polite", ["v1"]), (0, 1, "た", "る", "", [])]
