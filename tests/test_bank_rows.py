"""Rows of banks are parsed once, whatever is filtered on them."""

from kotonoha.sources import banks


def test_rows_are_parsed_once_and_types_kept(spark):
    text = '[["a","r","n","v5",3,["x",1]],["b",5,"n","v1",1,"g"],{"not":"a row"},7,null,["c","","n",["v5",2,"vi"],2.5,null,1,["p","q"]],["d","r"]]'
    docs = spark.createDataFrame([("z", "term", 1, text), ("z", "term", 2, "[}"), ("z", "term", 3, "[]")], "archive string, kind string, bank_ord long, text string")
    got = banks.ingest_term_banks(docs)
    want = [("a", "r", '["x",1]', "n | v5", 3), ("c", "", "null", "n | v5 vi | p q", 0)]
    assert sorted(map(tuple, got.select("kanji", "reading", "definitions", "rules", "popularity").collect())) == want
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
