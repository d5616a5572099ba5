"""Exploded sides of joins are never broadcast, whatever Spark takes their size for."""

from kotonoha.operators import evidence, lookup
from kotonoha.plans import all_queries
from pyspark.sql import functions as F


def hints(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge")


def test_positions_and_scores_are_dealt_out(spark, sf_dir):
    assert hints(all_queries.QUERIES["l01_coordinates"](spark, sf_dir)) == 1
    assert hints(all_queries.QUERIES["l16_matched_surface"](spark, sf_dir)) == 1
    for name in ("d14_size_pair_policy", "d14_declined_report"):
        assert hints(all_queries.QUERIES[name](spark, sf_dir)) >= 3


def test_scores_that_cover_a_batch_twice_leave_it_out(spark):
    asked = spark.createDataFrame([(1, 0, 0, "つ", False), (2, 0, 0, "っ", True)], "page_id long, line_idx int, idx int, ch string, is_small boolean")
    given = spark.createDataFrame([(1, 0, 0, -9.0), (2, 0, 0, 9.0), (2, 0, 1, 9.0)], "page_id long, line_idx int, idx int, logit double")
    got = evidence.size_pair_policy(asked, given, ["page_id", "line_idx"], ["page_id"])
    assert [(r["page_id"], r["to"]) for r in got.collect()] == [(1, "っ")]


def test_repeated_requests_are_answered_once_each(spark):
    lines = spark.createDataFrame([(1, 0, "かきく"), (1, 1, "けこ")], "page_id long, line_idx int, text string")
    asked = spark.createDataFrame([(1, 1, 2), (1, 1, 2), (1, 1, 4), (1, 3, 1)], "page_id long, gidx long, term_len int")
    got = lookup.matched_surface(lines, asked, 8).select("gidx", "term_len", "matched").collect()
    assert sorted(map(tuple, got)) == [(1, 2, "きく"), (1, 2, "きく"), (1, 4, "きくけこ"), (3, 1, "け")]
    at = lookup.coordinates(lines, asked.withColumn("n", F.lit(7))).filter("gidx = 3").collect()
    assert [(r["line_idx"], r["char_idx"], r["n"]) for r in at] == [(1, 0, 7)]
