"""Prefixes are counted without a row each."""

from pyspark.sql import functions as F

from kotonoha.operators import lookup


def _rows(d):
    return sorted(map(tuple, d.select("page_id", "length", "n", "n_distinct", "first_surface", "last_surface").collect()))


def test_counts_equal_those_of_expanded_prefixes(spark):
    lines = spark.createDataFrame(
        [(1, 0, "かきか　きかきくか"), (1, 1, "　　きくか𠮟か"), (1, 2, ""), (2, 0, "きき" * 9), (2, 3, "くき　"), (3, 0, "　")],
        "page_id long, line_idx long, text string",
    )
    wide = lookup.query_windows(lines, 4).filter(~F.col("cells").startswith("　"))
    want = _rows(lookup.prefix_expand(wide).groupBy("page_id", "length").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("surface").alias("n_distinct"), F.min("surface").alias("first_surface"), F.max("surface").alias("last_surface"),
    ))
    assert _rows(lookup.prefix_counts(lines, 4)) == want
    # page 2 is a large one
    assert _rows(lookup.prefix_counts(lines, 4, page_chars=18)) == want


def test_windows_are_shuffled_with_their_lines_only(spark):
    lines = spark.range(50).select(F.col("id").alias("page_id"), F.lit(0).cast("long").alias("line_idx"), F.lit("かきくけこ").alias("text"))
    plan = lookup.prefix_counts(lines, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(page_id" in plan
