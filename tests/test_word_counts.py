"""Words are counted once, and nothing that follows from a word works on its occurrences."""

from pyspark.sql import functions as F

from kotonoha.plans import inputs, model_queries, registry


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_words_stay_above_the_count(spark, sf_dir):
    counts = inputs.word_counts(spark, sf_dir)
    assert "Generate" not in _plan(counts.filter(F.length(inputs.kana(F.col("w"))) > 3))
    assert "Generate" not in _plan(model_queries._variant_lines(spark, sf_dir).filter("line like 'a%'"))
    words = inputs.words(spark, sf_dir)
    assert counts.agg(F.sum("n")).first()[0] == words.count()
    assert counts.count() == words.select("w").distinct().count()


def test_the_corpus_is_not_read_by_the_drift_guard_itself(spark, sf_dir):
    assert "documents.parquet" not in "".join(registry.QUERIES["e03_drift_guard"](spark, sf_dir).inputFiles())
