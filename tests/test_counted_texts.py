"""Windows of texts are counted in tasks, not shuffled a character each."""

import random
from collections import Counter

from pyspark.sql import functions as F

from kotonoha.operators import ngram


def _plain(texts, order):
    return Counter(t[max(0, i - order + 1) : i + 1] for t in texts for i in range(len(t)))


def test_windows_equal_a_plain_count():
    rng = random.Random(3)
    alphabets = ["ab ", "かき𠮟\u0000﷐", "".join(map(chr, range(0x3041, 0x9000)))]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 60))) for _ in range(300)]
    for order in (1, 2, 4):
        got = ngram._counted(texts, order).to_pydict()
        assert len(set(got["window"])) == len(got["window"])
        assert dict(zip(got["window"], got["n"])) == _plain(texts, order)


def test_many_occurrences_are_few_rows(spark):
    texts = spark.range(0, 2000, 1, 2).select(F.concat(F.repeat(F.lit("かきく "), 50), F.col("id").cast("string")).alias("text"))
    assert ngram.text_windows(texts).count() < 10_000
    counts = {r.ngram: r.cnt for r in ngram.raw_ngram_counts(texts).filter("length(ngram) = 4").collect()}
    assert counts["かきく "] == 100_000 and counts["く かき"] == 98_000
    assert ngram.raw_ngram_counts(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0
