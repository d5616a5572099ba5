"""The corpus pipeline: documents to packed sequences.

``STAGES`` lists named stages.  Each takes ``(spark, docs, sf_dir)`` and returns the rows it keeps of all that its
predecessor kept, with the columns of ``documents``; the last returns the pieces of packed sequences.  ``run`` writes each
stage as Parquet to the shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.llm import decontaminate, jaccard_join, language, packing, quality
from kotonoha.llm.registry import table
from kotonoha.session import ship_package

#: Not SQL: the stages learn models, hash and tokenize.  Tested against brute-force versions of each stage.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of all labelled ones scores 0.5 or more."""
    ship_package(spark)
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: with a letter, and without near ties of the languages."""
    ship_package(spark)
    return language.keep_known(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by links, the one of smallest id; of repeated rows of one id one (of the smallest text hash).

    Documents without shingles and rows without an id are not linked and stay.
    """
    ship_package(spark)
    linked = jaccard_join.join(docs)
    gone = written(linked.filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    repeated = written(repeated, "repeated")
    many = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    one = many.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.xxhash64("text"), "text")).alias("row"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(one.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    ship_package(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def cost_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids."""
    ship_package(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", cost_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
