"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.llm import (
    conversation_repair,
    decontaminate,
    id_files,
    jaccard_join,
    language,
    language_model,
    license_scan,
    merkle,
    neighbours,
    packing,
    quality,
    url_reputation,
    warc,
)
from kotonoha.llm.oracles import CONVERSATION_ORACLE, JACCARD_ORACLE, LICENSE_ORACLE, MERKLE_ORACLE, URL_ORACLE, WARC_ORACLE
from kotonoha.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401

URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """A page shows the document whose number ends its path; its label is the page's outcome."""
    number = F.regexp_extract(url_reputation.path_of(F.col("url")), r"/(\d{1,18})(?:/|\.html)?$", 1)
    bad = labels.select(
        F.col("doc_id").alias("number"),
        F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull(), 0).alias("bad"),
    )
    return pages.select("page_id", F.when(number != "", number.cast("long")).alias("number")).join(bad, "number").select("page_id", "bad")


@query("op2_url_reputation", URL_ORACLE)
def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_reputation.judge(pages, page_outcomes(pages, table(spark, sf_dir, "labels")), URL_RULES)


@query("op8_cost_packing")
def op8_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_id_files")
def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.store_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def learned_from(docs: DataFrame, parts: int = 3) -> DataFrame:
    """The rows that are not held out."""
    return docs.filter(F.coalesce(quality.remainder(F.col("doc_id"), parts), F.lit(0)) != 1)


def held_out(parts: int = 3):
    return F.coalesce(quality.remainder(F.col("doc_id"), parts) == 1, F.lit(False))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, learned_from(table(spark, sf_dir, "labels")))
    return quality.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_language")
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.train(learned_from(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


@query("op6_kneser_ney")
def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model.train(learned_from(docs, 5))
    return language_model.score(docs, model).withColumn("held_out", held_out(5))


@query("op9_license_scan", LICENSE_ORACLE)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query("op4_stable_projections")
def op4_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors.filter(F.col("vec_id") % 20 == 0), neighbours.build(vectors, 20), 20)


@query("op1_decontamination")
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_jaccard_join", JACCARD_ORACLE)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


@query("op11_warc", WARC_ORACLE)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive(table(spark, sf_dir, "pages"))
    return found.select(
        F.col("page_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to")
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped (``kept`` is false), emptied, cut, repeated or given another role, by a hash of conversation and turn."""
    value = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(value["conv_id"], F.lit(":"), value["turn"]).cast("binary")) % 20
    rows = conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(value["role"]).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(value["text"], "[.!?]", "")).when(kind > 0, value["text"]).alias("text"),
        (kind > 0).alias("kept"), F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copy", "copies")


@query("op12_conversation_repair", CONVERSATION_ORACLE)
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(damaged(table(spark, sf_dir, "conversations")), F.col("kept"))


@query("op13_merkle_manifest", MERKLE_ORACLE)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = [F.col("n_chars") + 1 if c == "n_chars" else F.col(c) for c in columns]
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(table(spark, sf_dir, "documents"), columns, "lang", "doc_id", {"tampered": F.when(touched, merkle.leaf(changed))})
    found = merkle.verified(found.withColumn("start", F.coalesce("tampered", "leaf")), "start")
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
