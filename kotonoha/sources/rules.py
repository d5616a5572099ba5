"""Deinflection rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RULE = "struct<kanaIn:string,kanaOut:string,rulesIn:array<string>,rulesOut:array<string>,reason:string>"


def parse_rules(files: DataFrame) -> DataFrame:
    """``(group_ord, rule_ord, suffix_in, suffix_out, types, reason)`` of rule files, ``files(value)`` with one whole file per row.

    A file is an array of rules, which may name their reason, or an object of arrays keyed by reason.  Groups keep the
    order of the file; an array is one group.  A file that is neither fails the job.
    """
    text = F.trim("value")
    as_list = F.when(text.startswith("["), F.from_json(text, f"array<{_RULE}>", {"mode": "FAILFAST"}))
    as_map = F.when(text.startswith("{"), F.from_json(text, f"map<string,array<{_RULE}>>", {"mode": "FAILFAST"}))
    keys = F.when(text.startswith("{"), F.json_object_keys(text))
    named = F.transform(keys, lambda k: F.struct(k.alias("reason"), F.element_at(as_map, k).alias("rules")))
    single = F.when(as_list.isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("reason"), as_list.alias("rules"))))
    neither = F.raise_error(F.lit("a rule file holds a JSON array or object")).cast(f"array<struct<reason:string,rules:array<{_RULE}>>>")
    groups = files.select(F.posexplode(F.coalesce(single, named, neither)).alias("group_ord", "g"))
    rules = groups.select("group_ord", F.col("g.reason").alias("_reason"), F.posexplode("g.rules").alias("rule_ord", "r"))
    return rules.select(
        "group_ord", "rule_ord", F.coalesce("r.kanaIn", F.lit("")).alias("suffix_in"), F.coalesce("r.kanaOut", F.lit("")).alias("suffix_out"),
        F.coalesce("r.rulesOut", F.array().cast("array<string>")).alias("types"), F.coalesce("_reason", "r.reason", F.lit("")).alias("reason"),
    ).filter("suffix_in <> ''")


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    return parse_rules(spark.read.text(path, wholetext=True))
