"""License texts by diagonal voting.

Every rolling word k-gram of a document is hashed and joined to the positions
of the same grams in license templates.  A match at document word ``i`` and
template word ``p`` votes for the diagonal ``i - p``.  Neighbouring diagonals (a
word put in or left out moves the rest by one) are merged, and the merged span
counts if its matches cover enough of the template's words within a span not much
longer than the template.

Only DataFrame functions are used.  The templates are a short literal list and
are broadcast; grams meet them without a shuffle, and only votes are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The templates are broadcast, so their words are bounded.
MOST_TEMPLATE_WORDS = 100_000

#: Phrases that name a license wherever they stand.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Publicly known notices, as label and words.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
            "by the free software foundation either version 3 of the license or at your option any later version"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
]


def words_of(text: Column) -> Column:
    """Words after A-Z are lower-cased.  ``lower`` differs for one sign only that it turns into an ASCII letter, the Kelvin sign."""
    low = F.when(F.contains(text, F.lit("K")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other; documents without its last word are not searched."""
    parts = phrase.split()

    def stands(i: Column) -> Column:
        hit = F.get(words, i) == parts[0]
        for j, part in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + j) == part)
        return hit

    n = F.size(words) - len(parts)
    found = F.filter(F.sequence(F.lit(0), n), lambda i: F.coalesce(stands(i), F.lit(False)))
    return F.when((n >= 0) & F.array_contains(words, parts[-1]), found).otherwise(F.expr("cast(array() as array<int>)"))


def grams_of(words: Column, k: int) -> Column:
    """Hashes of the k-grams in order."""
    n = F.size(words) - k
    hashes = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= 0, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def spans(
    docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, k: int = 4, apart: int = 2, coverage: float = 0.8, stretch: float = 1.5
) -> DataFrame:
    """Verified spans in ``docs(doc_id, text_hash, text)``: template, label, words from ``first`` to ``last``, and ``covered``, the share of the template."""
    if sum(len(t.split()) for _, t in templates) > MOST_TEMPLATE_WORDS:
        raise ValueError("the templates are too long to broadcast")
    literal = [(i, label, text, len(text.split())) for i, (label, text) in enumerate(templates)]
    table = small_table(docs.sparkSession, literal, "template int, label string, template_text string, size int")
    table = table.withColumn("words", words_of(F.col("template_text")))
    grams = table.select("template", F.posexplode(grams_of(F.col("words"), k)).alias("p", "gram"))
    sizes = table.select("template", "label", "size")
    own = docs.select("doc_id", "text_hash", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    own = own.select("doc_id", "text_hash", F.posexplode(grams_of(F.col("words"), k)).alias("i", "gram"))
    key = ["doc_id", "text_hash", "template"]
    votes = own.join(F.broadcast(grams), "gram").groupBy(*key, (F.col("i") - F.col("p")).alias("diagonal")).agg(F.collect_set("p").alias("ps"))
    along = Window.partitionBy(*key).orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(along) <= apart, 0).otherwise(1)
    merged = (
        votes.withColumn("new", new).withColumn("cluster", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "cluster").agg(
            F.array_distinct(F.flatten(F.collect_list("ps"))).alias("ps"),
            F.min(F.col("diagonal") + F.array_min("ps")).alias("first"),
            F.max(F.col("diagonal") + F.array_max("ps") + (k - 1)).alias("last"),
        )
    )
    matched = F.size(F.array_distinct(F.flatten(F.transform("ps", lambda p: F.sequence(p, p + (k - 1))))))
    return (
        merged.join(F.broadcast(sizes), "template").withColumn("covered", matched / F.col("size"))
        .filter((F.col("covered") >= coverage) & (F.col("last") - F.col("first") + 1 <= stretch * F.col("size")))
        .select("doc_id", "text_hash", "template", "label", "first", "last", "covered")
    )


def scan(docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, **settings) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: words, base phrases with their places, and the labels of phrases and verified spans.

    ``score`` is the best share of a template that a verified span covers; 0.5 if there are phrases only, 0 without labels.

    - A null or empty text has no words and no labels.  Whole texts are scanned.
    - Repeated rows have the same result, one row each; a null ``doc_id`` is a document like others.
    - A template shorter than ``k`` words has no grams and is never found; equal spans of two templates both count.
    - An empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    found = spans(rows, templates, **settings).groupBy("doc_id", "text_hash").agg(
        F.collect_set("label").alias("found"), F.max("covered").alias("covered"),
        F.count("*").alias("n_spans"),
    )
    words = rows.select("doc_id", "text_hash", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    at = {phrase: places(F.col("words"), phrase) for phrase, _ in phrases}
    base = words.select(
        "doc_id", "text_hash", F.size("words").cast("long").alias("n_words"),
        F.array(*[F.struct(F.lit(label).alias("label"), at[phrase].alias("at")) for phrase, label in phrases]).alias("base"),
    ).select(
        "doc_id", "text_hash", "n_words", F.flatten(F.transform("base", lambda b: b["at"])).alias("at"),
        F.transform(F.filter("base", lambda b: F.size(b["at"]) > 0), lambda b: b["label"]).alias("base"),
    )
    joined = base.alias("b").join(found.alias("f"), F.expr("b.doc_id <=> f.doc_id and b.text_hash <=> f.text_hash"), "left")
    labels = F.concat("base", F.coalesce("found", F.expr("cast(array() as array<string>)")))
    return joined.select(
        F.col("b.doc_id").alias("doc_id"), "n_words", F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        _joined(F.col("base")).alias("base_labels"), _joined(labels).alias("labels"),
        F.coalesce("covered", F.when(F.size("base") > 0, 0.5), F.lit(0.0)).alias("score"),
    )
