"""Operator inputs derived from the given tables.

Each input has a Spark form here and, in ``oracle.py``, the same recipe in SQL
for checking.  All of them read whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table, written

LETTERS = "abcdefghijklmnopqrstuvwxyz"
KANA = "かきくけこさしすせそたちつてとなにぬねのはひふへほま"
# one character of every kind the key stages treat specially
MIXED = "ｶﾞﾊﾟかゝゞはーヽヾつやうふひぢたきガⅧ來ゐへＡ"
# vowels to kana, consonants to ideographs
RUBY_TERM = "か亜唖娃き阿哀愛く挨姶逢葵茜こ穐悪握渥旭け葦芦鯵さ梓"
RUBY_READING = "かきくけきしすせくそかちつてこときにぬねけはひふさま"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kana(col: Column) -> Column:
    return F.translate(col, LETTERS, KANA)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word occurrence of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")
    ).filter("w <> ''")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words with their counts.  Written once: a filter on what follows from a word would otherwise be pushed
    below the count and work on every occurrence, and each use would count the corpus again."""
    return written(words(spark, sf_dir).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "word-counts")


def kana_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(spark, sf_dir).select(kana(F.col("w")).alias("surface"), "n", "w")


def mixed_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(spark, sf_dir).select(F.translate("w", LETTERS, MIXED).alias("surface"), "n", "w")


def word_id(col: Column) -> Column:
    return F.conv(F.substring(F.md5(col), 1, 15), 16, 10).cast("bigint")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(page_id, line_idx, text, is_vertical)``: turns as lines of a page."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select(
        F.col("conv_id").alias("page_id"),
        F.col("turn").alias("line_idx"),
        F.translate(F.lower("text"), LETTERS + " .,", KANA + "　。、").alias("text"),
        (F.col("turn") % 2 == 1).alias("is_vertical"),
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of the corpus' own words, popularity by frequency."""
    w, size = F.col("w"), F.length("w")
    return word_counts(spark, sf_dir).select(
        word_id(w).alias("id"),
        kana(w).alias("kanji"),
        kana(F.substr(w, F.lit(1), F.greatest(F.lit(1), size - 1))).alias("reading"),
        F.concat(
            F.lit("n | "),
            F.when(w.like("%s"), "v5").when(w.like("%e"), "v1 vt").otherwise("adj"),
        ).alias("rules"),
        F.col("n").cast("int").alias("popularity"),
        (size % 5).cast("bigint").alias("dictionary_id"),
        F.when(size % 7 == 0, kana(F.substring("w", 1, 2))).alias("onyomi"),
        F.lit(None).cast("string").alias("kunyomi"),
        F.when(size % 3 == 0, (size % 5).cast("string")).alias("jlpt"),
        "w",
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary dimension: one row per region; one of them is disabled."""
    region = table(spark, sf_dir, "region")
    key = F.col("r_regionkey")
    return region.select(
        key.cast("bigint").alias("id"),
        F.col("r_name").alias("name"),
        ((key * 3) % 5).cast("int").alias("priority"),
        (key != 3).alias("enabled"),
        (key == 1).alias("built_in"),
        F.when(key % 2 == 0, F.concat(F.lit("cat-"), key.cast("string"))).alias("catalog_id"),
    )


# group_ord, rule_ord, suffix_in, suffix_out, types, reason
RULES = [
    (0, 0, "こけ", "", ["v5"], "past"),
    (0, 1, "こけ", "こ", ["v1"], "past"),
    (1, 0, "せてし", "", ["v5"], "-te"),
    (1, 1, "せてし", "こ", ["v1"], "-te"),
    (2, 0, "ね", "", [], "plural"),
    (3, 0, "こぬ", "こ", ["v1"], "agent"),
    (3, 1, "こぬ", "", ["n", "adj"], "agent"),
    (4, 0, "のせとて", "のこ", ["v1"], "noun"),
    (5, 0, "こね", "こ", ["v5"], "third"),
    (6, 0, "か", "き", ["v5"], ""),
    (7, 0, "きてけ", "かて", ["adj"], "long"),
]
RULES_SCHEMA = (
    "group_ord int, rule_ord int, suffix_in string, suffix_out string, types array<string>, reason string"
)


def rules(spark: SparkSession) -> DataFrame:
    return small_table(spark, RULES, RULES_SCHEMA)


def benchmark_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as pages, their paragraphs as lines."""
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_idx", "raw")
    ).select(
        "page_id", "line_idx", F.translate(F.lower("raw"), LETTERS + " .,", KANA + "　。、").alias("text")
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages, their paragraphs as lines; words are set off by commas, as running Japanese has no spaces."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_idx", "raw")
    ).select("page_id", "line_idx", F.translate(F.lower("raw"), LETTERS + " .,", KANA + "、。、").alias("text"))


def talk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines; words are set off by commas, and a comma of the text is a space that a match may run across."""
    conv = table(spark, sf_dir, "conversations")
    text = F.translate(F.replace(F.lower("text"), F.lit(", "), F.lit("　")), LETTERS + " .", KANA + "、。")
    return conv.select(F.col("conv_id").alias("page_id"), F.col("turn").alias("line_idx"), text.alias("text"))


def benchmark_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(
        F.col("item_id").alias("query_id"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")
    ).filter("w <> ''").select("query_id", kana(F.col("w")).alias("term")).distinct()


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timesteps: the events of a user in time order; class 0 is the blank."""
    from kotonoha.operators import ordered

    e = table(spark, sf_dir, "events")
    cls = (
        F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "view", 1)
        .when(F.col("event_type") == "click", 2).when(F.col("event_type") == "signup", 3).otherwise(4)
    )
    rows = e.select(F.col("user_id").alias("line_id"), "ts", "event_id", cls.alias("cls"), F.col("value").alias("score"))
    day = F.to_date("ts")
    return ordered.ranked(rows, ["line_id"], day, [F.col("ts"), F.col("event_id")], "t").select("line_id", "t", "cls", "score")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scored classes per timestep."""
    s = event_steps(spark, sf_dir)
    return s.select("line_id", "t", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"), "cls", "score").select(
        "line_id", "t", ((F.col("cls") + F.col("k")) % 5).alias("cls"), (F.col("score") - F.col("k") * 2).alias("score")
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class tokens; one class has none."""
    r = table(spark, sf_dir, "region")
    return r.filter("r_regionkey <> 2").select(
        F.col("r_regionkey").alias("idx"), F.translate(F.right("r_name", F.lit(2)), "ACESIPT", "てかきくけこ…").alias("token")
    )


def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region")
    return r.filter("r_regionkey = 4").select(F.col("r_regionkey").alias("pruned"), F.lit(18709).alias("cls"))


def page_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page: the items of an order."""
    from kotonoha.operators import ordered

    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        F.col("l_orderkey").alias("page_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"
    )
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")]
    if ordered.largest_group(rows, ["page_id"]) <= ordered.BLOCK:
        # one shuffle by page, which what follows by page can use
        place = F.row_number().over(Window.partitionBy("page_id").orderBy(*order))
        rows = rows.withColumn("box_idx", (place - 1).cast("long"))
    else:
        rows = ordered.ranked(rows, ["page_id"], F.col("l_linenumber"), order, "box_idx")
    q = F.floor("l_quantity")
    return rows.select(
        "page_id", "box_idx",
        (F.col("l_partkey") % 900).cast("int").alias("x"),
        ((F.col("l_suppkey") * 37 + F.col("l_partkey")) % 1300).cast("int").alias("y"),
        F.when(q % 5 == 0, 12 + q % 30).otherwise(10 + q * 8).cast("int").alias("w"),
        F.when(q % 7 == 0, 300 + q * 4).otherwise(10 + (F.col("l_partkey") * 7) % 60).cast("int").alias("h"),
    )


def page_sizes(boxes: DataFrame) -> DataFrame:
    return boxes.select("page_id").distinct().withColumns({"img_w": F.lit(1000), "img_h": F.lit(1400)})
