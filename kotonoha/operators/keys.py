"""Text-key jobs over tables of distinct surfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx

STAGES = (
    "raw", "normalised", "hiragana", "emphatic", "modernised",
    "modernised_hiragana", "sound", "sound_hiragana",
)


def with_key_stages(surfaces: DataFrame, surface: str = "surface") -> DataFrame:
    """Add ``norm``, ``modern`` and ``sound``, the three forms the rest derive from."""
    return (
        tx.with_normalised(surfaces, surface, "norm")
        .withColumn("modern", tx.modernise_orthography(F.col("norm")))
        .withColumn("_ha", tx.shift_ha_row(F.col("modern")))
        .withColumn("sound", tx.change_vowels(F.col("_ha")))
        .drop("_ha")
    )


def _keys(surface: Column) -> Column:
    return F.array(
        surface,
        F.col("norm"),
        tx.to_hiragana(F.col("norm")),
        tx.collapse_emphatic(F.col("norm")),
        F.col("modern"),
        tx.to_hiragana(F.col("modern")),
        F.col("sound"),
        tx.to_hiragana(F.col("sound")),
    )


def distinct_keys(surface: Column) -> Column:
    """Ordered, de-duplicated search keys; the first occurrence is kept."""
    return F.array_distinct(_keys(surface))


def key_list(surface: Column) -> Column:
    """As ``distinct_keys``, with the stage that produced each key first."""
    keys = _keys(surface)
    labelled = F.transform(
        keys, lambda key, i: F.struct(F.element_at(F.array(*map(F.lit, STAGES)), i + 1).alias("stage"), key.alias("key"))
    )
    return F.filter(labelled, lambda item, i: F.array_position(keys, item["key"]) == i + 1)


def search_keys(surfaces: DataFrame, surface: str = "surface") -> DataFrame:
    """One row per distinct surface and search key, in search order."""
    distinct = surfaces.select(surface).distinct()
    return with_key_stages(distinct, surface).select(
        surface, F.posexplode(key_list(F.col(surface))).alias("ord", "item")
    ).select(surface, "ord", "item.stage", "item.key")


def corpus_char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each character; counted map-side before the shuffle."""
    return (
        texts.select(F.explode(tx.chars_of(F.col(text))).alias("ch"))
        .groupBy("ch")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def derive_measured_fold(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """Keep a candidate pair only where the corpus supports its direction.

    The variant must occur, the canonical must be at least as frequent, the
    most frequent canonical of a variant wins, and no canonical may itself be
    a variant that folds.
    """
    variant = counts.select(F.col("ch").alias("variant"), F.col("cnt").alias("variant_cnt"))
    canonical = counts.select(F.col("ch").alias("canonical"), F.col("cnt").alias("canonical_cnt"))
    supported = (
        pairs.select("variant", "canonical").distinct()
        .join(variant, "variant")
        .join(canonical, "canonical")
        .filter((F.col("canonical_cnt") >= F.col("variant_cnt")) & (F.col("variant") != F.col("canonical")))
    )
    best = Window.partitionBy("variant").orderBy(F.desc("canonical_cnt"), "canonical")
    chosen = supported.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")
    keys = chosen.select(F.col("variant").alias("canonical"))
    return chosen.join(keys, "canonical", "left_anti").select(
        "variant", "canonical", "variant_cnt", "canonical_cnt"
    )


def fold_census(surfaces: DataFrame, surface: str = "surface") -> DataFrame:
    """Groups of distinct surfaces that share a normalised key."""
    s = F.col(surface)
    staged = (
        surfaces.select(surface).distinct()
        .withColumn("width", tx.convert_width(s))
        .withColumn("folded", tx.fold_variants(F.col("width")))
        .withColumn("norm", tx.compose_marks(F.col("folded")))
    )
    changed = lambda a, b: F.max((F.col(a) != F.col(b)).cast("int"))
    return (
        staged.groupBy("norm")
        .agg(
            F.count(F.lit(1)).alias("n_surfaces"),
            changed(surface, "width").alias("by_width"),
            changed("width", "folded").alias("by_fold"),
            changed("folded", "norm").alias("by_marks"),
            F.min(surface).alias("first_surface"),
            F.max(surface).alias("last_surface"),
        )
        .filter("n_surfaces > 1")
    )


def reading_index(kanji_entries: DataFrame) -> DataFrame:
    """Inverted index reading -> kanji, with counts."""
    listed = lambda col, kind: kanji_entries.select(
        "kanji", F.lit(kind).alias("kind"), F.explode(tx.split_readings(F.col(col))).alias("reading")
    )
    return (
        listed("onyomi", "on").unionByName(listed("kunyomi", "kun"))
        .groupBy("reading", "kind", "kanji")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def ruby_segments(term: Column, reading: Column) -> Column:
    """``array<struct<base, ruby>>``, NULL where the reading does not align."""
    hira = lambda c: F.translate(c, tx._KATAKANA, tx._HIRAGANA)
    norm = tx.to_hiragana(reading)
    runs = F.regexp_extract_all(term, F.lit(f"(?s)[{fx.KANJI_CLASS}]+|[^{fx.KANJI_CLASS}]+"), 0)
    steps = F.transform(
        runs, lambda run, i: F.struct(run.alias("run"), F.get(runs, i + 1).alias("following"))
    )
    empty = F.array().cast("array<struct<base:string,ruby:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"), empty.alias("segments"))

    def step(acc: Column, item: Column) -> Column:
        run, following, at = item["run"], item["following"], acc["at"]
        is_kanji = run.rlike(f"^[{fx.KANJI_CLASS}]")
        anchor = hira(F.substr(following, F.lit(1), F.lit(1)))
        found = F.locate_from(anchor, norm, at + 1) if hasattr(F, "locate_from") else F.call_function(
            "locate", anchor, norm, at + 1
        )
        end = (
            F.when(~is_kanji, at + F.length(run))
            .when(following.isNull(), F.length(reading))
            .otherwise(found - 1)
        )
        literal_ok = hira(run) == F.substr(norm, at + 1, F.length(run))
        ok = acc["ok"] & F.when(is_kanji, end > at).otherwise(literal_ok)
        ruby = F.when(is_kanji, F.substr(reading, at + 1, F.greatest(end - at, F.lit(0))))
        segment = F.struct(run.alias("base"), ruby.alias("ruby"))
        return F.struct(
            F.when(ok, end).otherwise(at).cast("int").alias("at"),
            F.coalesce(ok, F.lit(False)).alias("ok"),
            F.concat(acc["segments"], F.array(segment)).alias("segments"),
        )

    done = F.aggregate(steps, start, step)
    aligned = F.when(done["ok"] & (done["at"] == F.length(reading)), done["segments"])
    whole = F.array(F.struct(term.alias("base"), F.lit(None).cast("string").alias("ruby")))
    return (
        F.when((F.length(term) == 0) | (F.length(reading) == 0), F.lit(None))
        .when(term == reading, whole)
        .otherwise(aligned)
    )


def ruby_alignment(entries: DataFrame) -> DataFrame:
    """Entries with their aligned segments, one row per entry."""
    return entries.withColumn("segments", ruby_segments(F.col("kanji"), F.col("reading")))


def ruby_alignment_stats(entries: DataFrame) -> DataFrame:
    """Counts per (kanji run, ruby); entries that do not align are
    counted under a NULL run."""
    aligned = ruby_alignment(entries.select("kanji", "reading"))
    pieces = aligned.select(
        F.explode(
            F.when(F.col("segments").isNull(), F.array(F.struct(
                F.lit(None).cast("string").alias("base"), F.lit(None).cast("string").alias("ruby")
            ))).otherwise(F.filter("segments", lambda s: s["ruby"].isNotNull()))
        ).alias("piece")
    )
    return pieces.groupBy(F.col("piece.base").alias("base"), F.col("piece.ruby").alias("ruby")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accent_census(pitch_rows: DataFrame) -> DataFrame:
    """``(reading, position)`` rows counted by mora count and accent class."""
    shaped = pitch_rows.withColumn("morae", F.size(tx.morae(F.col("reading")))).filter("morae > 0")
    pattern = tx.pitch_pattern(F.col("morae"), F.col("position"))
    shaped = shaped.withColumn(
        "pattern", F.array_join(F.transform(pattern, lambda h: F.when(h, "H").otherwise("L")), "")
    ).withColumn("accent", tx.pitch_class(F.col("morae"), F.col("position")))
    return shaped.groupBy("morae", "accent", "pattern").agg(F.count(F.lit(1)).alias("n"))
