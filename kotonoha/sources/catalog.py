"""The dictionary catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx


def audit_catalog(entries: DataFrame, schema: int = fx.CATALOG_SCHEMA) -> DataFrame:
    """Every violation, one row each: ``(id, problem)``."""
    repeats = entries.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "id", F.lit("duplicate id").alias("problem")
    )
    rules = {
        "bytes must be positive": F.col("bytes") == 0,
        "invalid sha256": ~F.col("sha256").rlike("^[0-9a-f]{64}$"),
        "url is not https": ~F.col("url").startswith("https://"),
        "url points at latest": F.contains("url", F.lit("/releases/latest/")),
    }
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    per_entry = entries.select("id", F.explode(found).alias("problem"))
    none = F.lit(None).cast("string")
    empty = entries.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(none.alias("id"), F.lit("lists no dictionaries").alias("problem"))
    out = repeats.unionByName(per_entry).unionByName(empty)
    if schema != fx.CATALOG_SCHEMA:
        wrong = entries.sparkSession.range(1).select(none.alias("id"), F.lit(f"schema {schema} is not supported").alias("problem"))
        out = out.unionByName(wrong)
    return out


def verify_files(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Size and SHA-256 of landed files (``name, content``) against their pins."""
    d = files.select("name", F.length("content").cast("bigint").alias("got_bytes"), F.sha2("content", 256).alias("got_sha"))
    d = d.join(pins.select("name", "bytes", "sha256"), "name", "left")
    size, digest = F.col("got_bytes") == F.col("bytes"), F.col("got_sha") == F.col("sha256")
    verdict = (
        F.when(F.col("bytes").isNull(), "not pinned").when(~size, "size mismatch").when(~digest, "sha256 mismatch").otherwise("ok")
    )
    return d.select("name", F.coalesce(size, F.lit(False)).alias("size_ok"), F.coalesce(digest, F.lit(False)).alias("sha_ok"), verdict.alias("verdict"))


def base_title(name: Column) -> Column:
    """A title without its bracketed revision."""
    trimmed = F.trim(name)
    cut = F.instr(trimmed, " [")
    return F.when(cut > 1, F.trim(F.left(trimmed, cut - 1))).otherwise(trimmed)


def match_installed(meta: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalogue id of each installed dictionary: an exact
    ``catalog_id`` first, else the first entry of the title's family.

    ``catalog(file_order, id, title)``.
    """
    exact = catalog.select(F.col("id").alias("_exact")).distinct()
    family = catalog.groupBy(F.trim("title").alias("_family")).agg(F.min_by("id", "file_order").alias("_by_title"))
    d = meta.withColumn("_family", base_title(F.col("name")))
    d = d.join(exact, F.col("catalog_id") == F.col("_exact"), "left").join(family, "_family", "left")
    return d.select("id", "name", F.coalesce("_exact", "_by_title").alias("matched_id"))


def bundled_install_needed(meta: DataFrame, specs: DataFrame) -> DataFrame:
    """Per bundled ``(id, family)`` whether it has to be installed: nothing
    of its family is there, or only own rows that were never completed."""
    rows = meta.select(base_title(F.col("name")).alias("_family"), "built_in", F.col("catalog_id").alias("_cid"))
    spec = specs.select("id", F.trim("family").alias("_family"))
    d = spec.join(rows, "_family", "left").groupBy("id").agg(
        F.bool_or(F.coalesce(F.col("built_in"), F.lit(False))).alias("complete"),
        F.bool_or(F.col("built_in").isNotNull() & ~F.col("_cid").eqNullSafe(F.col("id"))).alias("foreign"),
    )
    return d.select("id", (~F.col("complete") & ~F.col("foreign")).alias("needed"))
