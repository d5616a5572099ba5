"""Evaluation jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.operators import ordered

REL_TOLERANCE = 1e-4


def parity_report(
    got: DataFrame,
    want: DataFrame,
    keys: list[str],
    exact: tuple[str, ...] = (),
    within: dict[str, float] | None = None,
    relative: tuple[str, ...] = (),
    case: str = "case_id",
) -> DataFrame:
    """Expected against actual, per case.

    ``exact`` columns must be equal, ``within`` columns differ by at most their
    absolute tolerance, ``relative`` columns by 1e-4 of the expected value.
    """
    within = within or {}
    value_cols = [*exact, *within, *relative]
    g = got.select(*keys, *[F.col(c).alias(f"g_{c}") for c in value_cols], F.lit(True).alias("_g"))
    w = want.select(*keys, *[F.col(c).alias(f"w_{c}") for c in value_cols], F.lit(True).alias("_w"))
    both = g.join(w, keys, "full_outer")
    delta = lambda c: F.abs(F.col(f"g_{c}") - F.col(f"w_{c}"))
    scaled = lambda c: delta(c) / F.greatest(F.abs(F.col(f"w_{c}")), F.lit(1e-12))
    bad: Column = F.lit(False)
    for c in exact:
        bad = bad | ~F.col(f"g_{c}").eqNullSafe(F.col(f"w_{c}"))
    for c, tol in within.items():
        bad = bad | (delta(c) > tol)
    for c in relative:
        bad = bad | (scaled(c) > REL_TOLERANCE)
    present = F.col("_g").isNotNull() & F.col("_w").isNotNull()
    worst = [F.max(F.when(present, delta(c))).alias(f"worst_{c}") for c in within]
    worst += [F.max(F.when(present, scaled(c))).alias(f"worst_{c}") for c in relative]
    return both.groupBy(case).agg(
        F.count_if(present).alias("n_compared"),
        F.count_if(present & F.coalesce(bad, F.lit(True))).alias("n_bad"),
        F.count_if(F.col("_g").isNull()).alias("n_missing"),
        F.count_if(F.col("_w").isNull()).alias("n_extra"),
        *worst,
    )


def placement_metrics(boxes: DataFrame, gold: DataFrame, keys: list[str], case: str = "case_id") -> DataFrame:
    """``lo``/``hi`` of each placed box against the true ink box.

    Degenerate gold boxes are skipped.  Rates allow half a pixel.
    """
    ink = gold.filter(F.col("true_hi") > F.col("true_lo")).select(*keys, "true_lo", "true_hi")
    d = boxes.select(*keys, "lo", "hi").join(ink, keys)
    true_mid = (F.col("true_lo") + F.col("true_hi")) / 2.0
    mid = (F.col("lo") + F.col("hi")) / 2.0
    inside = lambda c, lo, hi: ((c >= F.col(lo) - 0.5) & (c <= F.col(hi) + 0.5)).cast("double")
    d = written(d.withColumn("err", F.abs(true_mid - mid)), "placed")
    p90 = ordered.group_quantiles(d, [case], "err", {"centre_err_p90": 0.9})
    return d.groupBy(case).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("err").alias("centre_err_mean"),
        F.avg(inside(true_mid, "lo", "hi")).alias("cover_rate"),
        F.avg(inside(mid, "true_lo", "true_hi")).alias("tap_rate"),
        F.avg((F.col("hi") - F.col("lo")) - (F.col("true_hi") - F.col("true_lo"))).alias("width_delta_mean"),
    ).join(p90, case, "left")


def drift_guard(fold: DataFrame, variants: DataFrame, expected: int) -> DataFrame:
    """Violations of the fold against the variant table.

    Every fold pair must exist there in the same direction, no canonical may
    be a fold key, and the fold must have ``expected`` entries.
    """
    pairs = variants.select("variant", "canonical").distinct()
    absent = fold.join(pairs, ["variant", "canonical"], "left_anti").select(
        "variant", "canonical", F.lit("not in table").alias("problem")
    )
    keys = fold.select(F.col("variant").alias("canonical")).distinct()
    folded = fold.join(keys, "canonical", "left_semi").select(
        "variant", "canonical", F.lit("canonical is a key").alias("problem")
    )
    none = F.lit(None).cast("string")
    count = fold.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != expected).select(
        none.alias("variant"), none.alias("canonical"), F.concat(F.lit("entry count "), F.col("n").cast("string")).alias("problem")
    )
    return absent.unionByName(folded).unionByName(count)
