"""Ordered computations that stay parallel inside one hot group.

A plain window over ``partitionBy(line)`` puts a whole line (page, user, ...)
into one task.  Here a group is cut into blocks of its own position column, the
bulk of the work is done per ``(group, block)``, and only one summary row per
block is looked at per group.  A group holding a third of all rows is then
spread over (rows / block) tasks, and the serial part shrinks by the block size.

The position column must be an integer-valued column; holes are fine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import written

BLOCK = 4096
_BLK = "_blk"


def _block(idx: str | Column, size: int) -> Column:
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(col / F.lit(size)).cast("long")


def in_blocks(df: DataFrame, idx: str, size: int = BLOCK) -> DataFrame:
    """Add the block number.  Windows over ``(keys, block)`` shuffle the rows
    once; block summaries are aggregated before they are shuffled."""
    return df.withColumn(_BLK, _block(idx, size))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    sums: dict[str, Column],
    size: int = BLOCK,
    order: Sequence[Column] = (),
    inclusive: bool = False,
) -> DataFrame:
    """Add running sums of ``sums`` over ``keys`` in ``idx`` (then ``order``) order.

    Exclusive of the row itself unless ``inclusive``.
    """
    keys = list(keys)
    d = df
    for name, col in sums.items():
        d = d.withColumn(f"_v_{name}", col)
    d = in_blocks(d, idx, size)
    inner = Window.partitionBy(*keys, _BLK).orderBy(F.col(idx), *order)
    inner = inner.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = d.groupBy(*keys, _BLK).agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    outer = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, _BLK, *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0)).alias(f"_b_{n}") for n in sums]
    )
    d = d.withColumns({f"_r_{n}": F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)) for n in sums})
    d = d.join(base, [*keys, _BLK])
    d = d.withColumns({n: F.col(f"_r_{n}") + F.col(f"_b_{n}") for n in sums})
    return d.drop(_BLK, *[f"_{p}_{n}" for p in "vrb" for n in sums])


def previous_values(
    df: DataFrame, keys: Sequence[str], idx: str, values: dict[str, str], size: int = BLOCK
) -> DataFrame:
    """Add, under each name in ``values``, that column of the preceding row."""
    keys = list(keys)
    d = in_blocks(df, idx, size)
    packed = F.struct(*[F.col(src).alias(out) for out, src in values.items()])
    last = d.groupBy(*keys, _BLK).agg(F.max_by(packed, F.col(idx)).alias("_last"))
    carry = last.select(
        *keys, _BLK, F.lag("_last").over(Window.partitionBy(*keys).orderBy(_BLK)).alias("_carry")
    )
    inner = Window.partitionBy(*keys, _BLK).orderBy(idx)
    d = d.withColumn("_prev", F.lag(packed).over(inner)).join(carry, [*keys, _BLK])
    prev = F.coalesce(F.col("_prev"), F.col("_carry"))
    d = d.withColumns({out: prev[out] for out in values})
    return d.drop(_BLK, "_prev", "_carry")


def with_halo(
    df: DataFrame, keys: Sequence[str], idx: str, before: int, after: int, size: int = BLOCK
) -> tuple[DataFrame, Window]:
    """Blocks that also hold the neighbours of their edge rows.

    Returns the frame and a window over it in which every row flagged
    ``_home`` sees its ``before`` predecessors and ``after`` successors.
    ``idx`` must be dense.  One shuffle; keep ``_home`` rows afterwards.
    """
    first = F.greatest(F.lit(0), _block(F.col(idx) - F.lit(after), size))
    last = _block(F.col(idx) + F.lit(before), size)
    d = df.withColumn(_BLK, F.explode(F.sequence(first, last)))
    d = d.withColumn("_home", F.col(_BLK) == _block(idx, size))
    return d, Window.partitionBy(*keys, _BLK).orderBy(idx)


def home_rows(df: DataFrame) -> DataFrame:
    return df.filter("_home").drop("_home", _BLK)


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str,
) -> DataFrame:
    """0-based ``row_number`` per group for an order whose coarse prefix is ``bucket``.

    ``bucket`` must never decrease along ``order``.  Only one count per bucket
    is brought together per group.
    """
    keys = list(keys)
    d = df.withColumn("_bucket", bucket)
    counts = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    outer = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "_bucket", F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_base"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    d = d.withColumn("_r", F.row_number().over(inner) - 1).join(base, [*keys, "_bucket"])
    return d.withColumn(out, (F.col("_r") + F.col("_base")).cast("long")).drop("_bucket", "_r", "_base")


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group: whether windows over whole groups may be used."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def group_medians(df: DataFrame, keys: Sequence[str], value: str, slots: int = 1024) -> DataFrame:
    """Exact medians per group: ``n``, ``median`` (mean of the two middles) and
    ``upper_median`` (element ``n / 2`` of the sorted values).

    Equal values are counted before anything is brought together, and only the
    value slot holding the middle is ordered.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ends = counts.groupBy(*keys).agg(
        F.sum("_c").alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi")
    )
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(width > 0, F.floor((F.col(value) - F.col("_lo")) / width * F.lit(slots))).otherwise(0)
    c = counts.join(ends, keys).withColumn("_slot", slot.cast("long"))
    per_slot = c.groupBy(*keys, "_slot", "n").agg(F.sum("_c").alias("_s"))
    outer = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    low, high = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    per_slot = per_slot.withColumn("_base", F.coalesce(F.sum("_s").over(outer), F.lit(0)))
    middle = per_slot.filter(
        (F.col("_base") <= high) & (F.col("_base") + F.col("_s") > low)
    ).select(*keys, "_slot", "_base")
    inner = Window.partitionBy(*keys, "_slot").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    m = c.join(middle, [*keys, "_slot"])
    m = m.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))
    upto = F.col("_before") + F.col("_c")
    hit = m.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max(F.when((F.col("_before") <= low) & (upto > low), F.col(value))).alias("_low"),
        F.max(F.when((F.col("_before") <= high) & (upto > high), F.col(value))).alias("upper_median"),
    )
    return hit.select(*keys, "n", ((F.col("_low") + F.col("upper_median")) / 2).alias("median"), "upper_median")


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], slots: int = 1024, most: int = 65_536
) -> DataFrame:
    """Exact interpolated quantiles per group, one column each; nulls do not count, and a group without values has no row.

    Equal values are counted before anything is brought together.  A wanted rank is then looked for in slots of the value's range,
    and again in the slot that holds it, until that has at most ``most`` distinct values; only those are ordered.
    """
    keys = list(keys)
    counts = written(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c")), "value-counts")
    ends = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_size"))
    at = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = [F.struct(F.lit(name).alias("name"), side(at(q)).cast("long").alias("rank")) for name, q in quantiles.items() for side in (F.floor, F.ceil)]
    target = [*keys, "_rank"]
    found = ends.withColumn("_r", F.explode(F.array_distinct(F.transform(F.array(*ranks), lambda r: r["rank"]))))
    found = written(found.select(*keys, F.col("_r").alias("_rank"), F.lit(0).cast("long").alias("_base"), "_lo", "_hi", "_size"), "ranks")
    inside = lambda t: counts.join(t, keys).filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
    before = Window.partitionBy(*target).rowsBetween(Window.unboundedPreceding, -1)
    while (found.agg(F.max("_size")).first()[0] or 0) > most:
        width = F.col("_hi") - F.col("_lo")
        slot = F.when(width > 0, F.floor((F.col(value) - F.col("_lo")) / width * F.lit(slots))).otherwise(0)
        per = inside(found).groupBy(*target, "_base", slot.alias("_slot")).agg(
            F.sum("_c").alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias("_size"))
        per = per.withColumn("_base", F.col("_base") + F.coalesce(F.sum("_s").over(before.orderBy("_slot")), F.lit(0)))
        hit = (F.col("_base") <= F.col("_rank")) & (F.col("_rank") < F.col("_base") + F.col("_s"))
        found = written(per.filter(hit).select(*target, "_base", "_lo", "_hi", "_size"), "ranks")
    upto = inside(found).withColumn("_before", F.col("_base") + F.coalesce(F.sum("_c").over(before.orderBy(value)), F.lit(0)))
    hit = upto.filter((F.col("_before") <= F.col("_rank")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
    values = hit.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_v")).join(ends.select(*keys, "_n"), keys)

    def quantile(q: float) -> Column:
        low, high = F.floor(at(q)).cast("long"), F.ceil(at(q)).cast("long")
        a, b = F.element_at("_v", low), F.element_at("_v", high)
        return F.when(a == b, a).otherwise((high - at(q)) * a + (at(q) - low) * b)

    return values.select(*keys, *[quantile(q).alias(name) for name, q in quantiles.items()])


def prefix_max(
    df: DataFrame, keys: Sequence[str], idx: str, value: Column, out: str, order: Sequence[Column] = (), size: int = BLOCK
) -> DataFrame:
    """Add the largest ``value`` of the preceding rows of ``keys`` (NULL for the first)."""
    keys = list(keys)
    d = in_blocks(df.withColumn("_v", value), idx, size)
    outer = Window.partitionBy(*keys).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    base = d.groupBy(*keys, _BLK).agg(F.max("_v").alias("_t")).select(*keys, _BLK, F.max("_t").over(outer).alias("_base"))
    inner = Window.partitionBy(*keys, _BLK).orderBy(F.col(idx), *order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_r", F.max("_v").over(inner)).join(base, [*keys, _BLK])
    return d.withColumn(out, F.greatest("_r", "_base")).drop(_BLK, "_v", "_r", "_base")


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], fold, schema: str) -> DataFrame:
    """Apply ``fold(rows) -> rows`` to each group's rows in ``order``.

    Groups are streamed from sorted partitions; a task holds one group's rows
    at a time.  For folds whose every step depends on the one before.
    """
    import pandas as pd

    keys = list(keys)
    columns = df.columns

    def run(batches):
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        current, held = None, []
        for pdf in batches:
            out = []
            at = [pdf.columns.get_loc(k) for k in keys]
            for row in pdf.itertuples(index=False, name=None):
                key = tuple(row[i] for i in at)
                if key != current and held:
                    out += fold([dict(zip(columns, r)) for r in held])
                    held = []
                current = key
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        if held:
            yield pd.DataFrame(fold([dict(zip(columns, r)) for r in held]), columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
