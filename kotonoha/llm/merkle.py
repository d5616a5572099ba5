"""Merkle manifest of a table.

The leaf of a row is the digest of its columns.  The leaves of a group (null first), in order, are the lowest level of a
tree of which every ``fanout`` consecutive nodes, in the last run fewer, become one; what remains is the group's root.
The roots of the groups, in order, make a tree in the same way, whose root stands for the whole table.

1. Leaves are put in order by range, and numbered within their group through one count per range.
2. Rows of a group are cut into blocks of ``fanout ** levels`` slots, which no run of a lower level crosses.  Each row
   carries the digest of its node.  At level ``i`` the nodes beside it are ``fanout ** i`` rows away or a multiple: lag
   and lead columns of these fixed offsets, masked by the node's place in its run and the run's length, are its siblings.
   Rows of a run's first child hash the parent, and the others take it from them by a lag.  All levels of a block are
   windows of one partitioning and one order, so rows are shuffled and sorted once.
3. The first rows of blocks are the leaves of the next tier, and so on until every group is one block.
4. The siblings of a leaf are those of its block and, joined by block, those of the tiers above.

Only windows and joins are used; no task sees more of a group than a block, or one row per block of the tier below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions.tables import written

#: Levels of a tier: a block has ``fanout ** LEVELS`` leaves.
LEVELS = 12
PATH = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(column: Column) -> Column:
    """A value and its length in bytes, so that no two rows read alike; a dash for null."""
    text = column.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return digest(F.concat(*[encoded(c) for c in columns]))


def slots(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """``nodes`` with ``slot``, from 0 within ``grp`` by ``order`` (nulls first), and ``size``, the rows of the group."""
    ranged = nodes.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    rows = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle-slots")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    group = Window.partitionBy("grp")
    parts = parts.select(
        "grp", "part",
        (F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(group).alias("size"),
    )
    return rows.join(parts, ["grp", "part"]).withColumn("slot", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _either(columns: Sequence[Column]) -> Column:
    return F.coalesce(*columns) if len(columns) > 1 else columns[0]


def climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes(grp, slot, size, h)`` with ``block``, ``path`` (siblings by level, lowest first) and ``top``, the node of the block."""
    width = fanout**levels
    rows = nodes.withColumns({"block": F.floor(F.col("slot") / width).cast("long"), "top": F.col("h")})
    order = Window.partitionBy("grp", "block").orderBy("slot")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    steps = []
    for level in range(levels):
        step = fanout**level
        node = F.floor(F.col("slot") / step)
        child = node % fanout
        beside = F.ceil(F.col("size") / step) - node  # nodes from here to the end of the level
        goes = F.col("size") > step
        near = {}
        for d in range(1, fanout):
            near[f"lag_{d}"] = F.lag("top", d * step).over(order)
            # a node that ends beyond the last row is the last one
            near[f"lead_{d}"] = F.coalesce(F.lead("top", d * step).over(order), F.last("top").over(whole))
        rows = rows.withColumns(near)
        before = [F.when(child >= d, F.col(f"lag_{d}")) for d in range(fanout - 1, 0, -1)]
        after = [F.when((child + d < fanout) & (d < beside), F.col(f"lead_{d}")) for d in range(1, fanout)]
        rows = rows.withColumn(f"step_{level}", F.when(goes, F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))))
        rows = rows.withColumn("parent", F.when(goes & (child == 0), digest(F.concat("top", F.col(f"step_{level}.after")))))
        others = [F.when(child == d, F.lag("parent", d * step).over(order)) for d in range(1, fanout)]
        rows = rows.withColumn("top", F.coalesce("parent", _either(others), "top")).drop("parent", *near)
        steps.append(f"step_{level}")
    path = F.filter(F.array(*steps), lambda s: s.isNotNull()) if steps else F.array()
    return rows.withColumn("path", path.cast(PATH)).drop(*steps)


def ascend(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[tuple[DataFrame, int]], DataFrame]:
    """The tiers over ``nodes`` with their depths, and ``(grp, h)``, the root of every group."""
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tiers = []
    while True:
        depth = 0
        while depth < levels and fanout**depth < largest:
            depth += 1
        tiers.append((nodes, depth))
        width = fanout**depth
        firsts = climb(nodes.select("grp", "slot", "size", "h"), fanout, depth).filter(F.col("slot") % width == 0)
        nodes = written(firsts.select("grp", F.col("block").alias("slot"), F.ceil(F.col("size") / width).alias("size"), F.col("top").alias("h")), "merkle-tier")
        if largest <= width:
            return tiers, nodes.select("grp", "h")
        largest = -(-largest // width)


def descend(tiers: list[tuple[DataFrame, int]], fanout: int, above: DataFrame | None = None) -> DataFrame:
    """The lowest nodes with ``path`` up to the root of their group or, with ``above(grp, path, root)``, on to that root."""
    done = None
    for nodes, depth in reversed(tiers):
        rows = climb(nodes, fanout, depth).withColumn("own", F.col("top"))
        if done is not None:
            up = done.select("grp", F.col("slot").alias("block"), F.col("path").alias("up"), F.col("own").alias("found"), "root")
            rows = rows.join(up, ["grp", "block"]).withColumn("own", F.col("found"))
        elif above is not None:
            rows = rows.join(above.select("grp", F.col("path").alias("up"), "root"), "grp")
        else:
            rows = rows.withColumns({"up": F.array().cast(PATH), "root": F.col("top")})
        done = rows.withColumn("path", F.concat("path", "up")).drop("up", "found", "top", "block")
    return done


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""))


def manifest(
    table: DataFrame, columns: Sequence[str], group: str, order: str, carried: dict[str, Column] | None = None,
    fanout: int = 2, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of ``table``: ``order``, ``leaf``, ``path``, ``subroot`` and ``root``, and the ``carried`` columns of own expressions.

    ``path`` has per level, lowest first, the digests ``before`` and ``after`` a node in its run, both empty where it is alone.
    A lone leaf is its group's root, and the root of a lone group that of the table.  Groups are told apart and ordered by
    their bytes, null first; rows of equal or null ``order`` follow each other by leaf (null first), so equal
    rows have leaves, but not slots, in common.  Null values are dashes in a leaf; an empty table gives no rows.  Other
    columns of ``table`` are not read, so they may have any name.
    """
    carried = carried or {}
    rows = table.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"),
        F.col(order).alias("place"), leaf([F.col(c) for c in columns]).alias("h"),
        F.struct(F.lit(0).alias("none"), *[c.alias(n) for n, c in carried.items()]).alias("carried"),
    )
    # written, as the sample of the ranges would read and hash the texts a second time
    leaves = slots(written(rows, "merkle-leaves"), ["place", "h"])
    tiers, subroots = ascend(leaves, fanout, levels)
    groups = slots(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "h"), ["of"])
    upper, _ = ascend(groups, fanout, levels)
    above = descend(upper, fanout).select(F.col("of").alias("grp"), "path", "root")
    done = descend(tiers, fanout, above)
    return done.select(
        F.col("place").alias(order), F.col("h").alias("leaf"), "path", F.col("own").alias("subroot"), "root",
        *[F.col(f"carried.{n}").alias(n) for n in carried],
    )


def verified(rows: DataFrame, start: str = "leaf") -> DataFrame:
    """``rows`` of a manifest with ``folded_root``, the root that ``start`` leads to, and whether it is ``root``."""
    found = rows.withColumn("folded_root", folded(F.col(start), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
