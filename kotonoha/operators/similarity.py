"""Component similarity, variants and suggestions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions.tables import dealt, written

IDEOGRAPHS = f"^[{fx.IDEOGRAPH_CLASS}]+$"
HOT_COMPONENT = 100_000
#: Pairs that a task measures at a time, and rows that it gives back at a time.
CELLS = 1 << 18
OUT_ROWS = 1 << 16
#: Stands for the weight of a component before the one where two items meet.
EARLIER = -1e30


# -- K01, K06: table files ------------------------------------------------------


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, line)`` of table files.  These are small reference tables;
    the number is the place in the file, not a row id of the scan."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\\r?\\n")).alias("line_no", "line"))


def parse_components(lines: DataFrame) -> DataFrame:
    """``item:component component`` lines to ``(item, component, pos)``.

    The key is one character; other tokens than single characters are ignored,
    repeats within a line too; the first line of a key wins even when it has no
    component, in which case a later line may fill it.
    """
    rows = lines.filter(F.col("line").rlike("(?s)^.:")).select(
        "line_no",
        F.left("line", F.lit(1)).alias("item"),
        F.array_distinct(
            F.filter(F.split(F.substr("line", F.lit(3), F.length("line")), " "), lambda t: F.length(t) == 1)
        ).alias("parts"),
    ).filter(F.size("parts") > 0)
    first = rows.groupBy("item").agg(F.min_by("parts", "line_no").alias("parts"))
    return first.select("item", F.posexplode("parts").alias("pos", "component"))


def load_components(spark: SparkSession, path: str) -> DataFrame:
    return parse_components(read_numbered_lines(spark, path))


def parse_variants(lines: DataFrame) -> DataFrame:
    """``variant<TAB>canonical`` lines to ``(line_no, variant, canonical)``."""
    fields = F.split(F.trim(F.col("line")), "\t")
    bmp = lambda c: (F.length(c) == 1) & ~c.rlike("[\\x{10000}-\\x{10FFFF}]")
    rows = lines.filter(~F.trim("line").startswith("#")).select("line_no", fields.alias("f")).filter("size(f) = 2")
    rows = rows.select("line_no", F.col("f")[0].alias("variant"), F.col("f")[1].alias("canonical"))
    return rows.filter(bmp(F.col("variant")) & bmp(F.col("canonical")) & (F.col("variant") != F.col("canonical")))


def load_variants(spark: SparkSession, path: str) -> DataFrame:
    return parse_variants(read_numbered_lines(spark, path))


def variant_tables(variants: DataFrame) -> DataFrame:
    """Per variant its canonical (first line) and all canonicals, sorted."""
    return variants.groupBy("variant").agg(
        F.min_by("canonical", "line_no").alias("canonical"),
        F.array_sort(F.collect_set("canonical")).alias("canonicals"),
    )


def variant_chains(variants: DataFrame) -> DataFrame:
    """Follow variant -> canonical to the last form.

    ``cycle`` flags genuine cycles, which are kept: the chain ends before its first repeat.  Every round appends to a
    chain the chain of its last form, so that the rounds grow with the logarithm of the longest.
    """
    d = variant_tables(variants).select("variant", F.array("variant", "canonical").alias("chain"), F.lit(False).alias("cycle"))
    while True:
        d = written(d, "chains")
        more = d.select(F.col("variant").alias("_from"), F.col("chain").alias("_more"), F.col("cycle").alias("_cycle"))
        open_ = F.when(~F.col("cycle"), F.element_at("chain", -1))
        # the old chain needs a name of its own: a lambda would otherwise see the new one
        met = d.select("variant", F.col("chain").alias("_old"), F.col("cycle").alias("_was"), open_.alias("_from")).join(more, "_from", "left")
        if met.filter("_more is not null").isEmpty():
            break
        rest = F.slice("_more", 2, F.size("_more"))
        first = F.array_position(F.transform(rest, lambda x: F.array_contains("_old", x)), True)
        new = F.when(first > 0, F.slice(rest, 1, (first - 1).cast("int"))).otherwise(rest)
        d = met.select(
            "variant", F.when(F.col("_more").isNull(), F.col("_old")).otherwise(F.concat("_old", new)).alias("chain"),
            (F.col("_was") | F.coalesce((first > 0) | F.col("_cycle"), F.lit(False))).alias("cycle"),
        )
    return d.select("variant", F.element_at("chain", -1).alias("last_form"), (F.size("chain") - 1).alias("hops"), "cycle")


# -- K02 - K05: components ------------------------------------------------------


def component_idf(components: DataFrame, population: str = IDEOGRAPHS) -> DataFrame:
    """Document frequency and ``ln(N / df)`` over ideograph keys only."""
    members = components.filter(F.col("item").rlike(population)).select("item", "component").distinct()
    total = members.agg(F.countDistinct("item").alias("total"))
    df = members.groupBy("component").agg(F.count(F.lit(1)).alias("df"))
    # joined to a one-row table
    return df.join(total, F.lit(True)).select("component", "df", F.ln(F.col("total") / F.col("df")).alias("idf"))


def items_with_all(requirements: DataFrame, components: DataFrame, population: str = IDEOGRAPHS) -> DataFrame:
    """Items carrying every requested component, by request.

    A request without components has no rows and so no result.  Items are reached by pairs of components, which a
    decomposition has few of: a request of up to two components is answered by one equi-join that brings nothing but
    results; a longer one takes the items of its two rarest and counts the others among their components.
    """
    members = components.filter(F.col("item").rlike(population)).select("item", "component").distinct()
    have = members.groupBy("item").agg(F.array_sort(F.collect_list("component")).alias("_have"))
    pairs = F.flatten(F.transform("_have", lambda a, i: F.transform(
        F.slice("_have", i + 1, F.size("_have")), lambda b: F.struct(a.alias("_a"), b.alias("_b"))
    )))
    # a component alone is the pair of itself
    carriers = dealt(have.select("item", F.inline(pairs)))
    asked = requirements.select("request_id", "component").distinct()
    wanted = asked.groupBy("request_id").agg(F.array_sort(F.collect_list("component")).alias("_need"))
    few = wanted.filter("size(_need) <= 2").select("request_id", F.col("_need")[0].alias("_a"), F.element_at("_need", -1).alias("_b"))
    found = few.join(carriers, ["_a", "_b"]).select("request_id", "item")
    many = wanted.filter("size(_need) > 2").select("request_id", F.explode("_need").alias("component"))
    df = members.groupBy("component").agg(F.count(F.lit(1)).alias("df"))
    ranked = many.join(df, "component", "left").groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "component"))).alias("_r")
    )
    names = F.transform("_r", lambda r: r["component"])
    ranked = ranked.select("request_id", F.array_sort(F.slice(names, 1, 2)).alias("_p"), F.slice(names, 3, F.size(names)).alias("_more"))
    near = ranked.select("request_id", F.col("_p")[0].alias("_a"), F.col("_p")[1].alias("_b"), "_more").join(carriers, ["_a", "_b"])
    rest = near.select("request_id", "item", F.size("_more").alias("_n"), F.explode("_more").alias("component")).join(members, ["item", "component"])
    whole = rest.groupBy("request_id", "item").agg(F.count(F.lit(1)).alias("_got"), F.first("_n").alias("_n")).filter("_got = _n")
    return found.unionByName(whole.select("request_id", "item"))


def item_profiles(components: DataFrame, idf: DataFrame) -> DataFrame:
    """Per item its components as numbers, heaviest first (``c``), their weights (``v``), their document frequencies (``d``),
    what each and all after it weigh (``r``), and the total mass.

    A decomposition is short.  All items have one order of components; an unknown one is -1 and weighs nothing.
    """
    # numbers in the order of the weights, written since they would not come out the same again
    known = written(
        idf.select("component", "idf", "df").orderBy(F.desc("idf"), "component").withColumn("_c", F.monotonically_increasing_id()), "weighted-components"
    )
    weighted = components.select("item", "component").distinct().join(known, "component", "left").na.fill({"idf": 0.0, "df": 0, "_c": -1})
    parts = F.array_sort(F.collect_list(F.struct((-F.col("idf")).alias("neg"), "_c", "idf", "df")))
    each = weighted.groupBy("item").agg(parts.alias("_p"), F.sum("idf").alias("mass"))
    of = lambda name: F.transform("_p", lambda p: p[name])
    rest = F.transform("_p", lambda p, i: F.aggregate(F.slice("_p", i + 1, F.size("_p")), F.lit(0.0), lambda acc, q: acc + q["idf"]))
    return each.select("item", "mass", of("_c").alias("c"), of("idf").alias("v"), of("df").alias("d"), rest.alias("r"))


class _Carriers:
    """Items of one component, by their other components."""

    def __init__(self, held: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(held).combine_chunks()
        self.names = rows["name"].combine_chunks()
        lists = rows["c"].combine_chunks()
        codes = lists.flatten().to_numpy()
        owners = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        order = np.argsort(codes, kind="stable")
        self.owners = owners[order]
        self.codes, self.starts, self.sizes = np.unique(codes[order], return_index=True, return_counts=True)

    def met(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """What each source shares with each carrier, if it is enough and this component is the first they share."""
        lists = rows.column("c")
        k = pc.list_value_length(lists).to_numpy()
        source = np.repeat(np.arange(len(k)), k)
        codes, weights = lists.flatten().to_numpy(), rows.column("v").flatten().to_numpy()
        at = np.arange(len(codes)) - np.repeat(np.cumsum(k) - k, k)
        weights = np.where(at < rows.column("place").to_numpy()[source], EARLIER, weights)
        found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        n = np.where(self.codes[found] == codes, self.sizes[found], 0)
        # as many sources at a time as there is room for cells and for shared components
        room = np.maximum(np.bincount(source, n, minlength=len(k)), len(self.names))
        part = (np.cumsum(room) // CELLS).astype(np.int64)
        for number in np.unique(part):
            low, high = np.searchsorted(part, [number, number + 1])
            own = slice(*np.searchsorted(source, [low, high]))
            yield from self._cells(rows, low, high, source[own] - low, found[own], n[own], weights[own], k[low:high])

    def _cells(self, rows, low, high, source, found, n, weights, k) -> Iterator[pa.RecordBatch]:
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        width = len(self.names)
        cell = np.repeat(source * width, n) + self.owners[np.repeat(self.starts[found], n) + within]
        weight = np.bincount(cell, np.repeat(weights, n), minlength=(high - low) * width)
        need = rows.column("need").to_numpy()[low:high]
        hit = np.flatnonzero(weight.reshape(-1, width) >= need[:, None])
        if len(hit) == 0:
            return
        shared = np.bincount(cell, minlength=(high - low) * width)[hit]
        for begin in range(0, len(hit), OUT_ROWS):
            some = hit[begin : begin + OUT_ROWS]
            of, to = some // width, some % width
            yield pa.RecordBatch.from_arrays([
                rows.column("name").take(pa.array(of + low)), self.names.take(pa.array(to)), pa.array(weight[some]),
                rows.column("mass").take(pa.array(of + low)), pa.array(shared[begin : begin + OUT_ROWS] == k[of]),
            ], ["src", "dst", "weight", "mass", "shares_all"])


def _met_by_component(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sources against carriers, of rows in order of component and salt, carriers first.  Only carriers are held."""
    key, held, carriers = None, [], None
    for batch in batches:
        runs = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("a", "salt", "kind")], axis=1)
        starts = np.flatnonzero(np.any(runs[1:] != runs[:-1], axis=1)) + 1
        for low, high in zip([0, *starts], [*starts, len(runs)]):
            if low == high:
                continue
            if key != (runs[low][0], runs[low][1]):
                key, held, carriers = (runs[low][0], runs[low][1]), [], None
            if runs[low][2] == 0:
                held.append(batch.slice(low, high - low))
            elif held:
                carriers = carriers or _Carriers(held)
                yield from carriers.met(batch.slice(low, high - low))


def _measured(pairs: DataFrame, min_fraction: float) -> DataFrame:
    """Pairs ``(src, dst, c, v, mass, _have)`` that reach the fraction."""
    shared = F.zip_with("c", "v", lambda x, w: F.when(F.array_contains("_have", x), w))
    weight = F.aggregate(shared, F.lit(0.0), lambda acc, w: acc + F.coalesce(w, F.lit(0.0)))
    return pairs.select(
        "src", "dst", F.round(weight / F.col("mass"), 9).alias("fraction"), F.forall(shared, lambda w: w.isNotNull()).alias("shares_all")
    ).filter(F.col("fraction") >= min_fraction)


def neighbours(
    components: DataFrame,
    idf: DataFrame,
    min_fraction: float = fx.MIN_IDF_FRACTION,
    sources: DataFrame | None = None,
    population: str = IDEOGRAPHS,
) -> DataFrame:
    """Pairs whose shared idf mass is at least ``min_fraction`` of the source's.

    A target reaching the fraction must share one of the source's rarest
    components: the components are taken rarest first until what is left over
    weighs less than the fraction asks for.  Only those are met at, so
    frequent components produce few pairs; the result is exact.  Sources and carriers of a component are brought
    together and measured there in arrays, through the lists of carriers of every other component; a pair counts at the first component that
    both have, so nothing of it is shuffled again.  With ``min_fraction=0`` every shared component
    counts.  Carriers of a very frequent component are spread over salts, to which its sources are repeated.
    """
    return _neighbours(written(item_profiles(components, idf), "profiles"), min_fraction, sources, population)


def _neighbours(profiles: DataFrame, min_fraction: float, sources: DataFrame | None, population: str) -> DataFrame:
    source = profiles if sources is None else profiles.join(sources.select("item").distinct(), "item", "left_semi")
    need = F.col("mass") * F.lit(min_fraction) - F.lit(1e-9) * (F.col("mass") + 1)
    each = F.posexplode(F.arrays_zip("c", "d", "r")).alias("place", "p")
    salts = F.greatest(F.lit(1), F.ceil(F.col("p.d") / F.lit(HOT_COMPONENT))).cast("int")
    left = source.filter("mass > 0").select(F.col("item").alias("name"), "c", "v", "mass", need.alias("need"), each).filter(F.col("p.r") >= F.col("need"))
    left = left.select(F.col("p.c").alias("a"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(1).alias("kind"), "name", "c", "v", "place", "need", "mass")
    right = profiles.filter(F.col("item").rlike(population)).select(F.col("item").alias("name"), "c", each)
    right = right.select(
        F.col("p.c").alias("a"), F.pmod(F.xxhash64("name"), salts).cast("int").alias("salt"), F.lit(0).alias("kind"), "name", "c",
    )
    rows = right.unionByName(left, allowMissingColumns=True).select(*left.columns)
    met = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "kind").mapInArrow(
        _met_by_component, "src string, dst string, weight double, mass double, shares_all boolean"
    )
    return met.filter("src <> dst").select("src", "dst", F.round(F.col("weight") / F.col("mass"), 9).alias("fraction"), "shares_all").filter(
        F.col("fraction") >= min_fraction
    )


def nearest(
    components: DataFrame,
    idf: DataFrame,
    best: int,
    also: DataFrame,
    min_fraction: float = fx.MIN_IDF_FRACTION,
    sources: DataFrame | None = None,
    population: str = IDEOGRAPHS,
) -> DataFrame:
    """The ``best`` neighbours of each source, and those of ``also(src, dst)`` that are neighbours at all.

    Neighbours are cut to the best where they are found, before they are brought together by source.
    """
    profiles = written(item_profiles(components, idf), "profiles")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("fraction"), "dst"))
    top = _neighbours(profiles, min_fraction, sources, population).withColumn("_n", place).filter(F.col("_n") <= best).drop("_n")
    given = also.select("src", "dst").distinct().filter("src <> dst")
    given = given if sources is None else given.join(sources.select(F.col("item").alias("src")).distinct(), "src", "left_semi")
    given = given.join(profiles.filter("mass > 0").select(F.col("item").alias("src"), "c", "v", "mass"), "src")
    target = profiles.filter(F.col("item").rlike(population)).select(F.col("item").alias("dst"), F.col("c").alias("_have"))
    # what shares nothing is no neighbour, whatever the fraction
    asked = _measured(given.join(target, "dst").filter(F.arrays_overlap("c", "_have")), min_fraction)
    return top.unionByName(asked).distinct()


def has_discriminating(components: DataFrame) -> DataFrame:
    """Items with two or more components."""
    return components.groupBy("item").agg(F.countDistinct("component").alias("n")).filter("n >= 2").select("item")


def majority_components(groups: DataFrame, components: DataFrame, need: float = 0.5) -> DataFrame:
    """Components a group's characters agree on.

    ``groups`` is ``(group_id, member)``, one row per vote.  Unknown members count towards
    the quorum.  If nothing reaches it the strongest component stands alone.
    """
    ballots = groups.groupBy("group_id", "member").agg(F.count(F.lit(1)).alias("_w"))
    parts = components.select(F.col("item").alias("member"), "component").distinct()
    # numbers in the order of the components, written since they would not come out the same again
    known = written(parts.select("component").distinct().orderBy("component").withColumn("_c", F.monotonically_increasing_id()), "numbered-components")
    coded = parts.join(known, "component").groupBy("member").agg(F.collect_list("_c").alias("_cs"))
    # a ballot is one row until it has reached its group; the component -1 counts them all
    met = ballots.join(dealt(coded), "member", "left").select("group_id", "_w", "_cs").repartition("group_id")
    every = F.concat(F.array(F.lit(-1).cast("long")), F.coalesce("_cs", F.array().cast("array<bigint>")))
    votes = met.select("group_id", "_w", F.explode(every).alias("_c")).groupBy("group_id", "_c").agg(F.sum("_w").alias("votes"))
    whole = Window.partitionBy("group_id")
    scored = votes.withColumns({
        "n": F.max(F.when(F.col("_c") < 0, F.col("votes"))).over(whole),
        "_best": F.min(F.when(F.col("_c") >= 0, F.struct((-F.col("votes")).alias("neg"), "_c"))).over(whole),
    }).filter("_c >= 0")
    quorum = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(need) + F.lit(0.9999)))
    # where the strongest does not reach it, none does
    kept = scored.filter((F.col("votes") >= quorum) | (F.col("_c") == F.col("_best._c")))
    return kept.join(known, "_c").select("group_id", "component", "votes")


# -- K07 ------------------------------------------------------------------------


def suggest(chars: DataFrame, head: DataFrame, near: DataFrame, forms: DataFrame, discriminating: DataFrame) -> DataFrame:
    """The suggestion list of each recognised character.

    ``chars`` is ``(char_id, ch)``, ``head`` ``(char_id, rank, ch)``; ``near`` is the
    K04 table at the suggestion tier, ``forms`` ``(canonical, variants)``.  Of ``near`` the first 15 of a source, one more for
    each head row and one for the character are enough, if all that are among its forms are there too (``nearest``).
    Duplicates go to the first group; each generated group keeps its first 15
    *new* entries.
    """
    current = chars.select("char_id", F.col("ch").alias("current"))
    own = lambda df, cls, pos, ch: df.select("char_id", F.lit(cls).alias("cls"), pos.alias("pos"), ch.alias("ch"))
    position = lambda *cols: F.struct(*cols)
    zero, none = F.lit(0.0), F.lit("")
    ranked_head = own(head, 0, position(F.col("rank").cast("double").alias("a"), none.alias("b")), F.col("ch"))
    itself = own(current, 1, position(zero.alias("a"), none.alias("b")), F.col("current"))
    # both generated groups depend on the character alone: build them once per character
    distinct = current.select(F.col("current").alias("src")).distinct()
    allowed = distinct.join(discriminating.select(F.col("item").alias("src")), "src", "left_semi")
    around = near.filter(F.col("fraction") >= fx.MIN_IDF_FRACTION).join(allowed, "src", "left_semi").select(
        "src", F.lit(2).alias("cls"), position((-F.col("fraction")).alias("a"), F.col("dst").alias("b")).alias("pos"), F.col("dst").alias("ch")
    )
    old = forms.withColumnRenamed("canonical", "src").join(distinct, "src", "left_semi").select(
        "src", F.lit(3).alias("cls"), F.explode("variants").alias("ch")
    ).select("src", "cls", position(zero.alias("a"), F.col("ch").alias("b")).alias("pos"), "ch")
    generated = current.withColumnRenamed("current", "src").join(around.unionByName(old), "src").select(
        "char_id", "cls", "pos", "ch"
    )
    # one shuffle by character serves all that follows
    rows = ranked_head.unionByName(itself).unionByName(generated).repartition("char_id")
    first = rows.groupBy("char_id", "ch").agg(F.min(F.struct("cls", "pos")).alias("m")).select(
        "char_id", "ch", "m.cls", "m.pos"
    )
    place = F.row_number().over(Window.partitionBy("char_id", "cls").orderBy("pos"))
    cap = F.when(F.col("cls") == 2, fx.MAX_COMPONENT_SUGGESTIONS).when(F.col("cls") == 3, fx.MAX_VARIANT_SUGGESTIONS)
    kept = first.withColumn("_n", place).filter(cap.isNull() | (F.col("_n") <= cap))
    order = F.row_number().over(Window.partitionBy("char_id").orderBy("cls", "pos")) - 1
    source = F.when(F.col("cls") <= 1, "head").when(F.col("cls") == 2, "components").otherwise("variant")
    return kept.select("char_id", order.alias("ord"), "ch", source.alias("source"))
