"""The published dictionary store.

Layout under one path: ``entries/dictionary_id=N``, ``tags/dictionary_id=N`` and
``meta/version=V``.  Readers take the newest meta version, so a dictionary
appears, changes or disappears in one step, after its rows are in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions.tables import small_table, written

META = "id bigint, name string, priority int, enabled boolean, built_in boolean, catalog_id string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _meta_version(spark: SparkSession, store: str) -> int:
    if not _exists(spark, f"{store}/meta"):
        return 0
    return spark.read.parquet(f"{store}/meta").agg(F.max("version")).first()[0] or 0


def read_meta(spark: SparkSession, store: str) -> DataFrame:
    """The newest meta table."""
    version = _meta_version(spark, store)
    if version == 0:
        return small_table(spark, [], META)
    return spark.read.parquet(f"{store}/meta").filter(F.col("version") == version).drop("version")


def read_entries(spark: SparkSession, store: str) -> DataFrame:
    """Entries of the dictionaries the meta table names."""
    return spark.read.parquet(f"{store}/entries").join(
        read_meta(spark, store).select(F.col("id").alias("dictionary_id")), "dictionary_id", "left_semi"
    )


def _write_meta(spark: SparkSession, store: str, meta: DataFrame, version: int) -> None:
    meta.coalesce(1).write.mode("overwrite").parquet(f"{store}/meta/version={version}")


def publish_dictionary(
    spark: SparkSession, store: str, title: str, entries: DataFrame, tags: DataFrame,
    catalog_id: str | None = None, built_in: bool = False,
) -> int:
    """Publish one dictionary, replacing the one of the same title.

    Rows first, the meta row last; running it again after a failure gives the
    same store.  Returns the dictionary id.
    """
    version = _meta_version(spark, store)
    # the meta table is one row per dictionary, a bounded dimension
    kept = [r.asDict() for r in read_meta(spark, store).collect() if r["name"] != title]
    used = [r["id"] for r in read_meta(spark, store).select("id").collect()]
    new_id = max(used, default=0) + 1
    priority = max((r["priority"] for r in kept), default=-1) + 1
    for rows, name in ((entries, "entries"), (tags, "tags")):
        rows.drop("dictionary_id").write.mode("overwrite").parquet(f"{store}/{name}/dictionary_id={new_id}")
    row = {"id": new_id, "name": title, "priority": priority, "enabled": True, "built_in": built_in, "catalog_id": catalog_id}
    names = [c.split(" ")[0] for c in META.split(", ")]
    rows = [tuple(r[n] for n in names) for r in [*kept, row]]
    _write_meta(spark, store, small_table(spark, rows, META), version + 1)
    return new_id


def apply_dictionary_changes(meta: DataFrame, changes: DataFrame) -> DataFrame:
    """The meta table after a change feed.

    ``changes(seq, id, op, value)`` with ``op`` rename, enable, priority or delete;
    the last change of a kind wins, a delete of a built-in row is refused.
    """
    latest = lambda op: F.max_by(F.when(F.col("op") == op, F.col("value")), F.when(F.col("op") == op, F.col("seq")))
    last = changes.groupBy("id").agg(
        latest("rename").alias("_name"), latest("enable").alias("_enabled"), latest("priority").alias("_priority")
    )
    gone = changes.filter("op = 'delete'").join(meta.filter("built_in").select("id"), "id", "left_anti").select("id").distinct()
    d = meta.join(gone, "id", "left_anti").join(last, "id", "left")
    return d.select(
        "id",
        F.coalesce("_name", "name").alias("name"),
        F.coalesce(F.col("_priority").cast("int"), "priority").alias("priority"),
        F.coalesce(F.col("_enabled").cast("boolean"), "enabled").alias("enabled"),
        "built_in",
        "catalog_id",
    )


def move_dictionary(meta: DataFrame, dictionary_id: int, up: bool) -> DataFrame:
    """Swap priorities with the neighbour in priority order; at the end of the order nothing moves."""
    place = F.struct("priority", "id")
    own = meta.filter(F.col("id") == dictionary_id).select("priority", "id").first()
    if own is None:
        return meta
    here = F.struct(F.lit(own["priority"]).cast("int").alias("priority"), F.lit(own["id"]).cast("bigint").alias("id"))
    side = meta.filter(place < here).agg(F.max(place).alias("p")) if up else meta.filter(place > here).agg(F.min(place).alias("p"))
    other = side.first()["p"]
    if other is None:
        return meta
    swapped = F.when(F.col("id") == own["id"], F.lit(other["priority"])).when(F.col("id") == other["id"], F.lit(own["priority"]))
    return meta.withColumn("priority", F.coalesce(swapped.cast("int"), "priority"))


def change_dictionaries(spark: SparkSession, store: str, changes: DataFrame, moves: list[tuple[int, bool]] = ()) -> DataFrame:
    """S11 on the store: apply a change feed, then moves ``(id, up)``, as one new meta version.

    A deleted dictionary's entries and tags are gone with its row; ``remove_unused`` frees their files.
    """
    version = _meta_version(spark, store)
    meta = apply_dictionary_changes(read_meta(spark, store), changes)
    for dictionary_id, up in moves:
        meta = move_dictionary(meta, dictionary_id, up)
    # one row per dictionary
    _write_meta(spark, store, small_table(spark, [tuple(r) for r in meta.collect()], META), version + 1)
    return read_meta(spark, store)


def remove_unused(spark: SparkSession, store: str) -> list[int]:
    """Delete the files of dictionaries that the newest meta table no longer names; returns their ids."""
    named = {r["id"] for r in read_meta(spark, store).select("id").collect()}
    gone = set()
    for name in ("entries", "tags"):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{name}")
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            folder = status.getPath().getName()
            if folder.startswith("dictionary_id=") and int(folder.partition("=")[2]) not in named:
                fs.delete(status.getPath(), True)
                gone.add(int(folder.partition("=")[2]))
    return sorted(gone)


def dictionary_listing(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Dictionaries with their entry counts."""
    n = entries.groupBy(F.col("dictionary_id").alias("id")).agg(F.count(F.lit(1)).alias("n_entries"))
    return meta.join(n, "id", "left").na.fill({"n_entries": 0})


def evolve_schema(meta: DataFrame) -> DataFrame:
    """Bring an older meta table up to date."""
    have = set(meta.columns)
    d = meta if "built_in" in have else meta.withColumn("built_in", F.lit(False))
    d = d if "catalog_id" in have else d.withColumn("catalog_id", F.lit(None).cast("string"))
    keeps: Column = F.col("catalog_id").eqNullSafe(F.lit(fx.LEGACY_BUILT_IN_ID))
    return d.withColumn("built_in", F.coalesce("built_in", F.lit(False)) & keeps)


SAMPLE_PREFIX = "ocr_line_"
#: Parts of a line dataset: what a correction rewrites.
DATASET_BUCKETS = 64
_DATASET = "name string, page_id long, line_idx long, text string, bucket int"


def _page_bucket(page: str = "page_id") -> Column:
    return F.pmod(F.xxhash64(F.col(page).cast("long")), F.lit(DATASET_BUCKETS)).cast("int")


def export_line_dataset(lines: DataFrame, path: str) -> None:
    """One labelled record per recognised line, by page bucket."""
    name = F.concat(F.lit(SAMPLE_PREFIX), F.col("page_id").cast("string"), F.lit("_"), F.col("line_idx").cast("string"))
    rows = lines.select(name.alias("name"), F.col("page_id").cast("long").alias("page_id"), F.col("line_idx").cast("long").alias("line_idx"), "text")
    rows.withColumn("bucket", _page_bucket()).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)


def correct_line_dataset(spark: SparkSession, path: str, corrections: DataFrame) -> list[int]:
    """Labels follow later corrections ``(page_id, line_idx, idx, ch, version)`` (D15); returns the buckets rewritten.

    Only the buckets of corrected pages are read and replaced.  The new rows are written elsewhere first, so a failure leaves
    either a bucket's old files or its new ones; running it again gives the same labels.  Lines the dataset does not
    have and positions a line does not have are ignored.
    """
    last = corrections.groupBy("page_id", "line_idx", "idx").agg(F.max_by("ch", "version").alias("ch")).filter("ch is not null")
    fixed = last.groupBy("page_id", "line_idx").agg(F.map_from_entries(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "ch"))).alias("_new"))
    fixed = written(fixed.withColumn("bucket", _page_bucket()), "line-corrections")
    touched = sorted(r["bucket"] for r in fixed.select("bucket").distinct().collect())
    if not touched:
        return []
    old = spark.read.schema(_DATASET).parquet(path).filter(F.col("bucket").isin(touched))
    chars = F.filter(F.split("text", ""), lambda c: c != "")
    new = F.array_join(F.transform(chars, lambda c, i: F.coalesce(F.element_at("_new", i), c)), "")
    rows = old.join(fixed, ["page_id", "line_idx", "bucket"], "left").withColumn("text", F.when(F.col("_new").isNull(), F.col("text")).otherwise(new))
    staged = written(rows.select("name", "page_id", "line_idx", "text", "bucket"), "line-dataset")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def list_inputs(files: DataFrame) -> DataFrame:
    """Image files to read next, without the samples a run wrote itself."""
    base = F.element_at(F.split("path", "/"), -1)
    image = F.lower(F.element_at(F.split(base, "\\."), -1)).isin("png", "jpg", "jpeg", "bmp", "webp")
    return files.filter(image & base.contains(".") & ~base.startswith(SAMPLE_PREFIX))
