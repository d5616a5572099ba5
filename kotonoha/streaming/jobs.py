"""Structured Streaming jobs.

Each job keeps its tables as runs by batch id (``sources/runs.py``), so a replayed batch overwrites its own output and
nothing else, and what a batch reads and writes does not grow with the batches before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kotonoha.functions.tables import written
from kotonoha.operators import lookup, ngram
from kotonoha.sources import banks
from kotonoha.sources.runs import RunStore, newest
from kotonoha.sources import store as dictionaries


def _run(stream: DataFrame, each, checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


# -- T01: lines of pages -------------------------------------------------------

LINES = "page_id long, line_idx long, version long, batch_id long, text string, is_vertical boolean, bucket int"
PAGES = "page_id long, batch_id long, line_idx long, start long, text string, bucket int"
#: Folders of a run.  Files inside are ordered by page, so the folders bound what a batch opens, not what it reads.
PAGE_BUCKETS = 16


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int")


def _line_store(spark: SparkSession, store: str) -> RunStore:
    # of equal versions that of the later batch stands
    merge = lambda d: newest(d, ["page_id", "line_idx", "bucket"], ["version", "batch_id", "text", "is_vertical"])
    return RunStore(spark, f"{store}/lines", LINES, merge, ["bucket"], ["page_id"])


def _last_pages(pages: DataFrame) -> DataFrame:
    """The lines of each page as its last batch left them."""
    last = pages.groupBy("page_id", "bucket").agg(F.max("batch_id").alias("batch_id"))
    return pages.join(last, ["page_id", "bucket", "batch_id"])


def _page_store(spark: SparkSession, store: str) -> RunStore:
    return RunStore(spark, f"{store}/pages", PAGES, _last_pages, ["bucket"], ["page_id"])


def current_lines(spark: SparkSession, store: str) -> DataFrame:
    """The newest version of every line seen so far."""
    return _line_store(spark, store).read().select("page_id", "line_idx", "text", "is_vertical")


def current_chars(spark: SparkSession, store: str) -> DataFrame:
    """The character stream of every page as of the batch that touched it last."""
    pages = _page_store(spark, store).read()
    chars = pages.select("page_id", "line_idx", "start", F.posexplode(F.split("text", "")).alias("char_idx", "ch"))
    return chars.select("page_id", (F.col("start") + F.col("char_idx")).alias("gidx"), "line_idx", "char_idx", "ch")


def stream_line_results(stream: DataFrame, store: str, checkpoint: str, once: bool = True, buckets: int = PAGE_BUCKETS):
    """Lines arrive in any order and may be revised.

    ``stream(page_id, line_idx, version, text, is_vertical)``.  Each batch keeps the last version of its lines and
    rebuilds the page index of the pages it touched, and of no others: it reads those pages' rows of a few runs.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        lines, pages = _line_store(spark, store), _page_store(spark, store)
        rows = batch.select(
            F.col("page_id").cast("long").alias("page_id"), F.col("line_idx").cast("long").alias("line_idx"), F.col("version").cast("long").alias("version"),
            "text", "is_vertical",
        ).withColumns({"batch_id": F.lit(batch_id).cast("long"), "bucket": _bucket(buckets)})
        own = lines.add(batch_id, rows)
        touched = written(own.select("page_id", "bucket").distinct(), "touched-pages")
        places = [r["bucket"] for r in touched.select("bucket").distinct().collect()]
        ends = touched.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high")).first()
        # folder and file statistics leave out most of what other pages have; the join the rest
        near = lines.stored(batch_id).filter(F.col("bucket").isin(places) & F.col("page_id").between(ends["low"], ends["high"]))
        now = lines.merge(near.join(touched, ["page_id", "bucket"], "left_semi"))
        offsets = lookup.line_offsets(now).select("page_id", "bucket", "line_idx", "start", "text")
        # a page whose lines are all empty has no rows: it had none before either, or one marks that
        bare = touched.join(offsets.select("page_id").distinct(), "page_id", "left_anti")
        bare = bare.select("page_id", "bucket", F.lit(None).cast("long").alias("line_idx"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("text"))
        pages.add(batch_id, offsets.unionByName(bare).withColumn("batch_id", F.lit(batch_id).cast("long")))

    return _run(stream, each, checkpoint, once)


# -- T02: banks ----------------------------------------------------------------

LANDED = "archive string, kind string, bank_ord long, title string, banks long, content long, batch_id long"


def _landed_store(spark: SparkSession, store: str) -> RunStore:
    merge = lambda d: newest(d, ["archive", "kind", "bank_ord"], ["batch_id", "content", "title", "banks"])
    return RunStore(spark, f"{store}/landed", LANDED, merge, (), ["archive"])


def stream_banks(stream: DataFrame, store: str, checkpoint: str, once: bool = True, library: str | None = None):
    """Bank documents ingested as they land, and dictionaries published once they are complete.

    ``stream`` carries the document columns.  Entries first, then the batch report; a batch without its report is not
    complete and is written again.  With ``library``, the path of a dictionary store, the stream also carries ``banks``, the
    number of bank documents of the archive: when the last of them has landed, in any order, the archive is published
    there, its meta row last.  A bank that lands again replaces the earlier one; if its text is the same, nothing is
    published anew.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        part = f"batch_id={batch_id}"
        # the stream's source is read once; what follows reads this copy
        kept = batch.filter("kind is not null")
        if library is not None:
            # of a bank that is twice in a batch one counts
            kept = newest(kept, ["archive", "kind", "bank_ord"], ["text", "name", "title", "banks"]).select(*batch.columns)
        kept.write.mode("overwrite").parquet(f"{store}/documents/{part}")
        docs = spark.read.schema(batch.schema).parquet(f"{store}/documents/{part}")
        bad = banks.malformed_documents(docs)
        bad.write.mode("overwrite").parquet(f"{store}/quarantine/{part}")
        good = docs.join(bad.select("archive", "bank_ord", "kind"), ["archive", "bank_ord", "kind"], "left_anti")
        # by archive, so that one dictionary is read back alone
        banks.ingest_banks(good).withColumn("of", F.xxhash64("archive")).write.mode("overwrite").partitionBy("of").parquet(f"{store}/entries/{part}")
        banks.ingest_tag_banks(good).withColumn("of", F.xxhash64("archive")).write.mode("overwrite").partitionBy("of").parquet(f"{store}/tags/{part}")
        landed = _stored(spark, store, "entries").filter(F.col("batch_id") == batch_id)
        banks.import_report(good, landed).write.mode("overwrite").parquet(f"{store}/report/{part}")
        if library is not None:
            _publish_complete(spark, store, library, docs, batch_id)

    return _run(stream, each, checkpoint, once)


_COLUMNS = {
    "entries": "archive string, bank_ord long, id long, kanji string, reading string, definitions string, rules string, popularity int, "
               "onyomi string, kunyomi string, jlpt string",
    "tags": "archive string, bank_ord long, row int, name string, category string, order_val int, notes string, popularity int",
}


def _stored(spark: SparkSession, store: str, name: str) -> DataFrame:
    return spark.read.schema(f"{_COLUMNS[name]}, batch_id long, of long").parquet(f"{store}/{name}")


def _publish_complete(spark: SparkSession, store: str, library: str, docs: DataFrame, batch_id: int) -> None:
    landed = _landed_store(spark, store)
    state = docs.select(
        "archive", "kind", "bank_ord", "title", F.col("banks").cast("long").alias("banks"), F.xxhash64("text", "name").alias("content"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )
    touched = landed.add(batch_id, state).select("archive").distinct()
    now = landed.read(batch_id).join(touched, "archive", "left_semi")
    totals = now.groupBy("archive").agg(
        F.max("title").alias("title"), F.count(F.lit(1)).alias("landed"), F.max("banks").alias("banks"),
        F.sum(F.xxhash64("kind", "bank_ord", "content").cast("decimal(38,0)")).cast("string").alias("content"),
    )
    # one row per archive of this batch, a bounded dimension
    complete = sorted(totals.filter("landed = banks").collect(), key=lambda r: r["archive"])
    marks = f"{store}/published"
    known = {}
    if dictionaries._exists(spark, marks):
        known = {r["archive"]: r["content"] for r in newest(spark.read.parquet(marks), ["archive"], ["batch_id", "content"]).collect()}
    for r in complete:
        if known.get(r["archive"]) == r["content"]:
            continue
        current = now.filter(F.col("archive") == r["archive"])
        of = spark.range(1).select(F.xxhash64(F.lit(r["archive"]))).first()[0]
        rows = {}
        for name, kinds in (("entries", "kind <> 'tag'"), ("tags", "kind = 'tag'")):
            own = _stored(spark, store, name).filter(F.col("of") == of)
            named = current.filter(kinds).select("archive", "bank_ord", "batch_id")
            rows[name] = own.join(named, ["archive", "bank_ord", "batch_id"], "left_semi").drop("of", "batch_id")
        dictionaries.publish_dictionary(spark, library, r["title"], rows["entries"], rows["tags"])
        # after the meta row; a replay in between publishes the same rows under the same title again
        mark = spark.createDataFrame([(r["archive"], batch_id, r["content"])], "archive string, batch_id long, content string")
        mark.coalesce(1).write.mode("append").parquet(marks)


# -- T03: counts ---------------------------------------------------------------


def _count_store(spark: SparkSession, store: str) -> RunStore:
    merge = lambda d: d.groupBy("ngram").agg(F.sum("cnt").alias("cnt"))
    return RunStore(spark, f"{store}/counts", "ngram string, cnt long", merge)


def stream_ngrams(stream: DataFrame, store: str, checkpoint: str, once: bool = True, text: str = "text"):
    """Raw n-gram counts of each batch, additive over batches and merged by size."""

    def each(batch: DataFrame, batch_id: int) -> None:
        _count_store(batch.sparkSession, store).add(batch_id, ngram.raw_ngram_counts(batch, text))

    return _run(stream, each, checkpoint, once)


def published_ngrams(spark: SparkSession, store: str) -> DataFrame:
    """The model as of now; pruning and saturation happen only here."""
    return ngram.publish_ngrams(_count_store(spark, store).read())
