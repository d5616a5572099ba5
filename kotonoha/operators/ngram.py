"""Character n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.functions.tables import written

SUPPLEMENTARY = "[\\x{10000}-\\x{10FFFF}]"
#: Characters of text whose windows are counted together before Spark adds them up.
COUNTED_CHARS = 1 << 21
#: Codes up to which places of an array are used in place of sorting.
DENSE = 1 << 24
#: Rows that a task gives back at a time.
OUT_ROWS = 1 << 16


def _with_windows(texts: DataFrame, text: str, before: int, after: int, out: str) -> DataFrame:
    """Per character the string from ``before`` places before it to ``after``
    places after it, cut at the ends.  Linear in the length of the text."""

    def at(_: Column, i: Column) -> Column:
        return F.concat(*[F.coalesce(F.get("_chars", i + k), F.lit("")) for k in range(-before, after + 1)])

    return (
        texts.filter(F.length(text) > 0)
        .withColumn("_chars", tx.chars_of(F.col(text)))
        .withColumn(out, F.explode(F.transform("_chars", at)))
        .drop("_chars")
    )


def document_windows(texts: DataFrame, key: str, text: str = "text", max_order: int = fx.MAX_ORDER) -> DataFrame:
    """``(key, window, n)``: each document's characters with up to ``max_order - 1`` before them, counted in arrays where the document is.

    Model counts, distinct windows and the mass all follow from this table; write it if more than one is needed.  Rows of
    one key are counted apart and have to be added up.
    """
    rows = texts.filter(F.length(text) > 0).select(F.col(text).alias("text"), key)
    schema = StructType([StructField("key", rows.schema[key].dataType), StructField("window", StringType()), StructField("n", LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, size = 0, 0
            for i, chars in enumerate(pc.utf8_length(batch.column(0)).to_pylist()):
                size += chars
                if size >= COUNTED_CHARS or i == batch.num_rows - 1:
                    held = batch.slice(low, i + 1 - low)
                    yield from _counted_apart(held.column(0).to_pylist(), held.column(1), max_order)
                    low, size = i + 1, 0

    return rows.mapInArrow(count, schema).withColumnRenamed("key", key)


def counts_of_windows(windows: DataFrame) -> DataFrame:
    """Counts of all n-grams from ``(window, n)``: an n-gram ends at some character, and is an end of its window.

    Windows are added up first, so the second step has the size of the vocabulary.
    """
    distinct = windows.groupBy("window").agg(F.sum("n").alias("n"))
    ends = F.transform(F.sequence(F.lit(1), F.length("window")), lambda n: F.right(F.col("window"), n))
    return distinct.select(F.explode(ends).alias("ngram"), "n").groupBy("ngram").agg(F.sum("n").alias("cnt"))


def _numbered(key: np.ndarray) -> np.ndarray:
    """Codes as dense numbers, in the same order."""
    if int(key.max()) >= DENSE:
        return np.unique(key, return_inverse=True)[1].astype(np.int64)
    return (np.cumsum(np.bincount(key) > 0) - 1)[key]


def _window_codes(texts: list[str], max_order: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and the window of each character as numbers, and the windows."""
    # one place before each text, which no window takes in
    whole = "".join(f" {t}" for t in texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    at = np.ones(len(whole), dtype=bool)
    at[starts] = False
    # 0 stands for no character, so that windows of all lengths have codes of their own
    ids = _numbered(np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)) + 1
    key, wide, inside = ids, int(ids.max()) + 1, at.copy()
    for k in range(1, max_order):
        # the character k places before, as long as its text has one
        inside[k:] &= at[:-k]
        inside[:k] = False
        older = np.zeros_like(ids)
        older[k:] = np.where(inside[k:], ids[:-k], 0)
        key = _numbered(key * wide + older)
    places = np.flatnonzero(at)
    own = _numbered(key[places])
    example = np.zeros(int(own.max()) + 1, dtype=np.int64)
    example[own] = places
    owner = np.searchsorted(starts, places) - 1
    begin = np.maximum(example - max_order + 1, starts[np.searchsorted(starts, example) - 1] + 1)
    return owner, own, [whole[b:e] for b, e in zip(begin.tolist(), (example + 1).tolist())]


def _counted(texts: list[str], max_order: int) -> pa.RecordBatch:
    """``(window, n)`` of some texts, each window once."""
    _, own, windows = _window_codes(texts, max_order)
    return pa.RecordBatch.from_arrays([pa.array(windows, pa.string()), pa.array(np.bincount(own), pa.int64())], ["window", "n"])


def _counted_apart(texts: list[str], names: pa.Array, max_order: int) -> Iterator[pa.RecordBatch]:
    """``(key, window, n)`` of some texts, each window once a text."""
    owner, own, windows = _window_codes(texts, max_order)
    words, (pairs, n) = pa.array(windows, pa.string()), np.unique(owner * len(windows) + own, return_counts=True)
    for low in range(0, len(pairs), OUT_ROWS):
        some = pairs[low : low + OUT_ROWS]
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(some // len(windows))), words.take(pa.array(some % len(windows))), pa.array(n[low : low + OUT_ROWS], pa.int64())],
            ["key", "window", "n"],
        )


def text_windows(texts: DataFrame, text: str = "text", max_order: int = fx.MAX_ORDER) -> DataFrame:
    """``(window, n)``: windows of all texts, counted by some millions of characters; a window has several rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for value in batch.column(0):
                held.append(value.as_py())
                size += len(held[-1])
                if size >= COUNTED_CHARS:
                    yield _counted(held, max_order)
                    held, size = [], 0
        if held:
            yield _counted(held, max_order)

    return texts.filter(F.length(text) > 0).select(text).mapInArrow(count, "window string, n long")


def raw_ngram_counts(texts: DataFrame, text: str = "text", max_order: int = fx.MAX_ORDER) -> DataFrame:
    """Counts of all 1..max_order-grams; windows are counted in tasks before the shuffle."""
    return counts_of_windows(text_windows(texts, text, max_order))


def publish_ngrams(counts: DataFrame, max_order: int = fx.MAX_ORDER, min_count_top: int = fx.MIN_COUNT_TOP) -> DataFrame:
    """Prune and saturate: rare n-grams go at the highest order only, n-grams
    with supplementary characters always, and counts stop at 65535."""
    n = F.length("ngram")
    return counts.filter(
        ((n < max_order) | (F.col("cnt") >= min_count_top)) & ~F.col("ngram").rlike(SUPPLEMENTARY)
    ).select("ngram", n.alias("n"), F.least(F.col("cnt"), F.lit(fx.COUNT_CEILING)).alias("cnt"))


def build_ngrams(
    texts: DataFrame, text: str = "text", max_order: int = fx.MAX_ORDER, min_count_top: int = fx.MIN_COUNT_TOP
) -> DataFrame:
    """The model table ``(ngram, n, cnt)``."""
    return publish_ngrams(raw_ngram_counts(texts, text, max_order), max_order, min_count_top)


def corpus_mass(texts: DataFrame, text: str = "text") -> DataFrame:
    """The number of corpus characters, one row."""
    return texts.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("mass"))


def ngram_counts(queries: DataFrame, ngrams: DataFrame) -> DataFrame:
    """The count of each queried n-gram, 0 where the model has none."""
    return queries.join(ngrams.select("ngram", F.col("cnt").alias("_cnt")), "ngram", "left").withColumn(
        "cnt", F.coalesce("_cnt", F.lit(0))
    ).drop("_cnt")


def log_probs(windows: DataFrame, ngrams: DataFrame, mass: DataFrame) -> DataFrame:
    """ln P(last character | the characters before it) per distinct window.

    A window is up to three context characters and the character itself.  The
    longest order with a known joint and a known context decides; then the
    unigram prior; then the floor.  All needed n-grams of a window are looked
    up by one join.
    """
    w = F.col("window")
    orders = F.sequence(F.lit(1), F.least(F.length(w), F.lit(fx.MAX_ORDER)))
    joint = F.transform(orders, lambda n: F.struct(n.alias("n"), F.lit(True).alias("joint"), F.right(w, n).alias("ngram")))
    context = F.transform(
        F.filter(orders, lambda n: n > 1),
        lambda n: F.struct(n.alias("n"), F.lit(False).alias("joint"), F.left(F.right(w, n), n - 1).alias("ngram")),
    )
    needed = windows.select("window").distinct().select("window", F.inline(F.concat(joint, context)))
    found = needed.join(ngrams.select("ngram", "cnt"), "ngram", "left")
    pick = lambda is_joint, n: F.max(
        F.when((F.col("joint") == is_joint) & (F.col("n") == n), F.col("cnt"))
    )
    wide = found.groupBy("window").agg(
        *[pick(True, n).alias(f"j{n}") for n in range(1, fx.MAX_ORDER + 1)],
        *[pick(False, n).alias(f"c{n}") for n in range(2, fx.MAX_ORDER + 1)],
    )
    # a one-row table: joined by its only row, bounded by construction
    wide = wide.join(mass.select("mass"), F.lit(True))
    backed_off = [
        F.when((F.col(f"j{n}") > 0) & (F.col(f"c{n}") > 0), F.ln(F.col(f"j{n}") / F.col(f"c{n}")))
        for n in range(fx.MAX_ORDER, 1, -1)
    ]
    prior = F.when((F.col("j1") > 0) & (F.col("mass") > 0), F.ln(F.col("j1") / F.col("mass")))
    return wide.select("window", F.coalesce(*backed_off, prior, F.lit(fx.UNSEEN_LOG_PROB)).alias("log_prob"))


def score_text(texts: DataFrame, key: str, ngrams: DataFrame, mass: DataFrame, text: str = "text") -> DataFrame:
    """Mean log probability per document.

    Windows are counted per document and scored once each.
    """
    return score_windows(written(document_windows(texts, key, text), "windows"), key, ngrams, mass)


def score_windows(per_doc: DataFrame, key: str, ngrams: DataFrame, mass: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """M03 from the counted windows of documents; ``distinct`` holds the windows once each, where they are known."""
    # the side of the vocabulary is hashed, so the windows of all documents are dealt but never sorted
    probs = log_probs(per_doc if distinct is None else distinct, ngrams, mass).hint("shuffle_hash")
    scored = per_doc.join(probs, "window")
    return scored.groupBy(key).agg(
        F.sum("n").alias("n_chars"), (F.sum(F.col("log_prob") * F.col("n")) / F.sum("n")).alias("mean_log_prob")
    )


def score_candidates(pools: DataFrame, ngrams: DataFrame, mass: DataFrame) -> DataFrame:
    """Add ``log_prob`` to pool rows carrying ``context`` and ``ch``."""
    rows = pools.withColumn("window", F.concat(F.right("context", F.lit(fx.MAX_ORDER - 1)), "ch"))
    return rows.join(log_probs(rows, ngrams, mass), "window").drop("window")


def rank_candidates(pools: DataFrame, ngrams: DataFrame, mass: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates per context best first; ties keep ``pos`` order."""
    w = Window.partitionBy(*keys).orderBy(F.desc("log_prob"), "pos")
    return score_candidates(pools, ngrams, mass).withColumn("rank", F.row_number().over(w) - 1)


def context_before(text: Column, index: Column) -> Column:
    """Up to three characters before ``index``, stopping at the gap character."""
    head = F.right(F.left(text, index), F.lit(fx.MAX_ORDER - 1))
    return F.substring_index(head, fx.GAP_CHAR, -1)


def line_pools(timesteps: DataFrame) -> DataFrame:
    """Offerable characters of each line in first-seen order (``first``)."""
    offered = timesteps.filter(
        (F.col("ch") != fx.GAP_CHAR)
        & ~F.col("ch").rlike("(?U)^[\\s\\u0085\\u00a0\\u3000]")
        & ~F.col("ch").rlike("^\\p{Cc}")
    )
    return offered.groupBy("line_id", "ch").agg(F.min(F.struct("t", "rank")).alias("first"))


def gap_candidates(
    gaps: DataFrame,
    timesteps: DataFrame,
    ngrams: DataFrame | None = None,
    mass: DataFrame | None = None,
    limit: int = fx.GAP_LIMIT,
) -> DataFrame:
    """Candidates for each gap from its line's evidence.

    ``gaps`` carries ``gap_id``, ``line_id``, ``text`` and ``insert_at``.  Gaps of
    a line that share a context share one ranking.
    """
    asked = gaps.select("gap_id", "line_id", context_before(F.col("text"), F.col("insert_at")).alias("context"))
    pools = line_pools(timesteps)
    if ngrams is None:
        w = Window.partitionBy("line_id").orderBy("first")
        best = pools.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < limit)
        return asked.join(best.select("line_id", "ch", "rank"), "line_id").select("gap_id", "rank", "ch")
    contexts = asked.select("line_id", "context").distinct()
    ranked = rank_candidates(
        contexts.join(pools, "line_id").withColumnRenamed("first", "pos"), ngrams, mass, ["line_id", "context"]
    ).filter(F.col("rank") < limit)
    return asked.join(ranked.select("line_id", "context", "ch", "rank"), ["line_id", "context"]).select(
        "gap_id", "rank", "ch"
    )


def gap_fallback(
    gaps: DataFrame,
    timesteps: DataFrame,
    ngrams: DataFrame | None = None,
    mass: DataFrame | None = None,
    limit: int = fx.GAP_LIMIT,
) -> DataFrame:
    """Defaults for gaps whose line offers nothing.  Punctuation always
    comes before kana; the model orders only within a class."""
    empty = gaps.join(line_pools(timesteps).select("line_id").distinct(), "line_id", "left_anti")
    defaults = F.array(*[
        F.struct(F.lit(cls).alias("cls"), F.lit(pos).alias("pos"), F.lit(ch).alias("ch"))
        for cls, chars in enumerate((fx.FALLBACK_PUNCTUATION, fx.FALLBACK_KANA))
        for pos, ch in enumerate(chars)
    ])
    asked = empty.select("gap_id", context_before(F.col("text"), F.col("insert_at")).alias("context"))
    if ngrams is None:
        ranked = asked.select("context").distinct().select("context", F.inline(defaults)).withColumn("in_class", F.col("pos"))
    else:
        pool = asked.select("context").distinct().select("context", F.inline(defaults))
        ranked = rank_candidates(pool, ngrams, mass, ["context", "cls"]).withColumnRenamed("rank", "in_class")
    order = F.when(F.col("cls") == 0, F.col("in_class")).otherwise(
        F.col("in_class") + F.lit(len(fx.FALLBACK_PUNCTUATION))
    )
    return asked.join(ranked, "context").select("gap_id", order.alias("rank"), "ch").filter(F.col("rank") < limit)
