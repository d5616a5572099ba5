"""Corpus dictionary lookup.

The unit of work is a table of text lines, not a cursor position.  Keys and
derivations are computed once per distinct surface; entries are reached through
one equi-join on an exploded key, never through an OR condition.  No join
carries a broadcast hint: Spark broadcasts a side by its measured size only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.functions.tables import dealt, written
from kotonoha.operators import keys, ordered

PAGE = ["page_id"]
RANGE_BLOCK = 4096
#: Characters of a page whose requests for matched text travel together.
REQUEST_BLOCK = 1024
#: Characters of a page up to which its windows are made and compared where its lines are.
PAGE_CHARS = 1 << 20


# -- L01, L02, L03: the page stream -------------------------------------------


def line_offsets(lines: DataFrame) -> DataFrame:
    """Lines that carry text, with ``start`` (page index of their first
    character) and ``ordinal`` (dense position among such lines)."""
    present = lines.filter(F.length("text") > 0)
    return ordered.prefix_sums(
        present, PAGE, "line_idx", {"start": F.length("text").cast("long"), "ordinal": F.lit(1).cast("long")}
    )


def char_stream(lines: DataFrame) -> DataFrame:
    """One row per character with its page-wide index."""
    return line_offsets(lines).select(
        "page_id", "line_idx", "start", F.posexplode(tx.chars_of(F.col("text"))).alias("char_idx", "ch")
    ).select("page_id", (F.col("start") + F.col("char_idx")).alias("gidx"), "line_idx", "char_idx", "ch")


def coordinates(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Inverse of L01: ``(page_id, gidx)`` to ``(line_idx, char_idx)``; other columns of ``positions`` are kept.

    A range join through blocks of the page index: a line is repeated once per
    block it touches, a position lies in one block.
    """
    block = lambda c: F.floor(c / F.lit(RANGE_BLOCK))
    spans = line_offsets(lines).withColumn("stop", F.col("start") + F.length("text"))
    spans = spans.select(
        "page_id", "line_idx", "start", "stop", F.explode(F.sequence(block(F.col("start")), block(F.col("stop") - 1))).alias("_b")
    )
    asked = dealt(positions.withColumn("_b", block(F.col("gidx"))))
    inside = (F.col("gidx") >= F.col("start")) & (F.col("gidx") < F.col("stop"))
    return asked.join(spans, ["page_id", "_b"]).filter(inside).select(
        *positions.columns, "line_idx", (F.col("gidx") - F.col("start")).cast("int").alias("char_idx")
    )


def _with_tail(offsets: DataFrame, width: int, text: str = "text") -> DataFrame:
    """Add ``tail``: the characters that follow each line on its page, enough
    for a window of ``width`` to start at the line's last character."""
    d, w = ordered.with_halo(offsets, PAGE, "ordinal", 0, width - 1)
    following = F.collect_list(F.left(F.col(text), F.lit(width))).over(w.rowsBetween(1, width - 1))
    d = d.withColumn("tail", F.left(F.array_join(following, ""), F.lit(width - 1)))
    return ordered.home_rows(d)


def query_windows(lines: DataFrame, width: int = fx.QUERY_WIDTH) -> DataFrame:
    """Per character the next ``width`` cells (``cells``) of the page, and
    the query text, which leaves out U+3000."""
    return _windows_of(_with_tail(line_offsets(lines), width), width)


def _windows_of(d: DataFrame, width: int) -> DataFrame:
    """The windows that start in lines with their ``tail``."""
    cells = tx.chars_of(F.concat("text", "tail"))
    starts = F.sequence(F.lit(1), F.length("text"))
    return (
        d.withColumn("_cells", cells)
        .select(
            "page_id",
            "start",
            F.posexplode(F.transform(starts, lambda p: F.array_join(F.slice("_cells", p, width), ""))).alias("_at", "cells"),
        )
        .select(
            "page_id",
            (F.col("start") + F.col("_at")).alias("gidx"),
            "cells",
            F.replace(F.col("cells"), F.lit(fx.FULL_SPACE), F.lit("")).alias("query"),
        )
    )


def live_characters(keyed: DataFrame, rules: DataFrame) -> str:
    """Characters that a surface with a match can have: those of lookup keys and rule suffixes, and any that a key stage changes.

    Any other stays in every key and in every derivation, so no term is reached.  There are no more than there are characters.
    """
    texts = keyed.select("term").union(rules.select("suffix_in"))
    found = texts.select(F.explode(tx.chars_of(F.col("term"))).alias("c")).distinct()
    return "".join(sorted({r["c"] for r in found.collect()} | set(tx.CHANGED)))


def live_windows(windows: DataFrame, keyed: DataFrame, rules: DataFrame) -> DataFrame:
    """Query texts up to the first character that no match can have; positions that begin with one are left out."""
    live = live_characters(keyed, rules)
    at = F.length(F.regexp_extract(F.translate("query", live, "\u0001" * len(live)), "^\u0001*", 0))
    return windows.filter(~F.col("cells").startswith(fx.FULL_SPACE)).withColumn("query", F.left("query", at)).filter("query <> ''")


#: Characters of a run, rows of a batch that a task hands on.
PIECE, OUT_ROWS = 64, 50_000


def _runs_in(text: str, tail: str, pattern: re.Pattern, width: int) -> Iterator[tuple[str, str]]:
    """``(run, more)`` of a line: what a match can lie in, in pieces, with the ``width - 1`` cells behind a piece."""
    space = fx.FULL_SPACE
    for m in pattern.finditer(text):
        run, more = m[0], ""
        if m.end() == len(text):
            ahead = pattern.match(tail)
            more = ahead[0].rstrip(space) if ahead else ""
        run = run.lstrip(space) if more else run.strip(space)
        if len(run) <= PIECE:
            if run:
                yield run, more
            continue
        whole = run + more
        for at in range(0, len(run), PIECE):
            end = min(at + PIECE, len(run))
            piece, behind = whole[at:end], whole[end : end + width - 1].rstrip(space)
            piece = piece.lstrip(space) if behind else piece.strip(space)
            if piece:
                yield piece, behind


def _counted_runs(live: str, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile("[" + "".join(map(re.escape, sorted({*live, fx.FULL_SPACE}))) + "]+")
        kind, page, counts, out = None, None, {}, ([], [], [], [])

        def put() -> None:
            for (run, more), n in counts.items():
                for column, value in zip(out, (page, run, more, n)):
                    column.append(value)
            counts.clear()

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(out[0], kind), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["page_id", "run", "more", "n"])
            for column in out:
                column.clear()
            return made

        for b in batches:
            kind = b.schema.field("page_id").type
            for at, text, tail in zip(*(b.column(c).to_pylist() for c in ("page_id", "text", "tail"))):
                if at != page or len(counts) >= OUT_ROWS:
                    put()
                    page = at
                    if len(out[0]) >= OUT_ROWS:
                        yield batch()
                for found in _runs_in(text, tail or "", pattern, width):
                    counts[found] = counts.get(found, 0) + 1
        put()
        if out[0]:
            yield batch()

    return scan


def live_runs(lines: DataFrame, live: str, width: int = fx.QUERY_WIDTH) -> DataFrame:
    """What windows are cut from, counted where the lines are: ``(page_id, run, more, n)``.

    A run is what lies between two characters that no match can have.  Windows begin in ``run``, which is of one line, and may
    reach into ``more``.  The windows of a text are those of its runs, as far as any match goes; equal runs need them once.
    """
    tailed = _with_tail(line_offsets(lines), width).select("page_id", "text", "tail")
    page = lines.schema["page_id"].dataType.simpleString()
    return tailed.mapInArrow(_counted_runs(live, width), f"page_id {page}, run string, more string, n long")


def run_windows(runs: DataFrame, width: int = fx.QUERY_WIDTH) -> DataFrame:
    """The windows that begin in each ``(run, more)``, without those that begin with U+3000: ``(run, more, cells, query)``."""
    whole = F.concat("run", "more")
    cells = F.transform(F.sequence(F.lit(1), F.length("run")), lambda p: F.substr(whole, p, F.lit(width)))
    each = runs.select("run", "more", F.explode(cells).alias("cells")).filter(~F.col("cells").startswith(fx.FULL_SPACE))
    return each.withColumn("query", F.replace(F.col("cells"), F.lit(fx.FULL_SPACE), F.lit("")))


def _shared_length(text: str, before: str, width: int) -> Column:
    """Characters that two texts begin with in common; none where there is no text before."""
    differs = [F.when(F.left(text, F.lit(i)) != F.left(before, F.lit(i)), i - 1) for i in range(1, width + 1)]
    return F.coalesce(*differs, F.when(F.col(before).isNotNull(), F.least(F.length(text), F.length(before))), F.lit(0))


def distinct_prefixes(queries: DataFrame, width: int = fx.QUERY_WIDTH) -> DataFrame:
    """Every prefix of distinct texts of up to ``width`` characters once: ``(surface)``.

    In order, a text has those prefixes of its own that are longer than what it shares with the one before, so that texts
    are shuffled and prefixes are not.
    """
    head = F.left("query", F.lit(2))
    before = queries.select("query", F.lag("query").over(Window.partitionBy(head).orderBy("query")).alias("_before"))
    first = F.greatest(_shared_length("query", "_before", width), F.lit(1)) + 1
    longer = before.withColumn("_first", first).filter(F.col("_first") <= F.length("query")).select(
        F.explode(F.transform(F.sequence("_first", F.length("query")), lambda i: F.left("query", i))).alias("surface")
    )
    return longer.unionByName(queries.select(F.left("query", F.lit(1)).alias("surface")).distinct())


def prefix_expand(windows: DataFrame, query: str = "query") -> DataFrame:
    """Every prefix of the query text, longest first."""
    q = F.col(query)
    return windows.filter(F.length(q) > 0).withColumn(
        "length", F.explode(F.sequence(F.length(q), F.lit(1), F.lit(-1)))
    ).withColumn("surface", F.left(q, F.col("length")))


def prefix_counts(lines: DataFrame, width: int = fx.QUERY_WIDTH, page_chars: int = PAGE_CHARS) -> DataFrame:
    """L02 and L03 counted per page: ``(page_id, length, n, n_distinct, first_surface, last_surface)``.

    Prefixes are never rows.  Of the distinct query texts of a page in order, one has those prefixes of its own that are longer than
    what it shares with the text before it.  Lines are dealt by page and their windows stay there; those of pages of more
    than ``page_chars`` characters are dealt by their first character too.
    """
    tailed = written(_with_tail(line_offsets(lines), width).select("page_id", "start", "text", "tail"), "tailed-lines")
    large = tailed.groupBy("page_id").agg(F.sum(F.length("text")).alias("n")).filter(F.col("n") > page_chars).select("page_id")
    large = written(large, "large-pages")
    if large.isEmpty():
        return _prefix_counts(_windows_of(tailed.repartition("page_id"), width), width)
    near = _prefix_counts(_windows_of(tailed.join(large, "page_id", "left_anti").repartition("page_id"), width), width)
    # not dealt by page: the first shuffle is by page and query text
    return near.unionByName(_prefix_counts(_windows_of(tailed.join(large, "page_id", "left_semi"), width), width))


def _prefix_counts(windows: DataFrame, width: int) -> DataFrame:
    asked = windows.filter(~F.col("cells").startswith(fx.FULL_SPACE) & (F.col("query") != ""))
    counted = asked.groupBy("page_id", "query").agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("query").over(Window.partitionBy("page_id", F.left("query", F.lit(1))).orderBy("query"))
    # the first place where the two differ; no text before it: none is shared
    differs = [F.when(F.left("query", F.lit(i)) != F.left("_before", F.lit(i)), i - 1) for i in range(1, width + 1)]
    shared = counted.withColumn("_before", before).select("page_id", "query", "n", F.coalesce(*differs, F.lit(0)).alias("shared"))
    kinds = shared.groupBy("page_id", F.length("query").alias("size"), "shared").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"), F.min("query").alias("low"), F.max("query").alias("high")
    )
    each = kinds.withColumn("length", F.explode(F.sequence(F.lit(1), "size")))
    # cut at one length, texts keep their order
    return each.groupBy("page_id", "length").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("length") > F.col("shared"), F.col("texts")).otherwise(0)).alias("n_distinct"),
        F.left(F.min("low"), F.first("length")).alias("first_surface"), F.left(F.max("high"), F.first("length")).alias("last_surface"),
    )


# -- L04: derivation -----------------------------------------------------------

MAX_LEVELS = 64
_STATE = ("term", "depth", "path", "reasons", "types")


def _suffix_texts(rules: DataFrame) -> list[str]:
    """The distinct suffixes of the rule table, which is a file of some hundred rules."""
    return sorted(r[0] for r in rules.select("suffix_in").distinct().collect())


def _suffix_lengths(rules: DataFrame) -> list[int]:
    """The distinct suffix lengths of the rule table: a few small integers."""
    return sorted(r[0] for r in rules.select(F.length("suffix_in")).distinct().collect())


def _suffixes(term: Column, lengths: list[int]) -> Column:
    """The suffixes of a term a rule could apply to; none for one character."""
    found = F.array_compact(F.array(*[F.when(F.length(term) >= n, F.right(term, F.lit(n))) for n in lengths]))
    return F.when(F.length(term) >= 2, found).otherwise(F.array().cast("array<string>"))


def _apply_rule(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rewrite ``term`` by the rule joined to its row."""
    root = F.concat(F.left("term", F.length("term") - F.length("suffix_in")), F.col("suffix_out"))
    return rows.withColumn("_root", root).filter("_root <> ''").select(
        *carried,
        F.col("_root").alias("term"),
        (F.col("depth") + 1).alias("depth"),
        F.concat("path", F.array("group_ord", "rule_ord")).alias("path"),
        F.when(F.col("reason") != "", F.concat("reasons", F.array("reason"))).otherwise(F.col("reasons")).alias("reasons"),
        F.col("rule_types").alias("types"),
    )


def _first_derivations(rows: DataFrame, carried: list[str]) -> DataFrame:
    best = F.min(F.struct("depth", "path", "reasons", "types")).alias("b")
    return rows.groupBy(*carried, "term").agg(best).select(*carried, "term", "b.*")


def derivation_closure(level_one: DataFrame, carried: list[str], rules: DataFrame) -> DataFrame:
    """All derivations reachable from ``level_one``; the first of a term wins.

    ``carried`` names the columns that identify a start and must include
    ``base``, its own term.  Each level is one equi-join on the suffix over the
    rows that were new in the level before, written once; the loop ends when a
    level brings nothing new.
    """
    lengths = _suffix_lengths(rules)
    named = rules.withColumnRenamed("types", "rule_types")
    frontier = written(_first_derivations(level_one.filter("term <> base"), carried), "derived")
    seen = frontier
    for _ in range(MAX_LEVELS):
        step = frontier.withColumn("suffix_in", F.explode(_suffixes(F.col("term"), lengths)))
        step = _first_derivations(_apply_rule(step.join(named, "suffix_in"), carried), carried)
        step = step.filter("term <> base").join(seen.select(*carried, "term"), [*carried, "term"], "left_anti")
        frontier = written(step, "derived")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
    raise RuntimeError(f"derivation still grows after {MAX_LEVELS} levels; the rule table does not terminate")


def _start(rows: DataFrame) -> DataFrame:
    """The state a term has before any rule was applied."""
    return rows.withColumns({
        "term": F.col("base"),
        "depth": F.lit(0),
        "path": F.array().cast("array<int>"),
        "reasons": F.array().cast("array<string>"),
        "types": F.array().cast("array<string>"),
    })


def deinflect(surfaces: DataFrame, rules: DataFrame, surface: str = "surface") -> DataFrame:
    """All dictionary forms of each distinct surface; the first derivation
    of a term wins, the surface itself comes first."""
    start = _start(surfaces.select(F.col(surface).alias("base")).distinct())
    opened = start.withColumn("suffix_in", F.explode(_suffixes(F.col("term"), _suffix_lengths(rules))))
    named = rules.withColumnRenamed("types", "rule_types")
    derived = derivation_closure(_apply_rule(opened.join(named, "suffix_in"), ["base"]), ["base"], rules)
    return start.unionByName(derived).select(
        F.col("base").alias(surface), "term", "depth", "reasons", F.col("types").alias("rule_types"), "path"
    )


# -- L05: candidates -----------------------------------------------------------

DIRECT, FROM_NORM, FROM_MODERN, FROM_SOUND = 0, 1, 2, 3
_START = ["surface", "norm", "kind", "base"]


def _probes(surfaces: DataFrame, endings: list[str]) -> DataFrame:
    """Everything a distinct surface can be looked up by, one row each: its
    direct keys, and those suffixes of its three derivable forms that a rule has."""
    lengths = sorted({len(s) for s in endings})
    staged = keys.with_key_stages(surfaces).withColumn("_keys", keys.distinct_keys(F.col("surface")))
    direct = F.transform(
        "_keys",
        lambda key, i: F.struct(F.lit(DIRECT).alias("kind"), i.alias("pos"), key.alias("base"), key.alias("probe")),
    )
    nothing = F.array().cast("array<string>")

    def suffix_probes(kind: int, col: str, when: Column) -> Column:
        of = lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("pos"), F.col(col).alias("base"), s.alias("probe"))
        known = F.filter(_suffixes(F.col(col), lengths), lambda s: s.isin(endings))
        return F.transform(F.when(when, known).otherwise(nothing), of)

    probes = F.concat(
        direct,
        suffix_probes(FROM_NORM, "norm", F.lit(True)),
        suffix_probes(FROM_MODERN, "modern", F.col("modern") != F.col("norm")),
        suffix_probes(FROM_SOUND, "sound", F.col("sound") != F.col("modern")),
    )
    return staged.select("surface", "norm", F.explode(probes).alias("p")).select("surface", "norm", "p.*").withColumn(
        "is_rule", F.col("kind") != DIRECT
    )


def candidate_rows(surfaces: DataFrame, rules: DataFrame, terms: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Candidates per distinct surface with a sortable ``rank``.  ``once``: no surface comes twice.

    ``required`` is NULL for direct keys and for derivations whose last rule
    names no type.  Surfaces are read once: one join on a probe string meets
    the suffix rules and, where ``terms`` is given, the lookup keys that exist.
    With ``terms`` only candidates found there are kept; that never changes
    which derivation of a term comes first.
    """
    distinct = surfaces.select("surface")
    probes = _probes(distinct if once else distinct.distinct(), _suffix_texts(rules))
    rule_probes = rules.select(
        F.lit(True).alias("is_rule"), F.col("suffix_in").alias("probe"), "group_ord", "rule_ord", "suffix_out",
        F.col("types").alias("rule_types"), "reason",
    )
    if terms is None:
        known = rule_probes
        met = probes.filter("is_rule").join(known, ["is_rule", "probe"])
        met = met.unionByName(probes.filter("not is_rule"), allowMissingColumns=True)
    else:
        known = rule_probes.unionByName(
            terms.select(F.lit(False).alias("is_rule"), F.col("term").alias("probe")), allowMissingColumns=True
        )
        met = probes.join(known, ["is_rule", "probe"])
    met = written(met.withColumnRenamed("probe", "suffix_in"), "candidates")
    opened = _apply_rule(_start(met.filter("is_rule")), _START)
    derived = derivation_closure(opened, _START, rules)
    if terms is not None:
        derived = derived.join(terms, "term", "left_semi")
    # a derivation made of unnamed rules only is a no-op result, not a candidate
    derived = derived.filter(F.size("reasons") > 0).withColumn("pos", F.lit(0))
    direct = _start(met.filter("not is_rule")).select(*_START, "pos", *_STATE)
    rows = direct.unionByName(derived.select(*_START, "pos", *_STATE))
    return rows.select(
        "surface",
        "norm",
        "kind",
        "term",
        F.struct("kind", "depth", "pos", "path").alias("rank"),
        "reasons",
        F.when((F.col("kind") != DIRECT) & (F.size("types") > 0), F.col("types")).alias("required"),
    )


def candidate_table(surfaces: DataFrame, rules: DataFrame) -> DataFrame:
    """Ordered candidates per distinct surface."""
    w = Window.partitionBy("surface").orderBy("rank")
    return candidate_rows(surfaces, rules).select(
        "surface", (F.row_number().over(w) - 1).alias("ord"), "term", "kind", "reasons", "required"
    )


# -- L06, L07, L08: entries and matches ---------------------------------------


def entry_keys(entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Enabled entries once per lookup key (headword and reading)."""
    enabled = meta.filter("enabled").select(F.col("id").alias("dictionary_id"), "priority")
    return entries.join(enabled, "dictionary_id").withColumn(
        "term", F.explode(F.array_distinct(F.array("kanji", "reading")))
    )


def find_by_texts(queries: DataFrame, entries: DataFrame, meta: DataFrame) -> DataFrame:
    """Entries whose headword or reading is among the terms of a query.

    ``queries`` is ``(query_id, term)``.  An entry reached by both sides comes
    once.  ``ordinal`` is its place in the query: priority, popularity descending, id.
    """
    hit = queries.join(entry_keys(entries, meta), "term").drop("term").dropDuplicates(["query_id", "id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("priority", F.desc("popularity"), "id"))
    return hit.withColumn("ordinal", place - 1)


def rule_filter(required: Column, rules: Column, is_kanji: Column, kanji: Column, norm: Column) -> Column:
    """Whether an entry satisfies a candidate.  Tokens split on U+0020 only."""
    tokens = F.filter(F.split(rules, " "), lambda t: t != "")
    verb = lambda a: F.exists(a, lambda t: t.startswith("v"))
    typed = F.arrays_overlap(tokens, required) | (verb(tokens) & verb(required))
    return F.when(required.isNull(), ~is_kanji | (kanji == norm)).otherwise(typed)


def filter_matches(candidates: DataFrame, keyed: DataFrame) -> DataFrame:
    """Candidate x entry rows that satisfy the candidate's rule types."""
    is_kanji = F.col("onyomi").isNotNull() | F.col("kunyomi").isNotNull()
    return candidates.join(keyed, "term").filter(
        rule_filter(F.col("required"), F.col("rules"), is_kanji, F.col("kanji"), F.col("norm"))
    )


def candidate_hits(surfaces: DataFrame, keyed: DataFrame, rules: DataFrame, once: bool = False) -> DataFrame:
    """Candidates of distinct surfaces that reach at least one entry of ``keyed``."""
    narrow = keyed.select("term", "kanji", "rules", "onyomi", "kunyomi")
    hits = filter_matches(candidate_rows(surfaces, rules, narrow.select("term").distinct(), once), narrow)
    return hits.select("surface", "term", "kind", "rank", "reasons", "required", "norm").distinct()


def surface_hits(surfaces: DataFrame, entries: DataFrame, meta: DataFrame, rules: DataFrame) -> DataFrame:
    """Candidates of distinct surfaces that reach at least one entry, with the
    entry count per dictionary (bounded by the number of dictionaries)."""
    # read for the terms, in the derivation and for the matches
    keyed = written(entry_keys(entries, meta).select(
        "term", "id", "kanji", "rules", "onyomi", "kunyomi", "dictionary_id"
    ), "entry-keys")
    terms = keyed.select("term").distinct()
    hits = filter_matches(candidate_rows(surfaces, rules, terms), keyed)
    per_dict = hits.groupBy("surface", "term", "kind", "rank", "reasons", "dictionary_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return per_dict.groupBy("surface", "term", "kind", "rank", "reasons").agg(
        F.array_sort(F.collect_list(F.struct("dictionary_id", "n"))).alias("dictionaries")
    )


def resolve_matches(hits: DataFrame, position: list[str]) -> DataFrame:
    """Per position the first hit of each term, longest prefix first.

    ``hits`` carries ``length``, ``rank`` and ``term``; ``max_len`` is the
    longest prefix with any hit.
    """
    rest = [c for c in hits.columns if c not in (*position, "term", "length", "rank")]
    # one shuffle by position serves both the aggregation and the window
    best = hits.repartition(*position).groupBy(*position, "term").agg(
        F.min(F.struct((-F.col("length")).alias("neg"), F.col("rank"), *rest)).alias("b"),
    )
    flat = best.select(*position, "term", (-F.col("b.neg")).alias("length"), F.col("b.rank").alias("rank"), *[f"b.{c}" for c in rest])
    return flat.withColumn("max_len", F.max("length").over(Window.partitionBy(*position)))


def expand_span(cells: Column, max_len: Column) -> Column:
    """Cells covered by ``max_len`` characters that are not U+3000; all
    cells when the stream ends first."""
    upto = F.filter(
        F.sequence(F.lit(1), F.length(cells)),
        lambda i: F.length(F.replace(F.left(cells, i), F.lit(fx.FULL_SPACE), F.lit(""))) >= max_len,
    )
    return F.when(max_len == 0, F.lit(0)).otherwise(F.coalesce(F.get(upto, F.lit(0)), F.length(cells)))


SALTS = 16


def _salt(surface: Column, position: Column) -> Column:
    """One-character surfaces are the hottest join keys; spread them."""
    return F.when(F.length(surface) <= 1, F.pmod(position, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")


def _salts(surface: Column) -> Column:
    return F.when(F.length(surface) <= 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))


def match_positions(
    lines: DataFrame, entries: DataFrame, meta: DataFrame, rules: DataFrame, width: int = fx.QUERY_WIDTH
) -> DataFrame:
    """Matches at every position of every page (L01 - L09 composed).

    Distinct surfaces are keyed and derived once.  Their hits, a table of the
    size of the dictionary rather than of the corpus, are written once so that
    the final join is planned by their true size.
    """
    windows = live_windows(query_windows(lines, width), entry_keys(entries, meta), rules)
    prefixes = prefix_expand(windows)
    hits = written(surface_hits(prefixes.select("surface"), entries, meta, rules), "surface-hits")
    left = prefixes.withColumn("_salt", _salt(F.col("surface"), F.col("gidx")))
    right = hits.withColumn("_salt", F.explode(_salts(F.col("surface"))))
    found = left.join(right, ["surface", "_salt"]).select(
        "page_id", "gidx", "cells", "length", "surface", "term", "kind", "rank", "reasons", "dictionaries"
    )
    matched = resolve_matches(found, ["page_id", "gidx", "cells"])
    return matched.withColumn("span", expand_span(F.col("cells"), F.col("max_len")))


def page_coverage(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Per page, positions looked up and matched, and what they matched."""
    totals = lines.filter(F.length("text") > 0).groupBy("page_id").agg(
        F.sum(F.length(F.replace(F.col("text"), F.lit(fx.FULL_SPACE), F.lit("")))).alias("n_positions")
    )
    per_position = matches.groupBy("page_id", "gidx").agg(
        F.max("max_len").alias("max_len"),
        F.max("span").alias("span"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("kind") == DIRECT).alias("direct"),
    )
    per_page = per_position.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n_matched"),
        F.sum("max_len").alias("sum_max_len"),
        F.sum("span").alias("sum_span"),
        F.sum("n").alias("n_matches"),
        F.sum("direct").alias("n_direct"),
    )
    return totals.join(per_page, "page_id", "left").na.fill(0).select(
        "page_id", "n_positions", "n_matched", "sum_max_len", "sum_span", "n_matches", "n_direct",
        F.round(F.try_divide(F.col("sum_max_len"), F.col("n_matched")), 6).alias("mean_max_len"),
    )


def hits_by_dictionary(matches: DataFrame) -> DataFrame:
    """Entries reached per page, dictionary and derivation kind."""
    return (
        matches.select("page_id", "kind", F.explode("dictionaries").alias("d"))
        .groupBy("page_id", F.col("d.dictionary_id").alias("dictionary_id"), "kind")
        .agg(F.sum("d.n").alias("n_entries"), F.count(F.lit(1)).alias("n_matches"))
    )


# -- L16 ------------------------------------------------------------------------


def matched_surface(lines: DataFrame, requests: DataFrame, width: int) -> DataFrame:
    """The text of a match at ``(page_id, gidx)`` of ``term_len``
    characters, U+3000 skipped, across line ends.  ``width`` is the longest
    ``term_len`` asked for; longer requests fail the job.
    """
    strip = lambda c: F.replace(c, F.lit(fx.FULL_SPACE), F.lit(""))
    present = lines.filter(F.length("text") > 0).withColumn("bare", strip(F.col("text")))
    dense = ordered.prefix_sums(
        present, PAGE, "line_idx", {"start": F.length("text").cast("long"), "ordinal": (F.col("bare") != "").cast("long")}
    )
    # a line of spaces only continues with the next line that is not
    follow = _with_tail(dense.filter("bare <> ''").select("page_id", "ordinal", "bare"), width + 1, "bare")
    follow = follow.select("page_id", "ordinal", F.col("bare").alias("next_bare"), "tail")
    after = F.when(F.col("bare") != "", F.col("tail")).otherwise(F.concat("next_bare", F.coalesce("tail", F.lit(""))))
    block = lambda c: F.floor(c / F.lit(REQUEST_BLOCK))
    last = F.col("start") + F.length("text") - 1
    spans = dense.join(follow, ["page_id", "ordinal"], "left").select(
        "page_id", "start", last.alias("last"), "text", F.coalesce(F.left(after, F.lit(width)), F.lit("")).alias("after"),
        F.explode(F.sequence(block(F.col("start")), block(last))).alias("_b"),
    )
    # a request is one number of its block, and lines come to the block: no text is repeated for its positions
    none = -(1 << 31)
    code = (F.col("gidx") % REQUEST_BLOCK) + F.coalesce("term_len", F.lit(none)).cast("long") * REQUEST_BLOCK
    asked = requests.filter("gidx >= 0").groupBy("page_id", block(F.col("gidx")).alias("_b")).agg(F.collect_list(code).alias("_codes"))
    base = F.col("_b") * REQUEST_BLOCK
    place = lambda c: base + F.pmod(c, F.lit(REQUEST_BLOCK))
    inside = F.filter("_codes", lambda c: (place(c) >= F.col("start")) & (place(c) <= F.col("last")))
    too_long = F.raise_error(F.lit("term_len exceeds width")).cast("string")
    kinds = {c: requests.schema[c].dataType for c in ("gidx", "term_len")}

    def answer(c: Column) -> Column:
        size = F.nullif(F.floor(c / F.lit(REQUEST_BLOCK)), F.lit(none)).cast("int")
        rest = strip(F.substr("text", (place(c) - F.col("start") + 1).cast("int"), F.length("text")))
        matched = F.when(size > width, too_long).otherwise(F.left(F.concat(rest, F.col("after")), size))
        return F.struct(place(c).cast(kinds["gidx"]).alias("gidx"), size.cast(kinds["term_len"]).alias("term_len"), matched.alias("matched"))

    met = dealt(asked).join(spans, ["page_id", "_b"])
    return met.select("page_id", F.inline(F.transform(inside, answer)))
