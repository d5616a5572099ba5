"""Registered queries for the text-key jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.operators import keys
from kotonoha.plans import inputs, oracle
from kotonoha.plans.registry import query

q = oracle.quoted


def _stage(name, fn, sql_fn, source="mixed_surfaces"):
    @query(name, oracle.sql(f"select surface, {sql_fn('surface')} as out from {source}", source))
    def run(spark, d):
        return getattr(inputs, source)(spark, d).select("surface", fn(F.col("surface")).alias("out"))


_stage("n01a_width", tx.convert_width, oracle.width_sql)
_stage("n01b_variant_fold", tx.fold_variants, oracle.fold_sql)
_stage("n01c_combining_marks", tx.compose_marks, oracle.compose_sql)
_stage("n01d_hiragana", tx.to_hiragana, oracle.hiragana_sql)
_stage("n01e_emphatic", tx.collapse_emphatic, oracle.emphatic_sql)
_stage("n01f_modern_orthography", tx.modernise_orthography, oracle.modern_sql)
_stage("n01g_sound_changes", tx.change_sounds, oracle.sound_sql, "kana_surfaces")


@query(
    "n01h_vertical_punctuation",
    oracle.sql(
        "select page_id, line_idx, case when is_vertical then "
        + oracle.translate("replace(replace(text,'。','?'),'、','…')", fx.VERTICAL_FROM, fx.VERTICAL_TO)
        + " else replace(replace(text,'。','?'),'、','…') end as out, "
        + oracle.translate("text", fx.PRESENTATION_FROM, fx.PRESENTATION_TO)
        + " as glyphs from lines",
        "lines",
    ),
)
def vertical_punctuation(spark, d):
    emitted = F.translate("text", "。、", "?…")
    return inputs.lines(spark, d).select(
        "page_id",
        "line_idx",
        F.when(F.col("is_vertical"), tx.vertical_punctuation(emitted)).otherwise(emitted).alias("out"),
        tx.vertical_glyphs(F.col("text")).alias("glyphs"),
    )


@query(
    "n01_search_keys",
    oracle.sql(
        "select surface, ord, stage, key from (" + oracle.key_rows("select surface from mixed_surfaces") + ")",
        "mixed_surfaces",
    ),
)
def search_keys(spark, d):
    return keys.search_keys(inputs.mixed_surfaces(spark, d))


# candidate pairs for the fold: neighbouring letters, in both directions
_PAIRS = [(a, b) for a, b in zip("bcdfghjklmnpqrstvwxyz", "cdfghjklmnpqrstvwxyzb")] + [
    ("e", "a"), ("a", "e"), ("é", "e"), ("è", "e"), ("ç", "c"), ("ö", "o"), ("ö", "e"), ("ñ", "n"), ("q", "k"),
]
_PAIR_ROWS = ", ".join(f"('{a}','{b}')" for a, b in _PAIRS)


@query(
    "n02_measured_fold",
    oracle.sql(f"""
with counts as (select ch, count(*) cnt from (select unnest(string_split(lower(text), '')) ch from documents
                where length(text) > 0) group by ch),
pairs(variant, canonical) as (values {_PAIR_ROWS}),
kept as (select p.variant, p.canonical, v.cnt variant_cnt, c.cnt canonical_cnt,
  row_number() over (partition by p.variant order by c.cnt desc, p.canonical) r
  from pairs p join counts v on v.ch = p.variant join counts c on c.ch = p.canonical where c.cnt >= v.cnt),
best as (select * from kept where r = 1)
select variant, canonical, variant_cnt, canonical_cnt from best
where canonical not in (select variant from best)"""),
)
def measured_fold(spark, d):
    docs = inputs.table(spark, d, "documents").select(F.lower("text").alias("text"))
    pairs = spark.createDataFrame(_PAIRS, "variant string, canonical string")
    return keys.derive_measured_fold(pairs, keys.corpus_char_counts(docs))


@query(
    "n03_fold_census",
    oracle.sql(
        "select norm, count(*) n_surfaces, max(cast(surface<>width as int)) by_width, "
        "max(cast(width<>folded as int)) by_fold, max(cast(folded<>norm as int)) by_marks, "
        "min(surface) first_surface, max(surface) last_surface from ("
        + oracle.staged(
            "select surface from mixed_surfaces union select " + oracle.width_sql("surface") + " from mixed_surfaces"
        )
        + ") group by norm having count(*) > 1",
        "mixed_surfaces",
    ),
)
def fold_census(spark, d):
    s = inputs.mixed_surfaces(spark, d).select("surface")
    return keys.fold_census(s.unionByName(s.select(tx.convert_width(F.col("surface")).alias("surface"))))


@query(
    "n04_reading_index",
    oracle.sql("""
with listed as (select surface as kanji, 'on' kind, unnest(regexp_split_to_array('-' || surface || ' --' || right(surface,2), '[ 　]')) reading from kana_surfaces
 union all select surface, 'kun', unnest(regexp_split_to_array(substr(surface,1,3) || '　' || left(surface,2) || '　', '[ 　]')) from kana_surfaces)
select reading, kind, kanji, count(*) n from (select kanji, kind, ltrim(reading, '-') reading from listed)
where reading <> '' group by all""", "kana_surfaces").replace("\nwith listed", "\n, listed", 1),
)
def reading_index(spark, d):
    s = inputs.kana_surfaces(spark, d)
    e = s.select(
        F.col("surface").alias("kanji"),
        F.concat(F.lit("-"), "surface", F.lit(" --"), F.right("surface", F.lit(2))).alias("onyomi"),
        F.concat(F.substring("surface", 1, 3), F.lit("　"), F.left("surface", F.lit(2)), F.lit("　")).alias("kunyomi"),
    )
    return keys.reading_index(e)


def _ruby_entries(spark, d):
    return inputs.word_counts(spark, d).select(
        F.translate("w", inputs.LETTERS, inputs.RUBY_TERM).alias("kanji"),
        F.translate("w", inputs.LETTERS, inputs.RUBY_READING).alias("reading"),
    )


_K = "[々〻㐀-䶿一-鿿豈-﫿]"
oracle.cte(
    "rec_walk",
    f"""select kanji, reading, runs, 1 k, 0 pos, true ok, cast([] as struct(base varchar, ruby varchar)[]) segs,
  len(runs) runs_left from (select kanji, reading, regexp_extract_all(kanji, '{_K}+|[^々〻㐀-䶿一-鿿豈-﫿]+') runs
   from (select {oracle.translate('w', inputs.LETTERS, inputs.RUBY_TERM)} kanji,
     {oracle.translate('w', inputs.LETTERS, inputs.RUBY_READING)} reading from word_counts))
 union all
 select kanji, reading, runs, k + 1, case when good then stop else pos end, ok and good,
  list_append(segs, {{'base': runs[k], 'ruby': case when is_k then substr(reading, pos+1, greatest(stop-pos,0)) end}}),
  runs_left - 1
 from (select *, case when is_k then stop > pos else runs[k] = substr(reading, pos+1, length(runs[k])) end good from (
  select *, case when not is_k then pos + length(runs[k]) when k = len(runs) then length(reading)
    else case when instr(substr(reading, pos+1), left(runs[k+1],1)) = 0 then pos else pos + instr(substr(reading, pos+1), left(runs[k+1],1)) - 1 end end stop
  from (select *, regexp_matches(runs[k], '^{_K}') is_k from rec_walk where runs_left > 0)))""",
    "word_counts",
)


@query(
    "n05_ruby_alignment",
    oracle.sql(
        f"""select base, ruby, count(*) n from (
 select unnest(case when ok and pos = length(reading) then list_filter(segs, lambda s: s.ruby is not null)
   else [{{'base': null, 'ruby': null}}] end, recursive := true) from rec_walk where runs_left = 0) group by base, ruby""",
        "rec_walk",
    ),
)
def ruby_alignment(spark, d):
    return keys.ruby_alignment_stats(_ruby_entries(spark, d))


@query(
    "n06_accent_census",
    oracle.sql(
        f"""
select morae, accent, pattern, count(*) n from (select morae,
  case when p <= 0 then 'heiban' when p >= morae then 'odaka' when p = 1 then 'atamadaka' else 'nakadaka' end accent,
  array_to_string(list_transform(range(0, morae), lambda i: case when
    case when p <= 0 then i >= 1 when p = 1 then i = 0 else i >= 1 and i < p end then 'H' else 'L' end), '') pattern
from (select length(w) % 4 - 1 + n % 3 p, len(regexp_extract_all({oracle.translate('w', inputs.LETTERS, 'かきゃけこゅしすせそァちつてとなにぬねのはょふへほま')},
  '.[{fx.FUSING_KANA}]*')) morae from word_counts)) group by all""",
        "word_counts",
    ),
)
def accent_census(spark, d):
    w = inputs.word_counts(spark, d)
    return keys.accent_census(
        w.select(
            F.translate("w", inputs.LETTERS, "かきゃけこゅしすせそァちつてとなにぬねのはょふへほま").alias("reading"),
            (F.length("w") % 4 - 1 + F.col("n") % 3).alias("position"),
        )
    )
