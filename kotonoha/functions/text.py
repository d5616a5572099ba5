"""Column functions for the text-key stages.

Each function maps a string column to a string column with built-in Spark
expressions, so they stay inside the JVM.  Stages that read neighbouring
characters read the original ones, except the iteration marks, which read the
character emitted last.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx


def _replace_all(text: Column, rows) -> Column:
    return reduce(lambda acc, row: F.replace(acc, F.lit(row[0]), F.lit(row[1])), rows, text)


def _char_class(chars: str) -> str:
    return "[" + "".join("\\x{%x}" % ord(c) for c in chars) + "]"


def chars_of(text: Column) -> Column:
    """The characters of a string (supplementary ones count as one)."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _is_in(char: Column, chars: str) -> Column:
    return F.instr(F.lit(chars), char) > 0


# -- normalisation -------------------------------------------------------------

_FULL_ASCII = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_ASCII = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_WIDTH_FROM = fx.HALF_KANA + _FULL_ASCII + fx.WIDTH_EXTRA_FROM
_WIDTH_TO = fx.FULL_KANA + _ASCII + fx.WIDTH_EXTRA_TO
_HALF_PAIRS = [(a + fx.HALF_VOICE_MARK, b) for a, b in zip(fx.HALF_VOICED, fx.FULL_VOICED)] + [
    (a + fx.HALF_SEMI_VOICE_MARK, b) for a, b in zip(fx.HALF_SEMI_VOICED, fx.FULL_SEMI_VOICED)
]
_FOLD_SINGLE = fx.pairs(fx.SINGLE_CHAR_FOLD) + fx.measured_pairs()
_FOLD_FROM = "".join(a for a, _ in _FOLD_SINGLE)
_FOLD_TO = "".join(b for _, b in _FOLD_SINGLE)
_FOLD_MULTI = fx.pairs(fx.MULTI_CHAR_FOLD)
_COMBINING = [
    (a + fx.COMBINING_VOICE_MARK, b) for a, b in zip(fx.COMBINING_VOICED_BASE, fx.COMBINING_VOICED)
] + [(a + fx.COMBINING_SEMI_MARK, b) for a, b in zip(fx.COMBINING_SEMI_BASE, fx.COMBINING_SEMI)]


def convert_width(text: Column) -> Column:
    """Halfwidth kana and fullwidth ASCII to their standard forms."""
    marks = fx.HALF_VOICE_MARK + fx.HALF_SEMI_VOICE_MARK
    joined = F.when(text.rlike(_char_class(marks)), _replace_all(text, _HALF_PAIRS)).otherwise(text)
    return F.translate(joined, _WIDTH_FROM, _WIDTH_TO)


def expand_iteration_marks(text: Column) -> Column:
    """``ゝゞヽヾ`` repeat or voice the kana emitted just before them."""

    def step(acc: Column, ch: Column) -> Column:
        last = F.right(acc, F.lit(1))
        hira = last.rlike("^[\\u3041-\\u3096]$")
        kata = last.rlike("^[\\u30A1-\\u30F6]$")
        out = (
            F.when((ch == "ゝ") & hira, last)
            .when((ch == "ゞ") & hira, F.translate(last, fx.VOICELESS_HIRAGANA, fx.VOICED_HIRAGANA))
            .when((ch == "ヽ") & kata, last)
            .when((ch == "ヾ") & kata, F.translate(last, fx.VOICELESS_KATAKANA, fx.VOICED_KATAKANA))
            .otherwise(ch)
        )
        return F.concat(acc, out)

    folded = F.aggregate(chars_of(text), F.lit(""), step)
    return F.when(text.rlike("[ゝゞヽヾ]"), folded).otherwise(text)


def _fold_single(text: Column) -> Column:
    return F.translate(text, _FOLD_FROM, _FOLD_TO)


def _fold_multi(text: Column) -> Column:
    wide = _char_class("".join(a for a, _ in _FOLD_MULTI))
    return F.when(text.rlike(wide), _replace_all(text, _FOLD_MULTI)).otherwise(text)


def fold_variants(text: Column) -> Column:
    """Variant characters to dictionary forms, then iteration marks."""
    return _bound(_bound(_fold_single(text), _fold_multi), expand_iteration_marks)


def compose_marks(text: Column) -> Column:
    """The listed kana + combining-mark pairs only; this is not NFC."""
    marks = fx.COMBINING_VOICE_MARK + fx.COMBINING_SEMI_MARK
    return F.when(text.rlike(_char_class(marks)), _replace_all(text, _COMBINING)).otherwise(text)


def _bound(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def normalise(text: Column) -> Column:
    """All three normalisation stages as one expression.  For whole tables
    prefer ``with_normalised``, which keeps each stage a column of its own."""
    return _bound(_bound(convert_width(text), fold_variants), compose_marks)


def with_normalised(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add ``out``, the normalised form of ``source``, stage by stage, so that
    no stage's expression is repeated inside the next."""
    return (
        df.withColumn("_width", convert_width(F.col(source)))
        .withColumn("_fold", _fold_single(F.col("_width")))
        .withColumn("_fold", _fold_multi(F.col("_fold")))
        .withColumn("_fold", expand_iteration_marks(F.col("_fold")))
        .withColumn(out, compose_marks(F.col("_fold")))
        .drop("_width", "_fold")
    )


# -- script, emphasis ----------------------------------------------------------

_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def to_hiragana(text: Column) -> Column:
    """Katakana to hiragana; a prolonged mark becomes the vowel of the
    original character before it, ``う`` when that is not listed."""
    long = text
    for source, vowel in ((fx.PROLONGED_A, "あ"), (fx.PROLONGED_I, "い"), (fx.PROLONGED_E, "え")):
        long = F.regexp_replace(long, f"(?<={_char_class(source)})ー", vowel)
    long = F.regexp_replace(long, "(?s)(?<=.)ー", "う")
    return F.translate(F.when(F.contains(text, F.lit("ー")), long).otherwise(text), _KATAKANA, _HIRAGANA)


def collapse_emphatic(text: Column) -> Column:
    return F.regexp_replace(text, f"([{fx.EMPHATIC}])\\1+", "$1")


# -- older spellings -----------------------------------------------------------


# A single regular expression over the original text decides where a rule
# applies, so no rule ever sees a neighbour another rule has rewritten; the
# places are marked, and marked characters are then replaced.
_MARK = "\u0001"


def _rewrite_marked(text: Column, places: str, source: str, target: str) -> Column:
    marked = F.regexp_replace(text, f"(?s)({places})", f"$1{_MARK}")
    rewritten = _replace_all(marked, [(a + _MARK, b) for a, b in zip(source, target)])
    return F.when(text.rlike(f"[{source}]"), rewritten).otherwise(text)


_ORTHO_PLACES = "|".join([
    f"[{fx.ORTHO_WA_ROW}]",
    f"(?<![{fx.ORTHO_DA_BLOCKED_AFTER}])[{fx.ORTHO_DA_ROW}]",
    f"[{fx.ORTHO_SMALL_TSU}](?=[{fx.ORTHO_TSU_BEFORE}])",
    f"(?<=[{fx.ORTHO_YA_AFTER}])[{fx.ORTHO_SMALL_YA}]",
])
_HA_PLACES = "|".join([
    f"(?<=[^う])ふ(?=\\z|[^\\u3041-\\u3096\\u30A1-\\u30F6]|[{fx.SOUND_FU_PARTICLES}])",
    f"ひ(?=[{fx.SOUND_HI_BEFORE}])",
    f"へ(?=[{fx.SOUND_HE_BEFORE}])",
    f"(?<=.)は(?=[{fx.SOUND_HA_BEFORE}])",
])


def modernise_orthography(text: Column) -> Column:
    """Pre-reform kana to modern spelling."""
    return _rewrite_marked(text, _ORTHO_PLACES, fx.ORTHO_FROM, fx.ORTHO_TO)


def shift_ha_row(text: Column) -> Column:
    """Word-medial and word-final ha row to wa row, by grammatical ending."""
    return _rewrite_marked(text, _HA_PLACES, fx.SOUND_HA_FROM, fx.SOUND_HA_TO)


_VOWEL_PAIRS = [(a + "う", b + "う") for a, b in fx.pairs(fx.SOUND_AU) + fx.pairs(fx.SOUND_EU)]


def change_vowels(text: Column) -> Column:
    """Vowel changes before ``う``.  No output is another row's input."""
    return F.when(F.contains(text, F.lit("う")), _replace_all(text, _VOWEL_PAIRS)).otherwise(text)


def change_sounds(text: Column) -> Column:
    return _bound(shift_ha_row(text), change_vowels)


# -- vertical text -------------------------------------------------------------


def vertical_punctuation(text: Column) -> Column:
    return F.translate(text, fx.VERTICAL_FROM, fx.VERTICAL_TO)


def vertical_glyphs(text: Column) -> Column:
    """The wider presentation-form table."""
    return F.translate(text, fx.PRESENTATION_FROM, fx.PRESENTATION_TO)


# -- readings ------------------------------------------------------------------


def split_readings(text: Column) -> Column:
    """A kana list on space and U+3000, leading ``-`` stripped, blanks dropped."""
    parts = F.split(F.coalesce(text, F.lit("")), "[ \\u3000]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^-+", "")), lambda p: p != "")


def morae(reading: Column) -> Column:
    """Morae; a fusing small kana joins the mora before it, if there is one."""
    return F.regexp_extract_all(reading, F.lit(f"(?s).[{fx.FUSING_KANA}]*"), 0)


def pitch_pattern(count: Column, position: Column) -> Column:
    """High (true) or low per mora for a downstep position."""
    high = lambda i: (
        F.when(position <= 0, i >= 1).when(position == 1, i == 0).otherwise((i >= 1) & (i < position))
    )
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), high)).otherwise(
        F.array().cast("array<boolean>")
    )


def pitch_class(count: Column, position: Column) -> Column:
    return (
        F.when(position <= 0, "heiban")
        .when(position >= count, "odaka")
        .when(position == 1, "atamadaka")
        .otherwise("nakadaka")
    )


def is_half_width(ch: Column) -> Column:
    """ASCII and halfwidth kana advance half an em."""
    code = F.ascii(ch)
    return (code <= 0x7E) | code.between(0xFF61, 0xFFDC)


#: Every character that a key stage reads or changes, kana and halfwidth forms as a whole.
CHANGED = "".join(sorted({
    *_WIDTH_FROM, *_FOLD_FROM, *(c for a, _ in (*_HALF_PAIRS, *_FOLD_MULTI, *_COMBINING, *_VOWEL_PAIRS) for c in a),
    *fx.EMPHATIC, *fx.ORTHO_FROM, *fx.SOUND_HA_FROM, *map(chr, range(0x3041, 0x3100)), *map(chr, range(0xFF01, 0xFFF0)),
}))
