import pytest
from pyspark.sql import functions as F

from kotonoha.functions import fixed as fx
from kotonoha.functions import text as tx
from kotonoha.operators import keys

CASES = {
    tx.normalise: [
        ("", ""), ("日本語のテキストです。", "日本語のテキストです。"), ("こゝろ", "こころ"), ("こゝゝろ", "こここ" + "ろ"),
        ("たゞ", "ただ"), ("まゞ", "まま"), ("がゞ", "がが"), ("カゝ", "カゝ"), ("ゝあ", "ゝあ"), ("Ⅻ世", "XII世"), ("℃", "°C"),
        ("ｶﾞｷﾞﾊﾟ", "ガギパ"), ("ｱﾞ", "アﾞ"), ("ＡＢＣ１", "ABC1"), ("︙︰", "…‥"), ("が", "が"), ("あ゙", "あ゙"), ("國會", "国会"),
    ],
    tx.to_hiragana: [("カー", "かあ"), ("ガー", "があ" if "ガ" in fx.PROLONGED_A else "がう"), ("コー", "こう"), ("カーー", "かあう"), ("ー", "ー"), ("アイウ", "あいう")],
    tx.collapse_emphatic: [("すごーーーい", "すごーい"), ("っっッッ", "っッ"), ("ああ", "ああ")],
    tx.modernise_orthography: [("ゐる", "いる"), ("つづく", "つづく"), ("ぢ", "じ"), ("かつた", "かった"), ("きやく", "きゃく"), ("ぢや", "じや"), ("ツつた", "ッった")],
    tx.change_sounds: [("やう", "よう"), ("けふ", "きょう"), ("思ふ", "思う"), ("うふ", "うふ"), ("は", "は"), ("言はず", "言わず")],
    tx.vertical_punctuation: [("?…‥", "？︙︰"), ("か", "か")],
}


@pytest.mark.parametrize("fn", CASES, ids=lambda f: f.__name__)
def test_stage(spark, fn):
    df = spark.createDataFrame(CASES[fn], "given string, want string")
    wrong = df.withColumn("got", fn(F.col("given"))).filter("got <> want or got is null").collect()
    assert wrong == []


def test_normalised_column_equals_expression(spark):
    df = spark.createDataFrame([(a,) for a, _ in CASES[tx.normalise]], "s string")
    both = tx.with_normalised(df, "s", "n").withColumn("e", tx.normalise(F.col("s")))
    assert both.filter("n <> e").count() == 0


def test_fixed_tables():
    pairs = fx.measured_pairs()
    assert len(pairs) == len(dict(pairs)) == 165
    assert not {b for _, b in pairs} & {a for a, _ in pairs}
    assert len(fx.PRESENTATION_FROM) == len(fx.PRESENTATION_TO)
    assert len(fx.SIZE_BIG) == len(fx.SIZE_SMALL) == 20


def test_no_vowel_output_feeds_another_row():
    inputs = {a for a, _ in fx.pairs(fx.SOUND_AU) + fx.pairs(fx.SOUND_EU)}
    assert not {b[-1] for _, b in fx.pairs(fx.SOUND_AU) + fx.pairs(fx.SOUND_EU)} & inputs


def test_search_keys_keep_the_first(spark):
    rows = keys.search_keys(spark.createDataFrame([("けふ",), ("けふ",)], "surface string")).orderBy("ord").collect()
    assert [(r.stage, r.key) for r in rows] == [("raw", "けふ"), ("sound", "きょう")]


@pytest.mark.parametrize(
    "term, reading, want",
    [
        ("食べる", "たべる", [("食", "た"), ("べる", None)]),
        ("お茶", "おちゃ", [("お", None), ("茶", "ちゃ")]),
        ("かな", "かな", [("かな", None)]),
        ("取り引き", "とりひき", [("取", "と"), ("り", None), ("引", "ひ"), ("き", None)]),
        ("食べる", "たへる", None),
        ("茶", "", None),
    ],
)
def test_ruby(spark, term, reading, want):
    df = spark.createDataFrame([(term, reading)], "kanji string, reading string")
    got = keys.ruby_alignment(df).first().segments
    assert (got and [(s.base, s.ruby) for s in got]) == want


def test_morae_and_pitch(spark):
    df = spark.createDataFrame([("きょう",), ("がっこう",), ("コーヒー",), ("ゃゅき",)], "r string")
    assert [len(r[0]) for r in df.select(tx.morae(F.col("r"))).collect()] == [2, 4, 4, 2]
    p = spark.range(1).select(*[tx.pitch_pattern(F.lit(4), F.lit(k)).alias(f"p{k}") for k in (0, 1, 3)]).first()
    assert p.p0 == [False, True, True, True] and p.p1 == [True, False, False, False] and p.p3 == [False, True, True, False]
