from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table
from kotonoha.operators import ngram, similarity

TOY = [("私", 100), ("の", 200), ("を", 50), ("は", 30), ("私の", 40), ("私を", 5), ("のは", 60), ("私は", 20)]


def model(spark):
    grams = small_table(spark, [(g, len(g), c) for g, c in TOY], "ngram string, n int, cnt bigint")
    return grams, small_table(spark, [(500,)], "mass bigint")


def test_counts(spark):
    q = spark.createDataFrame([("私",), ("私の",), ("私のは",), ("",), ("私のはをに",)], "ngram string")
    got = {r.ngram: r.cnt for r in ngram.ngram_counts(q, model(spark)[0]).collect()}
    assert got == {"私": 100, "私の": 40, "私のは": 0, "": 0, "私のはをに": 0}


def test_ranks(spark):
    pool = [("a", "私", 0, "を"), ("a", "私", 1, "の"), ("b", "", 0, "の"), ("b", "", 1, "は"), ("c", "私", 0, "x"), ("c", "私", 1, "y")]
    df = spark.createDataFrame(pool, "ctx string, context string, pos int, ch string")
    rows = ngram.rank_candidates(df, *model(spark), ["ctx"]).orderBy("ctx", "rank").collect()
    assert [(r.ctx, r.ch) for r in rows] == [("a", "の"), ("a", "を"), ("b", "の"), ("b", "は"), ("c", "x"), ("c", "y")]


def test_gap_pools_and_context(spark):
    steps = [(1, 0, 0, "◌"), (1, 0, 1, "、"), (1, 0, 2, "思"), (1, 1, 0, "思"), (1, 1, 1, "阿"), (1, 2, 0, "　"), (2, 0, 0, "　")]
    t = spark.createDataFrame(steps, "line_id int, t int, rank int, ch string")
    gaps = spark.createDataFrame([(1, 1, "私◌う", 1), (2, 2, "あいうえお◌", 5)], "gap_id int, line_id int, text string, insert_at int")
    assert [r.ch for r in ngram.gap_candidates(gaps, t).orderBy("rank").collect()] == ["、", "思", "阿"]
    assert [r.ch for r in ngram.gap_fallback(gaps, t).orderBy("rank").collect()] == list("、。「」…ーはのをにと")
    ctx = gaps.select(ngram.context_before(F.col("text"), F.col("insert_at")).alias("c")).collect()
    assert [r.c for r in ctx] == ["私", "うえお"]


def test_published_counts(spark):
    raw = small_table(spark, [("abcd", 4), ("abce", 5), ("a", 70000), ("𠮟", 9), ("abc", 1)], "ngram string, cnt bigint")
    got = {r.ngram: r.cnt for r in ngram.publish_ngrams(raw).collect()}
    assert got == {"abce": 5, "a": 65535, "abc": 1}


LINES = [(0, "明:日 月"), (1, "明:x"), (2, "時:日 寺 日"), (3, "朝:十 日 月"), (4, "#"), (5, "間:門 日 ab"), (6, "a:日 月"), (7, "晶:日")]


def test_components_and_neighbours(spark):
    c = similarity.parse_components(small_table(spark, LINES, "line_no int, line string"))
    parts = {r.item: r.p for r in c.groupBy("item").agg(F.sort_array(F.collect_list("component")).alias("p")).collect()}
    assert parts["明"] == ["日", "月"] and parts["時"] == ["寺", "日"] and parts["間"] == ["日", "門"]
    idf = similarity.component_idf(c)
    assert {r.component: r.df for r in idf.collect()}["日"] == 5
    every = similarity.neighbours(c, idf, min_fraction=0.0)
    assert {r.dst for r in every.filter("src = '明'").collect()} == {"時", "朝", "間", "晶"}
    near = {(r.src, r.dst): (r.fraction, r.shares_all) for r in similarity.neighbours(c, idf).collect()}
    assert near[("明", "朝")] == (1.0, True) and ("朝", "明") not in near


def test_variant_chains(spark):
    v = similarity.parse_variants(small_table(spark, [(0, "冩\t寫"), (1, "寫\t写"), (2, "干\t乾"), (3, "乾\t干"), (4, "x"), (5, "𠮟\t叱"), (6, "冩\t冫")], "line_no int, line string"))
    got = {r.variant: (r.last_form, r.cycle) for r in similarity.variant_chains(v).collect()}
    assert got["冩"] == ("写", False) and got["寫"] == ("写", False) and got["干"][1] and got["乾"][1]


def test_majority(spark):
    c = small_table(spark, [("咳", 0, "口"), ("咬", 0, "口"), ("眩", 0, "目"), ("啦", 0, "口")], "item string, pos int, component string")
    g = spark.createDataFrame([(1, ch) for ch in "咳咬啦哮眩"] + [(2, "哮")] + [(3, ch) for ch in "眩x"], "group_id int, member string")
    got = {(r.group_id, r.component): r.votes for r in similarity.majority_components(g, c).collect()}
    assert got == {(1, "口"): 3, (3, "目"): 1}
