import random

from pyspark.sql import functions as F

from kotonoha.functions.tables import small_table
from kotonoha.operators import lexicon, lookup
from kotonoha.plans import inputs

RULES = [
    (0, 0, "た", "る", ["v1"], "past"), (0, 1, "った", "う", ["v5"], "past"), (1, 0, "て", "る", ["v1"], "-te"),
    (2, 0, "かった", "い", ["adj-i"], "past"), (3, 0, "ない", "る", ["v1"], "negative"),
]


def rules(spark, rows=RULES):
    return small_table(spark, rows, inputs.RULES_SCHEMA)


def brute_deinflect(text, rows):
    out = [(text, [], [])]
    i = 0
    while i < len(out):
        term, why, _ = out[i]
        i += 1
        if len(term) < 2:
            continue
        for _, _, a, b, types, reason in rows:
            if term.endswith(a):
                root = term[: len(term) - len(a)] + b
                if root and root not in [t for t, _, _ in out]:
                    out.append((root, why + ([reason] if reason else []), types))
    return out


def test_deinflect_named_cases(spark):
    df = spark.createDataFrame([("食べた",), ("食べて",), ("高かった",), ("食べる",), ("た",)], "surface string")
    got = {(r.surface, r.term): r.reasons for r in lookup.deinflect(df, rules(spark)).collect()}
    assert got[("食べた", "食べる")] == ["past"]
    assert got[("食べて", "食べる")] == ["-te"]
    assert got[("高かった", "高い")] == ["past"]
    assert [t for s, t in got if s == "食べる"] == ["食べる"] and [t for s, t in got if s == "た"] == ["た"]


def test_deinflect_against_queue(spark):
    rng = random.Random(7)
    rows = [
        (g, r, "".join(rng.choice("abc") for _ in range(rng.randint(1, 2))), "".join(rng.choice("abc") for _ in range(rng.randint(0, 1))), [str(g)], f"r{g}")
        for g in range(4) for r in range(2)
    ]
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)})
    got = {}
    for r in lookup.deinflect(spark.createDataFrame([(w,) for w in words], "surface string"), rules(spark, rows)).collect():
        got[(r.surface, r.term)] = (r.reasons, r.rule_types)
    want = {(w, t): (why, types) for w in words for t, why, types in brute_deinflect(w, rows)}
    assert got == want


def entry(i, kanji, reading, rules="n", pop=0, dic=1, on=None, definitions='["x"]'):
    return (i, kanji, reading, definitions, rules, pop, dic, on, None, None)


ENTRY = "id bigint, kanji string, reading string, definitions string, rules string, popularity int, dictionary_id bigint, onyomi string, kunyomi string, jlpt string"
META = "id bigint, name string, priority int, enabled boolean"


def frames(spark, rows, meta=((1, "one", 0, True), (2, "off", 1, False))):
    return small_table(spark, rows, ENTRY), small_table(spark, list(meta), META)


def test_match_positions_cross_lines_and_spaces(spark):
    e, m = frames(spark, [entry(1, "食べる", "たべる", "v1"), entry(2, "食", "しょく", "n", on="ショク"), entry(3, "食べた", "x", dic=2), entry(4, "別", "食", on="x")])
    lines = spark.createDataFrame([(1, 0, "食"), (1, 1, ""), (1, 2, "　べた"), (2, 0, "食")], "page_id long, line_idx int, text string")
    got = {(r.page_id, r.gidx, r.term): r for r in lookup.match_positions(lines, e, m, rules(spark)).collect()}
    assert set(got) == {(1, 0, "食べる"), (1, 0, "食"), (2, 0, "食")}
    first = got[(1, 0, "食べる")]
    assert (first.length, first.max_len, first.span, first.reasons) == (3, 3, 4, ["past"])
    # the other headword's reading does not sweep in a kanji-type entry
    assert [d.n for d in got[(2, 0, "食")].dictionaries] == [1]


def test_offsets_do_not_depend_on_partitions(spark, sf_dir):
    lines = inputs.lines(spark, sf_dir)
    want = None
    for n in ("1", "7", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, lookup.line_offsets(lines).select("page_id", "line_idx", "start", "ordinal").collect()))
        want = want or got
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def link(target):
    return '[{"tag":"a","href":"?query=' + target + '&x=1"}]'


def test_redirects(spark):
    e, m = frames(spark, [
        entry(1, "a", "a", definitions=link("b")), entry(2, "b", "b", definitions=link("c")), entry(3, "c", "c", definitions=link("d")),
        entry(4, "d", "d", definitions=link("e")), entry(5, "e", "e"), entry(6, "p", "p", definitions='[{"data":{"content":"sense"},"content":' + link("a") + "}]"),
        entry(7, "q", "q", definitions=link("%E3%81%82+z")), entry(8, "あ+z", "x", definitions=link("q")),
    ])
    edges = lexicon.redirect_edges(e)
    assert {(r.kanji, r.target) for r in edges.collect()} == {("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("q", "あ+z"), ("あ+z", "q")}
    keyed = lookup.entry_keys(e, m)
    matches = spark.createDataFrame([(1, 0, "a"), (1, 1, "c"), (2, 0, "q"), (3, 0, "a")], "pos int, match_ord int, term string").join(keyed, "term")
    matches = matches.select("pos", "match_ord", "term", "id", "priority", "popularity")
    closure = lexicon.redirect_closure(matches, edges, keyed, ["pos"])
    rows = lexicon.splice_redirects(matches, closure, ["pos"]).orderBy("pos", "ord").collect()
    assert [(r.pos, r.term, r.via) for r in rows] == [
        (1, "a", None), (1, "b", "a"), (1, "c", None), (1, "d", "c"), (1, "e", "d"),
        (2, "q", None), (2, "あ+z", "q"), (3, "a", None), (3, "b", "a"), (3, "c", "b"), (3, "d", "c"),
    ]


def test_grouped_entry(spark):
    nbsp = " "
    sense = '[{"data":{"content":"sense-group"},"content":[{"tag":"b","content":"h"},{"data":{"content":"sense"},"content":"s1"},{"data":{"content":"sense"},"content":"s2"}]}]'
    e, m = frames(spark, [
        entry(1, "凡百", "ぼんぴゃく", f"old{nbsp}kanji priority{nbsp}form | v5 | common", definitions='["a hundred"]'),
        entry(2, "凡百", "ぼんぴゃく", f"old{nbsp}kanji priority{nbsp}form | v5 | common", definitions='["second"]'),
        entry(3, "凡百", "ぼんぴゃく", "n | | 2 later", definitions='["third"]'),
        entry(4, "凡百", "ぼんひゃく", "n", definitions='["a hundred"]'),
        entry(5, "凡百", "ぼんひゃく", "n", definitions=sense),
        entry(6, "凡百", "", "", definitions='{"reading":"ぼんひゃく","pitches":[{"position":1.0},{"position":"0"},{"position":true}]}'),
        entry(7, "只", "ただ", "", definitions='{"reading":"ただ","pitches":[{"position":1}]}'),
    ])
    rows = lookup.entry_keys(e, m).filter("term in ('凡百', '只')").withColumn("pos", F.lit(1))
    got = lexicon.group_entries(rows, ["pos", "term"]).collect()
    assert [r.term for r in got] == ["凡百"]
    first, second = got[0].reading_groups
    assert first.reading == "ぼんぴゃく" and first.render_senses
    assert [(g.tags, [(s["index"], s["text"]) for s in g.senses]) for g in first.sense_groups] == [
        ([f"old{nbsp}kanji", f"priority{nbsp}form", "common"], [(1, "a hundred"), (2, "second")]), (["n"], [(3, "third")]),
    ]
    assert not second.render_senses and list(second.pitch_positions) == [0, 1]
    assert [(g.header, [s.text for s in g.senses]) for g in second.sense_groups] == [(["h"], ["s1", "s2"])]
