import random

import numpy as np
import pytest
from helpers import DOCS, odd_docs, plain_components, plain_sets, plain_words
from kotonoha.llm import decontaminate, jaccard_join, neighbours, queries
from kotonoha.llm.components import components


def near_copies(seed, n=240):
    """Groups of copies and near copies of very different sizes, a shared passage, short texts and ties."""
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choice(pool) for _ in range(30))
    out, bases = [], [[rng.choice(pool) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    for i in range(n):
        words = list(bases[min(rng.randint(0, 20), 11)])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(pool)
        if rng.random() < 0.2:
            words += passage.split()
        out.append((100 + i, " ".join(words)))
    return out


@pytest.mark.parametrize("settings", [{}, {"most": 6, "shard_entries": 500}, {"most": 25, "shard_entries": 3000, "part": 1.0}])
def test_join_against_all_pairs(spark, settings, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 10)
    texts = near_copies(5)
    docs = odd_docs(spark, [(i, t, "en", "a") for i, t in texts])
    got = jaccard_join.join(docs, **settings).collect()
    assert len(got) == docs.count()
    plain = plain_components([(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None])
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["class_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == plain[r["doc_id"]]


def test_join_of_rows_with_one_id(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (3, "a b c d e f g"), (4, "x")]
    got = {(r["doc_id"], r["component_id"]) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_join_of_nothing(spark):
    assert jaccard_join.join(spark.createDataFrame([], DOCS)).count() == 0


def test_links_at_the_bound(spark):
    words = [f"w{i}" for i in range(11)]
    # 7 shingles, of which the other lacks one and has one more: 6 of 8 shared
    rows = [(1, " ".join(words)), (2, " ".join(words[1:] + ["z"])), (3, " ".join(words[2:] + ["y", "x"]))]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_links_in_one_of_two_large_regions(spark):
    texts = [(i, " ".join(f"t{i % 20}w{j}" for j in range(30)) + (" z" if i >= 20 else "")) for i in range(40)]
    # of the pairs (i, i + 20), the first are in both regions, the second in one
    members = [("p", i) for i in range(20)] + [("q", i) for i in range(40)]
    members, texts = spark.createDataFrame(members, "region string, node long"), spark.createDataFrame(texts, "node long, text string")
    links = jaccard_join.region_links(members, texts, most=10)
    got = {r["node"]: r["component"] for r in components(jaccard_join._all(links)).collect()}
    assert got == {i: i % 20 for i in range(40)}


@pytest.mark.parametrize("n,most", [(40, 8), (400, 40), (2000, 100)])
def test_sets_that_share_a_body_do_not_multiply(spark, monkeypatch, n, most):
    """All within twice the distance of each other and few linked: cutting does not help, and pairs of blocks are the most that is read."""
    body = " ".join(f"b{i}" for i in range(44))
    texts = [(i, f"{body} " + " ".join(f"o{i // 2 * 2 if i % 10 < 2 else i}x{k}" for k in range(10)) + (" end" if i % 2 else "")) for i in range(n)]
    sizes = []
    block_pairs = jaccard_join._block_pairs

    def counted(members, most):
        pairs = block_pairs(members, most)
        sizes.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard_join, "_block_pairs", counted)
    members = spark.createDataFrame([("p", i) for i in range(n)], "region string, node long")
    links = jaccard_join.region_links(members, spark.createDataFrame(texts, "node long, text string"), most=most)
    got = {r["node"]: r["component"] for r in components(jaccard_join._all(links)).collect()}
    sets = plain_sets(texts)
    want = {}
    for i in range(0, n, 10):
        assert 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1]) and 100 * len(sets[i] & sets[i + 2]) < 75 * len(sets[i] | sets[i + 2])
        want |= {i: i, i + 1: i}
    assert {i: c for i, c in got.items() if i != c or i in want} == want
    assert sum(sizes) <= 3 * n * 2.5 * n / most + 8 * n


def test_long_sets_count_as_several(spark):
    texts = [(i, " ".join(f"w{k}" for k in range(2000)) + f" own{i}") for i in range(6)]
    members = spark.createDataFrame([("p", i) for i in range(6)], "region string, node long")
    links = jaccard_join.region_links(members, spark.createDataFrame(texts, "node long, text string"), most=4)
    assert {r["component"] for r in components(jaccard_join._all(links)).collect()} == {0}


def plain_edited(words, kind, edits, rng):
    words, n = list(words), len(words)
    spots = sorted(rng.sample(range(n), edits), reverse=True)
    if kind == "spread":
        for i in spots:
            words[i] = f"z{i}"
    elif kind == "every fourth":
        for i in range(edits):
            words[i * 4 + 3] = f"z{i}"
    elif kind == "insertions":
        for i in spots:
            words.insert(i, f"z{i}")
    elif kind == "deletions":
        for i in spots:
            del words[i]
    elif kind == "front":
        words[:edits] = [f"z{i}" for i in range(edits)]
    else:
        middle = (n - edits) // 2
        words[middle : middle + edits] = [f"z{i}" for i in range(edits)]
    return words


@pytest.mark.parametrize("n,rate", [(8, 0.24), (12, 0.24), (18, 0.24), (20, 0.24), (30, 0.24), (60, 0.2), (60, 0.24), (100, 0.15), (200, 0.1), (200, 0.24), (400, 0.15)])
def test_recall_holds_at_any_length(n, rate):
    import pyarrow as pa

    rng = random.Random(n)
    pool = [f"w{i}" for i in range(3000)]
    given = [[rng.choice(pool) for _ in range(n)] for _ in range(60)]
    items = decontaminate.Items(list(range(60)), [" ".join(w) for w in given])
    for kind in ("spread", "every fourth", "insertions", "deletions", "front", "middle"):
        around = lambda k: [rng.choice(pool) for _ in range(k)]
        texts = [" ".join([*around(rng.randrange(40)), *plain_edited(w, kind, int(n * rate), rng), *around(30)]) for w in given]
        found = {row + t for row, hits in decontaminate._hits(items, pa.array(texts)) for t, k, *_ in hits if row + t == k}
        assert len(found) >= 54, (kind, len(found))


def test_tables_of_an_item_grow_with_its_words():
    rng = random.Random(1)
    for n in (50, 300, 1000):
        items = decontaminate.Items(list(range(40)), [" ".join(f"w{rng.randrange(9999)}" for _ in range(n)) for _ in range(40)])
        size = sum(keys.nbytes + of.nbytes for c in items.classes for keys, of, _ in c.keys)
        assert size <= 40 * n * 90


def test_blocks_by_bytes_give_the_same_passages(spark):
    rng = random.Random(4)
    pool = [f"w{i}" for i in range(500)]
    given = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([6, 15, 40, 90])))) for i in range(30)]
    docs = [(i, f"some words {t} and more") for i, t in given[::2]] + [(100 + i, " ".join(rng.choice(pool) for _ in range(50))) for i in range(20)] + [(7, None), (8, "")]
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(given, "item_id long, text string")
    assert len(list(decontaminate.blocks(items, 1000))) > 3
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).collect()))
    assert whole and sorted(map(tuple, decontaminate.contaminated(docs, items, 1000).collect())) == whole
    kept = sorted((r["doc_id"], r["text"] or "") for r in decontaminate.keep_clean(docs, items, 1000).collect())
    assert kept == sorted((r["doc_id"], r["text"] or "") for r in decontaminate.keep_clean(docs, items).collect()) and len(kept) == 22


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def plain_distance(item, text):
    """Least edits from the item to any run of the text's words."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_alignment_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 4, rng.integers(1, 20)).astype(np.uint64)
        edits, first, end = decontaminate.align(item, text)
        assert edits == plain_distance(item.tolist(), text.tolist())
        assert plain_distance(item.tolist(), text[first:end].tolist()) == edits


def planted(rate, n=150, seed=4):
    rng = random.Random(seed)
    pool = [f"p{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    items = [[rng.choice(pool) for _ in range(rng.randint(8, 60))] for _ in range(n)]
    docs = []
    for words in items:
        words = list(words)
        for _ in range(int(len(words) * rate)):
            at = rng.randrange(len(words))
            step = rng.random()
            if step < 0.5:
                words[at] = rng.choice(pool)
            elif step < 0.75:
                words.insert(at, rng.choice(pool))
            else:
                words.pop(at)
        docs.append(" ".join(rng.choices(pool, k=rng.randint(0, 200)) + [w.upper() + ",!" for w in words] + rng.choices(pool, k=rng.randint(0, 200))))
    return [" ".join(i) for i in items], docs


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 0.97), (0.2, 0.9)])
def test_passages_are_found(spark, rate, least):
    items, texts = planted(rate)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.contaminated(docs, benchmark, block=40).collect()}
    assert sum((i, i) in got for i in range(len(items))) >= least * len(items)
    lower = [[w.strip(",!") for w in plain_words(t)] for t in texts]
    for (d, i), r in got.items():
        assert r["distance"] == plain_distance(items[i].split(), lower[d]) <= len(items[i].split()) * 0.25
        assert plain_distance(items[i].split(), lower[d][r["first_word"] : r["last_word"] + 1]) == r["distance"]


def test_odd_rows_are_not_contaminated(spark):
    docs = odd_docs(spark)
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (None, "two three four five six"), (4, "nothing like it at all"), (4, "nothing like it at all")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.contaminated(docs, benchmark).collect())
    assert got == [(1, None, 0), (1, None, 0), (2, None, 0)]
    kept = decontaminate.keep_clean(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.keep_clean(docs, benchmark.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


def nearest(rows, query, k):
    score = [(-float(np.dot(v, query[1])), i) for i, v in rows if i != query[0]]
    return [(i, -s) for s, i in sorted(score)[:k]]


@pytest.mark.parametrize("cell_rows", [60, 100_000])
def test_neighbours_against_all_pairs(spark, cell_rows):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((6, 16))
    rows = [(i, (centres[i % 6] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] + [1.0] * 15), (2003, [None] + [1.0] * 15), (2004, [float("inf")] * 16), (2005, [1.0]), (None, rows[1][1])]
    table = spark.createDataFrame(rows + rows[:20] + odd, "vec_id long, embedding array<double>")
    index = neighbours.build(table, 20, cell_rows=cell_rows)
    assert (len(index.rows) > 4) == (cell_rows == 60)
    got = {}
    for r in neighbours.search(table.filter("vec_id % 20 = 0 or vec_id >= 2000"), index, 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    by, hits = dict(rows), 0
    assert set(got) == {i for i in by if i % 20 == 0}
    for q, found in got.items():
        plain = nearest(rows, (q, by[q]), 20)
        hits += len({i for i, _ in found} & {i for i, _ in plain})
        assert len(found) == 20 and all(np.isclose(s, np.dot(by[q], by[i]), rtol=1e-12) for i, s in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0])) and q not in dict(found)
    assert hits >= 0.9 * 20 * len(got)
    # a query that is nearest to its own copies finds those of smallest id
    longest = 10 * np.ones(16)
    copies = spark.createDataFrame([(i, longest.tolist()) for i in range(3000, 3050)], "vec_id long, embedding array<double>")
    found = neighbours.search(copies.filter("vec_id = 3010"), neighbours.build(table.union(copies), 20, cell_rows=cell_rows), 20).orderBy("rank").collect()
    assert [r["vec_id"] for r in found] == [i for i in range(3000, 3021) if i != 3010]


def test_few_or_no_neighbours(spark):
    table = spark.createDataFrame([(20, [1.0, 0.0]), (3, [0.5, 1.0]), (20, [1.0, 0.0])], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in neighbours.search(table, neighbours.build(table, 5), 5).orderBy("query_id").collect()]
    assert got == [(3, 1, 20, 0.5), (20, 1, 3, 0.5)]
    nothing = table.limit(0)
    assert neighbours.search(table, neighbours.build(nothing, 5), 5).count() == 0
    assert neighbours.search(nothing, neighbours.build(table, 5), 5).count() == 0


def test_recall_of_the_query(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], np.float64)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = {}
    for r in queries.QUERIES["op4_stable_projections"](spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    by = dict(rows)
    hits = sum(len(found & {i for i, _ in nearest(rows, (q, by[q]), 20)}) for q, found in got.items())
    assert len(got) == 25 and hits >= 0.9 * 20 * 25


def test_queries_of_another_length_do_not_decide(spark):
    rows = [(i, [float(i % 7), 1.0 + i, 2.0]) for i in range(1, 40)] + [(100 + i, [1.0, 2.0]) for i in range(30)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id in (3, 5) or vec_id >= 100")
    got = neighbours.search(asked, neighbours.build(vectors, 5), 5).collect()
    assert {r["query_id"] for r in got} == {3, 5} and all(r["vec_id"] < 100 for r in got)
