"""The windows of a document are counted where the document is."""

from collections import Counter

from kotonoha.operators import ngram

TEXTS = {1: "かきかきかきく", 2: "か", 3: "", 4: None, 5: "𠮟か" * 5, 6: "かきかきかきく"}


def test_windows_of_documents_are_not_shuffled(spark):
    df = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    windows = ngram.document_windows(df, "doc_id")
    want = Counter((d, t[max(0, i - 3) : i + 1]) for d, t in TEXTS.items() for i in range(len(t or "")))
    assert {(r.doc_id, r.window): r.n for r in windows.collect()} == want
    plan = windows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_results_come_in_pieces(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(ngram, "OUT_ROWS", 2)
    got = [tuple(r.values()) for b in ngram._counted_apart(["aab", "b"], pa.array([7, 8]), 2) for r in b.to_pylist()]
    assert sorted(got) == [(7, "a", 1), (7, "aa", 1), (7, "ab", 1), (8, "b", 1)]
