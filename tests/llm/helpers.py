"""Small tables with every odd case, and plain versions of what the operators compute."""

import re

LOWER = {c: c + 32 for c in range(65, 91)}
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, region string, word string, label int, set long"


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def odd_docs(spark, more=()):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names operators use inside."""
    long_text = " ".join(f"word{i % 997} of{i % 13}" for i in range(30_000))
    rows = [
        (1, "One two three four five six seven eight.", "en", "a"),
        (1, "One two three four five six seven eight.", "en", "a"),
        (2, "one two three four five six seven eight.", "en", None),
        (3, "", "en", "a"),
        (4, None, None, None),
        (None, "a document without a number", "en", "a"),
        (None, None, None, None),
        (5, long_text, "en", "b"),
        (6, "12345 !!! 678", "de", "b"),
        (7, "é", "fr", "b"),
        (8, "\n \t  ", "fr", "b"),
        *more,
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.5, 7, "r", "w", 1, 9) for r in rows], DOCS)


def plain_sets(texts, k=5):
    out = {}
    for i, text in texts:
        w = plain_words(text)
        out[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    return out


def plain_components(texts):
    """Compares all pairs."""
    sets = plain_sets(texts)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}
