import hashlib
import random
import re

import numpy as np
import pytest
from kotonoha.llm import conversation_repair
from kotonoha.llm.queries import damaged
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, keep boolean, code long, report string, grp string"


def plain(rows):
    """Sweeps strings of edits forward; every state keeps the least pair of cost and audit."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", x)
        faults.append("blank" if not solid else "duplicate" if (r, x) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((r, x))
    steps = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}
    names = {"u": "user", "a": "assistant"}
    best = {(0, ""): (0, "", ())}

    def put(key, value):
        if key not in best or value[:2] < best[key][:2]:
            best[key] = value

    for i in range(len(rows) + 1):
        for _ in range(3):
            for q in "", "s", "u", "a":
                for n in "ua":
                    if (i, q) in best and (q, n) in steps:
                        c, a, o = best[i, q]
                        put((i, n), (c + 2, a + "I", (*o, (names[n], ""))))
        if i == len(rows):
            break
        _, role, text = rows[i]
        for q in "", "s", "u", "a":
            if (i, q) not in best:
                continue
            c, a, o = best[i, q]
            put((i + 1, q), (c + 3, a + "D", o))
            if faults[i] in ("blank", "duplicate"):
                continue
            c += faults[i] == "truncated"
            if (q, role[:1]) in steps:
                put((i + 1, role[:1]), (c, a + "K", (*o, (role, text))))
            for n in "ua":
                if (q, n) in steps:
                    put((i + 1, n), (c + 2, a + "R", (*o, (names[n], text))))
    cost, audit, out = min(best[k] for k in ((len(rows), ""), (len(rows), "a")) if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest(),
    }


@pytest.fixture(scope="module")
def invented():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünd"]
    texts = ["Hi.", "Yes!", "a", "", " \n", "Ça va?", None, "x" * 50_000 + ".", *[f"text {k}." for k in range(20)]]
    out = {}
    for i in [None, *range(50)]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 8, 60])
        out[i] = [(rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]
    # nothing to do, one system row, only faults, many copies of one row, and a long sound one
    out[50] = [(0, "user", "Hi."), (1, "assistant", "Yes.")]
    out[51] = [(0, "system", "You.")]
    out[52] = [(0, "user", " "), (1, "assistant", "")]
    out[53] = [(0, "user", "Hi.")] * 90
    out[54] = [(k, "user" if k % 2 == 0 else "assistant", f"t{k}.") for k in range(150)]
    return out


def frame(spark, data):
    rows = [(c, *r, True) for c, v in data.items() for r in v] + [(c, None, None, None, False) for c in data]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(*r, 9, "r", "g") for r in rows], SCHEMA)


# whole tables in one task; small segments; segments by bytes; a task for nearly every row
@pytest.mark.parametrize("parts,rows,size", [(1, 4096, 1 << 20), (7, 5, 1 << 20), (3, 20, 40), (40, 3, 1 << 20)])
def test_reports_are_those_of_a_plain_search(spark, invented, parts, rows, size):
    got = conversation_repair.repair(frame(spark, invented), F.col("keep"), parts, rows, size).collect()
    assert len(got) == len(invented)
    for r in got:
        own = r.asDict()
        assert plain(invented[own.pop("conv_id")]) == own


def test_turns_are_those_that_are_hashed(spark, invented):
    df = frame(spark, invented)
    digests = {r["conv_id"]: r["repaired_sha256"] for r in conversation_repair.repair(df, F.col("keep"), 7, 5).collect()}
    turns = {c: [] for c in invented}
    for r in sorted(conversation_repair.repaired(df, F.col("keep"), 7, 5).collect(), key=lambda r: r["number"]):
        assert r["number"] == len(turns[r["conv_id"]]) and (r["edit"] != "I" or r["turn"] is None and r["text"] == "")
        turns[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(t).encode()).hexdigest() for c, t in turns.items()} == digests
    assert {len(t) % 2 == 0 or t[0][:1] == "s" for t in turns.values()} == {True}


def test_no_conversations(spark):
    assert conversation_repair.repair(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_repair.repaired(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ranks_of_doubled_lengths_order_nodes_by_their_audits():
    rng = np.random.default_rng(2)
    n = 200
    codes, gone, cut, at = rng.integers(0, 4, n), rng.random(n) < 0.2, rng.random(n) < 0.2, np.array([0, 70, 70, n])
    least = conversation_repair.costs(codes, gone, cut, at, np.tile(conversation_repair.ENDS, (3, 1)), True)
    ranked = conversation_repair.Ranked(codes, gone, cut, at, least, True)
    nodes, begins, _ = ranked.path(np.arange(least.size))
    audits = [tuple(ranked.label[nodes[i:j]]) for i, j in zip(begins[:-1], begins[1:])]
    order = sorted(set(audits))
    assert [order.index(a) for a in audits] == ranked.rank.tolist()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (1, 2, None) for t in (*range(60), None)]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = None if kind == 0 else "" if kind == 1 else "One Two" if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text, kind > 0)] * (2 if kind == 3 else 1)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
