"""Repair of the structure of conversations by cheapest edits.

The roles of a sound conversation begin with ``s?(ua)+``, or there are none.  Edits: Keep a row (0), Rerole it to user or
assistant (2), Delete it (3; needed for blank and repeated rows), Insert an empty turn of user or assistant (2); a truncated
row that is not deleted adds 1.  Of the cheapest sequences of edits that with the least initials is taken.

1. Rows are put in order by range.  A task goes through its rows conversation by conversation.
2. Nodes are the places between rows in the four states of the pattern.  A dynamic program from the end gives each node's
   least cost; the arcs that keep to it are the optimal ones.
3. Nodes are ranked by the least audit of length 1, 2, 4, ... that begins at them: a rank is that of the pair of the ranks of
   the node and of the node its pointer leads to, and pointers double along.  The initials of a node's arcs differ, so
   the least audit of any length ends at one node.
4. The least path from the first node is read through the doubled pointers.

Conversations that a task does not see whole, or that are long, are cut into segments of bounded size.  A segment is a
table of least costs from state to state; costs are carried over those tables from the end; each segment then ranks its
nodes for all four states in which it may be entered; and one pass in order, which holds nothing but the current piece,
joins audits and hashes texts, as a digest of a whole text can only be taken in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kotonoha.functions.tables import written

#: Rows and bytes of text of a conversation, or a segment, that a task holds.
MOST_ROWS, MOST_BYTES = 4096, 16 << 20
#: Rows and bytes of text of whole conversations that are solved together.
TOGETHER, TOGETHER_BYTES = 20_000, 32 << 20

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
# Initials in the order of their bytes; 0 stands for the end.
INITIALS = ["", "D", "I", "K", "R"]
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial (s, u, a, other), from each state; -1 where the pattern does not go on.
AFTER = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: The state after the one of user and assistant that may follow.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: Costs at the end of a conversation.
ENDS = np.array([0, FAR, FAR, 0])
NAMES = {USER: "user", ASSISTANT: "assistant"}
_CODES = {"s": 0, "u": 1, "a": 2}
LEGAL = {"su", "ua", "au"}


def code(role: str) -> int:
    return _CODES.get(role[:1], 3)


def faults(text: str) -> tuple[bool, bool]:
    """Whether a text is blank, and whether its end is missing."""
    solid = text.rstrip(BLANKS)
    return not solid, bool(solid) and solid[-1] not in ".!?"


def _with_inserts(cost: np.ndarray) -> np.ndarray:
    """Least costs of places ``(n, 4)`` if turns may be inserted there."""
    out = np.minimum(cost, INSERT + cost[:, NEXT])
    return np.minimum(out, INSERT + out[:, NEXT])


def costs(codes: np.ndarray, gone: np.ndarray, cut: np.ndarray, at: np.ndarray, ends: np.ndarray, inserts: bool) -> np.ndarray:
    """Least cost from every node to the end: row ``at[c] + c + i`` has the states of place ``i`` of conversation ``c``.

    ``ends`` are the costs of the last places, at which turns may be inserted only if ``inserts``.
    """
    m, sizes = len(at) - 1, np.diff(at)
    first = at[:-1] + np.arange(m)
    out = np.empty((at[-1] + m, 4), np.int64)
    out[first + sizes] = _with_inserts(ends) if inserts else ends
    by_size = np.argsort(-sizes, kind="stable")
    longest = sizes[by_size]
    for t in range(1, int(longest[0]) + 1 if m else 1):
        who = by_size[: np.searchsorted(-longest, -t, "right")]
        place, row = (first + sizes)[who] - t, at[1:][who] - t
        out[place] = _with_inserts(np.minimum.reduce(_row_arcs(codes[row], gone[row], cut[row], out[place + 1])))
    return out


def _row_arcs(codes, gone, cut, then) -> list[np.ndarray]:
    """Costs of deleting, keeping and reroling rows in each state, given those of the places after them."""
    must = np.where(gone, FAR, 0)[:, None]
    more = np.where(cut, TRUNCATED, 0)[:, None] + must
    to = AFTER.T[codes]
    kept = np.where(to >= 0, np.take_along_axis(then, np.maximum(to, 0), 1), FAR)
    return [DELETE + then, KEEP + more + kept, REROLE + more + then[:, NEXT]]


class Ranked:
    """Nodes ranked by the initials of their least audits, and pointers doubled along those."""

    def __init__(self, codes, gone, cut, at, least, inserts):
        m = len(at) - 1
        owner = np.repeat(np.arange(m), np.diff(at) + 1)
        place = np.arange(len(least))
        last = np.zeros(len(least), bool)
        last[at[1:] + np.arange(m)] = True
        row = np.minimum(place - owner, max(0, at[-1] - 1))
        then = least[np.minimum(place + 1, len(least) - 1)]
        after = np.broadcast_to(np.arange(4), least.shape)
        to = [after, np.broadcast_to(NEXT, least.shape), np.zeros_like(least), np.broadcast_to(NEXT, least.shape)]
        cost = [np.full(least.shape, FAR)] * 4
        if at[-1]:
            removed, kept, changed = _row_arcs(codes[row], gone[row], cut[row], then)
            to[2] = np.maximum(AFTER.T[codes[row]], 0)
            cost = [np.where(last[:, None], FAR, c) for c in (removed, removed, kept, changed)]
        cost[1] = INSERT + least[:, NEXT]
        if not inserts:
            cost[1] = np.where(last[:, None], FAR, cost[1])
        label, target = np.zeros(least.shape, np.int64), np.arange(least.size).reshape(least.shape)
        for k in range(3, -1, -1):  # the least initial is written last
            good = (cost[k] == least) & (least < FAR)
            step = 0 if k == 1 else 1
            label = np.where(good, k + 1, label)
            target = np.where(good, (place + step)[:, None] * 4 + to[k], target)
        self.label, self.place = label.ravel(), place
        pointer, rank, length = target.ravel(), self.label, (self.label > 0).astype(np.int64)
        self.pointers = []
        while True:
            self.pointers.append(pointer)
            further = length[pointer]
            if not further.any():
                break
            pair = rank * (int(rank.max()) + 1) + rank[pointer]
            rank = np.unique(pair, return_inverse=True)[1]
            length, pointer = length + further, pointer[pointer]
        self.rank, self.length = rank, length

    def path(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nodes on the least paths from ``starts``, where each path begins among them, and the nodes at their ends."""
        n = self.length[starts]
        begins = np.concatenate(([0], np.cumsum(n)))
        step = np.arange(begins[-1]) - np.repeat(begins[:-1], n)
        nodes, ends = np.repeat(starts, n), starts
        for k, pointer in enumerate(self.pointers):
            nodes = np.where(step >> k & 1, pointer[nodes], nodes)
            ends = np.where(n >> k & 1, pointer[ends], ends)
        return nodes, begins, ends


_LETTERS = np.array([ord(c) if c else 0 for c in INITIALS], np.uint8)


def solve(codes: np.ndarray, gone: np.ndarray, cut: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Least costs and audits of whole conversations."""
    m = len(at) - 1
    least = costs(codes, gone, cut, at, np.tile(ENDS, (m, 1)), True)
    starts = (at[:-1] + np.arange(m)) * 4 + START
    ranked = Ranked(codes, gone, cut, at, least, True)
    nodes, begins, _ = ranked.path(starts)
    letters = _LETTERS[ranked.label[nodes]].tobytes().decode()
    return least.ravel()[starts], [letters[i:j] for i, j in zip(begins[:-1], begins[1:])]


def edited(audit: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str, bool]]:
    """``(edit, role, text, takes a row)`` of the turns that stay; ``rows`` gives role and text of the rows in order."""
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = int(AFTER[state, code(role)]) if edit == "K" else int(NEXT[state])
        yield edit, role if edit == "K" else NAMES[state], text, edit != "I"


class Report:
    """What is counted and hashed of a conversation, row by row in order."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.last = None
        self.text, self.any = hashlib.sha256(), False

    def row(self, turn, role, blank, duplicate, truncated) -> None:
        self.blank += blank
        self.duplicate += not blank and duplicate
        self.truncated += not blank and not duplicate and truncated
        if self.last is not None and self.last + role[:1] not in LEGAL:
            self.illegal += 1
        self.last = role[:1]
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn

    def turn(self, role: str, text: str) -> None:
        self.text.update(f"\n{role}:{text}".encode("utf-8", "surrogatepass") if self.any else f"{role}:{text}".encode("utf-8", "surrogatepass"))
        self.any = True

    def out(self, cost: int, audit: str) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal,
            "cost": cost, "audit": audit, "repaired_sha256": self.text.hexdigest(),
        }


REPORT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
          ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
ROW = [("part", pa.int64()), ("segment", pa.int64()), ("position", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()),
       ("kept", pa.bool_()), ("blank", pa.bool_()), ("truncated", pa.bool_())]
TURN = [("number", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
_SQL = {pa.int64(): "long", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(fields) -> str:
    return "struct<" + ", ".join(f"{n}: {_SQL[t]}" for n, t in fields) + ">"


class _Out:
    """Rows of a pass: a conversation with a report, a turn, or a row of a conversation that is not solved yet."""

    def __init__(self, kind: pa.DataType):
        self.kind = kind
        self.schema = pa.schema([("conv_id", kind), ("report", pa.struct(REPORT)), ("repaired", pa.struct(TURN)), ("row", pa.struct(ROW))])
        self.ids, self.columns, self.size = [], ([], [], []), 0

    def add(self, conv_id, which: int, value: dict) -> None:
        self.ids.append(conv_id)
        for k in range(3):
            self.columns[k].append(value if k == which else None)
        self.size += 200 + len(value.get("text") or "")

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(self.ids, self.kind)] + [pa.array(c, f.type) for c, f in zip(self.columns, list(self.schema)[1:])]
        self.ids, self.columns, self.size = [], ([], [], []), 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

    def full(self) -> bool:
        return self.size > 8 << 20


def _solved(waiting: list[tuple], out: _Out, turns: bool) -> None:
    """Reports of whole conversations ``(conv_id, rows)``; a row is ``(turn, role, text, blank, duplicate, truncated)``."""
    at = np.concatenate(([0], np.cumsum([len(rows) for _, rows in waiting]))).astype(np.int64)
    flat = [r for _, rows in waiting for r in rows]
    codes = np.array([code(r[1]) for r in flat], np.int64)
    gone = np.array([r[3] or r[4] for r in flat], bool)
    cut = np.array([r[5] for r in flat], bool)
    cost, audits = solve(codes, gone, cut, at)
    for (conv_id, rows), own, audit in zip(waiting, cost.tolist(), audits):
        report = Report()
        for r in rows:
            report.row(r[0], r[1], *r[3:])
        _emit(conv_id, report, audit, START, iter(rows), out, turns, 0)
        out.add(conv_id, 0, report.out(own, audit))
    waiting.clear()


def _emit(conv_id, report: Report, audit: str, state: int, rows: Iterator[tuple], out: _Out, turns: bool, number: int) -> int:
    at: list = [None]

    def read():
        for at[0] in rows:
            yield at[0][1], at[0][2]

    for edit, role, text, takes in edited(audit, state, read()):
        report.turn(role, text)
        if turns:
            out.add(conv_id, 1, {"number": number, "edit": edit, "turn": at[0][0] if takes else None, "role": role, "text": text})
        number += 1
    return number


def _walk(turns: bool, most_rows: int, most_bytes: int):
    """The pass over sorted rows: solves conversations that it sees whole and hands on the rows of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = None
        first, open_, current = True, True, object()
        rows: list[tuple] = []  # of the current conversation
        seen, held, waiting, n_waiting, n_bytes = set(), 0, [], 0, 0
        segment = position = size = 0

        def hand_on(r) -> None:
            nonlocal segment, position, size
            turn, role, text, kept, blank, _, truncated = r
            if position == most_rows or size > most_bytes:
                segment, position, size = segment + 1, 0, 0
            out.add(current, 2, {"part": part, "segment": segment, "position": position, "turn": turn, "role": role, "text": text,
                                 "kept": kept, "blank": blank, "truncated": truncated})
            position, size = position + 1, size + len(text)

        for b in batches:
            if out is None:
                out = _Out(b.column(0).type)
            for conv_id, turn, role, text, kept in zip(*[b.column(k).to_pylist() for k in range(5)]):
                if first or conv_id != current:
                    if not first and not open_:
                        waiting.append((current, [(*r[:3], *r[4:]) for r in rows if r[3]]))
                        n_waiting, n_bytes = n_waiting + len(rows) + 1, n_bytes + held
                        if n_waiting > TOGETHER or n_bytes > TOGETHER_BYTES:
                            _solved(waiting, out, turns)
                            n_waiting = n_bytes = 0
                    # the first conversation of a task may have begun in the one before
                    open_ = first
                    current, first, rows, seen, held = conv_id, False, [], set(), 0
                    segment, position, size = 0, 0, 0
                blank, truncated = faults(text) if kept else (False, False)
                known = kept and (role, text) in seen
                r = (turn, role, text, kept, blank, known, truncated)
                if not open_:
                    rows.append(r)
                    if kept:
                        seen.add((role, text))
                    held += len(text)
                    if len(rows) > most_rows or held > most_bytes:
                        open_ = True
                        for r in rows:
                            hand_on(r)
                        rows, seen = [], set()
                else:
                    hand_on(r)
                if out.full():
                    yield out.batch()
        if out is None:
            return
        for r in rows:  # the last one may go on in the next task
            hand_on(r)
        if waiting:
            _solved(waiting, out, turns)
        yield out.batch()

    return run


def _narrow(group: pa.Table) -> tuple:
    order = np.argsort(group["position"].to_numpy())
    columns = [group[n].to_numpy(zero_copy_only=False)[order] for n in ("code", "gone", "cut")]
    return *columns, np.array([0, len(order)])


def _cost_table(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """Least costs of a segment from state to state."""
    codes, gone, cut, at = _narrow(group)
    n = len(codes)
    ends = np.where(np.eye(4, dtype=bool), 0, FAR)
    least = costs(np.tile(codes, 4), np.tile(gone, 4), np.tile(cut, 4), np.arange(5) * n, ends, False)
    table = least[np.arange(4) * (n + 1)].T  # by state at the begin, then at the end
    return pa.table({"grp": [key[0].as_py()], "part": [key[1].as_py()], "segment": [key[2].as_py()], "table": [np.minimum(table, FAR).ravel().tolist()]})


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each segment, over the segments of a conversation from its last to its first."""
    current, after, last = None, None, True
    for b in batches:
        rows = {"grp": [], "part": [], "segment": [], "after": [], "is_last": [], "before": []}
        for grp, part, segment, table in zip(*[b.column(k).to_pylist() for k in range(4)]):
            if grp != current:
                current, after, last = grp, _with_inserts(ENDS[None])[0], True
            before = np.minimum((np.array(table, np.int64).reshape(4, 4) + after).min(1), FAR)
            for name, value in zip(rows, (grp, part, segment, after.tolist(), last, before.tolist())):
                rows[name].append(value)
            after, last = before, False
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema(
            [("grp", pa.string()), ("part", pa.int64()), ("segment", pa.int64()), ("after", pa.list_(pa.int64())), ("is_last", pa.bool_()), ("before", pa.list_(pa.int64()))]))


def _pieces(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
    """The audit of a segment and the state after it, for each state before it."""
    codes, gone, cut, at = _narrow(group)
    after, is_last = np.array(group["after"][0].as_py(), np.int64), group["is_last"][0].as_py()
    ends = ENDS if is_last else after
    least = costs(codes, gone, cut, at, ends[None], is_last)
    ranked = Ranked(codes, gone, cut, at, least, is_last)
    nodes, begins, stops = ranked.path(np.arange(4))
    letters = _LETTERS[ranked.label[nodes]].tobytes().decode()
    return pa.table({
        "grp": [key[0].as_py()], "part": [key[1].as_py()], "segment": [key[2].as_py()],
        "audits": [[letters[i:j] for i, j in zip(begins[:-1], begins[1:])]], "states": [(stops % 4).tolist()], "costs": [least[0].tolist()],
    })


def _finish(turns: bool):
    """The pass over segments and their rows in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        current = key = report = None
        state = number = cost = 0
        audits: list[str] = []
        edits: Iterator[str] = iter(())

        def take(edit: str, row: tuple | None) -> None:
            nonlocal state, number
            if edit == "D":
                return
            role, text = (row[1], row[2]) if row else ("", "")
            state = int(AFTER[state, code(role)]) if edit == "K" else int(NEXT[state])
            role = role if edit == "K" else NAMES[state]
            report.turn(role, text)
            if turns:
                out.add(current, 1, {"number": number, "edit": edit, "turn": row[0] if row else None, "role": role, "text": text})
            number += 1

        def rest() -> None:
            for edit in edits:
                take(edit, None)

        for b in batches:
            if out is None:
                out = _Out(b.schema.field("conv_id").type)
            for grp, conv_id, position, turn, role, text, kept, blank, duplicate, truncated, pieces, first_costs in zip(*[c.to_pylist() for c in b.columns]):
                if position < 0:
                    rest()
                    if grp != key:
                        if report:
                            out.add(current, 0, report.out(cost, "".join(audits)))
                        key, report, state, number, audits = grp, Report(), START, 0, []
                        cost = first_costs[START]
                    edits = iter(pieces[state])
                    audits.append(pieces[state])
                    current = conv_id
                elif kept:
                    current = conv_id
                    report.row(turn, role, blank, duplicate, truncated)
                    while (edit := next(edits)) == "I":
                        take(edit, None)
                    take(edit, (turn, role, text))
                else:
                    current = conv_id
                if out.full():
                    yield out.batch()
        if out is None:
            return
        rest()
        out.add(current, 0, report.out(cost, "".join(audits)))
        yield out.batch()

    return run


def _long(rows: DataFrame, kind: str, turns: bool) -> DataFrame:
    """Conversations that no task saw whole: ``rows`` are written, with their segments and positions."""
    key = ["grp", "part", "segment"]
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("grp"), "conv_id", "row.*")
    rows = rows.withColumn("digest", F.when(F.col("kept"), F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    place = F.struct("part", "segment", "position")
    first = rows.filter("kept").groupBy("grp", "digest").agg(F.min(place).alias("first"))
    flagged = rows.join(first, ["grp", "digest"], "left").withColumn("duplicate", F.coalesce(F.col("first") < place, F.lit(False)))
    flagged = written(flagged.drop("first", "digest"), "repair-rows")
    initial = F.substring("role", 1, 1)
    narrow = flagged.filter("kept").select(
        *key, "position", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).cast("long").alias("code"),
        (F.col("blank") | F.col("duplicate")).alias("gone"), F.col("truncated").alias("cut"),
    )
    # segments whose rows are all only named have an empty table of costs
    named = flagged.select(*key).distinct()
    tables = narrow.groupBy(*key).applyInArrow(_cost_table, "grp string, part long, segment long, table array<long>")
    empty = F.array(*[F.lit(0 if i % 5 == 0 else FAR) for i in range(16)]).cast("array<long>")
    tables = named.join(tables, key, "left").select(*key, F.coalesce("table", empty).alias("table"))
    tables = written(tables, "repair-segments")
    order = ["grp", F.col("part").desc(), F.col("segment").desc()]
    carried = tables.repartition("grp").sortWithinPartitions(*order).mapInArrow(
        _carry, "grp string, part long, segment long, after array<long>, is_last boolean, before array<long>")
    carried = written(carried, "repair-carried")
    pieces = narrow.join(carried.drop("before"), key).groupBy(*key).applyInArrow(
        _pieces, "grp string, part long, segment long, audits array<string>, states array<long>, costs array<long>")
    # an empty segment at the end of a conversation may still insert turns
    ends = {False: ["", "", "", ""], True: ["", "II", "I", ""]}
    left = carried.select(*key, "before", *[F.when(F.col("is_last"), F.array(*map(F.lit, ends[True]))).otherwise(F.array(*map(F.lit, ends[False]))).alias("idle")])
    maps = left.join(pieces, key, "left").join(flagged.groupBy(*key).agg(F.first("conv_id").alias("conv_id")), key)
    maps = maps.select(*key, F.coalesce("audits", "idle").alias("pieces"), F.col("before").alias("first_costs"), "conv_id")
    none = {"turn": "long", "role": "string", "text": "string", "kept": "boolean", "blank": "boolean", "duplicate": "boolean", "truncated": "boolean"}
    heads = maps.select(*key, "conv_id", F.lit(-1).cast("long").alias("position"), *[F.lit(None).cast(t).alias(n) for n, t in none.items()], "pieces", "first_costs")
    lines = flagged.select(*key, "conv_id", "position", *none, F.lit(None).cast("array<string>").alias("pieces"), F.lit(None).cast("array<long>").alias("first_costs"))
    both = heads.unionByName(lines).repartition("grp").sortWithinPartitions(*key, "position")
    return both.select("grp", "conv_id", "position", *none, "pieces", "first_costs").mapInArrow(_finish(turns), _schema(kind))


def _schema(kind: str) -> str:
    return f"conv_id {kind}, report {_ddl(REPORT)}, repaired {_ddl(TURN)}, row {_ddl(ROW)}"


def _run(conversations: DataFrame, kept, turns: bool, parts: int | None, most_rows: int, most_bytes: int) -> DataFrame:
    space = F.lit(" ")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), space).alias("role"), F.coalesce(F.col("text"), space).alias("text"),
        (F.lit(True) if kept is None else kept).alias("kept"),
    )
    # the range's keys are short and never decrease along the order, so rows of one turn are dealt out too
    keys = ["conv_id", "turn", F.substring("role", 1, 8), F.substring("text", 1, 24)]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", "text", "kept")
    done = written(dealt.mapInArrow(_walk(turns, most_rows, most_bytes), _schema(kind)), "repair")
    open_ = done.filter("row is not null")
    if open_.isEmpty():
        return done
    return done.filter("row is null").unionByName(_long(open_, kind, turns))


def repair(conversations: DataFrame, kept=None, parts: int | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per conversation: counts of faults, the least ``cost`` and ``audit``, and the digest of what is repaired.

    Reads ``conv_id, turn, role, text``; other columns may have any name.  Rows are taken by ``turn`` (nulls first), then role
    and text.  A null role or text is one space; a null ``conv_id`` is a conversation like others.  Equal rows are
    duplicates of the first.  Where ``kept`` is false a row only names its conversation: one without kept rows has zeros, an empty
    audit and the digest of nothing.  An empty table gives no rows.  Long texts and conversations are read in pieces.
    """
    return _run(conversations, kept, False, parts, most_rows, most_bytes).filter("report is not null").select("conv_id", "report.*")


def repaired(conversations: DataFrame, kept=None, parts: int | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The turns that stay or come: ``conv_id``, ``number`` (from 0), ``edit``, ``turn`` (null if inserted), ``role``, ``text``; cases as ``repair``."""
    return _run(conversations, kept, True, parts, most_rows, most_bytes).filter("repaired is not null").select("conv_id", "repaired.*")
