"""Whole texts to ids of a given tokenizer.

The vocabularies used here cut a text into pieces before anything else, and a
piece's ids do not depend on its neighbours.  A batch is therefore cut at
bytes where a piece surely begins, each distinct part is encoded once with the
tokenizer, and the ids of the texts are gathered from those of their parts.
The literal of an added token (``<|endoftext|>``) is one part, and what stands
before and after it is cut like texts of their own, as the tokenizer does.
A worker keeps the ids of the parts it has met, up to ``KEPT`` of them: that
changes the time only.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from kotonoha.llm import words

KEPT = 1_200_000
#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20
#: Parts encoded in one call of the tokenizer.
_CALL = 5_000

_B = np.arange(256)
_ALNUM = ((_B >= 48) & (_B <= 57)) | ((_B >= 65) & (_B <= 90)) | ((_B >= 97) & (_B <= 122))
_SIGN = (_B > 32) & (_B < 127) & ~_ALNUM
_QUOTE = _B == 39
# No white-space character begins with one of these bytes.
_SOLID = _ALNUM | _SIGN | ((_B >= 0xC3) & (_B <= 0xDF)) | (_B >= 0xE4)
_BLANK = (_B == 32) | ((_B >= 9) & (_B <= 13))
_LINE = _B == 10

_loaded: dict[str, "Encoder"] = {}


def gather(values: np.ndarray, at: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """The concatenated runs ``values[at[p] : at[p] + sizes[p]]`` for ``p`` in ``pick``."""
    n = sizes[pick]
    ends = np.cumsum(n)
    if not len(ends) or not ends[-1]:
        return values[:0]
    index = np.ones(ends[-1], np.int64)
    full = np.flatnonzero(n)
    first = at[pick[full]]
    begin = ends[full] - n[full]
    index[begin] = first
    index[begin[1:]] -= first[:-1] + n[full[:-1]] - 1
    return values[np.cumsum(index)]


class Encoder:
    """``encode(texts)`` gives all ids and where each text's ids begin (one entry more than texts)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        # this vocabulary's normalizer lower-cases and its cutting drops white space
        self.folds = given.get("normalizer") is not None
        added = given.get("added_tokens") or []
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] and self.folds for t in added):
            raise ValueError("added tokens that take white space, stand as whole words or are found in normalized text are not supported")
        # of those that begin at one place the longest
        self.added = sorted((t["content"].encode() for t in added if t["content"]), key=len, reverse=True)
        self._added = re.compile(b"|".join(map(re.escape, self.added)))
        self._keys = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._sizes = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.uint32)

    def _literals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Begins and ends of the literals of added tokens, none of which reaches over the end of its text."""
        content, at, found = data.tobytes(), 0, []
        if any(t in content for t in self.added):
            while m := self._added.search(content, at):
                stop = int(offsets[np.searchsorted(offsets, m.start(), "right")])
                at = m.start() + 1
                # at the end of its text a shorter one may fit, or none
                if m := self._added.match(content, m.start(), stop):
                    found.append(m.span())
                    at = m.end()
        return np.array(found, np.int64).reshape(-1, 2)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray, literals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends of the parts."""
        n = len(data)
        starts = np.unique(np.concatenate((offsets[:-1], literals.ravel())))
        starts = starts[starts < n]
        cut = np.zeros(n, bool)
        alnum, sign = _ALNUM[data], _SIGN[data]
        cut[1:] |= alnum[:-1] & sign[1:]
        cut[1:] |= sign[:-1] & ~_QUOTE[data[:-1]] & alnum[1:]
        if self.folds:
            blank = _BLANK[data]
            cut[1:] |= blank[1:] != blank[:-1]
        else:
            solid, line = _SOLID[data], _LINE[data]
            before = (line[:-1] | (data[:-1] == 32)) & solid[1:]
            # the next text's first byte says nothing about this one's last
            before[starts[starts > 0] - 1] = False
            cut[:-1] |= before
            cut[1:] |= line[:-1] & solid[1:]
        for begin, end in literals.tolist():
            cut[begin:end] = False
        cut[starts] = True
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], n)
        if self.folds:
            full = ~_BLANK[data[at]]
            at, ends = at[full], ends[full]
        return at, ends

    def _look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spot = np.searchsorted(self._keys, keys)
        spot[spot == len(self._keys)] = 0
        return spot, (self._keys[spot] == keys) if len(self._keys) else np.zeros(len(keys), bool)

    def _learn(self, keys: np.ndarray, parts: list[bytes]) -> None:
        found = []
        for i in range(0, len(parts), _CALL):
            batch = [p.decode("utf-8", "replace") for p in parts[i : i + _CALL]]
            found += [x.ids for x in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter((i for x in found for i in x), np.uint32, int(sizes.sum()))
        at = len(self._ids) + np.cumsum(sizes) - sizes
        # both are in order
        spot = np.searchsorted(self._keys, keys)
        self._keys = np.insert(self._keys, spot, keys)
        self._at = np.insert(self._at, spot, at)
        self._sizes = np.insert(self._sizes, spot, sizes)
        self._ids = np.concatenate((self._ids, ids))

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """For a column of texts; a null text counts as empty."""
        keys, counts, where = [], [], []
        for row, stop, data, offsets in words.slices(column):
            if not len(data):
                counts.append(np.zeros(stop - row, np.int64))
                continue
            low = words.LOWER[data] if self.folds else data
            literals = self._literals(data, offsets)
            if self.folds:
                for begin, end in literals.tolist():
                    # found in the text as it is
                    low[begin:end] = data[begin:end]
            at, ends = self._cuts(low, offsets, literals)
            keys.append(words.spans(low, at, ends) if len(at) else np.zeros(0, np.uint64))
            counts.append(np.diff(np.searchsorted(at, offsets)))
            where.append((low, at, ends))
        parts = np.concatenate([[0], *counts]).cumsum().astype(np.int64)
        if not keys or not parts[-1]:
            return np.zeros(0, np.uint32), np.zeros(len(parts), np.int64)
        every = np.concatenate(keys)
        unique, first, inverse = np.unique(every, return_index=True, return_inverse=True)
        if len(self._keys) > KEPT:
            self._keys, self._at, self._sizes, self._ids = self._keys[:0], self._at[:0], self._sizes[:0], self._ids[:0]
        _, known = self._look_up(unique)
        fresh = np.flatnonzero(~known)
        if len(fresh):
            block_at = np.concatenate(([0], np.cumsum([len(k) for k in keys])))
            texts = []
            for i, b in zip(first[fresh], np.searchsorted(block_at, first[fresh], "right") - 1):
                low, at, ends = where[b]
                j = i - block_at[b]
                texts.append(low[at[j] : ends[j]].tobytes())
            self._learn(unique[fresh], texts)
        spot, _ = self._look_up(unique)
        pick = spot[inverse]
        ids = gather(self._ids, self._at, self._sizes, pick)
        return ids, np.concatenate(([0], np.cumsum(self._sizes[pick])))[parts]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def batches(column, size: int = BATCH_BYTES):
    """Row ranges of a column of about ``size`` bytes of text each."""
    import pyarrow.compute as pc

    n = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, row = np.concatenate(([0], np.cumsum(n))), 0
    while row < len(n):
        stop = max(row + 1, int(np.searchsorted(total, total[row] + size, "right")) - 1)
        yield row, stop
        row = stop
