import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from helpers import plain_sets, plain_words
from kotonoha.llm import tokens, words

ALPHABET = ["a", "Z", "é", "É", "ß", "K", " ", "\n", "\t", "\x1f", "　", "1", ".", "'", "日本", "x" * 30, " ", "  "]


def texts(n, seed, parts=ALPHABET):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_words_and_sets_match_plain_ones():
    some = [*texts(300, 1), "", None]
    names = {}
    for row, stop, h, at in words.text_rows(pa.array(some)):
        for i in range(row, stop):
            mine, plain = h[at[i - row] : at[i - row + 1]].tolist(), plain_words(some[i])
            assert len(mine) == len(plain)
            for a, b in zip(mine, plain):
                assert names.setdefault(a, b) == b
    assert len(set(names.values())) == len(names)
    plain = plain_sets(enumerate(some))
    for row, stop, values, at in words.sets(pa.array(some)):
        assert np.diff(at).tolist() == [len(plain[i]) for i in range(row, stop)]


def test_slices_do_not_change_words(monkeypatch):
    some = pa.array(texts(200, 2))
    whole = [(h.tolist(), np.diff(at).tolist()) for _, _, h, at in words.text_rows(some)]
    monkeypatch.setattr(words, "SLICE_BYTES", 50)
    parts = [(h.tolist(), np.diff(at).tolist()) for _, _, h, at in words.text_rows(some)]
    assert len(parts) > 10
    assert [x for p in parts for x in p[0]] == whole[0][0] and [x for p in parts for x in p[1]] == whole[0][1]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_those_of_the_tokenizer(name, monkeypatch):
    more = ["s", "t", "'s", "ll", "re", "…", "—", "!!", "İ", "Σ", "ς", "́", "\r", "\x85", " ", " ", "😀", "_", "<|endoftext|>"]
    some = [*texts(3000, 3, ALPHABET + more), "", None, "end\n\n", "next"]
    monkeypatch.setattr(tokens, "KEPT", 500)
    encoder = tokens.Encoder(public_tokenizers.path(name))
    for part in (some[:1500], some[1500:], some[:200]):
        ids, at = encoder.encode(pa.array(part))
        plain = encoder.tokenizer.encode_batch([t or "" for t in part], add_special_tokens=False)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [p.ids for p in plain]
