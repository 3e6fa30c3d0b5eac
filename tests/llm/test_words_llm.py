import re

import numpy as np
from hypothesis import given, settings, strategies as st

from tickerloom.llm import words as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXT = st.text(alphabet="aB \t\n\x0b\x0c\r\x1c\x85\xa0É9-_.{~é", max_size=40)


def low(text):
    return text.translate(str.maketrans(UPPER, LOWER))


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_words_are_those_of_the_patterns(text):
    blank = [w.decode() for w in W.split_words(text)]
    assert blank == re.findall(r"[^\x20\x09-\x0D]+", low(text))
    alnum = [w.decode() for w in W.split_words(text, W.ALNUM)]
    assert alnum == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9).map(" ".join), max_size=6))
def test_shingle_sets_equal_sets_of_words(texts):
    sets = list(W.shingle_sets(texts, 3))
    plain = []
    for t in texts:
        w = t.split()
        plain.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    for a, p in zip(sets, plain, strict=True):
        assert len(a) == len(p)
        for b, q in zip(sets, plain, strict=True):
            assert len(np.intersect1d(a, b)) == len(p & q)


def test_rounds_cover_all_texts_once(monkeypatch):
    monkeypatch.setattr(W, "ROUND_CHARS", 5)
    texts = ["abc", None, "", "x" * 50, "ab", "cd"]
    assert [i for lo, hi in W.rounds(texts) for i in range(lo, hi)] == list(range(6))
    assert list(W.rounds([])) == []
    assert [len(s) for s in W.shingle_sets(["a b c d", None, "", "a"], 2)] == [3, 0, 0, 1]
