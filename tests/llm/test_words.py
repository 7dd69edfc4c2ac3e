import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from treeparity.llm import words

TEXT = st.lists(st.one_of(st.text(max_size=40), st.text("aAbB \t\n\x1c\x00é.,-", max_size=60)), max_size=8)


def spaced(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    return re.findall(r"[^\x20\x09-\x0D]+", low)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_counts_and_sets(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    raw = [t.encode() for t in texts]
    _, counts = words.hash_words(raw, words.SPACED)
    assert counts.tolist() == [len(spaced(t)) for t in texts]
    names = {}
    for t, s in zip(texts, words.sets(raw, 2), strict=True):
        w = spaced(t)
        want = {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()
        assert len(s) == len(want) and (np.diff(s.astype(object)) > 0).all()
        assert names.setdefault(frozenset(want), frozenset(s.tolist())) == frozenset(s.tolist())
    assert len(set(names.values())) == len(names)


def test_long_texts_are_cut_at_words():
    long = b"ab Cd " * (words.SEGMENT // 3) + b"x" * (words.SEGMENT * 2) + b" ab cd"
    h, counts = words.hash_words([b"ab", long, b"cd"], words.SPACED)
    assert counts.tolist() == [1, 2 * (words.SEGMENT // 3) + 3, 1]
    assert h[0] == h[1] == h[-3] and h[2] == h[-1] == h[-2]


def test_minhash_estimates_jaccard():
    a = [b"%d" % i for i in range(1000)]
    x, y = b" ".join(a), b" ".join(a[:800] + [b"n%d" % i for i in range(200)])
    h, n = words.shingles([x, y, b""], 1)
    m = words.MinHash(512)(h, n)
    assert abs((m[0] == m[1]).mean() - 800 / 1200) < 0.08
    assert (m[2] == 0xFFFFFFFF).all()
