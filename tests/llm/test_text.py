import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from recoup.llm import text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(s):
    return WORD.findall((s or "").translate(LOW))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB zé9.\n東", max_size=30)), max_size=8))
def test_words_are_the_pattern_s(texts):
    w = text.words(pa.array(texts, pa.string()))
    want = [plain_words(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in want]
    assert text.count_words(pa.array(texts, pa.string())).tolist() == [len(x) for x in want]
    flat = [x for row in want for x in row]
    seen = {}
    for h, x in zip(w.hash.tolist(), flat, strict=True):
        assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=30), st.integers(1, 6))
def test_grams_are_equal_where_the_words_are(letters, k):
    w = text.words(pa.array([" ".join(letters)], pa.string()))
    g = text.grams(w.hash, k)
    seen = {}
    for i, h in enumerate(g.tolist()):
        assert seen.setdefault(tuple(letters[i:i + k]), h) == h
    assert len(set(seen.values())) == len(seen)


def test_pieces_keep_all_rows_and_bound_their_bytes():
    batch = pa.record_batch({"a": pa.array(range(7)), "t": pa.array(["x" * 40, None, "", "y" * 500, "z", "é" * 30, "w"])})
    parts = list(text.pieces([batch, batch.slice(0, 0)], 1, 100))
    assert [x for p in parts for x in p.column(0).to_pylist()] == list(range(7))
    assert all(p.num_rows == 1 or sum(len((x or "").encode()) for x in p.column(1).to_pylist()) <= 100 for p in parts)


def test_a_text_longer_than_a_piece():
    long = "ab cd " * 400_000
    w = text.words(pa.array([long, "ab"], pa.string()))
    assert len(w.hash) == 800_001 and w.hash[0] == w.hash[2] == w.hash[-1] and w.hash[1] != w.hash[0]


def test_short_hash_tells_words_of_every_length_apart():
    words = ["x" * k + end for k in range(140) for end in ("a", "b", "é")] + ["y" * k + "x" * (139 - k) for k in range(139)]
    w = text.words(pa.array([" ".join(words), " " + " ".join(reversed(words))], pa.string()), text.short_hash)
    h = w.hash.tolist()
    assert h[:len(words)] == h[len(words):][::-1]
    assert len(set(h)) == len(set(words))
