import hashlib
import random
import re

import numpy as np
import pytest

from recoup.llm import repeats


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    for (doc, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - width + 1):
            g = tuple(w[i:i + width])
            if doc is not None:
                first[g] = min(first.get(g, doc), doc)
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if doc is not None and first[tuple(w[i:i + width])] < doc:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(spark, rows, width=50):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = repeats.dedup_substrings(df, width=width)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return sorted([tuple(r) for r in out.collect()], key=str)


def texts(seed, letters, width, docs=40):
    """Texts with shared passages around the width, periodic ones, copies, and shared ids."""
    rng = random.Random(seed)

    def prose(n):
        return [rng.choice(letters) for _ in range(n)]

    shared = [prose(width + d) for d in (-1, 0, 1, 7, 3 * width)] + [["a"] * (2 * width), ["a", "b"] * width, (["x"] * 5 + ["y"]) * width]
    rows = []
    for d in range(docs):
        w = prose(rng.randrange(3 * width))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            cut = rng.randrange(len(s) + 1)
            w += (s if rng.random() < 0.6 else s[cut:] if rng.random() < 0.5 else s[:cut]) + prose(rng.randrange(5))
        rows.append((rng.choice([d, d, d, d // 2, None]), rng.choice([" ", "\n", "\t  "]).join(w)))
    return rows + [rows[3], (99, rows[5][1]), (100, rows[5][1]), (98, rows[7][1] + "  ")]


@pytest.mark.parametrize(("seed", "letters", "width"), [(1, [f"w{i}" for i in range(500)], 50), (2, "ab", 50), (3, "abcd", 9), (4, [f"é{i}" for i in range(9)], 20), (5, "a", 50), (6, "ab", 1)])
def test_against_brute_force(spark, seed, letters, width):
    rows = texts(seed, list(letters), width)
    want = brute(rows, width)
    assert any(r[2] for r in want) and result(spark, rows, width) == want


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(7)
    for letters in (2, 3, 50, 10_000):
        inner = rng.integers(1, letters + 1, 50)
        if letters == 3:
            inner[10:40] = 1
        names = set()
        for _ in range(60):
            left, right = rng.integers(1, letters + 1, rng.integers(0, 80)), rng.integers(1, letters + 1, rng.integers(0, 80))
            w = np.r_[left, inner, right].astype(np.uint64)
            at, name = repeats.anchors(repeats.mix(w), np.zeros(len(w), np.int64), 50)
            names.add(int(name[at == len(left)][0]))
        assert len(names) == 1


def test_anchors_are_few():
    w = repeats.mix(np.arange(1, 20_001, dtype=np.uint64))
    _, name = repeats.anchors(w, np.zeros(len(w), np.int64), 50)
    assert len(np.unique(name)) < len(w) / 5


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    got = sorted([tuple(r) for r in repeats.dedup_substrings(awkward, width=5).collect()], key=str)
    assert got == brute(rows, 5) and any(r[2] for r in got)
    assert repeats.dedup_substrings(nothing).collect() == []
