import random

import pytest

from recoup.llm import decontam

from .test_text import plain_words


def brute(docs, items, n=13):
    wins = {}
    for item, t in items:
        w = plain_words(t)
        if w:
            m = min(len(w), n)
            for i in range(len(w) - m + 1):
                wins.setdefault(tuple(w[i:i + m]), set()).add(item)
    sizes = {len(k) for k in wins}
    out = []
    for doc, t in docs:
        w = plain_words(t)
        hit, named = set(), set()
        for m in sizes:
            for i in range(len(w) - m + 1):
                found = wins.get(tuple(w[i:i + m]))
                if found:
                    hit |= set(range(i, i + m))
                    named |= found
        out.append((doc, len(w), len(hit), tuple(sorted(named))))
    return out


def rows(df):
    return [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in df.collect()]


def key(r):
    return (r[0] is None, r)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 10
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 7, 12, 13, 14, 20, 40])))) for i in range(20)]
    items += [(90, items[0][1]), (91, None), (92, ""), (93, "the " * 30)]
    docs = []
    for d in range(60):
        t = [rng.choice(vocabulary) for _ in range(rng.randrange(80))]
        if rng.random() < 0.6:
            w = rng.choice(items)[1] or ""
            at = rng.randrange(len(t) + 1)
            t[at:at] = w.split()[rng.randrange(3):]
        docs.append((d, " ".join(t).upper() if rng.random() < 0.3 else ", ".join(t)))
    docs += [(100, None), (101, ""), (102, "the " * 200)]
    got = rows(decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert sorted(got) == sorted(brute(docs, items))


def test_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wizards quietly pack my box"), (None, "x")], "item_id long, text string")
    got = rows(decontam.decontaminate(awkward, items))
    assert len(got) == awkward.count()
    by = {r[0]: r for r in got}
    assert by[1][2] == by[2][2] == by[None][2] > 0 and by[1][3] == (1,) and by[3][1:] == (0, 0, ()) and by[4][1:] == (0, 0, ())
    assert by[10][2] == 1 and by[10][3] == ()  # an item without an id has no name to list
    assert rows(decontam.decontaminate(nothing, items)) == []
    assert all(r[2] == 0 for r in rows(decontam.decontaminate(awkward, items.limit(0))))
