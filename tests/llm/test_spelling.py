import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from recoup.llm import spelling


def brute_words(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k > 1}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    out, form = {}, {}
    for w in n:
        others = sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x))
        f = others[0] if others and n[others[0]] >= 10 * n[w] else None
        form[w] = f
        out[w] = [n[w], len(others), f, n[f] if f else None]
    for w in n:
        r = w
        while form[r]:
            r = form[r]
        out[w].append(r)
    return {w: tuple(v) for w, v in out.items()}


def result(df):
    rows = df.collect()
    out = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows}
    assert len(out) == len(rows)
    return out


def rows_of(seed, letters, sizes, words=150, docs=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice(sizes))) for _ in range(words)]
    for w in base[:words // 3]:  # variants of every kind and place
        i = rng.randrange(len(w) + 1)
        base += [w[:i] + rng.choice(letters) + w[i:], w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i + 1:]]
    weight = [rng.choice((1, 1, 2, 30, 400)) for _ in base]
    return [(d, " ".join(rng.choices(base, weight, k=120)) + ", É" + rng.choice(base).upper()) for d in range(docs)]


@pytest.mark.parametrize(("seed", "letters", "sizes"), [(1, "ab", (7, 8, 9)), (2, "abcé", (7, 8, 12)), (3, "a", (7, 8, 9, 10, 40)), (4, "abcdefghÿ÷", (6, 7, 8))])
def test_against_brute_force(spark, seed, letters, sizes):
    rows = rows_of(seed, letters, sizes)
    want = brute(rows)
    assert any(v[1] for v in want.values()) and result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_large_partitions_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LIMIT", 5)
    monkeypatch.setattr(spelling, "WIDE", 3)
    rows = rows_of(5, "abc", (7, 8, 9, 15), words=120)
    assert result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_small_pieces_of_a_task():
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.choice((4, 5)))) for _ in range(150)})
    size = np.array([len(w) for w in words])
    cells = np.zeros((len(words), 5), np.uint8)
    for i, w in enumerate(words):
        cells[i, :len(w)] = np.frombuffer(w.encode(), np.uint8)
    a = spelling.minimised(np.zeros(len(words), np.int64), cells, size)
    assert len(a.final) < len(a.state) and a.words.max() == len(words)
    found = {frozenset((words[x], words[y])) for p in spelling.accepted_pairs(a, spelling.composed(a)) for x, y in zip(*p, strict=True)}
    assert found == {frozenset((v, w)) for v in words for w in words if near(v, w)}


def test_long_words(spark):
    long = "abcdefgh" * 4000
    rows = [(i, f"{long}{'x' * (i % 2)} {long[:9000]}q{long[9001:]}") for i in range(40)]
    got = result(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute(rows)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert result(spelling.spelling_variants(awkward)) == brute(rows)
    assert result(spelling.spelling_variants(nothing)) == {}
    assert spelling.spelling_variants(awkward).columns == ["word", "n", "n_near", "form", "form_n", "root"]


def test_query_equals_sql_where_forms_are_null(spark):
    from recoup.llm.queries import oracle_sql, queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    columns = ["word", "n", "n_near", "form", "form_n", "root"]
    want = con.sql(f"select {', '.join(columns)} from ({oracle_sql()['op12_spelling']})").fetchall()
    got = [tuple(r) for r in queries()["op12_spelling"](spark, folder).select(*columns).collect()]
    assert sorted(got, key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert len({r[0] for r in got}) == len(got) and any(r[3] is None for r in got)
