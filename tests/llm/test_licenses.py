import random

from recoup.llm import licenses

from .test_text import plain_words


def brute(text):
    w = plain_words(text)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def base(r):
    return r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]


def test_phrases_equal_brute_force(spark):
    rng = random.Random(2)
    pool = "gnu general public license apache mit cc by other words GNU License MIT CC-BY the".split()
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(60)))) for i in range(120)]
    docs += [(200, "CC BY cc by"), (201, "gnu general public general public license"), (202, "mit license mit license"), (203, "xmit license mit licenses")]
    got = rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    for d, t in docs:
        assert base(got[d]) == brute(t)


def test_spans_and_their_labels(spark):
    full = licenses.TEMPLATES[0][0]
    w = full.split()
    docs = [(1, "Licensed under CC BY-NC 4.0."), (2, "This work is licensed under the GNU General Public License, version 3."),
            (3, "before " + " ".join(w[:9] + ["really"] + w[9:]) + " after"), (4, " ".join(w[:8])), (5, "permission is hereby not granted to any person"),
            (6, " ".join(f"{a} filler{i} words between" for i, a in enumerate(w)))]
    got = rows(licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")))
    assert got[1]["labels"] == "cc-by,cc-by-nc-4.0" and got[2]["labels"] == "gpl,gpl-3.0"
    assert got[3]["labels"] == "mit" and got[3]["n_base"] == 0 and 0.8 < got[3]["score"] < 1
    assert all(got[d]["labels"] == "" and got[d]["score"] == 0.0 for d in (4, 5, 6))


def test_awkward_rows(spark, awkward, nothing):
    got = licenses.scan(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert base(by[3]) == base(by[4]) == base(by[5]) == (0, 0, None, None, "") and by[6]["n_words"] == 1
    assert by[7]["n_words"] == 6 * 30_000
    assert licenses.scan(nothing).count() == 0


def test_plan_has_no_python(spark):
    plan = licenses.scan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
