import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from recoup.llm import langid, tokens
from recoup.llm.queries import oracle_sql, queries
from recoup.session import stored

from .test_decontam import brute as brute_hits
from .test_lines import brute as brute_lines
from .test_simhash import brute_fingerprint, classes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], FOLDER), name))
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_keep_the_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns


def test_language_stage(spark, steps):
    rows = langid.predict(steps[0], langid.fit(steps[0])).collect()
    assert texts(steps[1]) == {r["doc_id"]: r["text"] for r in rows if not r["rejected"]}
    assert steps[1].count() >= 0.95 * steps[0].count()


def test_line_stage(steps):
    docs = texts(steps[1])
    gone = brute_lines(list(docs.items()))
    want = {d: "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone) for d, t in docs.items()}
    assert texts(steps[2]) == want and all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_near_duplicate_stage(steps):
    docs = texts(steps[2])
    fp = {d: brute_fingerprint(t) for d, t in docs.items()}
    fps = sorted(set(fp.values()))
    of = classes(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    first = {}
    for d in sorted(docs):
        first.setdefault(of[fp[d]], d)
    assert texts(steps[3]) == {d: docs[d] for d in first.values()}


def test_decontamination_stage(spark, steps):
    docs = texts(steps[3])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    bad = {d for d, n, hit, _ in brute_hits(list(docs.items()), items) if hit and 20 * hit >= n}
    assert texts(steps[4]) == {d: t for d, t in docs.items() if d not in bad}


def test_packing_stage(steps):
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"), False)
    docs = texts(steps[4])
    seen = {}
    for r in sorted(steps[5].collect(), key=lambda r: (r["doc_id"], r["start"])):
        ids = e.whole(docs[r["doc_id"]]) + np.array([1], "<u4").tobytes()
        assert r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids) // 4
        assert r["ids_crc32"] == zlib.crc32(ids[4 * r["start"]:4 * (r["start"] + r["length"])])
        seen[r["doc_id"]] = r["start"] + r["length"]
    assert seen.keys() == docs.keys()


def test_awkward_rows_pass_all_stages(spark, awkward, nothing):
    for docs in (awkward.withColumn("n_chars", awkward["doc_id"]), nothing.withColumn("n_chars", nothing["doc_id"])):
        step = docs
        for name, stage in corpus_pipeline.STAGES:
            step = stored(stage(spark, step, FOLDER), name)
            assert name == "packing" or step.columns == docs.columns
        assert step.count() <= 200


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    rel = con.sql(oracle_sql()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    df = queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[at[c]] for c in cols) for r in rel.fetchall())


def test_every_operator_has_its_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
