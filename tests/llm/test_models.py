import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from recoup.llm import langid, toxicity

FOLDER = "/root/testdata/sf0.01"


def held(d):
    return d is not None and zlib.crc32(str(d).encode()) % 4 == 2


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    assert set(model) == {"de", "en", "es", "fr"} and all(0 < len(v) <= langid.DICTIONARY_BYTES for v in model.values())
    rows = [r for r in langid.predict(docs, model).collect() if held(r["doc_id"])]
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows) and sum(r["rejected"] for r in rows) < 0.03 * len(rows)


def test_dictionaries_ignore_held_out_rows(spark):
    docs = [(i, f"only{i} heldout words" if held(i) else "plain training words", "en") for i in range(200)]
    content = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))["en"]
    assert b"heldout" not in content and b"training" in content


def test_language_of_awkward_rows(spark, awkward, nothing):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    rows = langid.predict(awkward, model).collect()
    assert len(rows) == awkward.count() and rows[0]["fp"] == "clash-fp"
    for r in rows:
        blank = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == blank and (not blank or (r["rejected"] and r["score"] == 0.0))
    assert langid.predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.fit(nothing)).collect()} == {"und"}
    assert langid.fit(awkward.where("doc_id = 1 or doc_id is null")).keys() <= {"en"}


def small_network(seed=1):
    texts = ["alpha beta gamma delta " * 12, "beta bad word gamma " * 3, "short", "", "x y z " * 30]
    d = toxicity.read(pa.array(texts))
    net = toxicity.Network(d.hash[::2], seed)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    return net, d


def test_gradients_are_numerically_right():
    net, d = small_network()
    row, start, length = toxicity.windows(d.first)
    index = d.of[start[:, None] + np.minimum(np.arange(toxicity.WINDOW), length[:, None] - 1)]
    sub, local = toxicity.subset(d, index)
    target = np.array([row_ % 2 for row_ in row], np.float64)
    weight = np.linspace(0.5, 2, len(row))

    def loss():
        z = net.logits(net.gates(net.inputs(sub).astype(np.float64)), local, length)
        return float((weight * (np.logaddexp(0, z) - target * z)).sum() / weight.sum())

    g = net.gradient(sub, net.inputs(sub), local, length, target, weight)
    rng = np.random.default_rng(0)
    for name in g:
        at = np.argwhere(np.abs(g[name]) > 1e-6)
        for k in rng.permutation(len(at))[:4]:
            i = tuple(at[k])
            before = net.p[name][i]
            step = 1e-2
            net.p[name][i] = before + step
            up = loss()
            net.p[name][i] = before - step
            down = loss()
            net.p[name][i] = before
            assert g[name][i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=3e-5)


def test_windows_cover_every_word():
    first = np.cumsum([0, 0, 1, 31, 32, 33, 48, 49, 1000])
    row, start, length = toxicity.windows(first)
    for r, n in enumerate(np.diff(first)):
        covered = set()
        for s, k in zip(start[row == r], length[row == r], strict=True):
            assert first[r] <= s and s + k <= first[r + 1]
            covered |= set(range(s, s + k))
        assert len(covered) == n


def test_scores_do_not_depend_on_the_batch():
    net, _ = small_network()
    texts = ["alpha beta bad word " * 40, None, "", "one", "Alpha BETA " * 20]
    together = net.score(toxicity.read(pa.array(texts)))
    alone = [net.score(toxicity.read(pa.array([t], pa.string())))[0] for t in texts]
    assert together == pytest.approx(alone, abs=1e-6) and together[1] == together[2]
    merged = toxicity.read_all([t or "" for t in texts], 2)
    assert net.score(merged) == pytest.approx(together, abs=1e-6)


def test_learns_words_and_unseen_forms():
    rng = random.Random(1)
    plain = [f"{a}{b}" for a in ("lor", "ips", "dol", "sit", "amet", "con") for b in ("um", "or", "is", "em", "a", "us", "ed")]

    def text(bad):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        for _ in range(bad and rng.randrange(1, 4)):
            w[rng.randrange(len(w))] = "grump" + rng.choice(["y", "ish", "ier", "o", "ling"]) if bad < 2 else "grump" + rng.choice(["eth", "ular"])
        return " ".join(w)

    labels = np.array([i % 3 == 0 for i in range(500)], np.int64)
    net = toxicity.train([text(int(y)) for y in labels], labels, np.ones(len(labels)))
    score = lambda ts: net.score(toxicity.read(pa.array(ts)))
    clean, seen, unseen = (score([text(k) for _ in range(60)]) for k in (0, 1, 2))
    assert (clean < 0.3).mean() > 0.9 and (seen >= 0.3).mean() > 0.9 and np.median(unseen) > 5 * np.median(clean)


def test_toxicity_of_awkward_rows(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    net = toxicity.fit(awkward, labels)
    rows = toxicity.score(awkward, net).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score(nothing, net).count() == 0
    for empty in (labels.limit(0), labels.where("toxic = 0")):
        assert all(0 <= r["score"] < 0.3 for r in toxicity.score(awkward, toxicity.fit(awkward, empty)).collect())
