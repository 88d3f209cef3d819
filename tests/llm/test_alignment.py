import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from recoup.llm import alignment
from recoup.llm.tokens import vocabulary

FILES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def tokens(libraries, text):
    """Ids and bytes of both, or none."""
    a, b = libraries
    if not text:
        return [], []
    code, k = {}, 0
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174:
            code[chr(x)] = x
        else:
            code[chr(256 + k)] = x
            k += 1
    e = a.encode(" " + text, add_special_tokens=False)
    one = [(i, bytes(code[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    two = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        two.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (one, two) if all(b"".join(t for _, t in x) == want for x in (one, two)) else ([], [])


def brute(libraries, texts):
    parts = []
    links = Counter()
    for text in texts:
        one, two = tokens(libraries, text)
        spans = []
        for side in (one, two):
            at, out = 0, []
            for i, t in side:
                out.append((at, at + len(t), i))
                at += len(t)
            spans.append(out)
        met = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        links.update(met)
        shared = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups = [[",".join(str(x[2]) for x in s if lo < x[1] <= hi) for s in spans] for lo, hi in zip([0, *shared], shared, strict=False)]
        text_of = ";".join("|".join(g) for g in groups)
        parts.append((len(one), len(two), len(groups), met, hashlib.sha256(text_of.encode()).hexdigest() if one else ""))
    top = defaultdict(int)
    for (_, b), n in links.items():
        top[b] = max(top[b], n)
    return [(a, b, g, len(m), sum(links[x] == top[x[1]] for x in m), sum(links[x] for x in m), s) for a, b, g, m, s in parts]


def texts_of(seed, n):
    rng = random.Random(seed)
    words = ["the", "tion", "Straße", "año", "naïve", "1234567", "don't", "東京", "\U0001f600", "anblewh", "<|endoftext|>", "<s>", "<0x41>", "\t", "\n\n", "  ", "…", "x" * 30, "fiﬁ"]
    out = [None, "", " ", "\n", " lead", "trail ", "a▁b", "▁", "a\x00b", "éé"]
    return out + [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, libraries, small, monkeypatch):
    if small:  # many blocks
        monkeypatch.setattr(alignment, "BLOCK_DOCS", 8)
    texts = texts_of(1, 60)
    texts += texts[5:15]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in alignment.align(df, *FILES).collect()}
    assert got == dict(enumerate(brute(libraries, texts)))


def test_bitmaps_count_and_return():
    rng = np.random.default_rng(2)
    docs = 64
    key = np.unique(rng.integers(0, 30 * docs, 700))
    count = rng.choice([1, 1, 2, 3, 9, 200], len(key))
    pairs, n_docs, n_links, bitmaps = alignment.planes(key, count, docs)
    want = {p: (int((key // docs == p).sum()), int(count[key // docs == p].sum())) for p in np.unique(key // docs)}
    assert {p: (d, n) for p, d, n in zip(pairs.tolist(), n_docs.tolist(), n_links.tolist(), strict=True)} == want
    blob = np.frombuffer(b"".join(bitmaps), np.uint8).reshape(-1, 4)
    owner = np.repeat(np.arange(len(pairs)), [len(b) // 4 for b in bitmaps])
    best = (n_links % 2).astype(np.int64)
    at, total, top = alignment.scored(blob, owner, n_links, best)
    for d in range(docs):
        mine = key % docs == d
        of = np.searchsorted(pairs, key[mine] // docs)
        assert (d in at) == bool(mine.any())
        if mine.any():
            assert total[d] == (count[mine] * n_links[of]).sum() and top[d] == (count[mine] * best[of]).sum()


def test_awkward_rows(spark, libraries, awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    short = [(d, t) for d, t in rows if len(t or "") < 1000]
    got = sorted([tuple(r) for r in alignment.align(awkward.where("length(text) < 1000 or text is null"), *FILES).collect()], key=str)
    assert got == sorted([(d, *x) for (d, _), x in zip(short, brute(libraries, [t for _, t in short]), strict=True)], key=str)
    long = alignment.align(awkward.where("length(text) >= 1000"), *FILES).collect()
    assert len(long) == len(rows) - len(short) and all(r["n_links"] == r["n_a"] + r["n_b"] - r["n_groups"] > 0 for r in long)
    assert alignment.align(nothing, *FILES).collect() == []
