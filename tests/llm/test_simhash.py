import random

import numpy as np
import pyarrow as pa
import xxhash

from recoup.llm import simhash

from .conftest import ROWS


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, links):
    of = {f: f for f in fps}

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        of[find(a)] = find(b)
    return {f: find(f) for f in fps}


def same_partition(a, b):
    return len(set(zip([a[k] for k in a], [b[k] for k in a], strict=True))) == len(set(a.values())) == len(set(b.values()))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["Ab", "cd", "é", "x y", "Q,"]) for _ in range(n)) for n in (0, 1, 2, 3, 4, 30)] + ["a\tb\nc\rd\x0be\x0cf g", "  "]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_fingerprint(t)


def test_links_of_a_large_group_keep_every_component(spark):
    """Hundreds of fingerprints around one centre share variants: the hot path has to find all."""
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    fps = {centre}
    while len(fps) < 500:
        f = rng.choice(sorted(fps)[:40] + [centre])
        for _ in range(rng.choice([1, 2])):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    fps |= {centre ^ (7 << s) for s in (3, 30, 60)} | {rng.getrandbits(64) for _ in range(50)} | {0, 1, (1 << 64) - 1}
    fps = sorted(fps)
    want = classes(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2])
    found = simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 2 for r in found)
    got = classes([signed(f) for f in fps], [(r["a"], r["b"]) for r in found])
    assert same_partition({signed(k): v for k, v in want.items()}, got)


def test_meeting_across_batches():
    """A large group spread over batches of any size comes out once, in full."""
    key = np.sort(np.r_[np.full(300, 5), np.full(3, 9), np.arange(20, 60), np.full(70, 7)])
    fp = np.arange(len(key))
    for step in (1, 7, 64, 65, 500):
        out = [b for b in simhash._meet(pa.record_batch({"key": key[a:a + step], "fp": fp[a:a + step]}) for a in range(0, len(key), step))]
        hot = sorted(x for b in out for x, h in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) if h)
        assert hot == sorted(fp[(key == 5) | (key == 7)].tolist())


def test_awkward_rows(spark, awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert sorted(map(str, [r["doc_id"] for r in rows])) == sorted(str(r[0]) for r in ROWS)
    for r in rows:
        assert int(r["fingerprint"], 16) in {brute_fingerprint(t) for d, t, _ in ROWS if d == r["doc_id"]} and len(r["fingerprint"]) == 16
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert by[3] == by[4] == by[5] == by[9] == 3 and by[2] == by[1] == by[None] == 1 and by[7] == 7
    assert simhash.near_duplicates(nothing).count() == 0
