"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

The network reads windows of WINDOW words. A word's input joins a learned word vector (words that
several training texts share) and the mean of learned vectors of its character n-grams, so unseen
forms of a stem are read too. Two gated recurrent passes, one in each direction, feed an attention
pooling and a logit. All overlapping windows of a whole text are scored; the text's score is the
largest logit, calibrated on the training texts.

Training is plain numpy on the driver, over a sample whose size is a parameter. Windows first carry
their text's label; after a share WARM of the steps the windows of a toxic text that score low lose it, except its
highest one. A quarter of the texts is kept for the calibration.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.langid import held_out
from recoup.llm.text import flat, mix, pieces, powers, words
from recoup.llm.text import LOWER
from recoup.session import spread

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 8, 8, 12
CHAR_BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: Training texts of each class, and windows drawn from one of them.
TOXIC_TEXTS, CLEAN_TEXTS, TEXT_WINDOWS = 1200, 1800, 16
#: Training texts that must share a word before it has a vector of its own: at most and at least,
#: in between a share of the texts.
SHARED, SHARED_LEAST, SHARED_PART = 12, 3, 0.005
STEPS, WARM, BATCH, RATE, DECAY = 330, 0.4, 512, 0.005, 0.5
CHUNK = 2048
#: Standard deviations that count as one unit of a vector at the start; most passes over the windows.
DEVIATIONS, EPOCHS = 4.0, 12
#: Share of the training texts kept for calibration, and of a batch's words read without their vector.
CALIBRATION, DROPPED = 0.25, 0.5
#: Parameters without weight decay.
KEPT = ("bias", "word", "char")
_GRAM_BASE = 0x9E3779B97F4A7C15 | 1


@dataclass
class Distinct:
    """The words of some texts: distinct hashes, each word's place among them, rows, n-grams."""

    hash: np.ndarray
    of: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray


def read(col: pa.Array) -> Distinct:
    """Words of the rows with the character n-gram buckets of each distinct one."""
    w = words(col)
    raw = np.frombuffer(LOWER, np.uint8)[flat(col)[0]]
    h, at, of = np.unique(w.hash, return_index=True, return_inverse=True)
    start, size = w.start[at], w.end[at] - w.start[at]
    # each distinct word between two marks, end to end
    total = size + 2
    ends = np.cumsum(total)
    text = np.ones(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(ends - total + 1, size) + inner] = raw[np.repeat(start, size) + inner].astype(np.uint64) + np.uint64(2)
    p, inverse = powers(_GRAM_BASE, len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(text * p[:len(text)], dtype=np.uint64, out=sums[1:])
    owner = np.repeat(np.arange(len(h)), total)
    bucket, whose = [], []
    for n in GRAMS:
        k = len(text) - n + 1
        if k <= 0:
            continue
        own = owner[:k] == owner[n - 1:]
        if n == GRAMS[0]:  # every word has one at least: its shortest words are one mark short
            own |= np.isin(np.arange(k), (ends - total)[total < n])
        at_ = np.flatnonzero(own)
        g = mix((sums[at_ + n] - sums[at_]) * inverse[at_] + np.uint64(n))
        bucket.append((g & np.uint64(CHAR_BUCKETS - 1)).astype(np.int64))
        whose.append(owner[at_])
    if bucket:
        b, o = np.concatenate(bucket), np.concatenate(whose)
        order = np.argsort(o, kind="stable")
        b, o = b[order], o[order]
    else:
        b = o = np.zeros(0, np.int64)
    return Distinct(h, of, w.first, b, np.searchsorted(o, np.arange(len(h) + 1)))


def read_all(texts: list[str], at_once: int = 256) -> Distinct:
    """``read`` for many texts, a few at a time."""
    parts = [read(pa.array(texts[a:a + at_once], pa.large_string())) for a in range(0, len(texts), at_once)]
    h, at, where = np.unique(np.concatenate([p.hash for p in parts]), return_index=True, return_inverse=True)
    of, first, base, words_before = [], [np.zeros(1, np.int64)], 0, 0
    for p in parts:
        of.append(where[base:base + len(p.hash)][p.of])
        first.append(p.first[1:] + words_before)
        base += len(p.hash)
        words_before += len(p.of)
    size = np.concatenate([np.diff(p.gram_first) for p in parts])
    start = np.cumsum(size) - size
    keep = size[at]
    pick = np.repeat(start[at], keep) + np.arange(int(keep.sum())) - np.repeat(np.cumsum(keep) - keep, keep)
    return Distinct(h, np.concatenate(of), np.concatenate(first), np.concatenate([p.grams for p in parts])[pick], np.r_[0, np.cumsum(keep)])


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word and length of every window; rows without words have none."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = first[row] + np.minimum(k * STRIDE, np.maximum(n[row] - WINDOW, 0))
    return row, start, np.minimum(n[row], WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name, all float32; ``vocabulary`` are the sorted hashes of the known words."""

    def __init__(self, vocabulary: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.vocabulary = np.sort(vocabulary)
        self.scale, self.length, self.shift = 1.0, 0.0, 0.0

        def normal(*shape: int, by: float) -> np.ndarray:
            return (rng.standard_normal(shape) * by).astype(np.float32)

        self.p = {"word": normal(len(vocabulary) + 1, WORD_DIM, by=0.1), "char": normal(CHAR_BUCKETS, CHAR_DIM, by=0.3),
                  "att": normal(2 * h, by=0.3), "out": normal(2 * h, by=0.3), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p["x" + side] = normal(d, 3 * h, by=d ** -0.5)
            self.p["h" + side] = normal(h, 3 * h, by=h ** -0.5)
            self.p["c" + side] = np.zeros(3 * h, np.float32)
        self.p["word"][0] = 0

    def places(self, h: np.ndarray) -> np.ndarray:
        """Row of the word table for each hash; 0 for unknown words."""
        if not len(self.vocabulary):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 1, 0)

    def inputs(self, d: Distinct) -> np.ndarray:
        """Input vector of each distinct word."""
        size = np.diff(d.gram_first)
        out = np.zeros((len(d.hash), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = self.p["word"][self.places(d.hash)]
        if len(d.grams):
            some = size > 0
            out[some, WORD_DIM:] = np.add.reduceat(self.p["char"][d.grams], d.gram_first[:-1][some]) / size[some][:, None]
        return out

    def _pass(self, gates: np.ndarray, index: np.ndarray, length: np.ndarray, side: str, keep: bool):
        """States after every step (time first); ``keep`` adds what the backward pass needs."""
        h = HIDDEN
        u = self.p["h" + side]
        n, steps = index.shape
        state = np.zeros((n, h), np.float32)
        states = np.zeros((steps, n, h), np.float32)
        kept = []
        short = bool((length < steps).any())
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x = gates[index[:, t]]
            a = state @ u
            zr = _sigmoid(x[:, :2 * h] + a[:, :2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(x[:, 2 * h:] + r * a[:, 2 * h:])
            after = new + z * (state - new)
            if short:
                after = np.where((t < length)[:, None], after, state)
            if keep:
                kept.append((t, state, z, r, new, a[:, 2 * h:]))
            states[t] = state = after
        return states, kept

    def logits(self, gates: dict[str, np.ndarray], index: np.ndarray, length: np.ndarray, keep: bool = False):
        """Logit of each window; index names the distinct word of each step."""
        fs, fk = self._pass(gates["f"], index, length, "f", keep)
        bs, bk = self._pass(gates["b"], index, length, "b", keep)
        hid = np.concatenate([fs, bs], axis=2)
        e = hid @ self.p["att"]
        if (length < index.shape[1]).any():
            e = np.where(np.arange(index.shape[1])[:, None] < length, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", e, hid)
        out = pooled @ self.p["out"] + self.p["bias"][0]
        return (out, (hid, e, pooled, fk, bk)) if keep else out

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {s: x @ self.p["x" + s] + self.p["c" + s] for s in "fb"}

    def score_windows(self, d: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """Row and logit of every window."""
        row, start, length = windows(d.first)
        out = np.zeros(len(row), np.float32)
        gates = self.gates(self.inputs(d))
        steps = np.arange(WINDOW)
        for part in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
            for a in range(0, len(part), CHUNK):
                at = part[a:a + CHUNK]
                place = start[at][:, None] + np.minimum(steps, length[at][:, None] - 1)
                out[at] = self.logits(gates, d.of[place], length[at])
        return row, out

    def best(self, d: Distinct) -> tuple[np.ndarray, np.ndarray]:
        """Largest logit and number of windows of each row; no windows: the bias, 0."""
        row, logit = self.score_windows(d)
        count = np.bincount(row, minlength=len(d.first) - 1)
        best = np.full(len(count), -np.inf)
        np.maximum.at(best, row, logit)
        best[count == 0] = self.p["bias"][0]
        return best, count

    def score(self, d: Distinct) -> np.ndarray:
        """Score of each row; a row without words has the score of the bias alone."""
        best, count = self.best(d)
        return 1 / (1 + np.exp(-np.clip(self.scale * best + self.length * np.log(np.maximum(count, 1)) + self.shift, -50, 50)))

    def gradient(self, d: Distinct, x: np.ndarray, index: np.ndarray, length: np.ndarray, target: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the weighted logistic loss over one batch of windows; x holds the inputs of
        the batch's distinct words only."""
        gates = self.gates(x)
        logit, (hid, e, pooled, fk, bk) = self.logits(gates, index, length, keep=True)
        dl = ((_sigmoid(logit) - target) * weight / max(weight.sum(), 1e-9)).astype(np.float32)
        g = {"out": pooled.T @ dl, "bias": np.array([dl.sum()], np.float32)}
        dp = dl[:, None] * self.p["out"]
        de = np.einsum("tnh,nh->tn", hid, dp)
        de = e * (de - (e * de).sum(axis=0))
        g["att"] = np.einsum("tn,tnh->h", de, hid)
        dh = e[:, :, None] * dp + de[:, :, None] * self.p["att"]
        dx = np.zeros_like(x)
        flat_index = index.T.ravel()
        order = np.argsort(flat_index, kind="stable")
        seen, first = np.unique(flat_index[order], return_index=True)
        for side, kept, part in (("f", fk, dh[:, :, :HIDDEN]), ("b", bk, dh[:, :, HIDDEN:])):
            u = self.p["h" + side]
            gu = np.zeros_like(u)
            dgates = np.zeros((index.shape[1], len(index), 3 * HIDDEN), np.float32)
            carry = np.zeros((len(index), HIDDEN), np.float32)
            for t, state, z, r, new, an in reversed(kept):
                total = carry + part[t]
                live = (t < length)[:, None]
                dz = total * (state - new) * z * (1 - z)
                dn = total * (1 - z) * (1 - new * new)
                dr = dn * an * r * (1 - r)
                da = np.concatenate([dz, dr, dn * r], axis=1) * live
                dgates[t] = np.concatenate([dz, dr, dn], axis=1) * live
                gu += state.T @ da
                carry = np.where(live, total * z + da @ u.T, total)
            g["h" + side] = gu
            rows = dgates.reshape(-1, 3 * HIDDEN)
            per_word = np.zeros((len(x), 3 * HIDDEN), np.float32)
            per_word[seen] = np.add.reduceat(rows[order], first)
            g["c" + side] = rows.sum(axis=0)
            g["x" + side] = x.T @ per_word
            dx += per_word @ self.p["x" + side].T
        g["word"] = np.zeros_like(self.p["word"])
        np.add.at(g["word"], self.places(d.hash), dx[:, :WORD_DIM])
        g["word"][0] = 0
        g["char"] = np.zeros_like(self.p["char"])
        size = np.diff(d.gram_first)
        if len(d.grams):
            share = np.repeat(dx[:, WORD_DIM:] / np.maximum(size, 1)[:, None], size, axis=0)
            by = np.argsort(d.grams, kind="stable")
            buckets, at = np.unique(d.grams[by], return_index=True)
            g["char"][buckets] = np.add.reduceat(share[by], at)
        return g


def subset(d: Distinct, index: np.ndarray) -> tuple[Distinct, np.ndarray]:
    """Only the distinct words of the index, and the index among them."""
    used, local = np.unique(index, return_inverse=True)
    size = np.diff(d.gram_first)[used]
    at = np.repeat(d.gram_first[used], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return Distinct(d.hash[used], np.zeros(0, np.int64), np.zeros(1, np.int64), d.grams[at], np.r_[0, np.cumsum(size)]), local.reshape(index.shape)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, seed: int = 7) -> Network:
    """A network fitted to texts with labels 0 / 1; weights are the texts each one stands for."""
    d = read_all(texts) if texts else read(pa.array([], pa.large_string()))
    n = np.diff(d.first)
    pair = np.unique(np.stack([d.of, np.repeat(np.arange(len(n)), n)]), axis=1) if len(d.of) else np.zeros((2, 0), np.int64)
    shared = np.bincount(pair[0], minlength=len(d.hash)) if len(d.hash) else np.zeros(0)
    net = Network(d.hash[shared >= min(SHARED, max(SHARED_LEAST, SHARED_PART * len(texts)))], seed)
    if len(texts) < 2 or labels.min() == labels.max():
        net.shift = -20.0 if not len(texts) or labels.max() == 0 else 20.0
        net.scale = 0.0
        return net
    rng = np.random.default_rng(seed)
    apart = rng.random(len(n)) < CALIBRATION
    start_from_counts(net, d, pair[:, ~apart[pair[1]]], labels)
    row, start, length = windows(d.first)
    drawn = ~apart[row] & (rng.random(len(row)) < (TEXT_WINDOWS / np.maximum(1, np.bincount(row, minlength=len(n))))[row])
    row, start, length = row[drawn], start[drawn], length[drawn]
    target = labels[row].astype(np.float32)
    active = np.ones(len(row), bool)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    steps, tick = np.arange(WINDOW), 0
    warm, most = True, min(STEPS, EPOCHS * max(1, -(-len(row) // BATCH)))
    while tick < most:
        warm = warm and tick < WARM * most
        if not warm:
            now = np.concatenate([net.logits(net.gates(net.inputs(sub)), local, length[a:a + CHUNK])
                                  for a in range(0, len(row), CHUNK)
                                  for sub, local in [subset(d, d.of[start[a:a + CHUNK, None] + np.minimum(steps, length[a:a + CHUNK, None] - 1)])]])
            best = np.full(len(n), -np.inf)
            np.maximum.at(best, row, now)
            active = (target == 0) | (now > 0) | (now >= best[row])
        share = active & (target == 1)
        balance = np.where(target == 1, active.sum() / max(1, 2 * share.sum()), active.sum() / max(1, 2 * (active & (target == 0)).sum())).astype(np.float32)
        order = rng.permutation(np.flatnonzero(active))
        for a in range(0, len(order), BATCH):
            at = order[a:a + BATCH]
            sub, local = subset(d, d.of[start[at][:, None] + np.minimum(steps, length[at][:, None] - 1)])
            x = net.inputs(sub)
            x[rng.random(len(x)) < DROPPED, :WORD_DIM] = 0  # some words are read by their characters alone
            g = net.gradient(sub, x, local, length[at], target[at], balance[at])
            tick += 1
            rate = RATE * max(0.1, 1 - tick / most) * np.sqrt(1 - 0.999 ** tick) / (1 - 0.9 ** tick)
            for k, v in g.items():
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (rate * (m / (np.sqrt(s) + 1e-8) + (DECAY * net.p[k] if k not in KEPT else 0))).astype(np.float32)
    some = np.flatnonzero(apart)
    if len(set(labels[some].tolist())) < 2:
        some = np.arange(len(n))
    calibrate(net, read_all([texts[i] for i in some]), labels[some], weights[some])
    return net


def start_from_counts(net: Network, d: Distinct, pair: np.ndarray, labels: np.ndarray) -> None:
    """Set the first coordinate of word and n-gram vectors to how far their number of toxic texts
    (pairs of distinct word and text) lies from its expectation, in standard deviations."""
    by = np.stack([np.bincount(pair[0], weights=labels[pair[1]] == v, minlength=len(d.hash)) for v in (0, 1)])
    size = np.diff(d.gram_first)
    of_gram = np.stack([np.bincount(d.grams, weights=np.repeat(c, size), minlength=CHAR_BUCKETS) for c in by])
    share = by[1].sum() / max(1.0, by.sum())

    def excess(c: np.ndarray) -> np.ndarray:
        expected = c.sum(axis=0) * share
        return np.clip((c[1] - expected) / np.sqrt(expected * (1 - share) + 1) / DEVIATIONS, -2, 2).astype(np.float32)

    at = net.places(d.hash)
    net.p["word"][at[at > 0], 0] = excess(by)[at > 0]
    net.p["char"][:, 0] = excess(of_gram)
    # the first state of each direction starts out reading these coordinates
    for side, k in (("f", 0), ("b", HIDDEN)):
        net.p["x" + side][:, 2 * HIDDEN] = 0
        net.p["x" + side][[0, WORD_DIM], 2 * HIDDEN] = 0.6, 1.0
        net.p["att"][k] = net.p["out"][k] = 3.0
    net.p["bias"][0] = -2.0


def calibrate(net: Network, d: Distinct, labels: np.ndarray, weights: np.ndarray) -> None:
    """Logistic fit of the labels on the largest logits and the log of their number, by damped
    Newton steps with a small ridge."""
    best, count = net.best(d)
    use = count > 0
    x = np.stack([best[use], np.log(count[use]), np.ones(use.sum())], axis=1)
    centre, unit = x.mean(axis=0), x.std(axis=0) + 1e-9
    centre[2], unit[2] = 0, 1
    x = (x - centre) / unit
    y, w, b = labels[use], weights[use] / weights[use].mean(), np.zeros(3)

    def loss(b: np.ndarray) -> float:
        return float((w * (np.logaddexp(0, x @ b) - y * (x @ b))).sum() + 0.5 * (b @ b))

    for _ in range(100):
        p = _sigmoid(x @ b)
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + np.eye(3), x.T @ (w * (p - y)) + b)
        size = 1.0
        while size > 1e-6 and loss(b - size * step) > loss(b):
            size /= 2
        b = b - size * step
        if np.abs(size * step).max() < 1e-7:
            break
    b /= unit
    net.scale, net.length = max(float(b[0]), 1e-3), float(b[1])
    net.shift = float(b[2] - net.scale * centre[0] - net.length * centre[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """A network from labelled rows that are not held out; the smallest label hashes are drawn,
    TOXIC_TEXTS and CLEAN_TEXTS at most. Null labels, ids and texts are left out; an id with several
    labels takes the largest, an id with several texts the first in order."""
    known = (labels.select(F.col(id_col).alias("doc"), F.col(label_col).cast("int").alias("y"))
             .where(F.col("doc").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc"))).groupBy("doc").agg(F.max("y").alias("y")))
    size = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = None
    for y, most in ((1, TOXIC_TEXTS), (0, CLEAN_TEXTS)):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc"), "doc").limit(most)
        drawn = part if drawn is None else drawn.unionByName(part)
    text = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # at most TOXIC_TEXTS + CLEAN_TEXTS ids, so they are sent to the tasks rather than the texts dealt out
    rows = text.join(F.broadcast(drawn), "doc").groupBy("doc").agg(F.min("text").alias("text"), F.max("y").alias("y")).orderBy("doc").collect()
    y = np.array([r["y"] for r in rows], np.int64)
    have = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.array([size[v] / have[v] for v in y.tolist()])
    return train([r["text"] for r in rows], y, weight)


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``.

    Null and empty texts, and texts without a word, have the score of the network's bias. Rows and
    ids may repeat; other columns are not read.
    """
    docs = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema, arrow = schemas([(id_col, docs.schema[0].dataType), ("score", T.DoubleType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield batch_of(arrow, **{id_col: part.column(0)}, score=net.score(read(part.column(1))))

    return spread(docs).mapInArrow(run, schema)
