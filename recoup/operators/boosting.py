"""Boosted trees over blocks of binned rows: many models grow at once, one scan per step.

A row is its bin codes, label and part (a fold, or the hold-out). A step asks every model for the
nodes whose histograms its tree still needs; one job adds them up for all models, and the driver,
which only ever sees histograms, picks the splits. Models do not wait for each other: one that ends
a tree begins the next in the following step, and the same scan scores the finished rounds on the
rows a model trains on and on those it leaves out.

The margins of a block live in the worker that saw it last and are brought forward by the trees grown
since; a worker without them starts from the last stored state, written every ``STATE_ROUNDS`` rounds.
"""
from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recoup.session import freed, stored

#: Part of rows that no model trains on.
HOLD_OUT = 255
#: Rows of a block, cells of all histograms of a step, rounds between stored states.
BLOCK_ROWS, STEP_CELLS, STATE_ROUNDS = 32_768, 4_000_000, 250
#: Rows of a task at least: below, starting another task takes longer than its sums.
TASK_ROWS = 8_192
#: Score bins from which the area under the curve is taken.
SCORE_BINS = 1_000
#: Partitions whose sums are collected directly; more are added up in the cluster first.
DIRECT = 64
#: Bytes of sums that are collected directly; more are added up in the cluster, the sums of so many
#: nodes under one key. After so many bytes dealt out for that their files are let go.
DIRECT_BYTES, SLOTS, FREED_BYTES = 32 << 20, 64, 2 << 30
#: Bytes of margins a worker keeps.
KEPT_BYTES = 256 << 20


@dataclass(frozen=True)
class Config:
    """One model. ``loss``: bernoulli (gradient boosting), discrete, real or gentle (adaptive), bag
    (one tree of a bag: a row counts as often as the frame's ``bag`` array says).

    leave: the fold it leaves out and is scored on; None trains on all folds and is scored on the
    hold-out. patience: it stops when no moving average of that many scores (area under the curve
    on the left-out rows) within the last ``patience`` ones is better than the one before by the
    relative tolerance. least_gain: share of the root's impurity a split has to remove.
    """

    name: str = "boosting"
    rounds: int = 1000
    depth: int = 3
    rate: float = 0.01
    min_rows: int = 100
    rows: float = 1.0
    tree_columns: float = 1.0
    split_columns: float = 1.0
    leave: int | None = None
    patience: int = 0
    tolerance: float = 1e-4
    loss: str = "bernoulli"
    least_gain: float = 0.0
    seed: int = 1


@dataclass
class Tree:
    """Nodes in the order they were made; the right child follows the left one. Leaves have column -1."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray  # fall of the squared error at the node

    def apply(self, codes: np.ndarray) -> np.ndarray:
        node = np.zeros(len(codes), np.int64)
        rows = np.arange(len(codes))  # those that are not in a leaf yet
        while True:
            at = node[rows]
            column = self.column[at]
            inner = column >= 0
            if not inner.all():
                rows, at, column = rows[inner], at[inner], column[inner]
            if not len(rows):
                return self.value[node]
            node[rows] = self.left[at] + (codes[rows, column] > self.cut[at])


@dataclass
class Fitted:
    """A model: bin edges by column, first margin, trees, and the score of every round."""

    config: Config
    columns: list[str]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)
    history: list[dict] = field(default_factory=list)
    steps: int = 0

    def margins(self, df: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
        """``key, margin`` of the model after the given number of rounds."""
        trees, edges, start = self.trees[:rounds], self.edges, self.start
        schema = f"{key} {df.schema[key].dataType.simpleString()}, margin double"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                codes = _codes([b.column(i + 1) for i in range(len(edges))], edges)
                total = np.full(len(codes), start)
                for t in trees:
                    total += t.apply(codes)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total)], [key, "margin"])

        return df.select(key, *[F.col(c).cast("double") for c in self.columns]).mapInArrow(run, schema)

    def best(self, score: str = "valid_loss") -> int:
        """Round of the smallest loss or error, or the largest area under the curve (the first of equals)."""
        sign = -1.0 if score.endswith("auc") else 1.0
        return min(self.history, key=lambda h: (sign * h[score], h["round"]))["round"]


def fold_losses(models: Sequence[Fitted]) -> list[float]:
    """Mean loss by round over all rows that the models leave out, as far as all have come."""
    n = [m.history[0]["valid_rows"] if m.history else 0 for m in models]
    upto = min(len(m.history) for m in models)
    return [sum(k * m.history[i]["valid_loss"] for k, m in zip(n, models, strict=True)) / sum(n) for i in range(upto)]


def no_better(losses: Sequence[float], rounds: int) -> bool:
    """Whether the last ``rounds`` losses are all no less than the least one before."""
    return len(losses) > rounds and min(losses[-rounds:]) >= min(losses[:-rounds])


# ---- blocks

_BLOCK = ["block", "codes", "label", "part", "id", "bag"]


def _codes(columns: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    """Bin codes: 0 for null, else one more than the edges below the value."""
    out = np.zeros((len(columns[0]), len(edges)), np.uint8)
    for j, (c, e) in enumerate(zip(columns, edges, strict=True)):
        x = c.to_numpy(zero_copy_only=False).astype(float)
        out[:, j] = np.where(np.isnan(x), 0, np.searchsorted(e, x, "left") + 1)
    return out


def bin_edges(df: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` quantiles of every column over all rows, by a mergeable sketch."""
    probs = [i / bins for i in range(1, bins)]
    found = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).approxQuantile(list(columns), probs, 0.2 / bins)
    return [np.unique(np.array(q, float)) for q in found]


def blocks(df: DataFrame, key: str, columns: Sequence[str], edges: list[np.ndarray], label: str, part: str, bag: Column | None = None) -> DataFrame:
    """``block, codes, label, part, id, bag``: rows as bytes, in blocks named by what they hold; id is
    a hash of the key, from which samples of rows are drawn, bag the row's counts by model."""
    size = BLOCK_ROWS
    last = 3 + len(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, size):
                x = b.slice(at, size)
                raw = [a.tobytes() for a in (
                    _codes([x.column(i + 3) for i in range(len(edges))], edges), x.column(0).to_numpy().astype(np.uint8),
                    x.column(1).to_numpy().astype(np.uint8), x.column(2).to_numpy(),
                    x.column(last).flatten().to_numpy(zero_copy_only=False).astype(np.uint8))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.md5(b"".join(raw)).hexdigest()]), *[pa.array([a], pa.binary()) for a in raw]], _BLOCK)

    return df.select(F.col(label).cast("int"), F.col(part).cast("int"), F.xxhash64(key), *[F.col(c).cast("double") for c in columns],
                     bag if bag is not None else F.array().cast("array<tinyint>")).mapInArrow(
        run, ", ".join(f"{c} {'string' if c == 'block' else 'binary'}" for c in _BLOCK))


def _drawn(ids: np.ndarray, seed: int, number: int, share: float) -> np.ndarray:
    """A sample of the rows for one tree: a hash of the row's id, the seed and the tree."""
    with np.errstate(over="ignore"):
        h = ids.view(np.uint64) + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(number + 1) * np.uint64(0xD1B54A32D192ED03)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h ^ (h >> np.uint64(31))) < np.uint64(min(int(share * 2.0 ** 64), 2 ** 64 - 1))


# ---- inside a task

#: (fit, block) -> trees applied per model and the margins, of the blocks met lately.
_KEPT: dict[tuple[str, str], tuple[list[int], np.ndarray]] = {}


def _keep(name: tuple[str, str], value: tuple[list[int], np.ndarray]) -> None:
    _KEPT.pop(name, None)
    _KEPT[name] = value
    size = sum(v[1].nbytes for v in _KEPT.values())
    for old in list(_KEPT):
        if size <= KEPT_BYTES or old == name:
            break
        size -= _KEPT.pop(old)[1].nbytes


class _Grown:
    """The trees of every model since the stored state: older ones in broadcasts that are only read
    where they are needed, the latest ones in place."""

    def __init__(self, models: int) -> None:
        self.first = [0] * models  # trees in the stored state
        self.sent: list = []  # broadcasts of [(model, number, tree)]
        self.sent_upto = [0] * models
        self.late: list[tuple[int, int, Tree]] = []

    def since(self, done: list[int]) -> Iterator[tuple[int, Tree]]:
        if any(d < s for d, s in zip(done, self.sent_upto, strict=True)):
            for b in self.sent:
                for m, i, t in b.value:
                    if i >= done[m]:
                        yield m, t
        for m, i, t in self.late:
            if i >= done[m]:
                yield m, t


def _advance(fit: str, block: tuple, starts: list[float], grown: _Grown, upto: list[int]) -> np.ndarray:
    """Margins of the block, a row per model."""
    name, codes, _, _, _, _, state = block
    kept = _KEPT.get((fit, name))
    if kept is None or any(k < f for k, f in zip(kept[0], grown.first, strict=True)):
        margin = np.frombuffer(state, float).reshape(len(starts), -1).copy() if len(state) else np.repeat(np.array(starts)[:, None], len(codes), 1)
        kept = (list(grown.first), margin)
    done, margin = kept
    for m, t in grown.since(done):
        margin[m] += t.apply(codes)
    _keep((fit, name), (list(upto), margin))
    return margin


def _gradients(loss: str, y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and weight of every row: residual and its variance, or weighted label and weight."""
    if loss == "bernoulli":
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, p * (1.0 - p)
    sign = 2.0 * y - 1.0
    w = 1.0 / (1.0 + np.exp(sign * margin)) if loss == "gentle" else np.exp(-np.clip(sign * margin, -700, 700))
    return w * sign, w


def _scores(config: Config, y: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """Rows, wrong ones, loss, and the score histogram of the zeros and the ones."""
    z = margin if config.loss == "bernoulli" else 2.0 * margin
    loss = np.logaddexp(0.0, z) - y * z
    at = np.minimum((SCORE_BINS / (1.0 + np.exp(-z))).astype(np.int64), SCORE_BINS - 1)
    hist = np.bincount(at + SCORE_BINS * y.astype(np.int64), minlength=2 * SCORE_BINS)
    return np.concatenate([[len(y), ((z > 0) != (y > 0)).sum(), loss.sum()], hist])


def _add_up(requests: list, block: tuple, configs: list[Config], margin: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Histograms ``(3, columns, bins)`` by slot, and scores by model (keys below zero)."""
    _, codes, label, part, ids, bag, _ = block
    p = codes.shape[1]
    cell = codes.astype(np.int32) + np.arange(p, dtype=np.int32) * width
    out: dict[int, np.ndarray] = {}
    for m, round_no, watch, tree in requests:
        config = configs[m]
        left_out = part == (HOLD_OUT if config.leave is None else config.leave)
        train = ~left_out & (part != HOLD_OUT)
        if watch:
            out[-m - 1] = np.stack([_scores(config, label[s].astype(float), margin[m][s]) for s in (train, left_out)])
        if tree is None:
            continue
        if config.rows < 1.0:
            train = train & _drawn(ids, config.seed, round_no, config.rows)
        rows = np.flatnonzero(train)
        if config.loss == "bag":
            rows = rows[bag[rows, m] > 0]
            h = bag[rows, m].astype(float)
            g = h * (2.0 * label[rows] - 1.0)
        else:
            g, h = _gradients(config.loss, label[rows].astype(float), margin[m][rows])

        def visit(node: tuple, at: np.ndarray) -> None:
            slot, splits = node
            if slot is not None and len(at):
                c = cell[rows[at]].ravel()
                size = p * width
                out[slot] = np.stack([np.bincount(c, np.repeat(g[at], p), size), np.bincount(c, np.repeat(h[at], p), size), np.bincount(c, minlength=size)])
            for column, cut, low, high in splits:
                right = codes[rows[at], column] > cut
                visit(low, at[~right])
                visit(high, at[right])

        visit(tree, np.arange(len(rows)))
    return out


def _apart(total: dict[int, np.ndarray]) -> Iterator[tuple[int, dict[int, np.ndarray]]]:
    """The sums in parts of SLOTS keys, to be added up apart from each other."""
    out: dict[int, dict[int, np.ndarray]] = {}
    for k, v in total.items():
        out.setdefault(k // SLOTS, {})[k] = v
    yield from out.items()


def _sum(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    for k, v in b.items():
        a[k] = a[k] + v if k in a else v
    return a


# ---- at the driver

def _auc(hist: np.ndarray) -> float:
    """Area under the curve of two score histograms; equal bins count half."""
    zero, one = hist[:SCORE_BINS], hist[SCORE_BINS:]
    n0, n1 = zero.sum(), one.sum()
    below = np.cumsum(zero) - zero
    return float((one * (below + zero / 2.0)).sum() / (n0 * n1)) if n0 and n1 else float("nan")


@dataclass
class _Node:
    path: tuple
    depth: int
    stat: tuple[float, float, float]
    split: tuple[int, int] | None = None
    gain: float = 0.0
    left: int = -1
    closed: bool = False


class _Growing:
    """One model: its finished trees, and the nodes of the tree in work. A path is the sequence of
    ``(column, cut, side)`` from the root."""

    def __init__(self, model: Fitted, number: int) -> None:
        self.model, self.number = model, number
        self.columns = len(model.columns)
        self.over = False
        self.begin()

    def begin(self) -> None:
        c = self.model.config
        self.known: dict[tuple, np.ndarray] = {}
        self.nodes: list[_Node] = [_Node((), 0, (0.0, 0.0, 0.0))]
        self.watch = c.loss != "bag"  # a bag is scored by the rows it has not seen, not here
        self.grow = len(self.model.trees) < c.rounds
        rng = np.random.default_rng([c.seed, len(self.model.trees), 7])
        k = max(1, round(c.tree_columns * self.columns))
        self.usable = np.sort(rng.permutation(self.columns)[:k])

    def wanted(self) -> list[tuple]:
        return [n.path for n in self.nodes if n.split is None and not n.closed and n.path not in self.known]

    def take(self, found: dict[tuple, np.ndarray], score: np.ndarray | None) -> None:
        """New sums; then the tree grows as far as what is known allows."""
        self.known.update(found)
        model, c = self.model, self.model.config
        if self.watch and score is not None:
            self.watch = False
            if model.trees:
                one, two = score
                model.history.append({"round": len(model.trees), "valid_rows": int(two[0]), **{f"{s}_{n}": v for s, x in (("train", one), ("valid", two)) for n, v in (
                    ("error", x[1] / max(x[0], 1)), ("loss", x[2] / max(x[0], 1)), ("auc", _auc(x[3:])))}})
            if not self.grow or self._stalled():
                self.over = True
                return
        i = 0
        while i < len(self.nodes):
            n = self.nodes[i]
            if n.split is None and not n.closed:
                if n.path not in self.known:
                    if i == 0:
                        return
                    i += 1
                    continue
                self._split(i, self.known.pop(n.path))  # a tree's sums are as large as its nodes are many
            i += 1
        if self.wanted():
            return
        model.trees.append(self._tree())
        if c.loss == "bag" and len(model.trees) >= c.rounds:
            self.over = True
            self.nodes = []
            return
        self.begin()

    def _stalled(self) -> bool:
        c, h = self.model.config, self.model.history
        k = c.patience
        if not k or len(h) < 2 * k:
            return False
        auc = [x["valid_auc"] for x in h[-2 * k:]]
        mean = [sum(auc[i:i + k]) / k for i in range(k + 1)]
        return max(mean[1:]) <= mean[0] * (1.0 + c.tolerance)

    def _split(self, i: int, hist: np.ndarray) -> None:
        n, c = self.nodes[i], self.model.config
        hist = hist.reshape(3, self.columns, -1)
        if i == 0:
            n.stat = tuple(hist[:, 0].sum(1))
        n.closed = True
        if n.depth >= c.depth or n.stat[2] < 2 * c.min_rows:
            return
        columns = self.usable
        if c.split_columns < 1.0:
            rng = np.random.default_rng([c.seed, len(self.model.trees), i, 11])
            columns = np.sort(rng.permutation(columns)[:max(1, round(c.split_columns * len(columns)))])
        low = np.cumsum(hist[:, columns], 2)[:, :, :-1]
        high = np.array(n.stat)[:, None, None] - low
        w = 2 if c.loss == "bernoulli" else 1  # residuals are compared by rows, weighted labels by weight
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = low[0] ** 2 / low[w] + high[0] ** 2 / high[w] - n.stat[0] ** 2 / n.stat[w]
        gain[(low[2] < c.min_rows) | (high[2] < c.min_rows) | ~np.isfinite(gain)] = -1.0
        best = float(gain.max())
        at = int((gain >= best - 1e-9 * abs(best)).argmax())  # equal but for the order of the sums: the first
        root = self.nodes[0].stat
        if best <= 1e-12 * max(1.0, abs(root[w])) or best < c.least_gain * (root[w] - root[0] ** 2 / root[w]):
            return
        k, cut = divmod(at, gain.shape[1])
        column = int(columns[k])
        n.split, n.gain, n.closed, n.left = (column, cut), best, False, len(self.nodes)
        for side, s in ((0, low[:, k, cut]), (1, high[:, k, cut])):
            child = _Node((*n.path, (column, cut, side)), n.depth + 1, tuple(s))
            child.closed = child.depth >= c.depth or child.stat[2] < 2 * c.min_rows
            self.nodes.append(child)

    def _tree(self) -> Tree:
        c = self.model.config
        g, h, _ = (np.array([n.stat[k] for n in self.nodes]) for k in range(3))
        column = np.array([n.split[0] if n.split else -1 for n in self.nodes], np.int16)
        cut = np.array([n.split[1] if n.split else 0 for n in self.nodes], np.int16)
        left = np.array([n.left for n in self.nodes], np.int32)
        leaf = column < 0
        if c.loss == "bernoulli":
            value = c.rate * g / np.maximum(h, 1e-12)
        elif c.loss in ("gentle", "bag"):
            value = c.rate * g / np.maximum(h, 1e-300)
        elif c.loss == "real":
            share = np.clip((1.0 + g / np.maximum(h, 1e-300)) / 2.0, 1e-5, 1.0 - 1e-5)
            value = c.rate * 0.5 * np.log(share / (1.0 - share))
        else:
            wrong = float((h[leaf] - np.abs(g[leaf])).sum() / 2.0 / h[leaf].sum())
            wrong = min(max(wrong, 1e-10), 1.0 - 1e-10)
            value = c.rate * 0.5 * math.log((1.0 - wrong) / wrong) * np.where(g >= 0, 1.0, -1.0)
        return Tree(column, cut, left, np.where(leaf, value, 0.0), np.array([n.gain for n in self.nodes]))


def _request(paths: Iterable[tuple], slots: dict[tuple, int]) -> tuple:
    """Nested ``(slot, [(column, cut, low, high)])`` that leads to all paths."""
    def node(path: tuple) -> tuple:
        splits = sorted({(s[0], s[1]) for s in below.get(path, ())})
        return slots.get(path), [(c, b, node((*path, (c, b, 0))), node((*path, (c, b, 1)))) for c, b in splits]

    below: dict[tuple, set] = {}
    for p in paths:
        for i in range(len(p)):
            below.setdefault(p[:i], set()).add(p[i])
    return node(())


def fit(df: DataFrame, key: str, columns: Sequence[str], configs: Sequence[Config], label: str = "label", part: str = "part",
        bins: int = 64, at_once: int = 200, until: Callable[[list[Fitted]], bool] | None = None,
        bag: Callable[[int, int], Column] | None = None) -> list[Fitted]:
    """All models over ``df``: ``label`` 0 or 1, ``part`` the fold (0 to 254) or ``HOLD_OUT``, numeric
    ``columns`` (null is a bin of its own, below all values). Edges are taken from the rows that are
    not held out. Models grow ``at_once`` at a time; ``until`` looks at their histories after every
    step and may end them all. ``bag`` gives the column of the counts of models a to b."""
    columns = list(columns)
    edges = bin_edges(df.where(F.col(part) != HOLD_OUT), columns, bins)
    width = max(len(e) for e in edges) + 2
    plain = None if bag else stored(blocks(df, key, columns, edges, label, part), "blocks")
    size = {(r[part], r[label]): r["count"] for r in df.select(F.col(part).cast("int").alias(part), F.col(label).cast("int").alias(label)).groupBy(part, label).count().collect()}
    out: list[Fitted] = []
    for at in range(0, len(configs), at_once):
        table = plain or stored(blocks(df, key, columns, edges, label, part, bag(at, min(at + at_once, len(configs)))), "blocks")
        out += _fit_some(table, columns, edges, width, size, list(configs[at:at + at_once]), until)
    return out


def _start(config: Config, size: dict) -> float:
    if config.loss != "bernoulli":
        return 0.0
    mine = {k: n for k, n in size.items() if k[0] not in (HOLD_OUT, config.leave)}
    one, all_ = sum(n for (_, y), n in mine.items() if y == 1), sum(mine.values())
    return math.log(one / (all_ - one)) if 0 < one < all_ else 0.0


def _fit_some(table: DataFrame, columns: list[str], edges: list[np.ndarray], width: int, size: dict, configs: list[Config], until: Callable | None) -> list[Fitted]:
    spark = table.sparkSession
    sc = spark.sparkContext
    name = uuid.uuid4().hex
    models = [Fitted(replace(c), columns, edges, _start(c, size)) for c in configs]
    growing = [_Growing(m, i) for i, m in enumerate(models)]
    starts = [m.start for m in models]
    p = len(columns)
    limit = max(2, STEP_CELLS // (3 * p * width))
    bags = all(c.loss == "bag" for c in configs)  # a bag's tree does not depend on trees before it

    def decoded(r) -> tuple:
        label = np.frombuffer(r[2], np.uint8)
        return (r[0], np.frombuffer(r[1], np.uint8).reshape(len(label), p), label, np.frombuffer(r[3], np.uint8), np.frombuffer(r[4], np.int64),
                np.frombuffer(r[5], np.uint8).reshape(len(label), -1), bytes(r[6]) if r[6] is not None else b"")

    def loaded(state: DataFrame):
        """The blocks in memory, in few partitions: every one of them gives sums of all nodes."""
        rdd = state.select(*_BLOCK, "state").rdd
        rdd = rdd.coalesce(max(1, min(rdd.getNumPartitions(), -(-sum(size.values()) // TASK_ROWS), 2 * sc.defaultParallelism))).map(decoded).persist(StorageLevel.MEMORY_AND_DISK)
        return rdd, rdd.getNumPartitions()

    state = table.select(*_BLOCK, F.lit(None).cast("binary").alias("state"))
    rdd, parts = loaded(state)
    grown = _Grown(len(models))
    noted = [0] * len(models)  # trees handed to grown
    moved = 0
    try:
        while True:
            open_ = [g for g in growing if not g.over]
            if not open_ or (until and until(models)):
                return models
            requests, slots, back = [], 0, {}
            for g in open_:
                want = sorted(g.wanted() if g.grow else (), key=lambda x: (len(x), x))[:limit]  # a wide tree goes on in the next step
                if slots and slots + len(want) > limit:
                    break  # and so do the models after it
                own = {}
                for path in want:
                    own[path] = slots
                    back[slots] = (g, path)
                    slots += 1
                requests.append((g.number, len(g.model.trees), g.watch, _request(want, own) if want else None))
                g.model.steps += 1
            upto = [len(m.trees) for m in models]

            def work(part: Iterable[tuple], requests=requests, upto=upto, grown=grown) -> Iterator[dict]:
                total: dict[int, np.ndarray] = {}
                for block in part:
                    _sum(total, _add_up(requests, block, configs, None if bags else _advance(name, block, starts, grown, upto), width))
                yield total

            sums = rdd.mapPartitions(work)
            total: dict[int, np.ndarray] = {}
            size_of = 24 * slots * p * width + 16 * (2 * SCORE_BINS + 3) * sum(r[2] for r in requests)
            if parts <= DIRECT and parts * size_of <= DIRECT_BYTES:
                for s in sums.collect():
                    _sum(total, s)
            else:
                for s in sums.flatMap(_apart).reduceByKey(_sum, max(1, min(parts, sc.defaultParallelism))).values().collect():
                    total.update(s)
                moved += parts * size_of
                if moved > FREED_BYTES:
                    freed(spark)
                    moved = 0
            found: dict[int, dict] = {}
            for slot, (g, path) in back.items():
                found.setdefault(g.number, {})[path] = total.get(slot, np.zeros((3, p * width)))
            served = {r[0] for r in requests}
            for g in open_:
                if g.number in served:
                    g.take(found.get(g.number, {}), total.get(-g.number - 1))
            for m, model in enumerate(() if bags else models):
                for i in range(noted[m], len(model.trees)):
                    grown.late.append((m, i, model.trees[i]))
                noted[m] = len(model.trees)
            if len(grown.late) > 20 * len(models):
                grown.sent.append(sc.broadcast(grown.late))
                grown.sent_upto, grown.late = list(noted), []
            if max(n - f for n, f in zip(noted, grown.first, strict=True)) >= STATE_ROUNDS:
                state, grown, rdd, parts = _saved(state, name, starts, grown, list(noted), rdd, loaded, p)
            # models that wait for a later step go first in the next one
            waiting, worked = [g for g in growing if g.number not in served], [g for g in growing if g.number in served]
            growing = worked + waiting if bags else waiting + worked  # a bag is finished before others have as many nodes
    finally:
        rdd.unpersist()
        for b in grown.sent:
            b.unpersist()


def _saved(state, name, starts, grown, noted, rdd, loaded, p):
    """The margins of all blocks, written; later steps start from them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                codes = np.frombuffer(r["codes"], np.uint8).reshape(len(r["label"]), p)
                r["state"] = _advance(name, (r["block"], codes, None, None, None, None, r["state"] or b""), starts, grown, noted).tobytes()
                yield pa.RecordBatch.from_pylist([r], b.schema)

    new = stored(state.mapInArrow(run, state.schema), "margins")
    rdd.unpersist()
    for b in grown.sent:
        b.unpersist()
    now = _Grown(len(starts))
    now.first, now.sent_upto = list(noted), list(noted)
    fresh, parts = loaded(new)
    return new, now, fresh, parts
