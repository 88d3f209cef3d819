"""Embedding near-duplicates by sorted projection passes.

Equal vectors of a label are one class. The classes of one label and dimension are a kind. A pass
gives every class a code, the concatenated signs of random projections of its difference from the
kind's mean, and orders the classes by kind and code, equal codes in an order of the pass's own; each
is compared with the WINDOW classes before it. Close vectors share long code prefixes, so they tend to
be near in some pass. The verified pairs of all passes are united into components.

The number of passes follows from each kind's own vectors: a sample is projected, and for probes of
it and partners at the threshold the chance to meet in a window is taken from the angle between them
as seen from the mean and from the runs of equal code prefixes; passes are added until such a pair
is missed with probability MISS at most. In a kind of one window a single pass compares all pairs.
Where the signs hardly split the vectors (several dense cones), so that neither MOST passes nor as
many as would compare every pair reach MISS, all pairs are compared instead: that is exact.

Links are then counted exactly inside each component, in blocks of a bounded number of vectors that
are compared with each other, so a group far larger than a window is counted in full, and no list
of its pairs is ever built.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.graph import components
from recoup.session import spread, stored

THRESHOLD = 0.98
WINDOW, BLOCK = 512, 1024
CODE_BITS = 32
MISS = 0.002
#: Vectors of one side of a block in which the links of a component are counted.
CHUNK = 512
#: Vectors of one side of a block in which all pairs of a kind are compared, and of those at once.
SIDE, TILE = 4096, 512
#: Vectors compared with one vector in a pass; vectors, probes and passes that the estimate looks at.
COMPARED = (BLOCK + WINDOW) ** 2 // BLOCK
SAMPLE, PROBES, TRIALS = 4096, 512, 8
#: Passes that a kind is given at least before all its pairs are compared instead.
MOST = 64


def passes(largest: int, threshold: float = THRESHOLD) -> int:
    """Passes for a kind of so many distinct vectors that every sign halves; ``needed`` adds to them."""
    agree = 1 - math.acos(threshold) / math.pi
    depth = max(0.0, math.log2(max(1, largest) / WINDOW))
    within = agree ** (min(depth, CODE_BITS) + 1)
    return max(2, math.ceil(math.log(MISS) / math.log(1 - within)))


def projections(number: int, dim: int) -> np.ndarray:
    """The CODE_BITS random directions of a pass; they depend on the pass and the dimension only."""
    return np.random.default_rng([20, number, dim]).standard_normal((dim, CODE_BITS))


def units(col: pa.Array, dim: np.ndarray) -> list[np.ndarray]:
    """Unit vectors of the rows, in double precision, by dimension (in order of np.unique)."""
    values = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(dim) - dim
    out = []
    for d in np.unique(dim):
        rows = np.flatnonzero(dim == d)
        x = values[first[rows][:, None] + np.arange(d)]
        x /= np.abs(x).max(axis=1, keepdims=True)
        out.append(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
    return out


def _classes(vectors: DataFrame) -> DataFrame:
    """``node, label, v, dim, least, n`` for the distinct usable vectors of each label."""
    usable = (F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
              & F.exists("v", lambda x: x != 0))
    return (vectors.where(usable).groupBy("label", "v").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
            .withColumn("dim", F.size("v")).withColumn("node", F.monotonically_increasing_id()))


def needed(x: np.ndarray, mean: np.ndarray, n: int, threshold: float = THRESHOLD) -> int:
    """Passes for a kind of n vectors of which the unit vectors x are a sample; 0: no number of passes
    up to MOST, or up to that which compares all pairs, is enough.

    A probe's partner is at the threshold, in a random direction. In a pass their codes agree in
    their first d bits with probability agree ** d. d is taken from the vectors that share the
    probe's prefix, at the rate of its own halvings where the sample holds too few of them.
    """
    most = max(MOST, (n - 1) // 2 // COMPARED)
    if n <= WINDOW + 1 or len(x) < 2:
        return 1
    count = passes(n, threshold)
    rng = np.random.default_rng([21, x.shape[1]])
    probe = rng.permutation(len(x))[:PROBES]
    aside = rng.standard_normal((len(probe), x.shape[1]))
    aside -= (aside * x[probe]).sum(axis=1, keepdims=True) * x[probe]
    length = np.sqrt((aside * aside).sum(axis=1, keepdims=True))
    partner = threshold * x[probe] + math.sqrt(1 - threshold ** 2) * aside / np.where(length > 0, length, 1)
    a, b = x[probe] - mean, partner - mean
    size = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    agree = 1 - np.arccos(np.clip((a * b).sum(axis=1) / np.where(size > 0, size, 1), -1, 1)) / math.pi
    rows = np.arange(len(probe))
    within = np.zeros(len(probe))
    for number in range(TRIALS):
        bits = (x - mean) @ projections(number, x.shape[1]) > 0
        left = np.full(len(probe), len(x) - 1)
        same = np.ones((len(probe), len(x)), bool)
        same[rows, probe] = False
        deepest, there = np.zeros(len(probe)), left.astype(float)
        for bit in range(CODE_BITS):  # the last prefix that several others of the sample share
            same &= bits[probe, bit][:, None] == bits[:, bit][None, :]
            left = same.sum(axis=1)
            on = (left >= 8) & (deepest == bit) & (n * there > WINDOW * len(x))
            deepest[on], there[on] = bit + 1, left[on]
        others = n * there / max(1, len(x) - 1)
        rate = -np.log2(there / max(1, len(x) - 1)) / np.maximum(deepest, 1)  # halvings a bit
        further = np.log2(np.maximum(others / WINDOW, 1))
        open_ = np.divide(further, rate, out=np.full(len(probe), float(CODE_BITS)), where=rate > 0)
        depth = np.minimum(np.ceil(deepest + np.where(further > 0, open_, 0)), CODE_BITS)
        run = others * 2.0 ** (-rate * np.maximum(depth - deepest, 0))
        met = 1 - (1 - np.minimum(1, WINDOW / np.maximum(run, 1))) ** 2  # places in a run of equal codes are random
        within += agree ** (depth + 1) * np.where(run > WINDOW, met, 1) / TRIALS
    while count <= most and ((1 - within) ** count).mean() > MISS:
        count += max(1, count // 16)
    return count if count <= most else 0


def _plans(classes: DataFrame) -> DataFrame:
    """``label, dim, size, kind, passes, mean``: how the classes of each label and dimension meet.

    Kinds beyond a window are sampled; the others need one pass and no mean.
    """
    kinds = stored(classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).withColumn("kind", F.monotonically_increasing_id()), "kinds")
    large = kinds.where(F.col("size") > WINDOW + 1)
    picked = classes.select("label", "dim", "node", "v").join(large, ["label", "dim"]).where(F.expr(f"pmod(xxhash64(node, 'sample'), size) < {SAMPLE}"))
    schema, arrow = schemas([("kind", T.LongType()), ("passes", T.IntegerType()), ("mean", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            x = _matrix(table.column(2).combine_chunks())
            mean = x.mean(axis=0)
            yield batch_of(arrow, kind=[table.column(0)[0].as_py()], passes=[needed(x, mean, table.column(1)[0].as_py())], mean=[mean.tolist()])

    plans = picked.select("kind", "size", "v", "node").repartition("kind").sortWithinPartitions("kind", "node").mapInArrow(run, schema)
    zero = F.array_repeat(F.lit(0.0), F.col("dim"))
    return stored(kinds.join(plans, "kind", "left").withColumns({
        "passes": F.coalesce("passes", (F.col("size") > 1).cast("int")), "mean": F.coalesce("mean", zero)}), "plans")


def _coded(classes: DataFrame) -> DataFrame:
    """A row for every class and pass of its kind, with its code and without its vector."""
    fields = [("pass", T.IntegerType()), ("kind", T.LongType()), ("code", T.LongType()), ("node", T.LongType())]
    schema, arrow = schemas(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = 1 << np.arange(CODE_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dim = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int32)
            count = batch.column(3).to_numpy()
            mean = batch.column(4).flatten().to_numpy()
            first = np.cumsum(dim) - dim
            by = [x - mean[first[dim == d][:, None] + np.arange(d)] for d, x in zip(np.unique(dim), units(batch.column(2), dim), strict=True)]
            for number in range(int(count.max(initial=0))):
                code = np.zeros(len(dim), np.int64)
                for d, x in zip(np.unique(dim), by, strict=True):
                    code[dim == d] = (x @ projections(number, int(d)) > 0) @ weight
                at = np.flatnonzero(count > number)
                rows = batch.take(pa.array(at))
                yield batch_of(arrow, **{"pass": np.full(len(at), number, np.int32)}, kind=rows.column(1), code=code[at], node=rows.column(0))

    return spread(classes.where("passes > 0").select("node", "kind", "v", "passes", "mean")).mapInArrow(run, schema)


def _ranked(coded: DataFrame) -> DataFrame:
    """The coded rows with their rank in the order of pass, kind and code, equal codes dealt anew in every pass."""
    spark = coded.sparkSession
    coded = coded.withColumn("tie", F.xxhash64("pass", "node"))
    order = ["pass", "kind", "code", "tie", "node"]
    fields = [(f.name, f.dataType) for f in coded.schema] + [("part", T.IntegerType()), ("at", T.LongType())]
    schema, arrow = schemas(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield batch_of(arrow, **dict(zip(coded_names, batch.columns, strict=True)), part=np.full(n, part, np.int32), at=at + np.arange(n))
            at += n

    coded_names = coded.columns
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = stored(coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "ranked")
    # a row for each range written, so it is sent to the rows
    before = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("at")).drop("part", "at", "before")


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of equal values in the first ``keys`` (long) columns of sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(keys)])
        cut = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _matrix(col: pa.Array) -> np.ndarray:
    dim = np.diff(col.offsets.to_numpy())
    return units(col, dim)[0]


def _forest(node: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each linked node to one of its connected group."""
    some = np.flatnonzero(linked.any(axis=1))
    near = linked[np.ix_(some, some)]
    root = np.full(len(some), -1)
    for i in range(len(some)):
        if root[i] >= 0:
            continue
        root[i] = i
        front = np.array([i])
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & (root < 0))
            root[front] = i
    keep = root != np.arange(len(some))
    return node[some[keep]], node[some[root[keep]]]


_EDGE, _EDGE_ARROW = schemas([("a", T.LongType()), ("b", T.LongType())])


def _edges(ranked: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified pairs of neighbours, thinned to a forest of each block. The vectors join the ranks here."""
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    copies = F.when(F.col("rank") % BLOCK >= BLOCK - WINDOW, F.array(block, block + 1)).otherwise(F.array(block))
    rows = (ranked.join(classes.select("node", "v"), "node").withColumn("block", F.explode(copies)).select("block", "rank", "node", "pass", "kind", "v")
            .repartition("block").sortWithinPartitions("block", "rank"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            rank, node, number, kind = (table.column(c).to_numpy() for c in (1, 2, 3, 4))
            v = table.column(5).combine_chunks()
            own = rank // BLOCK == table.column(0)[0].as_py()
            segment = np.cumsum(np.r_[True, (number[1:] != number[:-1]) | (kind[1:] != kind[:-1])])
            for s in np.unique(segment):
                at = np.flatnonzero(segment == s)
                if len(at) < 2 or not own[at].any():
                    continue
                x = _matrix(v.take(pa.array(at)))
                near = x @ x.T >= THRESHOLD
                r = rank[at]
                near &= np.abs(r[:, None] - r) <= WINDOW
                np.fill_diagonal(near, False)
                a, b = _forest(node[at], near)
                if len(a):
                    yield batch_of(_EDGE_ARROW, a=a, b=b)

    return rows.mapInArrow(run, _EDGE)


def _pairs(classes: DataFrame) -> DataFrame:
    """Verified pairs among all of each kind without passes, thinned to a forest of each block."""
    rows = (classes.where("passes = 0 AND size > 1").withColumn("chunks", F.ceil(F.col("size") / SIDE).cast("int"))
            .withColumn("chunk", F.expr("pmod(xxhash64(node, 'side'), chunks)").cast("int")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "kind", F.least("chunk", "other").cast("long").alias("i"), F.greatest("chunk", "other").cast("long").alias("j"), F.col("chunk").cast("long").alias("chunk"), "node", "v")
    keys = ["kind", "i", "j"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            chunk, node = table.column(3).to_numpy(), table.column(4).to_numpy()
            x = _matrix(table.column(5).combine_chunks())
            own = table.column(1)[0].as_py() == table.column(2)[0].as_py()
            root = np.arange(len(node))
            sides = [np.flatnonzero(chunk == table.column(c)[0].as_py()) for c in (1, 2)]
            for lo in range(0, len(sides[0]), TILE):
                left = sides[0][lo:lo + TILE]
                right = sides[1][lo:] if own else sides[1]
                near = x[left] @ x[right].T >= THRESHOLD
                for k in np.flatnonzero(near.sum(axis=1) > own):  # a group shares one root
                    met = np.unique(np.r_[root[left[k]], root[right[near[k]]]])
                    if len(met) > 1:
                        root[np.isin(root, met)] = met[0]
            joined = np.flatnonzero(root != np.arange(len(node)))
            if len(joined):
                yield batch_of(_EDGE_ARROW, a=node[joined], b=node[root[joined]])

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _EDGE)


def _counts(members: DataFrame) -> DataFrame:
    """``node, links`` for members ``component, node, n, v``: how many vectors each links with."""
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    rows = members.join(sizes, "component").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "component", F.least("chunk", "other").cast("long").alias("i"), F.greatest("chunk", "other").cast("long").alias("j"), F.col("chunk").cast("long").alias("chunk"), "node", "n", "v")
    keys = ["component", "i", "j"]
    schema, arrow = schemas([("node", T.LongType()), ("links", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 3):
            i, chunk, node, n = (table.column(c).to_numpy() for c in (1, 3, 4, 5))
            x = _matrix(table.column(6).combine_chunks())
            first = chunk == i
            left, right = np.flatnonzero(first), np.flatnonzero(~first)
            if table.column(1)[0].as_py() == table.column(2)[0].as_py():
                near = x @ x.T >= THRESHOLD
                np.fill_diagonal(near, False)
                yield batch_of(arrow, node=node, links=near @ n)
            elif len(left) and len(right):
                near = x[left] @ x[right].T >= THRESHOLD
                yield batch_of(arrow, node=np.r_[node[left], node[right]], links=np.r_[near @ n[right], n[left] @ near])

    return (rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
            .groupBy("node").agg(F.sum("links").alias("links")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    Vectors link if their labels are equal and not null, they have the same length and their cosine
    is THRESHOLD or more. Null, empty and zero vectors, vectors with null or non-finite components and
    rows with a null id link with nothing; such a row is its own component. Rows with equal vectors
    are linked, also if they share an id. Other columns are not read.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    classes = stored(_classes(rows), "classes")
    met = classes.select("node", "label", "dim", "v").join(_plans(classes), ["label", "dim"])
    found = _edges(_ranked(_coded(met)), classes).unionByName(_pairs(met))
    graph = stored(components(stored(found, "edges")), "graph")
    members = classes.join(graph, "node").select("component", "node", "n", "v", "least")
    links = _counts(members.select("component", "node", "n", "v"))
    least = members.groupBy("component").agg(F.min("least").alias("smallest"))
    linked = members.join(least, "component").join(links, "node").select("node", "smallest", "links")
    known = classes.join(linked, "node", "left").select(
        F.col("label").alias("kl"), F.col("v").alias("kv"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest"))
    usable = rows.withColumn("ok", F.col("id").isNotNull())
    out = usable.join(known, F.col("ok") & (F.col("label") == F.col("kl")) & (F.col("v") == F.col("kv")), "left")
    return out.select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("smallest", "id").alias("component_id"), F.coalesce(F.col("id") == F.coalesce("smallest", "id"), F.lit(False)).alias("kept"))
