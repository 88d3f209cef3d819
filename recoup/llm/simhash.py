"""SimHash near-duplicates over deletion-variant signatures.

Two fingerprints with at most two differing bits differ by at most one bit in one of the two
32-bit halves. So each distinct fingerprint is indexed under its 64 one-wildcard variants (a half
with one bit masked), equal variants meet, and the pairs are verified.

A variant shared by many fingerprints (a large group of near copies) is never expanded into pairs.
Its rows are indexed once more with a second wildcard: fingerprints that agree outside two masked
bits are all linked, so linking each to the smallest of them keeps every link's component.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.graph import components
from recoup.llm.text import LOWER, pieces
from recoup.session import spread, stored

#: Fingerprints under one variant up to which their pairs are compared directly.
DIRECT = 64


def fingerprint(text: bytes, width: int = 3) -> int:
    """64-bit SimHash of the word shingles of a text in UTF-8, A-Z lower-cased; no words: 0."""
    w = text.translate(LOWER).split()
    if not w:
        return 0
    if len(w) <= width:
        shingles = [b" ".join(w)]
    else:
        flat = b" ".join(w)
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        start = np.cumsum(size) - size
        end = start[width - 1:] + size[width - 1:] - 1
        shingles = [flat[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 14):
        part = shingles[at:at + (1 << 14)]
        h = np.frombuffer(b"".join(map(xxhash.xxh64_digest, part, repeat(42))), np.uint8)
        ones += np.unpackbits(h.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, fp`` for every row; fp holds the 64 bits as a signed long."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema, arrow = schemas([("doc", docs.schema["doc"].dataType), ("fp", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            texts = part.column(1).cast(pa.large_binary()).to_pylist()
            fp = np.array([fingerprint(t) if t else 0 for t in texts], np.uint64)
            yield batch_of(arrow, doc=part.column(0), fp=fp.view(np.int64))

    return spread(docs).mapInArrow(run, schema)


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1)


_EDGE, _EDGE_ARROW = schemas([("a", T.LongType()), ("b", T.LongType()), ("hot", T.IntegerType())])


def _pairs(key: np.ndarray, fp: np.ndarray, hot: int | None) -> pa.RecordBatch:
    """Whole groups: verified pairs of small ones, rows (fp, key) of large ones and of ``hot``."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])
    big = np.repeat(size > DIRECT, size)
    if hot is not None:
        big |= key == hot
    at = np.flatnonzero(~big)
    a, b, found = [fp[big]], [key[big]], 0
    for d in range(1, DIRECT):
        at = at[at + d < len(key)]
        at = at[key[at + d] == key[at]]
        if not len(at):
            break
        ok = at[_popcount(fp[at] ^ fp[at + d]) <= 2]
        a.append(fp[ok])
        b.append(fp[ok + d])
        found += len(ok)
    flag = np.r_[np.ones(int(big.sum()), np.int32), np.zeros(found, np.int32)]
    return batch_of(_EDGE_ARROW, a=np.concatenate(a), b=np.concatenate(b), hot=flag)


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, fp): verified pairs of small groups (hot 0), and the rows of large
    ones as they come (fp, key, hot 1). Holds one batch and DIRECT rows."""
    key = fp = np.zeros(0, np.int64)
    hot = None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
        fp = np.concatenate([fp, batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(key):
            continue
        now = int(key[-1])
        last = int(np.searchsorted(key, now, "left"))  # the last group may go on
        if now == hot or len(key) - last > DIRECT:  # and is known to be large
            yield _pairs(key, fp, hot)
            hot, key, fp = now, key[:0], fp[:0]
        elif last:
            yield _pairs(key[:last], fp[:last], hot)
            key, fp = key[last:], fp[last:]
    yield _pairs(key, fp, hot)


_STAR, _STAR_ARROW = schemas([("a", T.LongType()), ("b", T.LongType())])


def _star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (i, j, rest, fp): each fp linked to the first of its group."""
    lead: tuple | None = None
    for batch in batches:
        c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        if not len(c[0]):
            continue
        new = np.ones(len(c[0]), bool)
        new[1:] = (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1])
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        b = c[2][at]
        if lead is not None and lead[:2] == (c[0][0], c[1][0]):
            b = np.where(at == 0, lead[2], b)
        lead = (c[0][-1], c[1][-1], b[-1])
        keep = c[2] != b
        yield batch_of(_STAR_ARROW, a=c[2][keep], b=b[keep])


def links(fps: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of distinct fingerprints ``fp`` whose components are those of all pairs with
    at most two differing bits."""
    keyed = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).selectExpr(
        "fp", "shiftleft(cast(i as bigint), 32) | ((case when i >= 32 then shiftrightunsigned(fp, 32) else fp & 4294967295L end)"
        " & ~shiftleft(1L, i % 32)) as key")
    met = stored(keyed.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(_meet, _EDGE), "met")
    # rows of large groups, under a second masked bit: j in the other half when bit i of this half
    # is masked; or two bits of the other half, once, when this half is equal
    hot = met.where("hot = 1").selectExpr("a as fp", "cast(shiftrightunsigned(b, 32) as int) as i")
    cross = hot.select("fp", "i", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("j")).selectExpr(
        "fp", "i", "case when i >= 32 then j else j + 32 end as j")
    sides = hot.selectExpr("fp", "case when i >= 32 then 0 else 32 end as base").distinct()
    inner = (sides.select("fp", "base", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("p"))
             .select("fp", "base", "p", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("q")).where("p < q")
             .selectExpr("fp", "base + p as i", "base + q as j"))
    masked = (cross.selectExpr("fp", "least(i, j) as i", "greatest(i, j) as j").distinct().unionByName(inner)
              .selectExpr("cast(i * 64 + j as bigint) as ij", "fp & ~(shiftleft(1L, i) | shiftleft(1L, j)) as rest", "fp"))
    star = masked.repartition("ij", "rest").sortWithinPartitions("ij", "rest", "fp").mapInArrow(_star, _STAR)
    return met.where("hot = 0").select("a", "b").unionByName(star).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    component_id is the smallest id reachable over links of at most two differing bits; equal
    fingerprints are linked, texts without words (null, empty, white space) have fingerprint zero
    and are linked with it like any other. A null id takes part but is never the smallest, unless
    its component has no other. Rows are never merged: repeated rows come out as often as they
    come in. Other columns are not read.
    """
    fp = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stored(fp.groupBy("fp").agg(F.min("doc").alias("least")), "classes")
    graph = components(links(classes.select("fp")))
    graph = graph.select(F.col("node").alias("fp"), F.col("component"))
    member = classes.join(graph, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    known = member.join(least, "component").select("fp", "component_id")
    return fp.join(known, "fp").select(
        F.col("doc").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
