"""Substring deduplication by recompression.

Every word of a text gets a symbol that depends on the word alone. A round first names the inside of
every run of equal symbols (its first and last copy stay), then every pair of neighbours of which the
left one's name hashes to 0 and the right one's to 1. A name is a hash of what it stands for, so the
same run or pair has the same name in every task, without a table of names. What a window of words
becomes, away from its edges, follows from the window alone: the part of it that no neighbour outside
can change (its core) loses on average half a symbol on each side in a round, while symbols grow. The
window's anchor is the first symbol of the last core that is not empty, so equal windows have equal
anchors, whatever surrounds them.

Spark then groups the anchors of all texts: a name in one text only is no repeat. Texts that hold a
shared name are read again, their windows with such an anchor are named by 96 bits of hash, and
grouped to their smallest document.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import flat, grams, mix, pieces, span_hash, spans
from recoup.session import spread, stored

_MEMBER = np.array([b not in (9, 10, 11, 12, 13, 32) for b in range(256)])
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x2545F4914F6CDD1D)


class Split:
    """The words of a piece: bytes, first and last byte of each, row, and first word of each row."""

    def __init__(self, col: pa.Array) -> None:
        self.raw, offsets = flat(col)
        self.start, self.end = spans(self.raw, offsets, _MEMBER)
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = span_hash(self.raw, self.start, self.end)

    def joined(self, keep: np.ndarray) -> list[str]:
        """sha256 of each row's kept words, joined by one space."""
        start, end = self.start[keep], self.end[keep]
        first = np.r_[0, np.cumsum(np.bincount(self.row[keep], minlength=len(self.first) - 1))]
        size = end - start + 1
        at = np.cumsum(size)
        out = np.full(int(at[-1]) if len(at) else 0, 32, np.uint8)
        delta = np.zeros(len(self.raw) + 1, np.int8)
        np.add.at(delta, start, 1)
        np.add.at(delta, end, -1)
        blank = np.zeros(len(out), bool)
        blank[at - 1] = True
        out[~blank] = self.raw[np.cumsum(delta[:-1], dtype=np.int8).astype(bool)]
        edge = np.r_[0, at][first]
        view = memoryview(out)
        return [hashlib.sha256(view[a:max(a, b - 1)]).hexdigest() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def window_starts(row: np.ndarray, width: int) -> np.ndarray:
    """First words of all windows that stay in their row."""
    n = len(row) - width + 1
    return np.flatnonzero(row[:n] == row[width - 1:]) if n > 0 else np.zeros(0, np.int64)


def anchors(symbol: np.ndarray, row: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows' first words, and the name of the anchor of each."""
    at = window_starts(row, width)
    best = symbol[at]
    lo, hi = at.copy(), at + width - 1  # first and last symbol of the core
    alive = np.arange(len(at))
    level = 0
    while len(alive):
        level += 1
        # runs: x x x x becomes x (x, 2) x
        new = np.ones(len(symbol), bool)
        new[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        copies = np.diff(np.r_[begin, len(symbol)])
        keep = run[lo] < run[hi]  # else the core is inside one run
        alive, lo, hi = alive[keep], run[lo[keep]], run[hi[keep]]
        if len(begin) < len(symbol):
            kept = np.minimum(copies, 3)
            stop = np.cumsum(kept)
            lo, hi = stop[lo] - 1, stop[hi] - kept[hi]  # the last copy of the first run, the first of the last
            names = np.repeat(symbol[begin], kept)
            long = copies >= 3
            inside = stop[long] - 2
            names[inside] = mix(names[inside] * _C + (copies[long] - 2).astype(np.uint64))
            symbol, row = names, np.repeat(row[begin], kept)
        # pairs of a left and a right symbol
        right = (mix(symbol + np.uint64(level)) & np.uint64(1)).astype(bool)
        lo = lo + right[lo]
        hi = hi - ~right[hi]
        keep = lo <= hi
        alive, lo, hi = alive[keep], lo[keep], hi[keep]
        pair = np.zeros(len(symbol), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (row[:-1] == row[1:])
        head = np.ones(len(symbol), bool)
        head[1:] = ~pair[:-1]
        where = np.flatnonzero(pair)
        names = symbol.copy()
        names[where] = mix(mix(symbol[where] * _A) + symbol[where + 1] * _B)
        index = np.cumsum(head) - 1
        symbol, row = names[head], row[head]
        lo, hi = index[lo], index[hi]
        best[alive] = symbol[lo]
    return at, best


# ---- the passes

_FACT, _FACT_ARROW = schemas([("doc", T.LongType()), ("key", T.LongType()), ("n_words", T.LongType()), ("sha", T.StringType()), ("names", T.ArrayType(T.LongType()))])
_CUT, _CUT_ARROW = schemas([("doc", T.LongType()), ("key", T.LongType()), ("n_removed", T.LongType()), ("sha", T.StringType())])
_WINDOW, _WINDOW_ARROW = schemas([("h", T.LongType()), ("c", T.IntegerType()), ("doc", T.LongType()), ("key", T.LongType()), ("at", T.IntegerType())])


def _retyped(schema: T.StructType, arrow: pa.Schema, doc: T.DataType) -> tuple[T.StructType, pa.Schema]:
    return schemas([(f.name, doc if f.name == "doc" else f.dataType) for f in schema.fields])


def _list(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 50) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row of ``docs``.

    A word is removed if a window of ``width`` consecutive words covers it whose words also stand in
    a row with a smaller id; windows are those of the input. kept_sha256 is of the kept words, joined
    by one space. Null and empty texts have no words. A row with a null id removes nothing and loses
    nothing; rows that share an id do not remove each other's words, and each is judged by its own
    text. Repeated rows come out as often as they come in. Other columns are not read.
    """
    doc_type = docs.schema[id_col].dataType
    fact, fact_arrow = _retyped(_FACT, _FACT_ARROW, doc_type)
    cut_schema, cut_arrow = _retyped(_CUT, _CUT_ARROW, doc_type)
    window_schema, window_arrow = _retyped(_WINDOW, _WINDOW_ARROW, doc_type)
    # a row's result follows from its id and text, so the two name it
    base = spread(docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text")))

    def facts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            w = Split(part.column(2))
            at, name = anchors(w.hash, w.row, width)
            row = w.row[at]
            new = np.ones(len(at), bool)
            new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
            row, name = row[new], name[new]
            order = np.lexsort((name, row))
            row, name = row[order], name[order]
            new = np.ones(len(row), bool)
            new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
            rows = part.num_rows
            yield batch_of(fact_arrow, doc=part.column(0), key=part.column(1), n_words=np.diff(w.first), sha=w.joined(np.ones(len(w.row), bool)),
                           names=_list(name[new].view(np.int64), np.bincount(row[new], minlength=rows)))

    known = stored(base.mapInArrow(facts, fact), "facts")
    # equal texts are one: all but the first have every window in it
    long = known.where(F.col("doc").isNotNull() & (F.col("n_words") >= width))
    firsts = stored(long.groupBy("key").agg(F.min("doc").alias("first")), "texts")
    held = long.select("key", F.explode("names").alias("name"))
    shared = stored(held.groupBy("name").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a < b").select("name"), "names")
    named = held.join(shared, "name", "left_semi").groupBy("key").agg(F.collect_set("name").alias("names")).join(firsts, "key")
    # texts of one key but other ids are copies; those of the first id are judged
    near = base.where(F.col("doc").isNotNull()).join(named.withColumnRenamed("first", "doc"), ["key", "doc"]).select("doc", "key", "text", "names")
    near = stored(near, "sharing")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            w = Split(part.column(2))
            at, name = anchors(w.hash, w.row, width)
            count = pa.compute.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)
            live = part.column(3).flatten().to_numpy(zero_copy_only=False)
            at = at[_among(w.row[at], name.view(np.int64), np.repeat(np.arange(part.num_rows), count), live)]
            row = w.row[at]
            if len(at):
                h = grams(w.hash, width)[at]
                c = grams(mix(w.hash * _C + np.uint64(1)), width)[at]
                yield batch_of(window_arrow, h=h.view(np.int64), c=(c >> np.uint64(32)).astype(np.uint32).view(np.int32),
                               doc=part.column(0).take(pa.array(row)), key=part.column(1).take(pa.array(row)), at=(at - w.first[row]).astype(np.int32))

    # windows are named twice rather than written; their first documents are written, so that a join
    # with a window that very many texts share can be split
    window = near.mapInArrow(windows, window_schema)
    first = stored(window.groupBy("h", "c").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h", "c", "first"), "windows")
    hits = window.join(first, ["h", "c"]).where("doc > first").groupBy("doc", "key").agg(F.collect_set("at").alias("hits"))
    repeated = near.select("doc", "key", "text").dropDuplicates(["doc", "key"]).join(hits, ["doc", "key"]).select("doc", "key", "text", "hits")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 2):
            w = Split(part.column(2))
            count = pa.compute.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)
            at = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(w.first[:-1], count)
            delta = np.zeros(len(w.row) + 1, np.int64)
            np.add.at(delta, at, 1)
            np.add.at(delta, at + width, -1)
            keep = np.cumsum(delta[:-1]) == 0
            yield batch_of(cut_arrow, doc=part.column(0), key=part.column(1), sha=w.joined(keep),
                           n_removed=np.bincount(w.row[~keep], minlength=part.num_rows))

    cuts = repeated.mapInArrow(cut, cut_schema).select(F.col("doc").alias("d"), F.col("key").alias("k"), "n_removed", F.col("sha").alias("left"))
    copies = firsts.select(F.col("key").alias("fk"), "first")
    out = known.join(copies, (F.col("key") == F.col("fk")) & (F.col("doc") > F.col("first")), "left").join(
        cuts, (F.col("doc") == F.col("d")) & (F.col("key") == F.col("k")), "left")
    copy = F.col("first").isNotNull()
    return out.select(
        F.col("doc").alias(id_col), "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"))


def _among(row: np.ndarray, name: np.ndarray, of: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Which (row, name) are among the (of, live)."""
    known = np.unique(live)
    at = np.searchsorted(known, name)
    ok = at < len(known)
    ok[ok] = known[at[ok]] == name[ok]
    ok[ok] = np.isin(row[ok] * len(known) + at[ok], of * len(known) + np.searchsorted(known, live))
    return ok
