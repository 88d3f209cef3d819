"""Benchmark decontamination by winnowing.

A benchmark window is 13 consecutive words of an item (all words of a shorter item). For a window
of t words both sides keep the smallest hash of every ceil-half(t) consecutive k-grams, with
k = (t + 1) // 2: two texts that share t words always keep the same fingerprint there. The kept
fingerprints are joined, each hit is extended to the windows of t words that contain it, and those
are joined with the benchmark's windows by a 64-bit hash.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.rows import named, own_rows
from recoup.llm.text import Words, count_words, grams, mix, pieces, words
from recoup.session import spread, stored


def winnow(w: Words, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints for shared spans of t words: their hashes, and positions in ``w``."""
    k = (t + 1) // 2
    width = t - k + 1
    h = grams(w.hash, k)
    n = len(w.hash) - t + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = h[:n].copy()
    for j in range(1, width):
        np.minimum(low, h[j:n + j], out=low)
    at = np.zeros(n, np.int64)
    for j in range(width):  # the rightmost of equal ones
        at = np.where(h[j:n + j] == low, np.arange(j, n + j), at)
    at = np.unique(at[w.row[:n] == w.row[t - 1:t - 1 + n]])
    return mix(h[at] + np.uint64(t)), at


def _whole(w: Words, t: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of t words at ``start``, where they stay in their row."""
    start = start[(start >= 0) & (start + t <= len(w.hash))]
    start = start[w.row[start] == w.row[start + t - 1]]
    return (mix(grams(w.hash, t)[start] + np.uint64(t)) if len(start) else np.zeros(0, np.uint64)), start


def _item_windows(items: DataFrame, n: int) -> DataFrame:
    """``item, t, kind, hash``: kind 0 are kept fingerprints, kind 1 whole windows."""
    schema, arrow = schemas([("item", items.schema["item"].dataType), ("t", T.IntegerType()), ("kind", T.IntegerType()), ("hash", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            w = words(part.column(1))
            size = np.diff(w.first)
            for t in np.unique(np.minimum(size, n)):
                t = int(t)
                if not t:
                    continue
                chosen = (size >= n) if t == n else (size == t)
                keep = chosen[w.row] if len(w.row) else np.zeros(0, bool)
                sub = Words(w.hash[keep], w.row[keep], w.first, w.start[keep], w.end[keep])
                for kind, (h, at) in enumerate((winnow(sub, t), _whole(sub, t, np.arange(len(sub.hash))))):
                    yield batch_of(arrow, item=part.column(0).take(pa.array(sub.row[at])), t=np.full(len(at), t, np.int32), kind=np.full(len(at), kind, np.int32), hash=h.view(np.int64))

    return items.mapInArrow(run, schema).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", n: int = 13) -> DataFrame:
    """``doc_id, n_words, n_hit, items`` for every row of ``docs``.

    n_hit counts the words inside any occurrence of an item's window, items is the sorted array
    of the ids of items with such a window. Null and empty texts have no words and no hits. Rows
    that share an id (or a null id) are judged each by its own text. An item without words has no
    window; repeated items are all listed. Other columns of either table are not read.
    """
    id_type = docs.schema[id_col].dataType
    docs = docs.select(own_rows(docs, id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    known = stored(_item_windows(items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")), n), "windows")
    classes = sorted(r["t"] for r in known.select("t").distinct().collect())  # n values at most
    doc_type = docs.schema["doc"].dataType

    schema, arrow = schemas([("doc", doc_type), ("n_words", T.LongType())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            yield batch_of(arrow, doc=part.column(0), n_words=count_words(part.column(1)))

    sized = spread(docs).mapInArrow(counted, schema)

    print_schema, print_arrow = schemas([("doc", doc_type), ("t", T.IntegerType()), ("hash", T.LongType()), ("at", T.IntegerType())])

    def fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            w = words(part.column(1))
            for t in classes:
                h, at = winnow(w, t)
                row = w.row[at]
                yield batch_of(print_arrow, doc=part.column(0).take(pa.array(row)), t=np.full(len(at), t, np.int32), hash=h.view(np.int64), at=(at - w.first[row]).astype(np.int32))

    kept = known.where("kind = 0").select("t", "hash").distinct()
    hits = (spread(docs).mapInArrow(fingerprints, print_schema).join(kept, ["t", "hash"])
            .groupBy("doc").agg(F.collect_set(F.struct("t", "at")).alias("hits")))
    near = docs.join(hits, docs["doc"].eqNullSafe(hits["doc"])).select(docs["doc"], "text", F.col("hits.t").alias("ts"), F.col("hits.at").alias("ats"))

    win_schema, win_arrow = schemas([("doc", doc_type), ("t", T.IntegerType()), ("start", T.IntegerType()), ("hash", T.LongType())])

    def extended(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            w = words(part.column(1))
            count = np.diff(part.column(2).offsets.to_numpy())
            ts, ats = (part.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3))
            at = ats + np.repeat(w.first[:-1], count)
            for t in classes:
                k = (t + 1) // 2
                own = at[ts == t]
                h, start = _whole(w, t, np.unique((own[:, None] - np.arange(t - k + 1)).ravel()))
                row = w.row[start]
                yield batch_of(win_arrow, doc=part.column(0).take(pa.array(row)), t=np.full(len(row), t, np.int32), start=(start - w.first[row]).astype(np.int32), hash=h.view(np.int64))

    whole = known.where("kind = 1").select("t", "hash", "item")
    found = stored(near.mapInArrow(extended, win_schema).join(whole.select("t", "hash").distinct(), ["t", "hash"]).distinct(), "occurrences")
    hit = (found.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("start", "t"))).alias("w"))
           .select("doc", F.expr("""aggregate(w, struct(0 as upto, 0L as n), (a, x) -> struct(
               greatest(a.upto, x.start + x.t) as upto, a.n + greatest(0, x.start + x.t - greatest(a.upto, x.start)) as n)).n""").alias("n_hit")))
    hit_items = found.select("doc", "t", "hash").distinct().join(whole, ["t", "hash"]).groupBy("doc").agg(F.collect_set("item").alias("items"))
    both = hit.join(hit_items, hit["doc"].eqNullSafe(hit_items["doc"])).select(hit["doc"].alias("d"), "n_hit", "items")
    out = sized.join(both, sized["doc"].eqNullSafe(both["d"]), "left")
    return out.select(
        named(out, "doc", id_type).alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.sort_array("items"), F.array().cast(T.ArrayType(items.schema[item_col].dataType))).alias("items"))


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """At least a twentieth of the words are hit."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
