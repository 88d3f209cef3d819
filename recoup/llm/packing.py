"""Packing documents into windows of equal capacity by Karmarkar-Karp multiway differencing.

A document's ids are cut into whole windows, which need no packing, and a remainder, which is cut
into pieces of at most PIECE ids. The pieces of a block are packed by differencing: every piece
begins as a partition of its own, and the two partitions with the largest spread are merged with
opposing imbalances, the fullest window of one with the emptiest of the other, until one partition
is left. Its windows are near equal. If one exceeds the capacity, the block takes a window more.

A block is a bounded buffer inside a task, so nothing is shuffled and no task holds more than a
block. Blocks close a little below their windows' capacity; that slack is the padding.
"""
from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import pieces
from recoup.llm.tokens import encoder
from recoup.session import spread

CAPACITY = 2048
#: Windows of a block, pieces' length, and ids left free per window when a block closes.
BLOCK_WINDOWS = 64
PIECE = 256
SLACK = 16


def differencing(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each size, and the windows' sums."""
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(windows, np.int64)
    sums: list[np.ndarray] = []
    for s in sizes:
        v = np.zeros(windows, np.int64)
        v[0] = s
        sums.append(v)
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tree: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None  # merged
        tree.append((a, b, order))
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums)))
        sums.append(total)
    root = len(sums) - 1
    place: dict[int, np.ndarray] = {root: np.arange(windows)}
    for n in range(len(tree) - 1, -1, -1):
        a, b, order = tree[n]
        w = place.pop(len(sizes) + n)
        own = np.empty(windows, np.int64)
        own[order] = w
        place[a], place[b] = own, own[::-1]
    return np.array([place[i][0] for i in range(len(sizes))]), sums[root]


def pack(sizes: list[int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """The window of each size and the number of windows, none above the capacity."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        at, sums = differencing(sizes, windows)
        if not len(sizes) or sums.max() <= capacity:
            return at, windows
        windows += 1


def pack_documents(docs: DataFrame, path: str, end: int = 1, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is the ids of its text and the end id, so null and empty texts are one id. Each id
    lies in exactly one piece; offsets in a sequence run on without gaps from 0, and no sequence
    exceeds the capacity. Rows that share an id stay separate documents. sequence_id numbers the
    sequences of a task above the task's own range. Other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema, arrow = schemas([(id_col, docs.schema["doc"].dataType), ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()),
                             ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType())])
    tail = np.array([end], "<u4").tobytes()
    room = BLOCK_WINDOWS * (capacity - SLACK)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []  # doc, start, ids, doc_tokens
        free = room
        done: list[tuple] = []

        def close() -> None:
            nonlocal sequence, free, held
            at, windows = pack([len(h[2]) // 4 for h in held], capacity)
            filled = [0] * windows
            for h, w in zip(held, at.tolist(), strict=True):
                done.append((*h, sequence + w, filled[w]))
                filled[w] += len(h[2]) // 4
            sequence += windows
            held, free = [], room

        def flush() -> pa.RecordBatch:
            c = list(zip(*done, strict=True)) or [()] * 6
            done.clear()
            return batch_of(arrow, **{id_col: list(c[0])}, start=list(c[1]), length=[len(x) // 4 for x in c[2]], ids=list(c[2]),
                            doc_tokens=list(c[3]), sequence_id=list(c[4]), offset=list(c[5]))

        for part in pieces(batches, 1):
            flat_ids, first = enc.column(part.column(1))
            flat_ids = flat_ids.tobytes()
            for doc, a, b in zip(part.column(0).to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                ids = flat_ids[4 * a:4 * b] + tail
                total = len(ids) // 4
                start = 0
                while total - start >= capacity:
                    done.append((doc, start, ids[4 * start:4 * (start + capacity)], total, sequence, 0))
                    sequence += 1
                    start += capacity
                while start < total:
                    size = min(PIECE, total - start, free)
                    held.append((doc, start, ids[4 * start:4 * (start + size)], total))
                    start += size
                    free -= size
                    if not free:
                        close()
            yield flush()
        if held:
            close()
        yield flush()

    return spread(docs).mapInArrow(run, schema)


def with_sums(packed: DataFrame) -> DataFrame:
    """``ids_crc32``, the unsigned CRC-32 of the ids as little-endian 32-bit integers, for ``ids``."""
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
