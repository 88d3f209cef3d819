"""Token ids as compressed blocks: a static range asymmetric numeral system.

One frequency table, counted over all ids, is shared by all blocks. A block holds whole documents
(about BLOCK_IDS ids) and decodes on its own: its ids are dealt in turn to LANES interleaved states,
here one numpy vector, that share one stream. Every CHECKPOINT_STEPS steps the states and the place
in the stream are kept, so parts of a block decode on their own too (``Table.part``). CRC-32 sums
guard the stream and the ids.

Blocks are rows of Parquet files, so they are written, committed and read by Spark on any store.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import flat, pieces
from recoup.llm.tokens import encoder
from recoup.session import spread, stored

SCALE_BITS = 18
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_IDS = 1 << 18
_MAGIC = b"RNS1"
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)


class Table:
    """Scaled frequencies of the ids; they sum to 2^SCALE_BITS and every counted id has one."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        total = 1 << SCALE_BITS
        seen = counts > 0
        if not seen.any():
            seen = np.zeros(max(1, len(counts)), bool)
            seen[0] = True
            counts = seen.astype(np.int64)
        freq = np.zeros(len(counts), np.int64)
        freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * (total / counts.sum())).astype(np.int64))
        order = np.argsort(-freq, kind="stable")
        short = total - int(freq.sum())
        if short > 0:
            freq[order[0]] += short
        for i in order:  # taken from the most frequent
            if short >= 0:
                break
            give = min(int(freq[i]) - 1, -short, max(1, int(freq[i]) // 2))
            freq[i] -= give
            short += give
        if short < 0:
            raise ValueError("more distinct ids than the scale can hold")
        self.freq = freq.astype(np.uint64)
        self.base = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        """One block; the last step is filled up with the most frequent id."""
        n = len(ids)
        steps = max(1, -(-n // LANES))
        grid = np.full(steps * LANES, int(np.argmax(self.freq)), np.int64)
        grid[:n] = ids
        grid = grid.reshape(steps, LANES)
        x = np.full(LANES, _LOW, np.uint64)
        shift, top = np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
        chunks: list[np.ndarray] = []
        marks: list[tuple[int, bytes]] = []
        size = 0
        for t in range(steps - 1, -1, -1):
            f = self.freq[grid[t]]
            if not f.all():
                raise ValueError("an id is missing in the frequency table")
            out = np.flatnonzero((x >> top) >= f)
            if len(out):
                high = x[out]
                chunks.append(high.astype("<u4"))
                size += len(out)
                x[out] = high >> _32
            q = x // f
            x += (q << shift) - q * f + self.base[grid[t]]
            if t % CHECKPOINT_STEPS == 0:
                marks.append((size, x.astype("<u8").tobytes()))
        chunks.reverse()
        # places are counted from the end while encoding, from the start in the block
        head = b"".join(struct.pack("<I", size - at) + state for at, state in reversed(marks))
        body = head + b"".join(c.tobytes() for c in chunks)
        return _MAGIC + struct.pack("<IIII", n, steps, zlib.crc32(body), zlib.crc32(np.asarray(ids, "<u4").tobytes())) + body

    def part(self, block: bytes, k: int) -> np.ndarray:
        """The ids from the k-th checkpoint up to the next, filling included."""
        steps, body = struct.unpack_from("<I", block, 8)[0], memoryview(block)[20:]
        marks = -(-steps // CHECKPOINT_STEPS)
        record = 4 + 8 * LANES
        at = struct.unpack_from("<I", body, k * record)[0]
        x = np.frombuffer(body, "<u8", LANES, k * record + 4).copy()
        stream = np.frombuffer(body, "<u4", offset=marks * record)
        todo = min(CHECKPOINT_STEPS, steps - k * CHECKPOINT_STEPS)
        ids = np.empty((todo, LANES), np.uint32)
        mask, shift = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
        for t in range(todo):
            slot = x & mask
            s = self.symbol[slot]
            ids[t] = s
            x >>= shift
            x *= self.freq[s]
            x += slot - self.base[s]
            need = np.flatnonzero(x < _LOW)
            if len(need):
                x[need] = (x[need] << _32) | stream[at:at + len(need)]
                at += len(need)
        return ids.ravel()

    def decode(self, block: bytes) -> np.ndarray:
        """The block's ids; raises ValueError if a checksum does not hold."""
        n, steps, body_sum, ids_sum = struct.unpack_from("<IIII", block, 4)
        if block[:4] != _MAGIC or zlib.crc32(memoryview(block)[20:]) != body_sum:
            raise ValueError("damaged block")
        out = np.concatenate([self.part(block, k) for k in range(-(-steps // CHECKPOINT_STEPS))])[:n]
        if zlib.crc32(np.ascontiguousarray(out, "<u4").tobytes()) != ids_sum:
            raise ValueError("wrong ids")
        return out


def id_type(size: int) -> str:
    """Stored form of ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, end: int, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc, ids`` for every row: ids as little-endian integers of the size's type, end included."""
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    schema, arrow = schemas([("doc", docs.schema["doc"].dataType), ("ids", T.BinaryType())])
    kind = np.dtype(id_type(size))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for part in pieces(batches, 1):
            ids, first = enc.column(part.column(1))
            ids = np.insert(ids, first[1:], end)
            if len(ids) and int(ids.max()) >= size:
                raise ValueError("an id beyond the vocabulary's size")
            ends = (first + np.arange(len(first))) * kind.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype(kind))])
            yield batch_of(arrow, doc=part.column(0), ids=packed)

    return spread(docs).mapInArrow(run, schema)


def counted(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id below ``size`` occurs; one row per id reaches the driver."""
    schema, arrow = schemas([("id", T.IntegerType()), ("n", T.LongType())])
    kind = id_type(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for part in pieces(batches, 0):
            total += np.bincount(flat(part.column(0))[0].view(kind), minlength=size)
        yield batch_of(arrow, id=np.flatnonzero(total).astype(np.int32), n=total[total > 0])

    out = np.zeros(size, np.int64)
    for r in tokens.select("ids").mapInArrow(run, schema).groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def write_blocks(tokens: DataFrame, table: Table, path: str, size: int) -> None:
    """The folder's ``table``, and its ``blocks`` in ascending document order: ``part, at, docs, sizes,
    n, block``.

    part numbers the range of documents, at counts the part's ids before the block. Null ids come
    first, rows that share an id follow each other in the order of their ids.
    """
    spark, kind = tokens.sparkSession, id_type(size)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    schema, arrow = schemas([("part", T.IntegerType()), ("at", T.LongType()), ("docs", T.ArrayType(tokens.schema["doc"].dataType)),
                             ("sizes", T.ArrayType(T.LongType())), ("n", T.LongType()), ("block", T.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, count, held, docs = TaskContext.get().partitionId(), 0, 0, [], []

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            return batch_of(arrow, part=[part], at=[at], docs=[docs], sizes=[[len(x) for x in held]], n=[len(ids)], block=[table.encode(ids)])

        for piece in pieces(batches, 1):
            for doc, packed in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                held.append(np.frombuffer(packed, kind))
                docs.append(doc)
                count += len(held[-1])
                if count >= BLOCK_IDS:
                    yield block()
                    at += count
                    count, held, docs = 0, [], []
        if held:
            yield block()

    raw = np.ascontiguousarray(table.counts, "<i8").tobytes()
    spark.createDataFrame([(bytearray(raw), zlib.crc32(raw))], "counts binary, crc32 long").coalesce(1).write.parquet(f"{path}/table")
    (tokens.select("doc", "ids").repartitionByRange(parts, "doc").sortWithinPartitions("doc", "ids")
     .mapInArrow(run, schema).write.parquet(f"{path}/blocks"))


def read_table(spark: SparkSession, path: str) -> Table:
    """The frequency table of a folder of blocks: a number for every id of the vocabulary."""
    (row,) = spark.read.parquet(f"{path}/table").collect()
    if zlib.crc32(bytes(row["counts"])) != row["crc32"]:
        raise ValueError("the frequency table is damaged")
    return Table(np.frombuffer(bytes(row["counts"]), "<i8"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``doc, start, n_tokens, ids_crc32`` for every document, from the folder alone."""
    table = read_table(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    # one row per part: its first id's place in the whole
    before = blocks.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    schema, arrow = schemas([("doc", blocks.schema["docs"].dataType.elementType), ("start", T.LongType()), ("n_tokens", T.LongType()), ("ids_crc32", T.LongType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                before, at, docs, sizes, block = (batch.column(c)[row].as_py() for c in range(5))
                ids = np.ascontiguousarray(table.decode(block), "<u4")
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[e - s:e].tobytes()) for s, e in zip(sizes, ends.tolist(), strict=True)]
                yield batch_of(arrow, doc=docs, start=before + at + ends - np.array(sizes), n_tokens=sizes, ids_crc32=sums)

    # before has a row for each range written, so it is sent to the blocks and they stay where they are
    return blocks.join(F.broadcast(before), "part").select("before", "at", "docs", "sizes", "block").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, folder: str, end: int = 0, size: int = 1 << 16,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, write the blocks to ``folder``, and describe each document as read back.

    Null and empty texts hold the end id alone. Rows that share an id stay separate documents.
    Other columns are not read. ``size`` bounds the ids of the vocabulary.
    """
    tokens = stored(tokenized(docs, path, end, size, id_col, text_col), "tokens")
    table = Table(counted(tokens, size))
    write_blocks(tokens, table, folder, size)
    return read_blocks(docs.sparkSession, folder).withColumnRenamed("doc", id_col)
