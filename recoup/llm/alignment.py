"""Alignment of two tokenizers through inverted bitmaps of id pairs.

Both tokenizers cut the bytes of one text. Between two neighbouring cuts, of whichever side, lies one
link: an occurrence of a token of A and one of B whose byte ranges overlap. A task collects the
links of a block of documents and inverts them: each pair of ids gets bitmaps over the block's
documents, one for every binary digit of the number of its links in a document (multiplicity planes).
Bitmaps of pieces are OR-merged, stored without their zero bytes, and popcounted: the OR of the planes
for documents, the planes by their weights for links. Spark sums the counts of a pair over all blocks
and ranks a pair among those of its B id; then the bitmaps are postings that lead the scores back to
the documents of each block.
"""
from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import flat, pieces
from recoup.llm.tokens import encoder
from recoup.session import spread, stored

#: Documents and bytes of text of a block; a longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 8192, 12 << 20
_BITS = np.array([bin(i).count("1") for i in range(256)], np.int64)


class Table:
    """The bytes of a vocabulary's tokens, end to end, and their decimal ids."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)
        digits = len(str(len(tokens)))
        self.digits = np.zeros((len(tokens), digits + 1), np.uint8)  # right-aligned; zero is no digit
        n = np.arange(len(tokens))
        for k in range(digits):
            self.digits[:, digits - 1 - k] = np.where((n >= 10 ** k) | (k == 0), n // 10 ** k % 10 + 48, 0)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        ends = np.cumsum(size)
        return self.raw[np.repeat(self.begin[ids] - ends + size, size) + np.arange(int(ends[-1]) if len(ids) else 0)]


class Pair:
    """The two tokenizers of a worker. A: a byte-level file of ``tokenizers``; B: a ``sentencepiece`` model."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        import sentencepiece

        self.a = encoder(byte_file, True, plain=True)
        vocab = self.a.tokenizer.get_vocab()
        code = {chr(b): b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b}
        code |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in code)}
        tokens = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            tokens[i] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        parts = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.of_a = Table(tokens)
        self.of_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(parts)])

    def ids(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids and B ids of the rows end to end, with the number of each row. Rows that are null,
        empty, or not given back by both vocabularies byte by byte have none."""
        texts = [t or "" for t in col.to_pylist()]
        led = pa.array([" " + t if t else "" for t in texts], pa.large_string())
        raw, offsets = flat(led)
        a, first = self.a.column(led)
        n_a = np.diff(first)
        lists = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(n_b.sum()))
        size = np.diff(offsets)
        good = np.ones(len(size), bool)
        for ids, n, table in ((a, n_a, self.of_a), (b, n_b, self.of_b)):
            row = np.repeat(np.arange(len(n)), n)
            fits = np.bincount(row, weights=table.size[ids], minlength=len(n)).astype(np.int64) == size
            found = table.joined(ids[fits[row]])
            byte_row = np.repeat(np.arange(len(n)), size)
            ours = fits[byte_row]
            fits[byte_row[ours][raw[ours] != found]] = False
            good &= fits
        return (a[np.repeat(good, n_a)].astype(np.int64), np.where(good, n_a, 0), b[np.repeat(good, n_b)], np.where(good, n_b, 0))


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(byte_file: str, piece_file: str) -> Pair:
    """The worker's tokenizers; tasks of one worker share them."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (byte_file, piece_file) not in _PAIRS:
        _PAIRS[byte_file, piece_file] = Pair(byte_file, piece_file)
    return _PAIRS[byte_file, piece_file]


class Aligned:
    """The rows of a piece: their links, groups, and the text of their groups."""

    def __init__(self, p: Pair, col: pa.Array) -> None:
        a, self.n_a, b, self.n_b = p.ids(col)
        rows = len(self.n_a)
        end_a, end_b = np.cumsum(p.of_a.size[a]), np.cumsum(p.of_b.size[b])
        total = int(end_a[-1]) if len(a) else 0
        cut_a, cut_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
        cut_a[end_a], cut_b[end_b] = True, True
        both = np.flatnonzero(cut_a & cut_b)
        cuts = np.flatnonzero(cut_a | cut_b)
        of_a, of_b = (np.cumsum(c)[cuts] - c[cuts] for c in (cut_a, cut_b))
        row_a = np.repeat(np.arange(rows), self.n_a)
        self.row = row_a[of_a]
        self.a, self.b = a[of_a], b[of_b]
        self.n_links = np.bincount(self.row, minlength=rows)
        last_a, last_b = np.searchsorted(end_a, both), np.searchsorted(end_b, both)  # a group's last tokens
        group_row = row_a[last_a]
        self.n_groups = np.bincount(group_row, minlength=rows)
        # the ids in the order of the text: each group's tokens of A, then those of B
        size_a, size_b = np.diff(np.r_[-1, last_a]), np.diff(np.r_[-1, last_b])
        place_a = np.arange(len(a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(np.cumsum(size_a), size_b)
        wide = max(p.of_a.digits.shape[1], p.of_b.digits.shape[1])
        text = np.zeros((len(a) + len(b), wide), np.uint8)
        for ids, place, table, last, mark in ((a, place_a, p.of_a, last_a, 124), (b, place_b, p.of_b, last_b, 59)):
            part = table.digits[ids]
            part[:, -1] = 44
            part[last, -1] = mark
            text[place, wide - part.shape[1]:] = part
        ends = np.cumsum((text != 0).sum(1))
        out = memoryview(text[text != 0])
        stop = np.r_[0, ends][np.cumsum(self.n_a + self.n_b)]
        begin = np.r_[0, stop[:-1]]
        self.sha = ["" if e == s else hashlib.sha256(out[s:e - 1]).hexdigest() for s, e in zip(begin.tolist(), stop.tolist(), strict=True)]


def planes(key: np.ndarray, count: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Bitmaps of the pairs of sorted ``key = pair * docs + document`` with the number of links:
    the pairs, documents and links by popcount, and the stored bitmaps."""
    of, doc = key // docs, key % docs
    pairs, index = np.unique(of, return_inverse=True)
    n_docs, n_links = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    where, value, pair_at, plane = [], [], [], []
    digits = int(count.max(initial=0)).bit_length()
    for k in range(-1, digits):  # -1: the OR of all planes, only counted
        has = np.ones(len(key), bool) if k < 0 else (count >> k & 1).astype(bool)
        slot = index[has] * (docs // 8 + 1) + (doc[has] >> 3)
        slots, first = np.unique(slot, return_index=True)
        byte = np.bitwise_or.reduceat(np.left_shift(1, doc[has] & 7), first) if len(first) else first
        own = slots // (docs // 8 + 1)
        bits = np.bincount(own, weights=_BITS[byte], minlength=len(pairs)).astype(np.int64)
        if k < 0:
            n_docs = bits
            continue
        n_links += bits << k
        where.append(slots % (docs // 8 + 1))
        value.append(byte)
        pair_at.append(own)
        plane.append(np.full(len(own), k))
    if not len(pairs):
        return pairs, n_docs, n_links, []
    where, value, pair_at, plane = (np.concatenate(x) for x in (where, value, pair_at, plane))
    order = np.lexsort((plane, pair_at))
    cell = np.zeros((len(order), 4), np.uint8)  # plane, place (two bytes), byte
    cell[:, 0], cell[:, 1], cell[:, 2], cell[:, 3] = plane[order], where[order] & 255, where[order] >> 8, value[order]
    ends = np.cumsum(np.bincount(pair_at, minlength=len(pairs))) * 4
    raw = cell.tobytes()
    return pairs, n_docs, n_links, [raw[s:e] for s, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]


def scored(blob: np.ndarray, owner: np.ndarray, count: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of stored bitmaps (rows of four bytes, with the posting each belongs to): the sum of
    the counts over their links, and the number of links that are best."""
    bit = np.unpackbits(blob[:, 3:4], axis=1, bitorder="little")
    row, low = np.nonzero(bit)
    doc = (blob[row, 1].astype(np.int64) + (blob[row, 2].astype(np.int64) << 8)) * 8 + low
    links = np.left_shift(np.int64(1), blob[row, 0].astype(np.int64))
    size = int(doc.max(initial=-1)) + 1
    total, top = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(total, doc, links * count[owner[row]])
    np.add.at(top, doc, links * best[owner[row]])
    return np.flatnonzero(np.bincount(doc, minlength=size)), total, top


def _postings(doc_type: T.DataType) -> tuple[T.StructType, pa.Schema]:
    long = T.LongType()
    return schemas([("block", long), ("at", T.IntegerType()), ("doc", doc_type), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long),
                    ("sha", T.StringType()), ("a", T.IntegerType()), ("b", T.IntegerType()), ("n_docs", long), ("bitmap", T.BinaryType())])


def postings(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds, written together so that they agree whatever is computed again: documents
    (``block, at, doc, n_a, n_b, n_groups, n_links, sha``; a null) and the bitmaps of a block's
    pairs (``block, a, b, n_links, n_docs, bitmap``)."""
    schema, arrow = _postings(docs.schema[id_col].dataType)
    block_docs, block_bytes = BLOCK_DOCS, BLOCK_BYTES

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(byte_file, piece_file)
        ids = len(p.of_b.size)
        block = TaskContext.get().partitionId() << 32
        keys, counts, held, size = [], [], 0, 0

        def inverted() -> pa.RecordBatch:
            key, count = np.concatenate(keys), np.concatenate(counts)
            order = np.argsort(key, kind="stable")
            pairs, n_docs, n_links, bitmaps = planes(key[order], count[order], block_docs)
            n = len(pairs)
            none = pa.nulls(n)
            return batch_of(arrow, block=np.full(n, block), at=none, doc=none, n_a=none, n_b=none, n_groups=none, n_links=n_links, sha=none,
                            a=(pairs // ids).astype(np.int32), b=(pairs % ids).astype(np.int32), n_docs=n_docs, bitmap=bitmaps)

        for big in pieces(batches, 1):
            for at in range(0, big.num_rows, block_docs):
                part = big.slice(at, block_docs)
                if held and (held + part.num_rows > block_docs or size > block_bytes):
                    yield inverted()
                    block, keys, counts, held, size = block + 1, [], [], 0, 0
                x = Aligned(p, part.column(1))
                key, count = np.unique((x.a * ids + x.b) * block_docs + x.row + held, return_counts=True)
                keys.append(key)
                counts.append(count)
                n = part.num_rows
                none = pa.nulls(n)
                yield batch_of(arrow, block=np.full(n, block), at=np.arange(held, held + n, dtype=np.int32), doc=part.column(0), n_a=x.n_a, n_b=x.n_b,
                               n_groups=x.n_groups, n_links=x.n_links, sha=x.sha, a=none, b=none, n_docs=none, bitmap=none)
                held += n
                size += part.nbytes
        if held:
            yield inverted()

    return spread(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def pair_counts(post: DataFrame) -> DataFrame:
    """``a, b, n_links, n_docs, best`` of every pair of ids: links and documents that hold it, and
    whether no other pair of its B id has more links."""
    pairs = post.where("a is not null").groupBy("a", "b").agg(F.sum("n_links").alias("n_links"), F.sum("n_docs").alias("n_docs"))
    return pairs.withColumn("best", F.col("n_links") == F.max("n_links").over(Window.partitionBy("b")))


_SCORE, _SCORE_ARROW = schemas([("block", T.LongType()), ("at", T.IntegerType()), ("n_best", T.LongType()), ("count_sum", T.LongType())])


def _scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings ``block, bitmap, n_links, best`` in any order; sums of what is met, by document."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column(0).to_numpy()
        blob, offsets = flat(batch.column(1))
        blob = blob.reshape(-1, 4)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets) // 4)
        count, best = batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
        for one in np.unique(block):
            mine = block[owner] == one
            at, total, top = scored(blob[mine], owner[mine], count, best)
            yield batch_of(_SCORE_ARROW, block=np.full(len(at), one), at=at.astype(np.int32), n_best=top[at], count_sum=total[at])


def align(docs: DataFrame, byte_file: str, piece_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A encodes a space and the text, B the text, to which it adds that space. Where both cut the same
    byte a group ends; groups_sha256 is of ``a1,a2|b1;a3|b2,b3``. n_links counts the pairs of
    overlapping tokens, count_sum adds up the links that their pairs of ids have in the whole table,
    n_best counts the links whose pair has most of its B id's (ties included). Null and empty texts,
    and those whose tokens do not spell them, have zeros and an empty groups_sha256. Repeated rows
    and shared ids count as often as they come. Other columns are not read.
    """
    post = stored(postings(docs, byte_file, piece_file, id_col, text_col), "postings")
    counts = pair_counts(post).select("a", "b", F.col("n_links").alias("count"), "best")
    found = (post.where("a is not null").select("block", "a", "b", "bitmap").join(counts, ["a", "b"])
             .repartition("block", F.pmod(F.xxhash64("a", "b"), F.lit(8))).sortWithinPartitions("block").select("block", "bitmap", "count", "best"))
    sums = found.mapInArrow(_scores, _SCORE).groupBy("block", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return post.where("a is null").join(sums, ["block", "at"], "left").select(
        F.col("doc").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"),
        F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), F.col("sha").alias("groups_sha256"))
