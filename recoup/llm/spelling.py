"""Spelling variants: words one edit apart, found by finite-state composition.

The vocabulary is an acceptor whose first symbol names an initial-state partition: the words of one
length (and of the next) that share what an edit in a given range of places cannot touch. In each
task the acceptor is minimised (states with equal right languages become one), composed with a
transducer that copies symbols and makes exactly one edit, and with the acceptor again. Before the
edit both acceptors are in the same state, after it in a pair of states that is followed on common
symbols; pairs of states that accept nothing together are cut off first, so the accepted paths, read
off with the number of words below every arc, are the pairs of near words and nothing else.

A pair of words belongs to one partition: the range that holds the length of its longest common
prefix. A partition of more than ``LIMIT`` words, or with more than ``WIDE`` free places, is split
in the next round into the lower and the upper half of its range, down to a single place.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.session import spread, stored

#: Words of a partition that one task composes; a partition of one place has at most 3,900.
LIMIT = 20_000
#: Free places of a word in a partition.
WIDE = 64
#: Words and places of the acceptor that a task builds at a time, and pairs it reads off at a time.
WORDS, CELLS, PAIRS = 60_000, 6_000_000, 2_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, shortest: int = 7, least: int = 2) -> DataFrame:
    """``word, n``: runs of Latin letters (A-Z lower-cased) of at least ``shortest`` code points that
    occur ``least`` times or more in the whole table. If ``noise`` divides the crc32 of
    ``<id>:<run>``, the code point at crc32 modulo length is left out first. A null text has no
    words, the id of a null id is the empty text."""
    text = F.translate(F.col(text_col), _UPPER, _LOWER)
    runs = spread(docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("d"), text.alias("t"))).select(
        "d", F.explode(F.regexp_extract_all("t", F.lit(f"[a-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("d", F.lit(":"), F.col("run")).cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# ---- partitions

_KEY = ["len", "lo", "hi", "k1", "k2"]


def _placed(words: DataFrame, ranges: Column) -> DataFrame:
    """The words in the partitions of the given ranges ``(len, lo, hi)``: len is the length of the
    shorter word of a pair, lo to hi (not included) the length of the common prefix."""
    at = words.withColumn("r", F.explode(ranges)).select("word", "n", "r.*")
    tail = F.greatest(F.lit(0), F.col("len") - F.col("hi"))
    fixed = F.concat(F.substring("word", F.lit(1), F.col("lo")), F.lit(" "), F.substring("word", F.length("word") - tail + 1, tail))
    middle = F.substring("word", F.col("lo") + 1, F.length("word") - F.col("lo") - tail)
    return at.select("word", "n", "len", "lo", "hi", F.xxhash64(fixed).alias("k1"), F.xxhash64(F.lit(7), fixed).alias("k2"), middle.alias("middle"))


def _range(length: Column, lo: Column, hi: Column) -> Column:
    return F.struct(length.cast("int").alias("len"), lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))


def _halves(length: Column) -> list[Column]:
    mid = F.floor(length / 2)
    return [_range(length, F.lit(0), mid), _range(length, mid, length + 1)]


def near_words(vocab: DataFrame, shortest: int = 7) -> DataFrame:
    """``word, n_near, best_n, best``: for every word with a near one how many there are, and the
    one of largest n (ties: the smallest in code-point order). Pairs are never written."""
    n = F.length("word")
    roles = F.when(n > shortest, F.array(*_halves(n), *_halves(n - 1))).otherwise(F.array(*_halves(n)))
    rest: DataFrame | None = _placed(vocab, roles)
    found = None
    while rest is not None:
        rest = stored(rest, "placed")
        sized = (rest.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size"), F.max((F.length("word") == F.col("len")).cast("int")).alias("short"))
                 .where("size > 1 and short = 1").withColumn("wide", F.col("hi") - F.col("lo") > WIDE)
                 .withColumn("large", (F.col("hi") - F.col("lo") > 1) & (F.col("wide") | (F.col("size") > LIMIT))))
        sized = stored(sized.select(*_KEY, "large"), "sizes")
        small = rest.join(sized.where("not large"), _KEY, "left_semi").repartition(*_KEY).sortWithinPartitions(*_KEY, "middle")
        out = stored(small.select(*_KEY, "middle", "word", "n").mapInArrow(_compose, _NEAR), "near")
        found = out if found is None else found.unionByName(out)
        if sized.where("large").limit(1).count():
            mid = F.floor((F.col("lo") + F.col("hi")) / 2)
            large = rest.join(sized.where("large"), _KEY, "left_semi").select("word", "n", F.array(
                _range(F.col("len"), F.col("lo"), mid), _range(F.col("len"), mid, F.col("hi"))).alias("halves"))
            rest = _placed(large, F.col("halves")).dropDuplicates(["word", *_KEY])
        else:
            rest = None
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


# ---- the acceptor and its composition, in one task

_NEAR, _NEAR_ARROW = schemas([("word", T.StringType()), ("n_near", T.LongType()), ("best_n", T.LongType()), ("best", T.StringType())])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@dataclass
class Acceptor:
    """A minimised acceptor. Arcs are sorted by (state, symbol); an arc's ``offset`` is the number of
    the state's words that come before those behind it. ``first, state`` are the prefixes of the
    words: the first word with the prefix, and the state it leads to."""

    final: np.ndarray
    words: np.ndarray
    arc: np.ndarray  # state * 256 + symbol
    to: np.ndarray
    offset: np.ndarray
    begin: np.ndarray  # first arc of every state, and the end
    first: np.ndarray
    state: np.ndarray


def minimised(group: np.ndarray, cells: np.ndarray, size: np.ndarray) -> Acceptor:
    """The acceptor of sorted words ``cells`` (a row of symbols each, ``size`` of them), whose first
    symbol is their group: one initial arc for every group, made without looking inside others."""
    rows, width = cells.shape
    same = np.zeros(rows, np.int64)  # length of the prefix shared with the row before
    if rows > 1:
        differ = np.ones((rows - 1, width + 1), bool)
        differ[:, :width] = cells[1:] != cells[:-1]
        same[1:] = np.minimum(np.minimum(differ.argmax(1), size[1:]), size[:-1])
        same[1:][group[1:] != group[:-1]] = -1
    same[:1] = -1
    first, stop, depth_at = [], [], [0]
    for d in range(width + 1):
        at = np.flatnonzero((same < d) & (size >= d))
        outside = np.flatnonzero((same < d) | (size < d))  # where the words of a prefix end
        nxt = np.searchsorted(outside, at, "right")
        first.append(at)
        stop.append(np.r_[outside, rows][nxt] if len(at) else at)
        depth_at.append(depth_at[-1] + len(at))
    signs = [np.zeros(0, np.uint64)] * (width + 1)
    parents, symbols, children = [], [], []
    with np.errstate(over="ignore"):
        for d in range(width, -1, -1):
            sign = np.where(size[first[d]] == d, np.uint64(0x9E3779B97F4A7C15), np.uint64(1))
            if d < width and len(first[d + 1]):
                up = np.searchsorted(first[d], first[d + 1], "right") - 1
                symbol = cells[first[d + 1], d]
                np.add.at(sign, up, _mixed(signs[d + 1] * np.uint64(0xD6E8FEB86659FD93) + symbol.astype(np.uint64) + np.uint64(1)))
                parents.append(depth_at[d] + up)
                symbols.append(symbol.astype(np.int64))
                children.append(depth_at[d + 1] + np.arange(len(up)))
            signs[d] = _mixed(sign)
    first_all, stop_all = np.concatenate(first), np.concatenate(stop)
    depth = np.repeat(np.arange(width + 1), np.diff(depth_at))
    _, one, state = np.unique(np.concatenate(signs), return_index=True, return_inverse=True)
    final = size[first_all[one]] == depth[one]
    none = np.zeros(0, np.int64)
    parent, symbol, child = (np.concatenate(x) if x else none for x in (parents, symbols, children))
    is_one = np.zeros(len(state), bool)
    is_one[one] = True
    keep = is_one[parent]
    parent, symbol, child = parent[keep], symbol[keep], child[keep]
    code = state[parent] * 256 + symbol
    order = np.argsort(code, kind="stable")
    code, parent, child = code[order], parent[order], child[order]
    return Acceptor(final, (stop_all - first_all)[one], code, state[child], first_all[child] - first_all[parent],
                    np.searchsorted(code, np.arange(len(one) + 1) * 256), first_all, state)


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every i, ``count[i]`` entries: i, and the entry's number."""
    i = np.repeat(np.arange(len(count)), count)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


@dataclass
class Composed:
    """States after the edit that accept something together, and the edits that lead to them."""

    left: np.ndarray
    right: np.ndarray
    accepted: np.ndarray  # word pairs below a state
    begin: np.ndarray  # first step of every state, and the end
    to: np.ndarray
    off_left: np.ndarray
    off_right: np.ndarray
    edit_begin: np.ndarray  # first edit of every acceptor state, and the end
    edit_to: np.ndarray
    edit_left: np.ndarray
    edit_right: np.ndarray


def composed(a: Acceptor) -> Composed:
    """The acceptor, the one-edit transducer and the acceptor, without states that accept nothing.
    The left side is the larger word of a substitution and the longer one of a deletion."""
    n = len(a.final)
    degree = np.diff(a.begin)
    source = np.repeat(np.arange(n), degree)
    arcs = np.arange(len(a.to))
    i, k = _each(arcs - a.begin[source])  # every arc with all earlier ones of its state
    j = a.begin[source[i]] + k
    edit_from = np.concatenate([source[i], source])
    edit_l, edit_r = np.concatenate([a.to[i], a.to]), np.concatenate([a.to[j], source])
    edit_off_l = np.concatenate([a.offset[i], a.offset])
    edit_off_r = np.concatenate([a.offset[j], np.zeros(len(arcs), np.int64)])
    known = np.unique(edit_l * n + edit_r)
    front = known
    steps = []
    while len(front):
        p, q = front // n, front % n
        go = p != q
        row, k = _each(np.where(go, degree[p], 0))
        one = a.begin[p[row]] + k
        want = q[row] * 256 + a.arc[one] % 256
        other = np.searchsorted(a.arc, want)
        hit = (other < len(a.arc)) & (a.arc[np.minimum(other, len(a.arc) - 1)] == want) if len(a.arc) else np.zeros(0, bool)
        row, one, other = row[hit], one[hit], other[hit]
        to = a.to[one] * n + a.to[other]
        steps.append((front[row], to, a.offset[one], a.offset[other]))
        front = np.setdiff1d(to, known)
        known = np.union1d(known, front)
    src, dst, off_l, off_r = (np.concatenate([s[c] for s in steps]) if steps else np.zeros(0, np.int64) for c in range(4))
    src, dst = np.searchsorted(known, src), np.searchsorted(known, dst)
    p, q = known // n, known % n
    accepted = np.where(p == q, a.words[p], (a.final[p] & a.final[q]).astype(np.int64)) if len(known) else known
    # a step leads to a state with fewer symbols left: sums settle after as many rounds as symbols
    order = np.argsort(src, kind="stable")
    src, dst, off_l, off_r = src[order], dst[order], off_l[order], off_r[order]
    own = accepted.copy()
    while len(src):
        now = own.copy()
        np.add.at(now, src, accepted[dst])
        if np.array_equal(now, accepted):
            break
        accepted = now
    keep = accepted[dst] > 0
    src, dst, off_l, off_r = src[keep], dst[keep], off_l[keep], off_r[keep]
    to = np.searchsorted(known, edit_l * n + edit_r)
    live = accepted[to] > 0 if len(to) else np.zeros(0, bool)
    edit_from, to, edit_off_l, edit_off_r = edit_from[live], to[live], edit_off_l[live], edit_off_r[live]
    order = np.argsort(edit_from, kind="stable")
    return Composed(p, q, accepted, np.searchsorted(src, np.arange(len(known) + 1)), dst, off_l, off_r,
                    np.searchsorted(edit_from[order], np.arange(n + 1)), to[order], edit_off_l[order], edit_off_r[order])


def accepted_pairs(a: Acceptor, c: Composed) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the accepted pairs, about ``PAIRS`` at a time. A pair of words with a deletion
    inside a run of equal symbols is accepted on several paths and comes several times."""
    edits = np.diff(c.edit_begin)
    through = np.concatenate([[0], np.cumsum(c.accepted[c.edit_to])])
    total = np.cumsum((through[c.edit_begin[1:]] - through[c.edit_begin[:-1]])[a.state])
    at = 0
    while at < len(a.state):
        base = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, base + PAIRS, "right")))
        if total[stop - 1] > base:
            node = np.arange(at, stop)
            row, k = _each(edits[a.state[node]])
            edit = c.edit_begin[a.state[node[row]]] + k
            left, right, state = a.first[node[row]] + c.edit_left[edit], a.first[node[row]] + c.edit_right[edit], c.edit_to[edit]
            ls, rs = [], []
            while len(state):
                same = c.left[state] == c.right[state]
                row, k = _each(np.where(same, c.accepted[state], (a.final[c.left[state]] & a.final[c.right[state]]).astype(np.int64)))
                ls.append(left[row] + k)
                rs.append(right[row] + k)
                row, k = _each(np.where(same, 0, np.diff(c.begin)[state]))
                step = c.begin[state[row]] + k
                left, right, state = left[row] + c.off_left[step], right[row] + c.off_right[step], c.to[step]
            yield np.concatenate(ls), np.concatenate(rs)
        at = stop


def _answers(key: list[np.ndarray], middle: list[str], word: list[str], n: np.ndarray) -> pa.RecordBatch:
    """Near words of whole partitions, sorted by key and middle."""
    rows = len(word)
    new = np.zeros(rows, bool)
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    group = np.cumsum(new)
    size = np.fromiter(map(len, middle), np.int64, rows)
    width = int(size.max(initial=0))
    cells = np.zeros((rows, width), np.uint8)  # letters up to U+00FF, none of them zero
    cells[np.arange(width) < size[:, None]] = np.frombuffer("".join(middle).encode("latin-1"), np.uint8)
    a = minimised(group, cells, size)
    length, hi = key[0], key[2]
    word_size = np.fromiter(map(len, word), np.int64, rows)
    order = np.lexsort((np.argsort(np.argsort(np.array(word, object), kind="stable"), kind="stable"), -n))
    rank = np.empty(rows, np.int64)
    rank[order] = np.arange(rows)
    near, best = np.zeros(rows, np.int64), np.full(rows, rows, np.int64)
    for left, right in accepted_pairs(a, composed(a)):
        longer = word_size[left] > word_size[right]
        keep = longer | (word_size[left] == length[left])
        # a common prefix of the whole middle belongs to another range, unless nothing follows it
        ends = longer & (hi[left] <= length[left])
        at = np.flatnonzero(ends)
        keep[at] &= ((cells[left[at]] != cells[right[at]]) & (np.arange(width) < size[right[at], None])).any(1)
        code = np.unique(left[keep] * rows + right[keep])
        left, right = code // rows, code % rows
        for x, y in ((left, right), (right, left)):
            near += np.bincount(x, minlength=rows)
            np.minimum.at(best, x, rank[y])
    at = np.flatnonzero(near)
    of = order[best[at]]
    return batch_of(_NEAR_ARROW, word=[word[i] for i in at.tolist()], n_near=near[at], best_n=n[of], best=[word[i] for i in of.tolist()])


def _compose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and middle; holds whole partitions of ``WORDS`` words in all."""
    held: pa.Table | None = None

    def answer(part: pa.Table) -> pa.RecordBatch:
        cols = part.combine_chunks()
        return _answers([cols.column(k).to_numpy() for k in range(5)], cols.column(5).to_pylist(), cols.column(6).to_pylist(), cols.column(7).to_numpy())

    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part])
        k = [held.column(c).to_numpy() for c in range(5)]
        new = np.zeros(held.num_rows, bool)
        for c in k:
            new[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(new)  # the last partition may go on
        cells = np.cumsum(np.minimum(k[2] - k[1], k[0]) + 2)
        at = 0
        while len(cuts) and cuts[-1] > at and (held.num_rows - at > WORDS or cells[-1] - (cells[at - 1] if at else 0) > CELLS):
            base = cells[at - 1] if at else 0
            upto = cuts[(cuts > at) & (cuts - at <= WORDS) & (cells[cuts - 1] - base <= CELLS)]
            stop = int(upto[-1] if len(upto) else cuts[cuts > at][0])
            yield answer(held.slice(at, stop - at))
            at = stop
        held = held.slice(at)
    if held is not None and held.num_rows:
        yield answer(held)


# ---- forms

def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: the end of the chain of forms. The steps double each round;
    n grows tenfold along a chain, so there are few rounds."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("w"), F.col("root").alias("r"))
        now = stored(now.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        if not now.where("moved").limit(1).count():
            return now.select("word", "root")
        now = now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 31, shortest: int = 7,
                      least: int = 2, factor: int = 10) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the vocabulary of ``docs``.

    Two words are near if they differ by one inserted, deleted or replaced code point. A word's form
    is its near word of largest n (ties: the smallest in code-point order) if that n is at least
    ``factor`` times its own, else null; its root is the end of the chain of forms, or itself.
    Repeated rows count as often as they come; null and empty texts have no words; an empty table
    gives no rows. Other columns are not read.
    """
    vocab = stored(vocabulary(docs, id_col, text_col, noise, shortest, least), "vocabulary")
    near = near_words(vocab, shortest).withColumnRenamed("word", "w")
    strong = F.col("best_n") >= factor * F.col("n")
    known = stored(vocab.join(near, F.col("word") == F.col("w"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(strong, F.col("best")).alias("form"),
        F.when(strong, F.col("best_n")).alias("form_n")), "forms")
    root = roots(known.where("form is not null").select("word", "form")).withColumnRenamed("word", "w")
    return known.join(root, F.col("word") == F.col("w"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
