"""Language identification by compression.

Each language has a raw-content zstandard dictionary: the most frequent words of its training
texts, the commonest last, where matches are cheapest. A text is reduced to lower-case letters,
compressed in blocks with each dictionary, and takes the language of the smallest sum. A text whose
two smallest sums are too close is rejected.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recoup.llm.arrow import batch_of, schemas
from recoup.llm.text import pieces
from recoup.session import spread

#: Expected training texts of a language; beyond that they are thinned by a hash of their id.
SAMPLE = 4000
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 8 << 10
LEVEL = 6
#: Smallest relative distance of the two best sums that counts as a decision.
MARGIN = 0.001
UNKNOWN = "und"
#: Texts of fewer bytes are measured as the sum over their rotations by a word (at most ROTATIONS),
#: since a size in whole bytes is too coarse for them.
SHORT_BYTES = 256
ROTATIONS = 12

_GAPS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The words of letters in lower case, one space between them; number signs that are no letters
    (superscripts, fractions, Roman numerals) part words like digits."""
    if not text:
        return b""
    low = _GAPS.sub(" ", text.lower()).strip()
    if not low.isascii():
        signs = {ord(c): " " for c in set(low) if c != " " and not c.isalpha()}
        if signs:
            low = " ".join(low.translate(signs).split())
    return low.encode()


def blocks(raw: bytes) -> list[bytes]:
    """What is compressed for a text: its blocks, or the rotations of a short one."""
    if len(raw) >= SHORT_BYTES:
        return [raw[a:a + BLOCK_BYTES] for a in range(0, len(raw), BLOCK_BYTES)]
    w = raw.split(b" ")
    return [b" ".join(w[k:] + w[:k]) for k in range(min(len(w), ROTATIONS))] if len(w) > 1 else [raw, raw + b" " + raw, b" " + raw + b" "]


def held_out(key: Column) -> Column:
    """Whether a row is held out of training: crc32 of its id as text modulo 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for every language, from rows that are not held out.

    Uses about SAMPLE texts of each language; null languages, ids and texts are left out. The result
    is at most DICTIONARY_BYTES a language.
    """
    known = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("doc").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc")))
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not size:
        return {}
    draw = F.pmod(F.xxhash64("doc"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, SAMPLE / n))])
    sample = known.where(draw < share[F.col("lang")]).select("lang", "text")
    schema, arrow = schemas([("lang", T.StringType()), ("word", T.StringType()), ("n", T.LongType())])

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            count: Counter = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                count.update((lang, w) for w in letters(text).decode().split())
            yield batch_of(arrow, lang=[k[0] for k in count], word=[k[1] for k in count], n=list(count.values()))

    words = sample.mapInArrow(counted, schema).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    upto = rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chosen = words.withColumn("bytes", F.sum(F.octet_length("word") + 1).over(upto)).where(F.col("bytes") <= DICTIONARY_BYTES)
    out = chosen.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w")).select("lang", F.array_join("w.word", " ").alias("d"))
    found = {r["lang"]: r["d"].encode() + b" " for r in out.collect()}
    return {lang: found.get(lang, b"") for lang in sorted(size)}


def predict(docs: DataFrame, model: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``lang_pred, score, rejected`` added (replacing such columns).

    lang_pred is a language of the model, ``und`` for null texts and texts without a letter (or
    if the model is empty). score is the margin 1 - best / second best, 0 for ``und``. rejected is
    true for ``und`` and for scores below MARGIN; with a single language nothing else is.
    Of equal sums the first language in alphabetical order wins, with score 0. Whole texts are
    compressed, in blocks; rows and ids may repeat.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*kept)
    at = kept.index(text_col)
    types = [(f.name, f.dataType) for f in docs.schema]
    schema, arrow = schemas([*types, ("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = {}
        for lang, content in model.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        def one(text: str | None) -> tuple[str, float, bool]:
            raw = letters(text)
            if not raw or not packers:
                return UNKNOWN, 0.0, True
            cut = blocks(raw)
            size = sorted((sum(len(p.compress(b)) for b in cut), lang) for lang, p in packers.items())
            if len(size) == 1:
                return size[0][1], 1.0, False
            score = 1 - size[0][0] / size[1][0]
            return size[0][1], score, score < MARGIN

        for part in pieces(batches, at):
            lang, score, rejected = zip(*map(one, part.column(at).to_pylist()), strict=True)
            added = dict(zip(kept, part.columns, strict=True))
            yield batch_of(arrow, **added, lang_pred=list(lang), score=list(score), rejected=list(rejected))

    return spread(docs).mapInArrow(run, schema)
