"""One query per operator, with production parameters, over whole tables."""
from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recoup.llm import (
    alignment, decontam, extract, langid, licenses, lines, packing, rans, repeats, simhash, spelling, toxicity, vectors,
)
from recoup.llm.tokens import vocabulary
from recoup.session import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs.select("doc_id", "text"), langid.fit(docs)).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op3_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), decontam.contaminated().alias("contaminated"))


def op5_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"blocks-{uuid.uuid4().hex}")
    return rans.round_trip(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), folder, end=0)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.with_sums(packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end=1)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.dedup_substrings(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_vectors": op3_vectors,
    "op4_decontamination": op4_decontamination,
    "op5_token_blocks": op5_token_blocks,
    "op6_simhash": op6_simhash,
    "op7_licenses": op7_licenses,
    "op8_lines": op8_lines,
    "op9_packing": op9_packing,
    "op10_extraction": op10_extraction,
    "op11_alignment": op11_alignment,
    "op12_spelling": op12_spelling,
    "op13_repeats": op13_repeats,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontamination": f"""
WITH item AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS t, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS gram
       FROM item, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS u(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, t, i, array_to_string(list_slice(w, i, i + t - 1), ' ') AS gram
       FROM doc, (SELECT DISTINCT t FROM iw) AS c, unnest(range(1, len(w) - t + 2)) AS u(i)),
hit AS (SELECT dw.doc_id, dw.i, dw.t, iw.item_id FROM dw JOIN iw ON dw.gram = iw.gram AND dw.t = iw.t),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM hit, unnest(range(i, i + t)) AS u(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(named.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(cover.n, 0) > 0 AND 20 * coalesce(cover.n, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN cover ON cover.doc_id = doc.doc_id LEFT JOIN named ON named.doc_id = doc.doc_id""",
    # crc32 byte by byte from the table of its polynomial
    "op12_spelling": r"""
WITH RECURSIVE tab AS MATERIALIZED (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
run AS MATERIALIZED (SELECT doc_id, run, count(*) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY ALL),
raw AS (SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM run),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM raw, tab),
vocab AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
part AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM vocab, unnest(range(1, length(word) + 1)) AS u(i)),
pair AS MATERIALIZED (
  SELECT DISTINCT x.word, y.word AS other FROM part AS x JOIN part AS y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT part.word, v.word FROM part JOIN vocab AS v ON v.word = a || b
  UNION SELECT v.word, part.word FROM part JOIN vocab AS v ON v.word = a || b),
near AS (SELECT pair.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS best, max(v.n) AS best_n FROM pair JOIN vocab AS v ON v.word = other GROUP BY pair.word),
known AS MATERIALIZED (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM vocab AS v LEFT JOIN near ON near.word = v.word),
chain AS (SELECT word, word AS root, 0 AS step FROM known UNION ALL SELECT chain.word, known.form, step + 1 FROM chain JOIN known ON known.word = chain.root WHERE known.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT known.word, n, n_near, form, form_n, root FROM known JOIN ends ON ends.word = known.word""",
    "op13_repeats": r"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, doc_id, i, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS g FROM doc, unnest(range(1, len(w) - 48)) AS u(i)),
least AS (SELECT g, min(doc_id) AS first FROM win GROUP BY g),
cover AS (SELECT DISTINCT r, p FROM win JOIN least ON least.g = win.g, unnest(range(i, i + 50)) AS u(p) WHERE first < doc_id),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM cover GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM doc LEFT JOIN gone ON gone.r = doc.r""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
