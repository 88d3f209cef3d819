"""Awkward inputs that every operator has to bear."""
import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of a very long text" for i in range(30_000))
COPY = "The quick brown fox jumps over the lazy dog while seven wizards quietly pack my box with liquor jugs.\nA second line of the same document follows here."

ROWS = [
    (1, COPY, "en"), (2, COPY, "en"), (2, COPY, "en"), (3, None, "en"), (4, "", None), (5, " \n\t ", "de"), (6, "!!! ??? 12", "fr"),
    (7, LONG, "en"), (8, COPY.replace("lazy", "idle"), "en"), (None, COPY, "en"), (9, None, None), (10, "x", "es"),
    (11, "Ünïcödé ñandú çà et là — naïve façade 東京 \U0001f600", "fr"),
]

#: Names that the operators use inside.
CLASHING = ["doc", "text_", "hash", "t", "at", "fp", "a", "b", "score", "n", "line", "size", "sig", "prefix", "token", "component_id", "node",
            "n_words", "n_lines", "lang_pred", "rejected", "__text", "gone", "first", "hit", "n_chars", "ids", "pos", "pair", "label", "w"]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
