"""Rows that share an id, or have none, each by its own text."""
import pytest

from recoup.llm import decontam, langid, licenses, lines, rans, tokens

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"
ROWS = [(1, "the first line stands here alone today\nanother line"), (5, "the first line stands here alone today\nother words follow it"),
        (5, "keep me please i am unique yes\nthe first line stands here alone today"), (7, f"x {ITEM} y"), (7, "one two three four"), (None, ITEM), (None, "nothing of it"),
        (9, "MIT License and the GNU General Public License"), (9, "plain"), (9, "plain")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)


def test_lines(docs):
    got = sorted([(r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(docs).collect()], key=str)
    kept = [t for d, t, _ in got if d == 5]
    assert sorted(kept) == ["keep me please i am unique yes", "other words follow it"]
    assert [n for d, _, n in got if d in (1, None)] == [0] * 3
    assert sorted(n for d, _, n in got if d == 7) == [0, 1]  # one holds the line of the null id, which comes first
    assert sorted(t for d, t, _ in got if d == 9) == sorted(["MIT License and the GNU General Public License", "plain", "plain"])


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(3, ITEM)], "item_id long, text string")
    got = sorted([(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontam.decontaminate(docs, items).collect()], key=str)
    assert len(got) == len(ROWS)
    assert [x for x in got if x[0] in (7, None)] == sorted([(7, 16, 14, (3,)), (7, 4, 0, ()), (None, 14, 14, (3,)), (None, 3, 0, ())], key=str)


def test_licenses(docs):
    got = sorted((r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.scan(docs).where("doc_id = 9").collect())
    assert got == [(1, 0, ""), (1, 0, ""), (8, 2, "gpl,mit")]


def test_license_votes_count_once(spark):
    texts = ["all rights all rights", "creative commons creative commons", "all rights all rights all rights all rights reserved", "rights reserved all rights", "all rights reserved"]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(5)] == [("", 0.0), ("", 0.0), ("all-rights-reserved", 1.0), ("", 0.0), ("all-rights-reserved", 1.0)]


def test_number_signs_are_no_letters(spark):
    model = {"aa": b"some words ", "bb": b"other things "}
    df = spark.createDataFrame([(1, "½ ²"), (2, "Ⅷ 12 ①"), (3, "五"), (4, "a½"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    assert got[1] == got[2] == got[5] == "und" and got[3] != "und" and got[4] != "und"


def test_a_folder_of_blocks_is_enough(spark, docs, tmp_path):
    folder = str(tmp_path / "blocks")
    written = rans.round_trip(docs, tokens.vocabulary("byte_bpe_50k.json"), folder)
    again = rans.read_blocks(spark.newSession(), folder)
    assert sorted(map(str, map(tuple, written.collect()))) == sorted(map(str, map(tuple, again.collect())))
    counts = rans.read_table(spark, folder).counts
    assert counts[0] == len(ROWS) and counts.sum() == sum(r["n_tokens"] for r in again.collect())
