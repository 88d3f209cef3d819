import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from recoup.llm import packing, rans, tokens

from .conftest import ROWS

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


def library(name, text, plain=False):
    """Ids of a tokenizer of its own, as the library loads it."""
    from tokenizers import Tokenizer

    if (name, plain) not in LOADED:
        LOADED[name, plain] = Tokenizer.from_file(tokens.vocabulary(name))
        if plain:
            LOADED[name, plain].encode_special_tokens = True
    return np.array(LOADED[name, plain].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


LOADED = {}


@pytest.mark.parametrize("plain", [False, True])
@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_chunks_give_the_library_s_ids(name, spaced, plain):
    e = tokens.Encoder(tokens.vocabulary(name), spaced, plain)

    @settings(max_examples=500, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("abAB  \n\n.,!?'\"-_*&12é日ŉİıΣſ½\x01\x00\t\r ́"), st.characters(exclude_categories=["Cs"])), max_size=40))
    def same(text):
        assert e.encode(text) == library(name, text, plain)

    same()
    for text in ["it's. don't, I'll.'s we've", "a<|endoftext|>b <|endoftext|>", "a <|endoftext|> b", "x <|STARTOFTEXT|><|startoftext|>\n.", "Hello World.\nNew line, here!!! ***",
                 " led by a space", "  two", " ", " \n", "x" * 3000, "word... word.' 3.14, 5% (a) [b]."]:
        assert e.encode(text) == library(name, text, plain)


def test_slices_of_a_column():
    texts = [None, "", " a b", "c <|endoftext|> d", "e  f", "g\nh", "i"] * 3
    col = pa.array(texts, pa.large_string())
    for name, spaced in FILES:
        e = tokens.Encoder(tokens.vocabulary(name), spaced)
        for at in range(0, len(texts), 4):
            ids, first = e.column(col.slice(at, 5))
            assert [ids[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)] == [library(name, t or "") for t in texts[at:at + 5]]


def test_generations_keep_ids(monkeypatch):
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), True)
    monkeypatch.setattr(tokens, "KEPT_CHUNKS", 5)
    text = " ".join(f"word{i % 9} and again." for i in range(60))
    assert e.encode(text) == e.whole(text) and len(e.kept) <= 5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70_000), max_size=3000), st.integers(0, 2000))
def test_blocks_round_trip(ids, more):
    ids = np.array(ids + [3] * more, np.int64)
    table = rans.Table(np.bincount(ids, minlength=4))
    block = table.encode(ids)
    assert table.decode(block).tolist() == ids.tolist()


def test_checkpoints_decode_alone_and_damage_is_seen():
    rng = np.random.default_rng(1)
    ids = (rng.pareto(1.0, rans.LANES * rans.CHECKPOINT_STEPS * 2 + 77) * 20).astype(np.int64).clip(0, 50_000)
    table = rans.Table(np.bincount(ids))
    block = table.encode(ids)
    per = rans.LANES * rans.CHECKPOINT_STEPS
    assert table.part(block, 1).tolist() == ids[per:2 * per].tolist()
    assert table.part(block, 2)[:77].tolist() == ids[2 * per:].tolist()
    bits = -(np.bincount(ids) / len(ids))[np.bincount(ids) > 0]
    entropy = float((bits * np.log2(-bits)).sum()) * len(ids) / 8
    assert len(block) < 1.1 * entropy + 4 * 8 * rans.LANES
    for at in (len(block) - 3, 40):
        broken = bytearray(block)
        broken[at] ^= 16
        with pytest.raises(ValueError, match="damaged"):
            table.decode(bytes(broken))
    with pytest.raises(ValueError, match="missing"):
        table.encode(np.array([int(np.flatnonzero(np.bincount(ids) == 0)[0])]))


def test_wide_vocabularies_keep_their_ids():
    assert rans.id_type(1 << 16) == "<u2" and rans.id_type((1 << 16) + 1) == "<u4"


@pytest.mark.parametrize(("name", "spaced"), FILES)
def test_a_column_is_its_rows(name, spaced):
    e = tokens.Encoder(tokens.vocabulary(name), spaced)
    texts = ["One two, three.", None, "", " lead", "tail ", "a  b", "x\ty", "wide\u00a0space", "thin\u2009space", "plain again, and again.", "\n", "end\nline.\nmore", "é, è. ç", "A.B,C d'e's 'tis"] * 2
    ids, first = e.column(pa.array(texts, pa.string()))
    for r, t in enumerate(texts):
        assert ids[first[r]:first[r + 1]].tobytes() == (e.whole(t) if t else b"")


def test_documents_read_back(spark, awkward, nothing, tmp_path):
    path = tokens.vocabulary("byte_bpe_50k.json")
    e = tokens.Encoder(path, True)
    rows = rans.round_trip(awkward, path, str(tmp_path / "blocks")).collect()
    docs = sorted(((d, e.whole(t) if t else b"") for d, t, _ in ROWS), key=lambda r: (r[0] is not None, r))
    at, want = 0, []
    for d, ids in docs:
        ids += np.array([0], "<u4").tobytes()
        want.append((d, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=lambda r: r[1])
    assert got == want
    assert rans.round_trip(nothing, path, str(tmp_path / "none")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 256), min_size=1, max_size=300))
def test_differencing(sizes):
    at, windows = packing.pack(sizes)
    sums = np.bincount(at, weights=sizes, minlength=windows)
    assert len(at) == len(sizes) and sums.sum() == sum(sizes) and sums.max() <= packing.CAPACITY
    own, totals = packing.differencing(sizes, 7)
    assert np.bincount(own, weights=sizes, minlength=7).tolist() == totals.tolist()
    assert totals.max() - totals.min() <= max(sizes)


def test_the_window_count_rises():
    at, windows = packing.pack([1500, 1500, 1000])  # 4000 ids would fit into two windows by number
    assert windows == 3 and len(set(at.tolist())) == 3


def test_packed_documents(spark, awkward, nothing):
    path = tokens.vocabulary("word_bpe_49k.json")
    e = tokens.Encoder(path, False)
    rows = packing.pack_documents(awkward, path).collect()
    place, pieces = {}, {}
    for r in rows:
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for at in place.values():
        end = 0
        for offset, length in sorted(at):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    for d in {r[0] for r in ROWS}:
        own = [(e.whole(t) if t else b"") + np.array([1], "<u4").tobytes() for x, t, _ in ROWS if x == d]
        assert sorted(sum(len(ids) for _, ids, _ in pieces[d]) for _ in [0]) == [sum(map(len, own))]
        if len(own) == 1:
            assert b"".join(ids for _, ids, _ in sorted(pieces[d])) == own[0] and {n for *_, n in pieces[d]} == {len(own[0]) // 4}
    assert sum(r["length"] for r in rows) / (len(place) * packing.CAPACITY) > 0.9
    assert packing.pack_documents(nothing, path).count() == 0
