"""Whole texts to token ids with the ``tokenizers`` library, each distinct chunk encoded once per worker.

Both tokenizers first cut a text into words that never reach over the boundary before a space (a
space opens a new word), around a line break between two other characters, or between an ASCII
letter or digit and punctuation after it (an apostrophe aside, which may open a suffix). The texts
of a piece are cut there all at once, equal chunks are found by their hash, and the ids of each
distinct chunk are looked up; only chunks a worker has not met are encoded. Texts that hold white
space in any other form, or the text of an added token, are encoded in one piece. The lookup is bounded (two generations, so that
frequent chunks stay) and only ever holds what the library returned.
"""
from __future__ import annotations

import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recoup.llm.text import LOWER, flat, span_hash

#: Distinct chunks of a generation; a worker keeps two.
KEPT_CHUNKS = 300_000

_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_SPACE, _BREAK, _PLAIN, _CLOSE, _ODD, _LEAD = 1, 2, 3, 4, 5, 6


def _kinds() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    kind[:32] = _ODD
    kind[32], kind[10] = _SPACE, _BREAK
    kind[[b for b in range(128) if chr(b).isalnum()]] = _PLAIN
    kind[list(_CLOSING.encode())] = _CLOSE
    kind[[0xC2, 0xE1, 0xE2, 0xE3]] = _LEAD  # first bytes of the white space beyond ASCII
    return kind


_KIND = _kinds()

#: Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_SYMBOLS = {b: chr(256 + n) for n, b in enumerate(_HIDDEN)}

assert sys.byteorder == "little" and array("I").itemsize == 4  # the ids' bytes are taken as they are


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit integers.

    spaced: the space before a word belongs to the word (byte-level vocabularies); otherwise white
    space is dropped and the vocabulary is of lower case. plain: the texts of added tokens are
    ordinary text; otherwise they become their own ids, as the library does unless told.
    """

    def __init__(self, path: str, spaced: bool, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.kept = _Chunks(self)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def chunk(self, raw: bytes) -> bytes:
        text = raw.decode()
        base = text.rstrip(_CLOSING)
        if len(base) < len(text) and base[-1:].isalnum():
            return self.kept[base.encode()] + self.kept[text[len(base):].encode()]
        space = self.spaced and text[0] == " "
        word = text[1:] if space else text
        if word.isalpha() and (word.isascii() or max(word) < "\u0180" and "\u0130" not in word):  # one Latin word: the model alone
            if not self.spaced:
                word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(_SYMBOLS)
            return array("I", [t.id for t in self.tokenize("\u0120" + word if space else word)]).tobytes()
        return self.whole(text)

    def encode(self, text: str | None) -> bytes:
        return self.column(pa.array([text], pa.large_string()))[0].tobytes()

    def column(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, and where each row begins (and the end); null is empty."""
        raw, offsets = flat(col)
        rows = len(offsets) - 1
        kind = _KIND[raw]
        odd = self._odd(raw, offsets, kind)
        for content in self.added:
            odd |= pc.fill_null(pc.match_substring(col, content, ignore_case=True), False).to_numpy(zero_copy_only=False)
        before = np.empty_like(kind)
        before[:1] = 0
        before[1:] = kind[:-1]
        blank = (kind == _SPACE) | (kind == _BREAK)
        after_blank = (before == _SPACE) | (before == _BREAK)
        opens = (kind == _CLOSE) & (before == _PLAIN)
        if self.spaced:
            opens |= blank | (before == _BREAK)
        else:
            opens |= after_blank
        edge = offsets[:-1][np.diff(offsets) > 0]
        opens[edge] = True
        if self.spaced:
            start = np.flatnonzero(opens)
            end = np.r_[start[1:], len(raw)] if len(start) else start
        else:
            opens &= ~blank
            stop = np.flatnonzero(opens | blank)
            start = np.flatnonzero(opens)
            end = np.r_[stop, len(raw)][np.searchsorted(stop, start, "right")]
        row = np.searchsorted(offsets, start, "right") - 1
        if odd.any():
            keep = ~odd[row]
            start, end, row = start[keep], end[keep], row[keep]
        low = raw if self.spaced else np.frombuffer(LOWER, np.uint8)[raw]
        _, at, of = np.unique(span_hash(low, start, end), return_index=True, return_inverse=True)
        text = low.tobytes()
        out = list(map(self.kept.__getitem__, [text[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]))
        size = np.fromiter(map(len, out), np.int64, len(out)) // 4
        known = np.frombuffer(b"".join(out), "<u4")
        each = size[of]
        ends = np.cumsum(each)
        ids = known[np.repeat((np.cumsum(size) - size)[of] - ends + each, each) + np.arange(int(each.sum()))]
        count = np.bincount(row, weights=each, minlength=rows).astype(np.int64)
        if not odd.any():
            return ids, np.r_[0, np.cumsum(count)]
        first = np.r_[0, np.cumsum(count)]
        parts = [ids[first[r]:first[r + 1]] for r in range(rows)]
        for r in np.flatnonzero(odd):
            parts[r] = np.frombuffer(self.whole(col[int(r)].as_py()), "<u4")
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]

    def _odd(self, raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Rows with white space other than single spaces and line breaks between two characters; a
        space before the first one may belong to its word."""
        rows = len(offsets) - 1
        odd = np.zeros(rows, bool)
        if not len(raw):
            return odd
        blank = (kind == _SPACE) | (kind == _BREAK)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        bad = kind == _ODD
        bad[1:] |= blank[1:] & blank[:-1] & ~edge[1:-1]
        led = (kind == _SPACE) if self.spaced else np.zeros(len(raw), bool)
        bad |= blank & ((edge[:-1] & ~led) | edge[1:])
        at = np.flatnonzero(bad)
        lead = np.flatnonzero(kind == _LEAD)
        lead = lead[lead < len(raw) - 1]
        first, second = raw[lead], raw[lead + 1]
        wide = ((first == 0xC2) & ((second == 0x85) | (second == 0xA0))) | ((first == 0xE1) & (second == 0x9A)) \
            | ((first == 0xE2) & ((second == 0x80) | (second == 0x81))) | ((first == 0xE3) & (second == 0x80))
        odd[np.searchsorted(offsets, np.r_[at, lead[wide]], "right") - 1] = True
        return odd


class _Chunks(dict):
    """Ids of the chunks met lately; a chunk of the generation before is taken over when met."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.before: dict[bytes, bytes] = {}

    def __missing__(self, raw: bytes) -> bytes:
        out = self.before.get(raw)
        if out is None:
            out = self.encoder.chunk(raw)
        if len(self) >= KEPT_CHUNKS:
            self.before = dict(self)
            self.clear()
        self[raw] = out
        return out


_ENCODERS: dict[tuple[str, bool, bool], Encoder] = {}


def encoder(path: str, spaced: bool, plain: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file; tasks of one worker share it."""
    if (path, spaced, plain) not in _ENCODERS:
        _ENCODERS[path, spaced, plain] = Encoder(path, spaced, plain)
    return _ENCODERS[path, spaced, plain]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)
