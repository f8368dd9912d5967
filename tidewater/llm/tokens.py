"""Token ids of many texts with the tokenizers library, each distinct piece of text tokenised once.

A byte-pair tokenizer never merges across some places, such as a single space between words. Texts
are cut there, pieces are told apart by 64-bit hashes of their bytes, and a bounded cache in each
worker process keeps the ids of pieces that were met before. The ids are those of the whole text.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa

from . import textnum

#: Distinct pieces a worker keeps before it starts afresh, which bounds its memory (about 40 MB a million).
CACHE_PIECES = 1_500_000

#: Bytes that may end or begin a Unicode space, or are controls that some pattern classes take for spaces.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_SPACE = textnum._SPACE
_LATIN = np.zeros(256, bool)
_LATIN[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?"]] = True


def _solid(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ends, begins): whether the character that ends, or begins, at a byte surely is no white space.

    Spaces beyond ASCII have a first byte C2 (two bytes) or E1, E2, E3 (three bytes).
    """
    high = data >= 0x80
    one, two = np.roll(data, 1), np.roll(data, 2)
    maybe = (one == 0xC2) | ((two >= 0xE1) & (two <= 0xE3))
    maybe[:2] = True
    ends = _PLAIN[data] | (high & ~maybe)
    begins = _PLAIN[data] | ((data >= 0xC3) & ~((data >= 0xE1) & (data <= 0xE3)))
    return ends, begins


def pieces(data: np.ndarray, offsets: np.ndarray, drop_space: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): spans of text that can be tokenised apart, and for each text the spans before it.

    With drop_space (tokenizers that discard white space and treat it as a wall) spans are words;
    else a word takes along the single space before it, and runs of spaces stay in one piece with
    their neighbours, where the tokenizer decides. Sentence marks that end a word are their own piece.
    """
    n = len(data)
    ends, begins = _solid(data)
    if drop_space:
        starts, stops, _ = textnum.words(data, offsets)
        begin = np.zeros(n + 1, bool)
        begin[starts] = True
        stop = np.zeros(n + 1, bool)
        stop[stops] = True
    else:
        begin = np.zeros(n + 1, bool)
        begin[offsets] = True
        lone = np.zeros(n, bool)
        lone[1:-1] = _SPACE[data[1:-1]] & ends[:-2] & begins[2:]
        begin[:-1] |= lone & ((data == 0x20) | (data == 0x0A))
        after = np.flatnonzero(lone & (data == 0x0A)) + 1
        begin[after] = True
        begin[n] = True
        stop = None
    # a sentence mark after a letter, before white space or the end of the text
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    letter = _LATIN[data] | ((data >= 0x80) & (np.roll(data, 1) == 0xC3) & (data != 0x97) & (data != 0xB7))
    mark = np.zeros(n, bool)
    if n > 1:
        mark[1:] = _MARK[data[1:]] & letter[:-1] & ~edge[1:-1]
        mark[:-1] &= (_SPACE[data[1:]] & (data[1:] <= 0x20)) | edge[1:-1]
    begin[:-1] |= mark
    if drop_space:
        stop[:-1] |= mark
        starts, stops = np.flatnonzero(begin[:-1]), np.flatnonzero(stop)
    else:
        cuts = np.flatnonzero(begin)
        starts, stops = cuts[:-1], cuts[1:]
        some = stops > starts
        starts, stops = starts[some], stops[some]
    return starts, stops, np.searchsorted(starts, offsets)


@dataclass
class Encoder:
    """Encodes runs of texts with one tokenizer file; kept by a worker process between batches."""

    path: str
    drop_space: bool
    known: int = 0
    at: np.ndarray = field(default_factory=lambda: np.zeros(1 << 10, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.zeros(1 << 12, np.uint32))
    #: (sorted hashes, their slots): many settled ones, and the few that came last.
    settled: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    recent: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def __post_init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pandas import factorize
        from tokenizers import Tokenizer

        self._factorize = factorize
        self.tokenizer = Tokenizer.from_file(self.path)
        self.tokenizer.encode_special_tokens = True

    def _look(self, keys: np.ndarray) -> np.ndarray:
        """Slots of known hashes, else -1."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for hashes, slots in (self.settled, self.recent):
            if len(hashes) and len(open_):
                where = np.minimum(np.searchsorted(hashes, keys[open_]), len(hashes) - 1)
                hit = hashes[where] == keys[open_]
                out[open_[hit]] = slots[where[hit]]
                open_ = open_[~hit]
        return out

    def _add(self, keys: np.ndarray, texts: list[str]) -> np.ndarray:
        """The slots of new pieces, whose ids are kept from now on."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        begin, slots = int(self.at[self.known]), np.arange(self.known, self.known + len(keys))
        self.known += len(keys)
        size = begin + int(lengths.sum())
        self.at, self.ids = _room(self.at, self.known + 1), _room(self.ids, size)
        self.at[slots + 1] = begin + np.cumsum(lengths)
        self.ids[begin:size] = np.fromiter(chain.from_iterable(got), np.uint32, size - begin)
        self.recent = _merged(self.recent, (keys, slots))
        if len(self.recent[0]) > max(1 << 14, len(self.settled[0]) // 8):
            self.settled, self.recent = _merged(self.settled, self.recent), (keys[:0], slots[:0])
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids before each text and in all)."""
        starts, stops, first = pieces(data, offsets, self.drop_space)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        code, keys = self._factorize(textnum.span_hashes(data, starts, stops))
        keys = np.asarray(keys, np.uint64)
        slots = self._look(keys)
        new = np.flatnonzero(slots < 0)
        if len(new):
            if self.known and self.known + len(new) > CACHE_PIECES:
                # start afresh with all pieces of this run
                self.known, self.settled, self.recent, new = 0, (keys[:0], slots[:0]), (keys[:0], slots[:0]), np.arange(len(keys))
            some = np.zeros(len(keys), np.int64)
            some[code[::-1]] = np.arange(len(code))[::-1]
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8") for a, b in zip(starts[some[new]].tolist(), stops[some[new]].tolist(), strict=True)]
            slots[new] = self._add(keys[new], texts)
        each = slots[code]
        lengths = self.at[each + 1] - self.at[each]
        ends = np.cumsum(lengths)
        # one gather of all ids: each piece's place in the cache, stepping by one inside it
        index = np.repeat(self.at[each] - (ends - lengths), lengths) + np.arange(int(ends[-1]))
        return self.ids[index], np.concatenate([[0], ends])[first]


def _room(buffer: np.ndarray, size: int) -> np.ndarray:
    """The buffer, or one of at least twice its length that begins with it, so growing costs little in all."""
    if size <= len(buffer):
        return buffer
    out = np.zeros(max(size, 2 * len(buffer)), buffer.dtype)
    out[: len(buffer)] = buffer
    return out


def _merged(one: tuple, other: tuple) -> tuple:
    keys, slots = np.concatenate([one[0], other[0]]), np.concatenate([one[1], other[1]])
    order = np.argsort(keys, kind="stable")
    return keys[order], slots[order]


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, drop_space: bool) -> Encoder:
    """The worker process's encoder for a file; its cache lives as long as the process."""
    key = (path, drop_space)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, drop_space)
    return _ENCODERS[key]


def encoded(texts: pa.Array, path: str, drop_space: bool, end: int | None):
    """(first row, end row, ids, places): ids of a run of texts with `end` after each, and where each text begins."""
    for a, b, data, offsets in textnum.runs(texts):
        ids, at = encoder(path, drop_space).encode(data, offsets)
        if end is not None:
            ids = np.insert(ids, at[1:], np.uint32(end))
            at = at + np.arange(b - a + 1)
        yield a, b, ids.astype(np.uint32), at
