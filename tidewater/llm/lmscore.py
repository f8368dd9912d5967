"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words and word pairs over all training texts: tasks combine the hashes of many
texts in numpy and send (hash range, hashes, counts) blocks, so a word that is in every text is one
entry a block. Counts are quantised to powers of BASE; an n-gram of level q is put into the filter
q times, once for each level up to its own, and a lookup probes level after level until one is
missing. Each hash range owns its segment of the filter, so segments are built apart, as files in
the shared folder. The filter has at least BITS_PER_ENTRY bits for each entry whatever the input
holds, so the rate of false positives (Scorer.false_positives) does not rise with it. Workers look
up the distinct words and pairs of LOOKUP_BYTES of text at once and read segments for that a slice
of at most SLICE_BYTES at a time, so no filter is held whole or broadcast.
Words and pairs seen once are entries of level 1 like others.

The probability of a token is PAIR_WEIGHT of its share among what followed the word before, and the
rest the add-one unigram estimate, both from the filter: the least count of the level of the pair or
word, over the greatest count of the level of the word before or over all tokens. So, false positives
aside, the probabilities of all words after a word sum to at most 1. The exact unigram base score uses exact counts, which workers read from the shared folder a slice of at most
SLICE words at a time, so no table of all words is held or broadcast. Edge cases:

* null or empty text: one token, the end; no training rows: every probability is 1, scores 0;
* a null doc_id counts as a training row (its crc32 counts as 0); repeated rows each count and
  each get their equal score; very long texts are read whole; an empty table gives an empty
  result; only doc_id and text are read. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnum
from .common import cut, frugal, scratch_path, small_batches
from .files import read_all, write_once

BASE = math.sqrt(2)
LEVELS = 96
PROBES = 4
BITS_PER_ENTRY = 12
PAIR_WEIGHT = 0.5
SLICE = 1_500_000
SLICE_BYTES = 16 << 20

#: Bytes of text whose words and pairs a scoring task looks up together.
LOOKUP_BYTES = 16 << 20
LOOKUP_KEYS = 1 << 17

#: Bytes of text whose counts a task combines before it sends them.
BLOCK_BYTES = 16 << 20
RUN_BYTES = 2 << 20

END = np.uint64(0x9AE16A3B2F90404F)
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def token_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token of each text in a row, each text's first token and the end): words, then an end."""
    data = textnum.lowered(data)
    starts, ends, first = textnum.words(data, offsets)
    h = np.insert(textnum.span_hashes(data, starts, ends), first[1:], END)
    return h, first + np.arange(len(first))


def pair_hashes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each token with the one before, index of the one before); before a text stands an end."""
    before = np.roll(h, 1)
    before[first[:-1]] = END
    with np.errstate(over="ignore"):
        return textnum.mix(before * _PAIR + h) ^ np.uint64(1), before


def _combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes and their summed counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def _count(shift: int):
    """Blocks of counts: kind 1 words, kind 2 pairs; range is the top bits of the hash."""

    def blocks(kind: int, held: list) -> pa.RecordBatch:
        keys, counts = _combined(held)
        at = (keys >> np.uint64(shift)).astype(np.int64)
        heads = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        stops = [*heads[1:].tolist(), len(keys)]
        cols = zip(*(((int(at[a]), kind, keys[a:b].tobytes(), counts[a:b].astype(np.int64).tobytes())) for a, b in zip(heads.tolist(), stops, strict=True)), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["range", "kind", "keys", "counts"])

    def run(batches):
        words, pairs, size = [], [], 0
        for batch in batches:
            for _, _, data, offsets in textnum.runs(batch.column(0), RUN_BYTES):
                h, first = token_hashes(data, offsets)
                words.append(np.unique(h, return_counts=True))
                pairs.append(np.unique(pair_hashes(h, first)[0], return_counts=True))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield blocks(1, words)
                    yield blocks(2, pairs)
                    words, pairs, size = [], [], 0
        if words:
            yield blocks(1, words)
            yield blocks(2, pairs)

    return frugal(run)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS, 1 + np.floor(np.log(counts) / math.log(BASE) + 1e-9)).astype(np.int64)


#: The least and the greatest whole count of each level (0 for level 0).
LEAST = np.concatenate([[0.0], np.ceil(BASE ** np.arange(LEVELS) - 1e-6)])
GREATEST = np.concatenate([[0.0], np.maximum(LEAST[1:], np.ceil(BASE ** np.arange(1.0, LEVELS + 1) - 1e-6) - 1)])


def _summed(folder: str):
    """Sums the blocks of each range, in order; writes exact word counts to a file, passes on what the filter stores."""

    def finish(place: int, words: list, pairs: list) -> pa.RecordBatch:
        empty = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        (w, wc), (p, pc) = _combined(words or empty), _combined(pairs or empty)
        path = write_once(folder, f"words-{place}", w.tobytes() + wc.tobytes())
        keys, level = np.concatenate([w, p]), levels_of(np.concatenate([wc, pc]))
        values = [place, path, len(w), int(wc.sum()), int(level.sum()), keys.tobytes(), level.astype(np.uint8).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _SUMS.types, strict=True)], schema=_SUMS)

    def run(batches):
        place, words, pairs = None, [], []
        for batch in batches:
            for r, kind, keys, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != place:
                    if place is not None:
                        yield finish(place, words, pairs)
                    place, words, pairs = r, [], []
                into = words if kind == 1 else pairs
                into.append((np.frombuffer(keys, np.uint64), np.frombuffer(counts, np.int64)))
                if len(into) >= 16:
                    into[:] = [_combined(into)]
        if place is not None:
            yield finish(place, words, pairs)

    return frugal(run)


_SUMS = pa.schema([("range", pa.int32()), ("path", pa.string()), ("words", pa.int64()), ("tokens", pa.int64()), ("entries", pa.int64()), ("keys", pa.binary()), ("levels", pa.binary())])


def _places(keys: np.ndarray, level: int, segment_bits: int) -> list[np.ndarray]:
    """PROBES bit places in a segment for keys at a level."""
    with np.errstate(over="ignore"):
        a = textnum.mix(keys + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15))
        b = textnum.mix(a ^ np.uint64(0x5851F42D4C957F2D)) | np.uint64(1)
        return [((a + np.uint64(i) * b) >> np.uint64(20)) % np.uint64(segment_bits) for i in range(PROBES)]


def build_segment(keys: np.ndarray, levels: np.ndarray, segment_bits: int) -> np.ndarray:
    """The filter's bytes for one hash range."""
    bits = np.zeros(segment_bits, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(keys[levels >= level], level, segment_bits):
            bits[place.astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Scorer:
    """What scoring needs: the filter, corpus totals, and where the exact counts are.

    segments: slices of the filter, each a first hash range and the files of the ranges from there
    on (none for a range of no entries); without any, the filter is the whole of it.
    """

    filter: np.ndarray
    shift: int
    segment_bits: int
    tokens: int
    words: int
    entries: int
    slices: list[list[tuple[str, int]]]
    segments: list[tuple[int, list[str | None]]] = field(default_factory=list)

    @property
    def false_positives(self) -> float:
        """The expected rate at which one level of an absent n-gram is found."""
        bits = self.segment_bits << (64 - self.shift)
        return (1 - math.exp(-PROBES * self.entries / max(bits, 1))) ** PROBES

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The highest level that the filter holds in unbroken order for each key, 0 for none."""
        level = np.zeros(len(keys), np.uint8)
        place = (keys >> np.uint64(self.shift)).astype(np.int64)
        for start, paths in self.segments or [(0, None)]:
            some = np.arange(len(keys)) if paths is None else np.flatnonzero((place >= start) & (place < start + len(paths)))
            if len(some):
                bits = self.filter if paths is None else _bits(paths, self.segment_bits // 8, len(self.segments) == 1)
                level[some] = _found(bits, keys[some], (place[some] - start) * self.segment_bits, self.segment_bits)
        return level


def _found(bits: np.ndarray, keys: np.ndarray, base: np.ndarray, segment_bits: int) -> np.ndarray:
    """The highest level of each key found in unbroken order; base is where its segment begins."""
    level = np.zeros(len(keys), np.uint8)
    for a in range(0, len(keys), LOOKUP_KEYS):
        level[a : a + LOOKUP_KEYS] = _found_in(bits, keys[a : a + LOOKUP_KEYS], base[a : a + LOOKUP_KEYS], segment_bits)
    return level


def _found_in(bits: np.ndarray, keys: np.ndarray, base: np.ndarray, segment_bits: int) -> np.ndarray:
    level = np.zeros(len(keys), np.uint8)
    left = np.arange(len(keys))
    for j in range(1, LEVELS + 1):
        alive = np.arange(len(left))
        for place in _places(keys[left], j, segment_bits):
            at = base[left[alive]] + place[alive].astype(np.int64)
            alive = alive[(bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
        left = left[alive]
        level[left] = j
        if not len(left):
            break
    return level


_BITS: dict[str, np.ndarray] = {}


def _bits(paths: list[str | None], size: int, keep: bool) -> np.ndarray:
    """The bytes of some segments of the filter; the only slice there is stays in the worker."""
    name = next((x for x in paths if x), "")
    if name in _BITS:
        return _BITS[name]
    _BITS.clear()  # of another model, before this one takes room
    got = np.zeros(len(paths) * size, np.uint8)
    for i, path in enumerate(paths):
        if path:
            got[i * size : (i + 1) * size] = np.frombuffer(read_all(path), np.uint8)
    if keep:
        _BITS[name] = got
    return got


_SLICES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _slice(files: list[tuple[str, int]], keep: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sorted word hashes and exact counts of some ranges; the only slice there is stays in the worker."""
    name = files[0][0]
    if name in _SLICES:
        return _SLICES[name]
    _SLICES.clear()
    got = np.empty(sum(n for _, n in files), np.uint64), np.empty(sum(n for _, n in files), np.int64)
    at = 0
    for path, n in files:
        raw = read_all(path)
        got[0][at : at + n], got[1][at : at + n] = np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.int64, n, 8 * n)
        at += n
    if keep:
        _SLICES[name] = got
    return got


def train(docs: DataFrame) -> Scorer:
    """Counts the texts of docs and builds the filter."""
    spark = docs.sparkSession
    small_batches(spark)
    # the scan's partitions grow with the data, and so do the ranges
    ranges = 1 << max(5, (4 * docs.rdd.getNumPartitions() - 1).bit_length())
    shift = 64 - (ranges.bit_length() - 1)
    folder = scratch_path(spark, "words")
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = text.mapInArrow(_count(shift), "range int, kind int, keys binary, counts binary")
    sums = blocks.repartition(ranges, "range").sortWithinPartitions("range", "kind").mapInArrow(_summed(folder), "range int, path string, words long, tokens long, entries long, keys binary, levels binary")
    sums = cut(sums)
    files = sums.select("range", "path", "words", "tokens", "entries").orderBy("range").collect()  # one row a range
    entries = sum(r["entries"] for r in files)
    bits = max(1 << 16, 1 << (BITS_PER_ENTRY * max(1, entries) - 1).bit_length())
    segment_bits = max(8, bits // ranges)

    def segments(batches):
        for batch in batches:
            for r, keys, levels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = build_segment(np.frombuffer(keys, np.uint64), np.frombuffer(levels, np.uint8), segment_bits)
                path = write_once(folder, f"bits-{r}", got.tobytes())
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int32()), "path": pa.array([path])})

    built = {r["range"]: r["path"] for r in sums.select("range", "keys", "levels").mapInArrow(frugal(segments), "range int, path string").collect()}  # one row a range
    many = max(1, SLICE_BYTES // (segment_bits // 8))
    parts = [(a, [built.get(r) for r in range(a, min(ranges, a + many))]) for a in range(0, ranges, many)] if built else []
    whole = np.zeros(0 if built else ranges * (segment_bits // 8), np.uint8)
    slices: list[list[tuple[str, int]]] = []
    for r in files:
        if not slices or sum(n for _, n in slices[-1]) + r["words"] > SLICE:
            slices.append([])
        slices[-1].append((r["path"], r["words"]))
    return Scorer(whole, shift, segment_bits, sum(r["tokens"] for r in files), sum(r["words"] for r in files), entries, slices, parts)


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, held_out (passed through), n_tokens, n_known, train_tokens, base_score, score of docs (doc_id, held_out, text)."""
    from pandas import factorize

    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def coded(h, first):
        """Tokens and pairs of a run as (places, sorted distinct hashes) each, and first."""
        out = []
        for keys in (h, pair_hashes(h, first)[0]):
            code, some = factorize(keys)
            order = np.argsort(np.asarray(some, np.uint64))
            place = np.empty(len(order), np.int32)
            place[order] = np.arange(len(order), dtype=np.int32)
            out += [place[code], np.asarray(some, np.uint64)[order]]
        return (*out, first)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            runs = []
            for _, _, data, offsets in textnum.runs(batch.column(2), RUN_BYTES):
                runs.append(coded(*token_hashes(data, offsets)))
                size += len(data)
            # a copy, which does not hold the texts
            held.append((batch.select([0, 1]).take(pa.array(np.arange(len(batch)))), runs))
            if size >= LOOKUP_BYTES:
                yield from scored(held)
                held, size = [], 0
        yield from scored(held)

    def scored(held):
        m = shared.value
        floor = m.tokens + 1 * (m.words + 1)
        runs = [r for _, some in held for r in some]
        if not runs:
            return
        words, pairs = (np.unique(np.concatenate([r[i] for r in runs])) for i in (1, 3))
        exact = np.zeros(len(words), np.int64)
        for files in m.slices:
            keys, counts = _slice(files, len(m.slices) == 1)
            if len(keys):
                lo, hi = np.searchsorted(words, keys[[0, -1]])
                at = np.minimum(np.searchsorted(keys, words[lo : hi + 1]), len(keys) - 1)
                hit = np.flatnonzero(keys[at] == words[lo : hi + 1])
                exact[lo + hit] = counts[at[hit]]
        guess, joint = m.levels(words), m.levels(pairs)
        for batch, some in held:
            parts = []
            for wplace, wsome, pplace, psome, first in some:
                code = np.searchsorted(words, wsome)[wplace]
                both = joint[np.searchsorted(pairs, psome)][pplace]
                # the word before is a token of this run, or an end, which every text has
                prior = np.roll(code, 1)
                prior[first[:-1]] = code[first[1] - 1]
                context = GREATEST[guess[prior]]
                share = np.where(context > 0, np.minimum(1.0, LEAST[both] / np.maximum(context, 1.0)), 0.0)
                unigram = np.minimum(1.0, (LEAST[guess[code]] + 1) / floor)
                p = PAIR_WEIGHT * share + (1 - PAIR_WEIGHT) * unigram if m.tokens else np.ones(len(code))
                base = np.log10((exact[code] + 1) / floor)
                heads = first[:-1]
                parts.append((np.diff(first), np.add.reduceat((exact[code] > 0).astype(np.int64), heads), np.add.reduceat(base, heads), np.add.reduceat(np.log10(p), heads)))
            if not parts:
                continue
            n, known, base, own = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), m.tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(frugal(run), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0))
    docs = docs.withColumn("held_out", rest == 2)
    return score(docs, train(docs.where(~F.col("held_out"))))
