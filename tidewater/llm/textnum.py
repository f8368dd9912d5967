"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes (a longer text alone), which bounds memory.
RUN_BYTES = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(n, np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * step
        done += more
        step = np.uint64(int(step) ** 2 % 2**64)
    return out


_POWER = [_powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)]


def _power(kind: int, n: int) -> np.ndarray:
    if len(_POWER[kind]) < n:
        _POWER[kind] = _powers((_BASE, _INVERSE)[kind], 1 << (n - 1).bit_length())
    return _POWER[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand: a polynomial over
    random values of the bytes, shifted to the span's start, then mixed with its length."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * _power(0, len(data)), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _power(1, len(data) + 1)[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def runs(texts: pa.Array, size: int = RUN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into the bytes) for runs of rows; a null is an empty text."""
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    n = len(texts)
    _, where, data = texts.buffers()
    at = np.frombuffer(where, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + size, "right")) - 1)
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): word spans in text order, and for each text the number of words before it."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, finish = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1] | edge[1:-1]
    finish[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z as a-z."""
    return _LOWER[data]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of lower-cased words; shorter texts are one shingle."""
    data = lowered(data)
    starts, ends, first = words(data, offsets)
    h = span_hashes(data, starts, ends)
    whole = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, width):
            full = max(0, len(h) - k)
            whole[:full] = mix(whole[:full] * np.uint64(0x2545F4914F6CDD1D) + h[k:])
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(whole[a : b - width + 1]))
            elif b > a:
                one = h[a : a + 1]
                for k in range(1, b - a):
                    one = mix(one * np.uint64(0x2545F4914F6CDD1D) + h[a + k])
                out.append(mix(one + np.uint64(b - a)))
            else:
                out.append(h[:0])
    return out
