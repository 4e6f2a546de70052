"""Word and shingle hashes of whole texts in numpy, over the bytes of Arrow columns.

Words are maximal runs of bytes outside ASCII white space (0x20, 0x09 to 0x0D), with A-Z lowered.
All other characters are bytes of 0x80 and above in UTF-8, so working on bytes is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer document is handled alone.
PIECE = 1 << 21

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SLOT = _rng.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = 1 << int(n).bit_length()
        table = np.full(size, _BASE)
        table[0] = 1
        _POWERS = np.multiply.accumulate(table)
    return _POWERS


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds) for runs of rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null slot may span bytes
        column = column.fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = column.buffers()[2]
        whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word and the first word's number of each document, with the total last."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    space = _SPACE[data]
    head = np.ones(n + 1, bool)  # a word cannot go on here
    head[1:n] = space[:-1]
    head[bounds] = True
    starts = np.flatnonzero(~space & head[:-1])
    ends = np.flatnonzero(~space & _stops(space, bounds)) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends, np.zeros(len(bounds), np.int64)
    lengths = ends - starts
    total = np.concatenate(([0], np.cumsum(lengths)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], lengths)
    solid = data[~space]
    value = _BYTE[solid] * _powers(int(lengths.max()))[place]
    out = mix(np.add.reduceat(value, total[:-1]) + lengths.astype(np.uint64))
    return out, starts, ends, np.searchsorted(starts, bounds)


def _stops(space: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """True where the next byte is white space or of another document."""
    out = np.ones(len(space), bool)
    out[:-1] = space[1:]
    edge = bounds[(bounds > 0) & (bounds <= len(space))] - 1
    out[edge] = True
    return out


def ngrams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of `size` words that begin at each word (those that fit)."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64)
    last = len(hashes) - size + 1
    total = hashes[:last] * _SLOT[0]
    for i in range(1, size):
        total = total + hashes[i : i + last] * _SLOT[i]
    return mix(total)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each document.

    With fewer words than `size` the whole sequence is the one shingle; without words there is none.
    """
    for _, data, bounds in pieces(column):
        hashes, _, _, first = words(data, bounds)
        runs = ngrams(hashes, size)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield mix((hashes[a:b] * _SLOT[: b - a]).sum(keepdims=True) + _SLOT[15:] * np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash: for each nonempty set its smallest value under `count` multiplicative permutations."""
    factors = mix(np.arange(1, count + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    joined = np.concatenate(sets)
    out = np.empty((len(sets), count), np.uint32)
    for j in range(count):
        out[:, j] = np.minimum.reduceat(joined * factors[j], starts) >> np.uint64(32)
    return out


def range_minima(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, count: int) -> np.ndarray:
    """MinHash of the values between each start and stop, which are in order and hold one at least."""
    factors = mix(np.arange(1, count + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    spots = np.stack([starts, stops], axis=1).ravel()
    padded = np.append(values, np.uint64(0))  # a stop may be the end
    out = np.empty((len(starts), count), np.uint32)
    for j in range(count):
        out[:, j] = np.minimum.reduceat(padded * factors[j], spots)[::2] >> np.uint64(32)
    return out
