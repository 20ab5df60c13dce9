"""Vectorised text kernels over Arrow string buffers.

Everything here works on the UTF-8 bytes of many documents at once: a slice is
a run of documents whose bytes lie next to each other, so one numpy pass serves
all of them.  No function looks across a document boundary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Positions whose hashes are made at once: so many fit into a core's cache.
BLOCK = 1 << 15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S32 = np.uint64(33), np.uint64(32)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first 0..8 bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 bits."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


@lru_cache(maxsize=16)
def _keys(seed: int) -> tuple[np.uint64, np.uint64, np.uint64]:
    """What tells the hashes of one seed from those of another: a start, an odd factor and a summand."""
    a, b, c = np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, 3, dtype=np.uint64)
    return a, b | np.uint64(1), c


def _pair(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    """Hash of two hashes in order."""
    _, factor, summand = _keys(seed)
    out = x * factor
    out ^= (y << _S32) | (y >> _S32)
    out += summand
    return mix(out)


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number, zeros after the end."""
    return np.ndarray((len(data) + 1,), np.dtype("<u8"), np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))


def byte_class(inside: bytes | None = None, outside: bytes | None = None) -> np.ndarray:
    """Boolean table over byte values, from the bytes in or not in the class."""
    table = np.zeros(256, bool) if inside is not None else np.ones(256, bool)
    table[list(inside if inside is not None else outside or b"")] = inside is not None
    return table


#: `[^\x20\x09-\x0D]+`
BLANK_SEPARATED = byte_class(outside=bytes([0x20, *range(0x09, 0x0E)]))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z are lower-cased
ALNUM = byte_class(outside=bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Slice:
    """Documents first..last-1 of a batch; offsets are into data, one more than documents."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def bytes_of(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a column into runs of documents of at most `most` bytes, longer documents alone."""
    raw, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(n, max(at + 1, end))
        yield Slice(at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end


@dataclass
class Words:
    """Words of a slice: byte starts and ends, and for each document its first word (one more than documents)."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    @property
    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def words(part: Slice, table: np.ndarray = BLANK_SEPARATED) -> Words:
    inside = table[part.data]
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(part.last - part.first + 1, np.int64))
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:n]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:n]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, part.offsets))


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each range of bytes: its blocks of eight bytes, each mixed with a key of its place, added up and mixed with the length."""
    start, factor, summand = _keys(seed)
    lengths = ends - starts
    eight = loads(data)
    sums = mix((eight[starts] & _MASKS[np.minimum(lengths, 8)]) ^ start)
    long = np.flatnonzero(lengths > 8)
    if len(long):
        counts = (lengths[long] - 1) >> 3
        first = np.cumsum(counts) - counts
        row = np.repeat(long, counts)
        k = np.arange(len(row)) - np.repeat(first, counts) + 1
        at = starts[row] + 8 * k
        key = mix(start + k.astype(np.uint64) * _STEP)
        sums[long] += np.add.reduceat(mix((eight[at] & _MASKS[np.minimum(ends[row] - at, 8)]) ^ key), first)
    return mix(sums * factor + lengths.astype(np.uint64) * _STEP + summand)


def word_hashes(part: Slice, w: Words, fold: bool = False, seed: int = 1) -> np.ndarray:
    """64-bit hash of each word; fold lower-cases A-Z first."""
    if not len(w.starts):
        return np.zeros(0, np.uint64)
    return range_hashes(LOWER[part.data] if fold else part.data, w.starts, w.ends, seed)


def same_bytes(x: np.ndarray, at: np.ndarray, y: np.ndarray, there: np.ndarray, lengths: np.ndarray) -> bool:
    """Whether each range of one text from `at` holds the bytes of the one of another from `there`; x and y are their loads()."""
    mask = _MASKS[np.minimum(lengths, 8)]
    if ((x[at] & mask) != (y[there] & mask)).any():
        return False
    long = np.flatnonzero(lengths > 8)
    if not len(long):
        return True
    counts = (lengths[long] - 1) >> 3
    row = np.repeat(long, counts)
    step = 8 * (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1)
    mask = _MASKS[np.minimum(lengths[row] - step, 8)]
    return bool(((x[at[row] + step] & mask) == (y[there[row] + step] & mask)).all())


def distinct(x: np.ndarray) -> np.ndarray:
    """The different values in order; by sorting, which is faster here than numpy's table of hashes."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    return x[keep]


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges one after the other, and where each begins (one more than ranges)."""
    lengths = ends - starts
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    return data[np.arange(bounds[-1]) + np.repeat(starts - bounds[:-1], lengths)], bounds


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each byte range, equal for equal bytes only, and a range that has each number.

    Ranges are grouped by hash and their bytes compared; if a hash should have two texts, all are told apart by their bytes.
    """
    _, codes = np.unique(range_hashes(data, starts, ends), return_inverse=True)
    lead = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    lead[codes] = np.arange(len(codes))
    own = lead[codes]
    eight = loads(data)
    if ((ends - starts) == (ends - starts)[own]).all() and same_bytes(eight, starts, eight, starts[own], ends - starts):
        return codes, lead
    raw, bounds = gathered(data, starts, ends)
    codes = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)]).dictionary_encode().indices.to_numpy()
    lead = np.zeros(int(codes.max()) + 1, np.int64)
    lead[codes] = np.arange(len(codes))
    return codes, lead


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Up to eight first bytes of each range as one number, mixed with its length."""
    return (loads(data)[starts] & _MASKS[np.minimum(ends - starts, 8)]) ^ ((ends - starts).astype(np.uint64) << np.uint64(40))


def _doubled(h: np.ndarray, width: int, size: int, seed: int) -> np.ndarray:
    """Hashes of `size` items from hashes of `width` items at each position: doubled while that fits, then two that overlap."""
    count = len(h) + width - size
    while width * 2 <= size:
        h = _pair(h[: len(h) - width], h[width:], seed)
        width *= 2
    return h if width == size else _pair(h[:count], h[size - width : size - width + count], seed)


def byte_gram_hashes(data: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of the `size` bytes from each position (only those that fit into data)."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    start = _keys(seed)[0]
    eight, width = loads(data), min(size, 8)
    out = np.empty(n, np.uint64)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        base = mix((eight[a : b + size - width] & _MASKS[width]) ^ start)
        out[a:b] = _doubled(base, width, size, seed)
    return out


def gram_hashes(values: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of the `size` successive hashes from each position, over the whole array."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    return mix(values ^ _keys(seed)[0]) if size == 1 else _doubled(values, 1, size, seed)


def fitting(bounds: np.ndarray, size: int, n: int) -> np.ndarray:
    """True at each of the first n positions from which `size` items lie in one document."""
    ok = np.zeros(max(n, 0), bool)
    lengths = np.diff(bounds)
    long = lengths >= size
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, bounds[:-1][long], 1)
    np.add.at(step, bounds[:-1][long] + lengths[long] - size + 1, -1)
    np.not_equal(np.cumsum(step[:n]), 0, out=ok)
    return ok


_POSITION = np.uint64((1 << 24) - 1)


def leftmost_minima(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of `span` successive hashes the position of its least one, the leftmost of equals."""
    n = len(hashes)
    if n < span:
        return np.zeros(0, np.int64)
    if span > int(_POSITION) // 2:
        raise ValueError("the run is too long")
    out = np.empty(n - span + 1, np.int64)
    size = max(BLOCK, span)
    place = np.arange(min(n, size + span - 1), dtype=np.uint64)
    for a in range(0, len(out), size):  # in parts that overlap by a run
        some = hashes[a : a + size + span - 1]
        low = (some & ~_POSITION) | place[: len(some)]
        width, count = 1, len(some) - span + 1
        while width * 2 <= span:
            low = np.minimum(low[: len(low) - width], low[width:])
            width *= 2
        low = np.minimum(low[:count], low[span - width : span - width + count])
        np.add((low & _POSITION).view(np.int64), a, out=out[a : a + count])
    return out
