"""Vectorised word work on the UTF-8 bytes of Arrow string columns: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK = 1 << 20
PIECE = 4 << 20
_rng = np.random.Generator(np.random.PCG64(77))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(BASE), -1, 2**64))
#: Spans over so many bytes are hashed by the library, one by one.
FAR = 2048
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_powers: dict[str, np.ndarray] = {}

#: The white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        for key, base in (("p", BASE), ("q", _INV)):
            steps = np.full(max(n + 1, BLOCK + 1), base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["p"], _powers["q"]


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return body, off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, overlap: int, block: int = BLOCK, space: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (bytes, offsets, row of each part) of about `block` bytes. A row over PIECE bytes is cut at white space
    into parts which share `overlap` words, so that every run of overlap + 1 words lies whole in one part."""
    n, lo = len(off) - 1, 0
    while lo < n:
        if off[lo + 1] - off[lo] > PIECE:
            yield from _cut(data[off[lo] : off[lo + 1]], lo, overlap, space)
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + block, "right")) - 1)
        wide = np.flatnonzero(np.diff(off[lo : hi + 1]) > PIECE)
        hi = lo + int(wide[0]) if len(wide) else hi
        yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], np.arange(lo, hi)
        lo = hi


def _cut(body: np.ndarray, row: int, overlap: int, space: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    start, n = 0, len(body)
    while start < n:
        end = min(n, start + PIECE)
        while end < n and not space[body[end]]:
            step = np.flatnonzero(space[body[end : end + PIECE]])
            end = end + int(step[0]) if len(step) else min(n, end + PIECE)
        part = body[start:end]
        yield part, np.array([0, len(part)]), np.array([row])
        if end >= n:
            return
        ws = space[part]
        starts = np.flatnonzero(~ws & np.r_[True, ws[:-1]])
        start = start + int(starts[-overlap]) if overlap and len(starts) > overlap else end


def words(data: np.ndarray, off: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word of a block."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    ws = space[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.r_[True, ws[:-1]] | first[:-1]
    after = np.r_[ws[1:], True] | first[1:]
    starts, ends = np.flatnonzero(~ws & before), np.flatnonzero(~ws & after) + 1
    counts = np.diff(np.searchsorted(starts, off))
    return starts, ends, np.repeat(np.arange(len(off) - 1), counts)


def prefix_sums(data: np.ndarray, values: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """Running polynomial sums of a block modulo 2^64, for rolling values that only have to be spread."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * p[: len(data)], out=out[1:])
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of a block, equal for equal bytes wherever they stand. Eight bytes at a time go through the
    finaliser, which is no polynomial: texts of a simple build, such as a word and its complement, don't fall together.
    Spans of up to eight bytes and one length never do."""
    n = ends - starts
    if not len(n):
        return np.zeros(0, np.uint64)
    body = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray(len(data) + 1, "<u8", body, strides=(1,))
    h = mix(mix(n.astype(np.uint64) * BASE) ^ (load[starts] & _MASK[np.minimum(n, 8)]))
    far, at = np.flatnonzero((n > 8) & (n <= FAR)), 8
    while len(far):
        left = n[far] - at
        h[far] = mix(h[far] * BASE ^ (load[starts[far] + at] & _MASK[np.minimum(left, 8)]))
        far, at = far[left > 8], at + 8
    for k in np.flatnonzero(n > FAR).tolist():
        h[k] = xxhash.xxh3_64_intdigest(body[starts[k] : ends[k]].tobytes())
    return h


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after another."""
    total = int(size.sum())
    return flat[np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)]


def strings(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: pa.DataType = pa.string()) -> pa.Array:
    """Spans of a block as an Arrow column."""
    size = ends - starts
    off = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(kind, len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(gather(body, starts, size)))])


def unique(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order of appearance, the first place of each, and each value's number."""
    enc = pa.array(h).dictionary_encode()
    number = enc.indices.to_numpy(zero_copy_only=False)
    values = enc.dictionary.to_numpy(zero_copy_only=False)
    first = np.empty(len(values), np.int64)
    first[number[::-1]] = np.arange(len(h) - 1, -1, -1)
    return values, first, number


def follow(h: np.ndarray, row: np.ndarray, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the runs of n consecutive words of one row."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    x = np.full(m, seed, np.uint64)
    for i in range(n):
        x = mix(x * BASE + h[i : i + m])
    keep = row[:m] == row[n - 1 :]
    return x[keep], row[:m][keep]
