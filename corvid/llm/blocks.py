"""Arrow text columns as flat numpy byte arrays: words, hashes, and blocks of bounded size.

Every function works on a whole block of documents at once. A block is a slice of an Arrow
record batch of about ``BLOCK`` bytes of text (one longer document is a block of its own), so
memory is bounded by that size or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1_000_000
#: ``[\x20\x09-\x0D]``
WS = np.zeros(256, dtype=bool)
WS[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_pows: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """p**i and p**-i modulo 2**64 for i up to n."""
    if len(_pows[0]) <= n:
        for k, base in enumerate((_P, _PINV)):
            x = np.full(max(n + 1, BLOCK + 1), base, np.uint64)
            x[0] = 1
            _pows[k] = np.multiply.accumulate(x)
    return _pows


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(col) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0] if len(off) else np.zeros(1, np.int64)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(n, (n[at - 1] if at else 0) + size, "right"))
            end = max(end, at + 1)
            yield batch.slice(at, end - at)
            at = end


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte and document of each maximal run without white space."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~WS[data]
    first = off[:-1][off[:-1] < off[1:]]
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    before[first] = False
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    after[first[1:] - 1] = False
    starts = np.flatnonzero(solid & ~before)
    return starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(off, starts, "right") - 1


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from prefix sums of a polynomial modulo 2**64; equal for equal bytes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    pow_, inv = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pow_[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights, minlength=n)


def chars_before(data: np.ndarray) -> np.ndarray:
    """Code points before each byte position (one longer than data)."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
