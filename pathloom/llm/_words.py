"""Vectorised splitting and hashing of words, for code that runs in Arrow batches.

Texts are taken whole. A batch is cut into slices of bounded bytes (a single text larger than
the bound is a slice of its own), so memory follows the slice, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SLICE_BYTES = 4 << 20
#: Where slices share nothing with each other, small ones do.
SMALL_SLICE = 1 << 20

Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frugal(f: Mapper) -> Mapper:
    """f, for a Python worker that lives on from task to task and gives freed memory back to the system.

    Arrow takes its memory from the C library then, which hands blocks of over 1 MB back when they are freed (-3 and -1:
    M_MMAP_THRESHOLD and M_TRIM_THRESHOLD; by default it raises these bounds to the largest block freed), and the rest at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.mallopt(-3, 1 << 20)
            libc.mallopt(-1, 1 << 20)
            pa.set_memory_pool(pa.system_memory_pool())
        yield from f(batches)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return run


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Bytes that end a word `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes between words of letters and digits: every ASCII byte but 0-9, A-Z and a-z.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Words:
    """Words of some texts: buf[start:end] each; those of text i are first[i]:first[i + 1]."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """Index of the text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part's texts hold about `most` bytes, or it is one row."""
    if not batch.num_rows:
        return
    sizes = pa.compute.binary_length(batch.column(column).cast(pa.binary())).fill_null(0)
    upto = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, before + most, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def split(texts: pa.Array, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    """Words between white space, or other bytes; null texts have none."""
    parts = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
    buf = b"\n" + b"\n".join(parts) + b"\n"
    if lower:
        buf = buf.translate(_LOWER)
    inside = ~between[np.frombuffer(buf, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin = np.concatenate([[1], 2 + np.cumsum([len(x) for x in parts]) + np.arange(len(parts))]).astype(np.int64)
    start, end = edges[0::2], edges[1::2]
    return Words(buf, start, end, np.searchsorted(start, begin))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all; in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def hashes(w: Words, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each word: eight bytes of all words at a time."""
    length = w.end - w.start
    out = mix(length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    padded = w.buf + bytes(8)
    eights = np.ndarray(len(w.buf), "<u8", padded, strides=(1,))
    todo, k = np.arange(len(w)), 0
    while len(todo):
        part = eights[w.start[todo] + 8 * k] & _MASK[np.minimum(length[todo] - 8 * k, 8)]
        out[todo] = mix(out[todo] ^ part) if k else mix(out ^ part)
        k += 1
        todo = todo[length[todo] > 8 * k]
    return out


_P = 0xD6E8FEB86659FD93


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Unmixed hash of the n hashes from each place on, by doubling; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    power = lambda k: np.uint64(pow(_P, k, 1 << 64))
    known, out, size = h, None, 1
    done = 0
    while True:
        if n & size:
            m = len(h) - done - size + 1
            out = known[:m].copy() if out is None else out[:m] * power(size) + known[done : done + m]
            done += size
        if done == n:
            return out
        known = known[: len(known) - size] * power(size) + known[size:]
        size *= 2


def join_kept(w: Words, kept: np.ndarray, count: int) -> pa.Array:
    """For each of `count` texts, its words under the mask `kept`, joined by single spaces."""
    start, size = w.start[kept], (w.end - w.start)[kept] + 1
    n = np.bincount(w.owner()[kept], weights=size, minlength=count).astype(np.int64)
    total = int(size.sum())
    at = np.cumsum(size) - size
    index = np.arange(total) + np.repeat(start - at, size)
    data = np.frombuffer(w.buf, np.uint8)[index]
    data[at + size - 1] = 0x20
    ends = np.cumsum(n)
    begin = ends - n
    raw = data.tobytes()
    return pa.array([raw[a : max(a, b - 1)] for a, b in zip(begin.tolist(), ends.tolist(), strict=True)], pa.binary()).cast(pa.string())
