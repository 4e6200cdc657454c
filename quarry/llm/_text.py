"""Vectorised tokenising and hashing of Arrow text batches.

Every function works on one chunk: the UTF-8 bytes of some rows, one space
after each row.  A word's hash takes its bytes eight at a time through a bit
mixer (beyond 64 bytes it is a BLAKE2 digest); FIRST and SECOND mix from other
states, so they fail independently.  Runs of words are hashed as polynomials of
their words' hashes modulo 2**64 with an odd base, so that the hash of any run
follows from two prefix sums and the inverse power of the base at its start.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
U64 = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of BASE and of its inverse, shared by all hashes; they grow as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(10, (n - 1).bit_length())
            for name, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                full = np.full(size, b, U64)
                full[0] = 1
                setattr(self, name, np.multiply.accumulate(full))


POWERS = Powers()


class Poly:
    """Hashes of words, and of runs of 64-bit values; the state that mixing starts from tells two of them apart."""

    def __init__(self, seed: int):
        self.seed = U64(seed * 0xC2B2AE3D27D4EB4F % (1 << 64))
        self.key = seed.to_bytes(8, "little")

    def words(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of byte spans, those of a block of bytes at a time."""
        out, i = np.empty(len(lo), U64), 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(lo, lo[i] + CHUNK_BYTES)))
            a, n = lo[i], hi[i:j] - lo[i:j]
            eight, at = windows(data[a : int(lo[j - 1]) + WIDEST]), lo[i:j] - a
            h = mix(mix(n.astype(U64) * U64(0x9E3779B97F4A7C15) + self.seed) ^ (eight[at] & MASKS[np.minimum(n, 8)]))
            more, step = np.flatnonzero(n > 8), 8
            while len(more) and step < WIDEST:
                h[more] = mix(h[more] * U64(0xD6E8FEB86659FD93) ^ (eight[at[more] + step] & MASKS[np.minimum(n[more] - step, 8)]))
                step += 8
                more = more[n[more] > step]
            for k in more.tolist():
                h[k] = int.from_bytes(hashlib.blake2b(data[lo[i + k] : hi[i + k]], digest_size=8, key=self.key).digest(), "little")
            out[i:j] = h
            i = j
        return out

    def prefix(self, values: np.ndarray) -> np.ndarray:
        POWERS.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * POWERS.up[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((prefix[hi] - prefix[lo]) * POWERS.down[lo])

    def grams(self, values: np.ndarray, k: int) -> np.ndarray:
        """The hash of every run of k values, by its first index."""
        if len(values) < k:
            return np.zeros(0, U64)
        p = self.prefix(values)
        return mix((p[k:] - p[:-k]) * POWERS.down[: len(values) - k + 1])


FIRST, SECOND = Poly(1), Poly(2)
WIDEST = 64
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one little-endian number; zeros follow the last byte."""
    two = np.zeros(len(data) + 8, np.uint16)
    two[: len(data)] = data
    two[:-1] |= two[1:] << 8
    four = two.astype(np.uint32)
    four[:-2] |= four[2:] << 16
    eight = four.astype(U64)
    eight[:-4] |= eight[4:] << U64(32)
    return eight


# Bytes that end a word: ASCII white space; all but a-z, 0-9 and non-ASCII.
SPACE_ENDS = np.ones(256, bool)
SPACE_ENDS[[0x20, *range(0x09, 0x0E)]] = False
ALNUM_ENDS = np.zeros(256, bool)
ALNUM_ENDS[0x30:0x3A] = ALNUM_ENDS[0x61:0x7B] = ALNUM_ENDS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def as_array(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    return column


def chunks(text, target: int = CHUNK_BYTES, rows: int = 4096) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): at most ``rows`` rows of about ``target`` bytes; each row's bytes end in one space, null is empty."""
    arr = pc.fill_null(as_array(text).cast(pa.large_binary()), b"")
    if not len(arr):
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    raw = arr.buffers()[2]
    raw = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        hi = min(hi, len(arr), lo + rows)
        own = offs[lo : hi + 1] - offs[lo]
        out = np.full(int(own[-1]) + hi - lo, 0x20, np.uint8)
        keep = np.ones(len(out), bool)
        keep[own[1:] + np.arange(hi - lo)] = False
        out[keep] = raw[offs[lo] : offs[hi]]
        yield lo, hi, out, own + np.arange(hi - lo + 1)
        lo = hi


class Words:
    """The words of a chunk: byte spans and, for row i, words first[i]..first[i+1]."""

    __slots__ = ("data", "ends", "first", "starts")

    def __init__(self, data: np.ndarray, offs: np.ndarray, kind: np.ndarray = SPACE_ENDS, lower: bool = False):
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 1, np.int8)
        inside[1:] = kind[self.data]
        if kind is not SPACE_ENDS:
            inside[offs[1:]] = 0
        edge = np.diff(inside)
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.searchsorted(self.starts, offs)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, poly: Poly = FIRST) -> np.ndarray:
        return poly.words(self.data, self.starts, self.ends)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def ragged(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the concatenated spans, and the offsets of each in the result."""
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    return np.repeat(np.asarray(starts, np.int64) - offs[:-1], lens) + np.arange(offs[-1]), offs


def joined(words: Words, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words, each followed by one space, and the offsets of the rows in them."""
    at, offs = ragged(words.starts[kept], words.ends[kept] - words.starts[kept] + 1)
    data = words.data[at] if len(at) else np.zeros(0, np.uint8)
    data[offs[1:] - 1] = 0x20
    n = np.concatenate([[0], np.cumsum(kept)])[words.first]
    return data, offs[n]


def tidy() -> None:
    """Gives memory back to the system: Python workers live on, and other tasks follow in them."""
    POWERS.__init__()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """The function of an Arrow stage, which tidies up when its task ends."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return whole


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
