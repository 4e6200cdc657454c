"""Arrays as compressed blobs, and grouping and finding of 64-bit keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_ZSTD = pa.Codec("zstd", compression_level=1)


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers or doubles: as narrow as they come, bytes of equal place together, compressed."""
    if a.dtype.kind != "f":
        most = int(a.max(initial=0))
        if not most:  # zeros take no room
            return bytes([1]) + len(a).to_bytes(8, "little")
        a = a.astype(np.min_scalar_type(most))
    raw = np.ascontiguousarray(a.reshape(-1, 1).view(np.uint8).T).tobytes() if len(a) else b""
    kind = {"uint8": 1, "uint16": 2, "uint32": 4, "uint64": 8, "float64": 9}[a.dtype.name]
    return bytes([kind]) + len(a).to_bytes(8, "little") + (_ZSTD.compress(raw, asbytes=True) if raw else b"")


def unpack(raw: bytes) -> np.ndarray:
    kind, n = np.dtype({1: "u1", 2: "u2", 4: "u4", 8: "u8", 9: "f8"}[raw[0]]), int.from_bytes(raw[1:9], "little")
    if len(raw) == 9:
        return np.zeros(n, kind)
    planes = np.frombuffer(_ZSTD.decompress(raw[9:], n * kind.itemsize), np.uint8).reshape(kind.itemsize, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def sorting(keys: np.ndarray) -> np.ndarray:
    """Places of unsigned keys in their order.

    Numbers are sorted several times faster than places, so keys are sorted with
    their places in the low bits: of small keys all bits have room; of others
    the high ones, which tell hashes apart, and where they don't, places are sorted.
    """
    n = len(keys)
    if n < 2:
        return np.zeros(n, np.int64)
    low = np.uint64((n - 1).bit_length())
    mask, keys = (np.uint64(1) << low) - np.uint64(1), keys.astype(np.uint64, copy=False)
    small = keys.max() >> (np.uint64(64) - low) == 0
    line = keys << low if small else keys & ~mask
    line |= np.arange(n, dtype=np.uint64)
    line.sort()
    line &= mask
    order = line.view(np.int64)
    if not small:
        own = keys[order]
        if (own[1:] < own[:-1]).any():
            return np.argsort(keys)
    return order


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sorted, a place of each, and which of them every key is; where runs of equal keys are long, one of each is sorted."""
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    if 4 * np.count_nonzero(new) < 3 * len(keys):
        heads = np.flatnonzero(new)
        distinct, at, which = groups(keys[heads])
        return distinct, heads[at], np.repeat(which, np.diff(heads, append=len(keys)))
    order = sorting(keys)
    line = keys[order]
    np.not_equal(line[1:], line[:-1], out=new[1:])
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    return line[new], order[new], which


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted keys, one at least, and which are there; asked in order, for the cache's sake, and long runs of equal keys once."""
    new = np.ones(len(wanted), bool)
    np.not_equal(wanted[1:], wanted[:-1], out=new[1:])
    if 4 * np.count_nonzero(new) < 3 * len(wanted):
        heads = np.flatnonzero(new)
        often = np.diff(heads, append=len(wanted))
        at, there = find(keys, wanted[heads])
        return np.repeat(at, often), np.repeat(there, often)
    order = sorting(wanted)
    at = np.empty(len(wanted), np.int64)
    at[order] = np.searchsorted(keys, wanted[order])
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted
