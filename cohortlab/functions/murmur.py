"""MurmurHash3 (x86, 32 bits, seed 0, unsigned) of strings, vectorised over Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_C1, _C2, _M = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return ((x << np.uint64(r)) | (x >> np.uint64(32 - r))) & np.uint64(_M)


def _mul(x: np.ndarray, c: int) -> np.ndarray:
    return (x * np.uint64(c)) & np.uint64(_M)


def murmur32(keys: list[str | None]) -> np.ndarray:
    """Hashes of keys; None hashes like the empty string (callers keep nulls apart)."""
    raw = [(k or "").encode() for k in keys]
    size = np.array([len(r) for r in raw], np.int64)
    if not len(raw):
        return np.zeros(0, np.int64)
    width = int(-(-max(1, int(size.max())) // 4) * 4)
    block = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), "<u4").reshape(len(raw), -1).astype(np.uint64)
    h = np.zeros(len(raw), np.uint64)
    for j in range(block.shape[1]):
        k = _mul(_rot(_mul(block[:, j], _C1), 15), _C2)
        full = size >= 4 * (j + 1)
        tail = (size > 4 * j) & ~full
        mixed = h ^ k
        h = np.where(full, (_rot(mixed, 13) * np.uint64(5) + np.uint64(0xE6546B64)) & np.uint64(_M), np.where(tail, mixed, h))
    h ^= size.astype(np.uint64)
    h ^= h >> np.uint64(16)
    h = _mul(h, 0x85EBCA6B)
    h ^= h >> np.uint64(13)
    h = _mul(h, 0xC2B2AE35)
    h ^= h >> np.uint64(16)
    return h.astype(np.int64)


def _scrambled(k: np.ndarray) -> np.ndarray:
    k = k * np.uint32(_C1)
    return ((k << np.uint32(15)) | (k >> np.uint32(17))) * np.uint32(_C2)


class Prefixed:
    """Hashes of the same keys under many prefixes: what depends on the keys alone is worked out once for each
    place, of four, that a prefix gives them in a word."""

    def __init__(self, keys: list[str]):
        raw = [k.encode() for k in keys]
        size = np.array([len(r) for r in raw], np.int64)
        self.n, self.words = len(raw), {}
        self.own = [(int(s), np.flatnonzero(size == s)) for s in np.unique(size)]
        self.bytes = [np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), s) for s, at in self.own]

    def _placed(self, group: int, shift: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """The first word as it is, for a prefix may fill its start, and the others scrambled."""
        if (group, shift) not in self.words:
            s, at = self.own[group]
            wide = np.zeros((len(at), -(-(shift + s) // 4) * 4), np.uint8)
            wide[:, shift : shift + s] = self.bytes[group]
            w = np.ascontiguousarray(wide.view("<u4").T)
            self.words[group, shift] = list(w[:1]), [_scrambled(x) for x in w[1:]]
        return self.words[group, shift]

    def hashes(self, prefix: bytes) -> np.ndarray:
        shift, h0 = len(prefix) % 4, 0
        head, rest = prefix[: len(prefix) - shift], int.from_bytes(prefix[len(prefix) - shift :], "little")
        for (k,) in struct.iter_unpack("<I", head):
            k = k * _C1 & _M
            h0 ^= ((k << 15 | k >> 17) & _M) * _C2 & _M
            h0 = ((h0 << 13 | h0 >> 19) & _M) * 5 + 0xE6546B64 & _M
        out = np.empty(self.n, np.uint32)
        for g, (s, at) in enumerate(self.own):
            first, others = self._placed(g, shift)
            h = np.full(len(at), h0, np.uint32)
            for j, k in enumerate([_scrambled(x | np.uint32(rest)) for x in first] + others):
                h ^= k
                if shift + s >= 4 * (j + 1):
                    h = ((h << np.uint32(13)) | (h >> np.uint32(19))) * np.uint32(5) + np.uint32(0xE6546B64)
            h ^= np.uint32(len(prefix) + s)
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(16)
            if len(self.own) == 1:
                return h
            out[at] = h
        return out


@F.pandas_udf(LongType())
def _murmur(keys: pd.Series) -> pd.Series:
    out = pd.Series(murmur32([k if isinstance(k, str) else None for k in keys]), index=keys.index, dtype="Int64")
    return out.mask(keys.isna())


def murmur(*parts: Column | str) -> Column:
    """Hash of the parts joined by underscores; null if any part is null."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    joined = F.concat(*[c for i, x in enumerate(cols) for c in ([F.lit("_")] if i else []) + [x.cast("string")]])
    return _murmur(joined)


def uniform(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from the hash of the parts."""
    return murmur(*parts) / F.lit(4294967296.0)
