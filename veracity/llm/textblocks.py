"""Vectorised tokenising and hashing of Arrow text columns.

An Arrow string column is one UTF-8 buffer plus offsets, so a whole batch is
tokenised with a handful of numpy operations.  Words are maximal runs of
bytes outside a separator set and never cross a document border.  Hashes are
64 bits wide and depend on the word's bytes only.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The white space of the contracts' word pattern [^\x20\x09-\x0D]+.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
# ASCII separators for feature words: everything but letters and digits.
NON_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())

_RNG = np.random.default_rng(20240131)
_BYTE_CODES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE_CODES[65:91] = _BYTE_CODES[97:123]  # A-Z hash like a-z
_RADIX = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 21  # bytes hashed at once, bounds the temporary arrays

#: Bytes of text per slice that the operators process at once.
SLICE_BYTES = 4 << 20


class Words(NamedTuple):
    """Words of a batch: byte ranges, hashes, and each document's first word."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # len(docs) + 1 positions into the word arrays

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(column, size: int = SLICE_BYTES):
    """Row ranges (lo, hi) whose texts hold about ``size`` bytes, one row at least."""
    _, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche finaliser on 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def tokenize(column, separators: bytes = SPACES) -> Words:
    """Words of every text with lower-cased (A-Z) hashes."""
    data, at = utf8(column)
    gap = np.zeros(256, bool)
    gap[list(separators)] = True
    inside = ~gap[data]
    head = np.zeros(len(data) + 1, bool)
    head[at] = True  # a document border splits words
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | head[1:-1]
    starts = np.flatnonzero(begins)
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | head[1:-1]
    ends = np.flatnonzero(stops) + 1
    return Words(starts, ends, _hash(data, starts, ends), np.searchsorted(starts, at))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    powers = np.full(int(sizes.max()), _RADIX, np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    run = np.cumsum(sizes)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(run, (run[lo - 1] if lo else 0) + _CHUNK, "right")))
        n = sizes[lo:hi]
        base = np.cumsum(n) - n
        inner = np.arange(int(n.sum())) - np.repeat(base, n)
        at = inner + np.repeat(starts[lo:hi], n)
        out[lo:hi] = np.add.reduceat(_BYTE_CODES[data[at]] * powers[inner], base)
        lo = hi
    return mix(out + sizes.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def chain(*parts: np.ndarray, salt: int = 0) -> np.ndarray:
    """Order-sensitive hash of aligned arrays of hashes."""
    acc = np.full(len(parts[0]), (salt * 0x2545F4914F6CDD1D + 1) % 2**64, np.uint64)
    for p in parts:
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + p
    return mix(acc)


def shingles(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word windows and each document's first window.

    A document with fewer words gives its whole sequence as one window; one
    without words gives none.
    """
    counts = words.counts
    per_doc = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.zeros(int(first[-1]), np.uint64)
    h = words.hashes
    if len(h) >= n:
        windows = chain(*(h[k:len(h) - n + 1 + k] for k in range(n)), salt=n)
        full = np.flatnonzero(counts >= n)
        if len(full):
            k = per_doc[full]
            inner = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
            out[np.repeat(first[full], k) + inner] = windows[np.repeat(words.first[full], k) + inner]
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        seq = h[words.first[d]:words.first[d + 1]]
        out[first[d]] = chain(*(seq[k:k + 1] for k in range(len(seq))), salt=len(seq))[0]
    return out, first


def stems(column, words: Words, size: int) -> np.ndarray:
    """Hashes of the first ``size`` bytes of each word."""
    data, _ = utf8(column)
    return _hash(data, words.starts, np.minimum(words.ends, words.starts + size))


def crc_held_out(column: str = "doc_id", modulus: int = 7, remainder: int = 2) -> str:
    """SQL for ``crc32(<column> as text) mod modulus = remainder``; a null id counts as ''."""
    return f"pmod(crc32(cast(coalesce(cast({column} as string), '') as binary)), {modulus}) = {remainder}"
