"""Word hashing over Arrow string batches, vectorised over bytes.

A word's hash is a polynomial of its bytes modulo 2**64 with random byte values, finished by an
avalanche mix; n-gram hashes combine the word hashes. Both words' alphabets of this package are
unions of ASCII bytes and all bytes of multi-byte characters, so bytes can be classed alone.
Distinct strings share a hash with probability of about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; keeps the temporary 64-bit arrays in cache and memory flat.
CHUNK = 1 << 18

_U = np.uint64
_M1, _M2, _GOLD = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _M1
    x = x ^ (x >> _U(27))
    x = x * _M2
    return x ^ (x >> _U(31))


def _values(is_word: np.ndarray, lower: bool) -> np.ndarray:
    values = mix((np.arange(256, dtype=np.uint64) + _U(1)) * _GOLD)
    if lower:
        values[65:91] = values[97:123]
    values[~is_word] = 0
    return values


def _ascii(pred) -> np.ndarray:
    return np.array([b >= 128 or pred(b) for b in range(256)])


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the hash value of each."""

    is_word: np.ndarray
    values: np.ndarray


def alphabet(pred, lower: bool) -> Alphabet:
    """``pred`` tells for an ASCII byte whether it is part of a word; others always are."""
    w = _ascii(pred)
    return Alphabet(w, _values(w, lower))


#: ``[^\x20\x09-\x0D]+`` over text with A-Z lowered, the same as written, and
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over text with A-Z lowered.
SPACED_LOWER = alphabet(lambda b: not (b == 32 or 9 <= b <= 13), True)
SPACED = alphabet(lambda b: not (b == 32 or 9 <= b <= 13), False)
ALNUM_LOWER = alphabet(lambda b: 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122, True)

_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, _BASE, np.uint64)]))
    return _powers


@dataclass
class Chunk:
    """Words of the documents ``first .. first + len(bounds) - 2`` of a batch.

    Document ``first + i`` has the words ``bounds[i]:bounds[i + 1]``; ``starts`` are their
    positions in ``data``, the bytes of the chunk, and ``offsets`` those of the documents.
    """

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def string_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and its offsets; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64, count=n + 1, offset=texts.offset * 8) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]  # of a slice its own bytes alone


def chunks(texts: pa.Array, kind: Alphabet, size: int = CHUNK) -> Iterator[Chunk]:
    """Hash the words of a batch, some ``size`` bytes of whole documents at a time."""
    raw, offsets = string_bytes(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n)
        lo, hi = int(offsets[at]), int(offsets[end])
        yield _hash(raw[lo:hi], offsets[at : end + 1] - lo, kind, at)
        at = end


def _hash(data: np.ndarray, offsets: np.ndarray, kind: Alphabet, first: int) -> Chunk:
    is_word = kind.is_word[data]
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1]
    inner = offsets[offsets < len(data)]
    begins[inner] = is_word[inner]
    starts = np.flatnonzero(begins)
    bounds = np.searchsorted(starts, offsets)
    if not len(starts):
        return Chunk(first, bounds, np.zeros(0, np.uint64), starts, data, offsets)
    gaps = np.diff(starts, append=len(data))
    values = kind.values[data[starts[0] :]]
    inside = np.arange(len(values), dtype=np.int64)
    inside -= np.repeat(starts - starts[0], gaps)
    values *= _power(int(gaps.max()))[inside]
    hashes = mix(np.add.reduceat(values, starts - starts[0]))
    return Chunk(first, bounds, hashes, starts, data, offsets)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; position i is the run that starts at word i."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, n, np.uint64) * _GOLD
    for k in range(n):
        out = mix(out + hashes[k : k + count] * _GOLD)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return x.view(np.int64)


def ragged(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
