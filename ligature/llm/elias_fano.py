"""Elias-Fano coding of ascending integers, and the token shard format built on it.

A shard holds whole documents in ascending document id order::

    magic "LTS1" | u8 id width | u8 flags | u64 documents, null ids, tokens, base id | u32 sizes
    | Elias-Fano of the document ids | Elias-Fano of the document boundaries | token ids

``boundaries`` are the ends of the documents in the id array. n values up to u take about
n * (2 + log2(u / n)) bits: the low bits of each are packed, the high bits are a bit vector in
which value i sets bit (value >> low) + i, and ``select`` finds the i-th set bit from a sample.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<4sBBQQQqII")
_MAGIC = b"LTS1"
#: Every so many set bits, select keeps a position.
SAMPLE = 256


class EliasFano:
    """An ascending sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        #: The byte of the high bits in which each SAMPLE-th set bit lies, and set bits before it.
        self.at = np.searchsorted(ones, np.arange(0, n, SAMPLE), side="right")
        self.before = ones[self.at] - np.bitwise_count(high[self.at]) if n else np.zeros(0, np.int64)

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        cut = np.zeros((n, low_bits), np.uint8)
        for k in range(low_bits):
            cut[:, k] = (values >> np.uint64(k)) & np.uint64(1)
        high = np.zeros((n + (top >> low_bits) + 8) // 8 if n else 0, np.uint8)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        np.bitwise_or.at(high, places >> 3, (1 << (places & 7)).astype(np.uint8))
        return cls(n, low_bits, np.packbits(cut.ravel(), bitorder="little"), high)

    def to_bytes(self) -> bytes:
        return struct.pack("<QBII", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes | memoryview) -> "EliasFano":
        n, low_bits, a, b = struct.unpack_from("<QBII", raw)
        at = struct.calcsize("<QBII")
        return cls(n, low_bits, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a))

    def _low(self, i: int) -> int:
        bit, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= (int(self.low[(bit + k) >> 3]) >> ((bit + k) & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """The i-th value, from the sample nearest before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, left = int(self.at[i // SAMPLE]), i - int(self.before[i // SAMPLE])
        while (ones := int(self.high[byte]).bit_count()) <= left:
            left -= ones
            byte += 1
        bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        place = 8 * byte + (bits & -bits).bit_length() - 1
        return (place - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        values = (places - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits and self.n:
            bits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
            values |= bits.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return values


class Shard:
    """Documents of a shard: ``doc_ids`` (None for null), ``tokens(i)`` and ``bounds(i)``."""

    def __init__(self, raw: bytes):
        magic, width, _, self.n, self.nulls, self.n_tokens, self.base, a, b = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a token shard")
        at, view = _HEAD.size, memoryview(raw)
        self.ids = EliasFano.from_bytes(view[at : at + a])
        self.ends = EliasFano.from_bytes(view[at + a : at + a + b])
        self.data = np.frombuffer(raw, np.dtype(f"<u{width}"), self.n_tokens, at + a + b)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.ids.select(i - self.nulls) + self.base

    def bounds(self, i: int) -> tuple[int, int]:
        return self.ends.select(i - 1) if i else 0, self.ends.select(i)

    def tokens(self, i: int) -> np.ndarray:
        lo, hi = self.bounds(i)
        return self.data[lo:hi]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.ids.decode() + self.base).tolist()


def write_shard(doc_ids: list[int | None], lengths: np.ndarray, tokens: np.ndarray, width: int) -> bytes:
    """Documents in ascending id order, nulls first; ``tokens`` are those of all, in that order."""
    if len(tokens) and int(tokens.max()) >= 1 << 8 * width:
        raise ValueError(f"id {int(tokens.max())} does not fit {width} bytes")
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    base = int(known[0]) if len(known) else 0
    ids = EliasFano.encode(known.astype(np.uint64) - np.uint64(base % (1 << 64))).to_bytes()
    ends = EliasFano.encode(np.cumsum(lengths)).to_bytes()
    head = _HEAD.pack(_MAGIC, width, 0, len(doc_ids), len(doc_ids) - len(known), len(tokens), base, len(ids), len(ends))
    return head + ids + ends + tokens.astype(f"<u{width}").tobytes()
