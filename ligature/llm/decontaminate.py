"""Benchmark passages in documents: a prefix-filtered containment join of word windows.

A window is ``window`` consecutive words of an item (the whole item if shorter), seen as the set
of its ``shingle``-word shingles. A document contains a window only if it contains all of them,
so the necessary prefix of each window is one shingle: the rarest in the documents, by counts
over all of them. Document positions are joined with these prefix shingles only; the place of
the shingle in its window gives where the window must start (positional bound) and end (length
bound); the words there are then compared one by one.

The benchmark side is held in blocks of ``block_bytes`` of item text. They are built in tasks and
kept as a table, as are the counts of their shingles; the driver passes one block after the other
on to the workers. A task, and the driver, hold one block in memory at a time, so any number of
items is matched exactly, and documents never move.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, scratch, ship
from . import words as W
from .rowwise import SLICE_ROWS, per_document, trim

_COLUMNS = "n_words long, n_hit long, items array<string>, spans array<int>"
_BITS = 20


class Block:
    """Windows of some items, their shingles, and the prefix shingle of each window."""

    def __init__(self, item_ids: list[str], texts: list[str | None], window: int, shingle: int):
        seen: dict[tuple, set[str]] = {}
        for c in W.chunks(pa.array(texts, pa.large_string()), W.ALNUM_LOWER):
            for i in range(len(c.bounds) - 1):
                h = c.hashes[c.bounds[i] : c.bounds[i + 1]]
                for at in range(max(1, len(h) - window + 1) if len(h) else 0):
                    seen.setdefault(tuple(h[at : at + window].tolist()), set()).add(item_ids[c.first + i])
        self.windows = [np.array(k, np.uint64) for k in seen]
        self.items = [sorted(v) for v in seen.values()]
        #: By shingle length: the sorted hashes of all shingles, and a filter on their first bits.
        self.keys: dict[int, np.ndarray] = {}
        self._of: list[tuple[int, np.ndarray]] = []
        by_size: dict[int, list[np.ndarray]] = {}
        for w in self.windows:
            q = min(shingle, len(w))
            g = W.grams(w, q)
            self._of.append((q, g))
            by_size.setdefault(q, []).append(g)
        self.keys = {q: np.unique(np.concatenate(g)) for q, g in by_size.items()}

    def choose(self, counts: dict[int, np.ndarray]) -> "Index":
        """``counts``: by shingle length, how often documents hold each of ``keys``."""
        chosen = {}
        for w, (q, g) in enumerate(self._of):
            n = counts[q][np.searchsorted(self.keys[q], g)]
            at = int(np.lexsort((g, n))[0])
            chosen.setdefault(q, []).append((int(g[at]), w, at))
        return Index(self.windows, self.items, chosen)


class Index:
    """Prefix shingles and the windows they lead to."""

    def __init__(self, windows: list[np.ndarray], items: list[list[str]], chosen: dict[int, list[tuple[int, int, int]]]):
        self.length = np.array([len(w) for w in windows], np.int64)
        self.words = np.zeros((len(windows), int(self.length.max(initial=1))), np.uint64)
        for i, w in enumerate(windows):
            self.words[i, : len(w)] = w
        self.items = items
        self.prefix = {}
        for q, rows in chosen.items():
            rows.sort()
            hashes = np.array([r[0] for r in rows], np.uint64)
            keys, first = np.unique(hashes, return_index=True)
            self.prefix[q] = (keys, np.append(first, len(rows)), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), first_bits(keys))

    def hits(self, c: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in the chunk: (start word, window), each verified word by word."""
        starts, found = [], []
        ends = c.bounds[1:]
        for q, (keys, first, window, place, bits) in self.prefix.items():
            g = W.grams(c.hashes, q)
            at, key = lookup(g, keys, bits)
            n = first[key + 1] - first[key]
            rows = np.repeat(first[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            w = window[rows]
            shingle = np.repeat(at, n)
            start = shingle - place[rows]
            doc = np.searchsorted(ends, shingle, "right")
            fits = (start >= c.bounds[doc]) & (start + self.length[w] <= ends[doc])
            start, w = start[fits], w[fits]
            for size in np.unique(self.length[w]):
                of = self.length[w] == size
                s, v = start[of], w[of]
                same = (c.hashes[s[:, None] + np.arange(size)] == self.words[v, :size]).all(axis=1)
                starts.append(s[same])
                found.append(v[same])
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *found])


def first_bits(keys: np.ndarray) -> np.ndarray:
    bits = np.zeros(1 << _BITS, bool)
    bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return bits


def lookup(g: np.ndarray, keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``g`` whose value is among the sorted ``keys``, and which it is."""
    maybe = np.flatnonzero(bits[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
    key = np.minimum(np.searchsorted(keys, g[maybe]), len(keys) - 1)
    same = keys[key] == g[maybe] if len(keys) else np.zeros(0, bool)
    return maybe[same], key[same]


def _rarity(docs: DataFrame, text_col: str, keys: list[tuple[int, Broadcast]]) -> DataFrame:
    """block, size, key, n: occurrences of every block's shingles in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        step = SLICE_ROWS if len(keys) < 2 else None
        for batch in (part.slice(at, step or part.num_rows) for part in batches for at in range(0, part.num_rows, step or max(part.num_rows, 1))):
            made = list(W.chunks(batch.column(0), W.ALNUM_LOWER))
            for b, held in keys:
                for q, k in held.value.items():
                    total = sums.setdefault((b, q), np.zeros(len(k), np.int64))
                    bits = first_bits(k)
                    for c in made:
                        g = W.grams(c.hashes, q)
                        at, key = lookup(g, k, bits)
                        doc = np.searchsorted(c.bounds[1:], at, "right")
                        total += np.bincount(key[at + q <= c.bounds[1:][doc]], minlength=len(k))
                _forget(held, len(keys))
        for (b, q), total in sums.items():
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(i), b, np.int32)), "size": pa.array(np.full(len(i), q, np.int32)), "key": i, "n": total[i]})
        trim()

    counted = docs.select(text_col).mapInArrow(count, "block int, size int, key long, n long")
    return counted.groupBy("block", "size", "key").agg(F.sum("n").alias("n"))


def _build(window: int, shingle: int) -> Callable[[pa.Table], pa.Table]:
    """From the items of a block to the block."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("item", "ascending"), ("text", "ascending")])
        block = Block(rows["item"].to_pylist(), rows["text"].to_pylist(), window, shingle)
        return pa.table({"block": rows["block"].slice(0, 1), "made": [pickle.dumps(block)], "keys": [pickle.dumps(block.keys)]})

    return run


def _choose(blocks: pa.Table, counted: pa.Table) -> pa.Table:
    """From a block and the counts of its shingles to its index."""
    block = pickle.loads(blocks["made"][0].as_py())
    counts = {q: np.zeros(len(k), np.int64) for q, k in block.keys.items()}
    size, key, n = (counted[c].to_numpy() for c in ("size", "key", "n"))
    for q, total in counts.items():
        total[key[size == q]] = n[size == q]
    return pa.table({"block": blocks["block"], "made": [pickle.dumps(block.choose(counts))]})


def _passed_on(table: DataFrame, column: str) -> list[tuple[int, Broadcast]]:
    """The blocks of a table, broadcast one after the other."""
    sc = table.sparkSession.sparkContext
    numbers = sorted(r.block for r in table.select("block").collect())
    return [(b, sc.broadcast(pickle.loads(table.where(F.col("block") == b).select(column).first()[0]))) for b in numbers]


def _forget(value: Broadcast, n_blocks: int) -> None:
    """Let go of one block before the next is loaded."""
    if n_blocks > 1 and hasattr(value, "_value"):
        del value._value


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = 13, shingle: int = 5, share: tuple[int, int] = (1, 20), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 8 << 20, carry: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (ids as strings, in string order),
    spans (hit words as start, end, start, end, ...) and contaminated.

    A document is contaminated if at least ``share`` of its words are hit, and one is. Null and
    empty texts have no words; items without an id or a word have no windows; items that share an
    id count once; repeated rows each get their row; with an empty benchmark nothing is hit.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    block = F.pmod(F.xxhash64("item", "text"), F.lit(max(1, -(-size // block_bytes)))).cast("int")
    with scratch():
        made = materialize(items.distinct().withColumn("block", block).groupBy("block").applyInArrow(_build(window, shingle), "block int, made binary, keys binary"), "benchmark-blocks")
        counts = materialize(_rarity(docs, text_col, _passed_on(made, "keys")), "benchmark-counts")
        chosen = made.select("block", "made").groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_choose, "block int, made binary")
        indexes = [index for _, index in _passed_on(materialize(chosen, "benchmark-indexes"), "made")]
    num, den = share

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            made = list(W.chunks(texts, W.ALNUM_LOWER))
            cover = [np.zeros(len(c.hashes) + 1, np.int32) for c in made]
            named: list[set[str]] = [set() for _ in range(len(texts))]
            for index in indexes:
                one = index.value
                for c, d in zip(made, cover, strict=True):
                    start, w = one.hits(c)
                    np.add.at(d, start, 1)
                    np.add.at(d, start + one.length[w], -1)
                    doc = c.first + np.searchsorted(c.bounds[1:], start, "right")
                    for i, v in set(zip(doc.tolist(), w.tolist(), strict=True)):
                        named[i].update(one.items[v])
                _forget(index, len(indexes))
            n_words, n_hit, spans = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [[] for _ in range(len(texts))]
            for c, d in zip(made, cover, strict=True):
                hit = np.cumsum(d[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                own = slice(c.first, c.first + len(c.bounds) - 1)
                n_words[own] = np.diff(c.bounds)
                n_hit[own] = total[c.bounds[1:]] - total[c.bounds[:-1]]
                for i in np.flatnonzero(n_hit[own]):
                    lo, hi = c.bounds[i], c.bounds[i + 1]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], hit[lo:hi].astype(np.int8), [0]])))
                    spans[c.first + i] = turn.tolist()
            return [pa.array(n_words), pa.array(n_hit), pa.array([sorted(x) for x in named], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]

        return kernel

    # A block is loaded once for each kernel call, so with several a call gets a whole batch.
    found = per_document(docs, make, _COLUMNS, id_col, text_col, carry, SLICE_ROWS if len(indexes) < 2 else None)
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words")))
