"""Best-fit-decreasing packing of tokenised documents into sequences of fixed capacity.

Best fit decreasing places pieces from long to short, each into the open sequence with the least
room that still holds it. Pieces of one length are alike, so the placement is worked out on the
histogram of lengths, which has as many entries as the capacity however large the corpus: a
segment tree over remaining capacities finds the tightest open sequence in logarithmic time, and
runs of alike sequences move together. The runs say where the k-th piece of each length goes;
the k is counted per task and made global by per-task totals, a row of ``capacity`` numbers per
task. Pieces are not shuffled while these fit a broadcast of checked size (about a thousand tasks);
beyond, Spark shuffles the pieces by their task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, ship, small_side
from .rowwise import trim
from .tokens import MEMO_WORDS, Facts, memo

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class CapacityTree:
    """A segment tree that holds the number of open sequences for each remaining capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = self.size + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int | None:
        """The least room of at least ``length`` that an open sequence has."""
        at = self.size + length
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Per length, runs (first piece, pieces per sequence, first sequence, offset), by first piece.

    The placement is that of best fit decreasing piece by piece. A sequence with room r takes
    r // length pieces before any other, since each leaves it the tightest.
    """
    tree, rooms = CapacityTree(capacity), {}  # room: [(first sequence, sequences)]
    opened, runs = 0, {}
    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left, nth, out = counts[length], 0, []
        while left:
            room = tree.tightest(length)
            if room is None:
                room, at_once = capacity, capacity // length
                first, n = opened, -(-left // at_once)
                opened += n
            else:
                first, n = rooms[room].pop()
                tree.add(room, -n)
            each = room // length
            used = min(n, left // each)
            tail = min(left - used * each, each - 1) if used < n else 0
            if used:
                out.append((nth, each, first, capacity - room))
                _open(tree, rooms, room - each * length, first, used)
            if tail:
                out.append((nth + used * each, tail, first + used, capacity - room))
                _open(tree, rooms, room - tail * length, first + used, 1)
            rest = n - used - bool(tail)
            if rest:
                _open(tree, rooms, room, first + used + bool(tail), rest)
            placed = used * each + tail
            left, nth = left - placed, nth + placed
        runs[length] = np.array(out, np.int64)
    return runs


def _open(tree: CapacityTree, rooms: dict, room: int, first: int, n: int) -> None:
    if room:
        rooms.setdefault(room, []).append((first, n))
        tree.add(room, n)


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Tokenise, append ``end_id`` and cut what is longer than ``capacity``.

    All pieces of a cut document are full but the first. ``nth`` numbers the pieces of a length
    within their task ``part``.
    """
    ship(docs.sparkSession)
    facts = Facts.of(tokenizer)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = memo(tokenizer, memo_words, facts), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                some = batch.slice(i, 512)
                rows = []
                for d, b in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                    b += end
                    n = len(b) // 4
                    lo, hi, k = 0, n % capacity or min(n, capacity), 0
                    while lo < n:
                        one = b[4 * lo : 4 * hi]
                        rows.append((d, k, lo, hi - lo, zlib.crc32(one), part, seen[hi - lo], one if with_ids else None))
                        seen[hi - lo] += 1
                        lo, hi, k = hi, hi + capacity, k + 1
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=False)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]
                if with_ids:
                    arrays.append(pa.array(cols[7], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def _dense(capacity: int):
    """From a task's rows (length, base) to one row with the base of every length."""

    def run(rows: pa.Table) -> pa.Table:
        bases = np.zeros(capacity, np.int64)
        bases[rows["length"].to_numpy() - 1] = rows["base"].to_numpy()
        return pa.table({"of": rows["part"].slice(0, 1), "bases": pa.array([bases], pa.list_(pa.int64()))})

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there; sequences have no gaps.

    Null texts are empty and hold the end id alone; rows with the same or a null id are packed
    each for itself; which of several pieces of one length goes where follows from their tasks and
    their order there; an empty table gives no rows; other columns are not read. ``with_ids`` adds
    the ids as little-endian unsigned 32-bit integers, for ``sequences``. ``memo_words`` bounds the
    words whose ids a worker keeps; it changes the time and the memory, not the result.
    """
    made = materialize(pieces(docs, tokenizer, end_id, capacity, id_col, text_col, with_ids, memo_words), "pieces")
    by_task = materialize(made.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = materialize(by_task.withColumn("base", F.coalesce(before, F.lit(0))).groupBy("part").applyInArrow(_dense(capacity), "of int, bases array<long>"), "piece-bases")
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan(counts, capacity)
    ranked = made.join(small_side(bases), F.col("part") == F.col("of")).withColumn("base", F.element_at("bases", F.col("length").cast("int"))).drop("of", "bases", "part")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            nth = batch.column("nth").to_numpy() + batch.column("base").to_numpy()
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for k in np.unique(length):
                own = length == k
                run = runs[int(k)]
                r = run[np.searchsorted(run[:, 0], nth[own], "right") - 1]
                past = nth[own] - r[:, 0]
                sequence[own] = r[:, 2] + past // r[:, 1]
                offset[own] = r[:, 3] + past % r[:, 1] * k
            arrays = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(sequence), pa.array(offset)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                arrays.append(batch.column("ids"))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return ranked.mapInArrow(place, _PLACED + ", ids binary" * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack(..., with_ids=True)``: sequence_id, n_tokens, ids.

    A group is one sequence, so it holds ``capacity`` ids at most.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    return rows.select("sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p.length).alias("n_tokens"), F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p.ids)).alias("ids"))
