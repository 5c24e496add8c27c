"""Scaffolding: contig ends matched by score, paths through the matches, sequences.

Ends are numbered 2k (left) and 2k + 1 (right) for the k-th contig of a bin. Bins are independent
groups; within a bin, matching is a sequence of choices and runs in one kernel.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import ship

_PATHS = "bin string, scaffold int, rank int, nth int, is_reverse boolean, circular boolean"


def match_ends(scores: Iterable[tuple[int, int, float]], threshold: float, sure: float = 5.0) -> list[tuple[int, int]]:
    """Pairs of ends, each end once, by falling score.

    An end with a single candidate above the threshold comes first if its score exceeds
    ``sure`` times the threshold, the best of such; else the best of all, in row order on ties.
    Only scores above the threshold are held, in two heaps: all, and those of ends with one left.
    """
    near: dict[int, dict[int, float]] = {}
    for i, j, s in scores:
        if i // 2 != j // 2 and s > threshold:
            near.setdefault(i, {})[j] = near.setdefault(j, {})[i] = s
    every = [(-s, i, j) for i, row in near.items() for j, s in row.items() if i < j]
    alike: dict[float, list[tuple[int, int]]] = {}
    for s, i, j in sorted(every, reverse=True):
        alike.setdefault(-s, []).append((i, j))  # popped in row order
    heapq.heapify(every)
    lone = [e for e in every if len(near[e[1]]) == 1 or len(near[e[2]]) == 1]
    heapq.heapify(lone)

    def top(heap: list[tuple[float, int, int]]) -> float:
        while heap and heap[0][2] not in near.get(heap[0][1], ()):
            heapq.heappop(heap)
        return -heap[0][0] if heap else 0.0

    pairs = []
    while (best := top(every)) > threshold:
        single = top(lone)
        same = alike[single if single > sure * threshold else best]
        i, j = same.pop()
        while j not in near.get(i, ()):
            i, j = same.pop()
        pairs.append((i, j))
        for end in (i, j):
            for other in near.pop(end):
                if other in near:
                    del near[other][end]
                    if len(near[other]) == 1:
                        (last, s), = near[other].items()
                        heapq.heappush(lone, (-s, min(other, last), max(other, last)))
    return pairs


def paths(n: int, pairs: list[tuple[int, int]]) -> list[tuple[int, int, int, bool, bool]]:
    """(scaffold, rank, contig, is_reverse, circular) along the matched ends.

    A scaffold with two free ends starts at the lower of them; one without starts at its lowest
    end and is circular. A contig is reversed if it is entered by its right end. Scaffolds are in
    the order of their lowest contig.
    """
    mate = dict(pairs) | {b: a for a, b in pairs}
    seen: set[int] = set()
    rows, made = [], 0
    for k in range(n):
        if k in seen:
            continue
        group, stack = {k}, [k]
        while stack:
            c = stack.pop()
            for e in (2 * c, 2 * c + 1):
                if e in mate and mate[e] // 2 not in group:
                    group.add(mate[e] // 2)
                    stack.append(mate[e] // 2)
        free = [e for c in sorted(group) for e in (2 * c, 2 * c + 1) if e not in mate]
        at, circular = (free[0], False) if free else (2 * min(group), True)
        for rank in range(len(group)):
            seen.add(at // 2)
            rows.append((made, rank, at // 2, bool(at % 2), circular))
            at = mate.get(at ^ 1, -1)
        made += 1
    return rows


def scaffolds(scores: DataFrame, contigs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """bin, scaffold, rank, nth, is_reverse, circular from (bin, end_i, end_j, score).

    ``contigs`` has bin and nth, from 0 in each bin; contigs without a score are scaffolds alone.
    """
    ship(scores.sparkSession)
    ends = scores.where(F.col("score") > threshold).select("bin", "end_i", "end_j", "score")
    own = contigs.select("bin", (F.col("nth") * 2).alias("end_i"), F.lit(-1).cast("long").alias("end_j"), F.lit(0.0).alias("score"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        listed = pdf["end_j"] < 0
        n = int(listed.sum())
        rows = paths(n, match_ends(sorted(pdf.loc[~listed, ["end_i", "end_j", "score"]].itertuples(index=False, name=None)), threshold))
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["bin", "scaffold", "rank", "nth", "is_reverse", "circular"]).astype({"scaffold": "int32", "rank": "int32", "nth": "int32"})

    return ends.unionByName(own).groupBy("bin").applyInPandas(solve, _PATHS)


def scaffold_table(placed: DataFrame, contigs: DataFrame, prefix: str = "scaffold") -> DataFrame:
    """One row per contig of a scaffold: bin, scaffold (name), rank, name, start, end, strand."""
    own = placed.join(contigs.select(F.col("bin").alias("_b"), F.col("nth").alias("_n"), "name", "size"), (F.col("bin") == F.col("_b")) & (F.col("nth") == F.col("_n")))
    return own.select("bin", F.format_string(prefix + "_%04d", F.col("scaffold") + 1).alias("scaffold"), "rank", "name", F.lit(0).cast("long").alias("start"), F.col("size").alias("end"), F.when(F.col("is_reverse"), -1).otherwise(1).alias("strand"), "circular")


def scaffold_sequences(table: DataFrame, seqs: DataFrame, junction: str = "NNNNN") -> DataFrame:
    """bin, scaffold, length, seq: the contigs in order and orientation, joined by ``junction``."""
    from ..functions.sequences import reverse_complement

    own = table.join(seqs.select(F.col("name").alias("_s"), "seq"), F.col("name") == F.col("_s"))
    part = F.struct("rank", F.when(F.col("strand") < 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("part"))
    rows = own.groupBy("bin", "scaffold").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.part), junction).alias("seq"))
    return rows.select("bin", "scaffold", F.char_length("seq").cast("long").alias("length"), "seq")


def numbered(contigs: DataFrame, group: str = "bin", order: str = "id") -> DataFrame:
    """Adds nth, from 0 in each group."""
    return contigs.withColumn("nth", (F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1).cast("long"))
