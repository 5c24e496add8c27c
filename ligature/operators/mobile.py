"""Mobile elements: contacts between contigs, greedy binning, hosts."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, ship
from .components import connected_components


def element_contacts(pairs: DataFrame, elements: DataFrame, min_gap: int = 1000) -> DataFrame:
    """i <= j and n: contacts between listed contigs (id); within one only beyond ``min_gap``."""
    one, two = elements.select(F.col("id").alias("_i1")), elements.select(F.col("id").alias("_i2"))
    both = pairs.join(one, F.col("c1") == F.col("_i1"), "left_semi").join(two, F.col("c2") == F.col("_i2"), "left_semi")
    far = both.where((F.col("c1") != F.col("c2")) | (F.abs(F.col("pos1") - F.col("pos2")) > min_gap))
    return far.groupBy(F.least("c1", "c2").alias("i"), F.greatest("c1", "c2").alias("j")).agg(F.count("*").alias("n"))


def merge_greedily(contacts: Iterable[tuple[int, int, float]], threshold: float) -> list[tuple[int, int, float]]:
    """The merges (i, j, score) of one sparse matrix (i <= j, n), best score first.

    Scores are contacts over the root of both diagonals (0 if one is 0). While the best exceeds
    the threshold, the first such pair in row order merges: j's contacts go to i, whose scores
    are worked out anew, and j leaves. A heap holds the pairs above the threshold; those of an
    end that has changed since are passed over. Memory follows the contacts, not their square.
    """
    inner: dict[int, float] = {}
    around: dict[int, dict[int, float]] = {}
    for i, j, n in contacts:
        if i == j:
            inner[i] = inner.get(i, 0.0) + n
            around.setdefault(i, {})
        else:
            for a, b in ((i, j), (j, i)):
                near = around.setdefault(a, {})
                near[b] = near.get(b, 0.0) + n
    turn = dict.fromkeys(around, 0)
    heap: list[tuple[float, int, int, int, int]] = []

    def offer(a: int, b: int) -> None:
        base = inner.get(a, 0.0) * inner.get(b, 0.0)
        score = around[a][b] / math.sqrt(base) if base > 0 else 0.0
        if score > threshold:
            i, j = min(a, b), max(a, b)
            heapq.heappush(heap, (-score, i, j, turn[i], turn[j]))

    for a, near in around.items():
        for b in near:
            if a < b:
                offer(a, b)
    merges = []
    while heap:
        score, i, j, ti, tj = heapq.heappop(heap)
        if turn[i] != ti or turn[j] != tj:
            continue
        merges.append((i, j, -score))
        inner[i] = inner.get(i, 0.0) + inner.pop(j, 0.0) + around[i].pop(j)
        gone = around.pop(j)
        turn[i], turn[j] = ti + 1, -1
        for k, n in gone.items():
            if k != i:
                del around[k][j]
                around[i][k] = around[k][i] = around[i].get(k, 0.0) + n
        for k in around[i]:
            offer(i, k)
    return merges


def bins_of_merges(ids: list[int], merges: list[tuple[int, int, float]]) -> list[tuple[int, int, float | None]]:
    """(id, bin, score): contigs joined by merges, in the order of merging.

    A bin's score is the least that its merges and their parts had. Contigs without a merge are
    bins of their own with a null score. Bins are numbered from 0: by first merge, then alone.
    """
    bin_of: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    score: dict[int, float] = {}
    made = 0
    for i, j, s in merges:
        a, b = bin_of.get(i), bin_of.get(j)
        if a is None and b is None:
            a, made = made, made + 1
            members[a], score[a] = [i, j], s
        elif a is None or b is None:
            a, lone = (a, j) if a is not None else (b, i)
            members[a].append(lone)
            score[a] = min(score[a], s)
        else:
            members[a] += members.pop(b)
            score[a] = min(score[a], score.pop(b), s)
        for m in members[a]:
            bin_of[m] = a
    rank = {b: k for k, b in enumerate(sorted(members))}
    rows: list[tuple[int, int, float | None]] = [(ids[m], rank[b], score[b]) for b, ms in members.items() for m in ms]
    rows += [(ids[m], len(rank) + k, None) for k, m in enumerate(m for m in range(len(ids)) if m not in bin_of)]
    return rows


def bin_elements(contacts: DataFrame, elements: DataFrame, threshold: float = 0.8) -> DataFrame:
    """id, bin, score: greedy binning of contigs by their contacts (i <= j, n).

    Merging never crosses components of the contact graph, so each component is one group and
    they run side by side. A bin is named by its smallest contig.
    """
    ship(contacts.sparkSession)
    parts = materialize(connected_components(contacts, "i", "j"), "element-parts")
    own = contacts.join(parts, F.col("i") == F.col("node")).select("component", "i", "j", "n")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf["i"]) | set(pdf["j"]))
        at = {v: k for k, v in enumerate(ids)}
        own = ((at[min(i, j)], at[max(i, j)], float(n)) for i, j, n in zip(pdf["i"], pdf["j"], pdf["n"], strict=True))
        rows = bins_of_merges(ids, merge_greedily(own, threshold))
        out = pd.DataFrame(rows, columns=["id", "bin", "score"])
        out["bin"] = out.groupby("bin")["id"].transform("min")
        return out.astype({"id": "int64", "bin": "int64", "score": "float64"})

    solved = own.groupBy("component").applyInPandas(solve, "id long, bin long, score double")
    alone = elements.select("id").join(solved.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti").select("id", F.col("id").alias("bin"), F.lit(None).cast("double").alias("score"))
    return solved.select("id", "bin", F.nanvl("score", F.lit(None).cast("double")).alias("score")).unionByName(alone)


def shuffled_bins(bins: DataFrame, seed: int = 0) -> DataFrame:
    """The same bin sizes over contigs in random order (a null model), the same for a seed."""
    from .consensus import ordinals

    mixed = ordinals(bins.select("id", F.xxhash64("id", F.lit(seed)).alias("_r")), ["_r", "id"], "_k")
    placed = ordinals(bins.select("bin", F.col("id").alias("_at")), ["bin", "_at"], "_n")
    return mixed.join(placed, F.col("_k") == F.col("_n")).select("id", "bin")


def element_summary(members: DataFrame) -> DataFrame:
    """bin, length, gc (weighted by size), hit, n, contigs of bins of (bin, id, name, size, gc, hit)."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ",")
    return members.groupBy("bin").agg(F.sum("size").alias("length"), F.try_divide(F.sum(F.col("gc") * F.col("size")), F.sum("size")).alias("gc"), F.sum("hit").alias("hit"), F.count("*").alias("n"), names.alias("contigs"))


def bin_signals(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between binned contigs with both bins: mag1 <= mag2, w."""
    one, two = members.select(F.col("id").alias("_i1"), F.col("bin").alias("b1")), members.select(F.col("id").alias("_i2"), F.col("bin").alias("b2"))
    found = edges.join(one, F.col("src") == F.col("_i1")).join(two, F.col("dst") == F.col("_i2"))
    return found.select(F.least("b1", "b2").alias("mag1"), F.greatest("b1", "b2").alias("mag2"), "w")


def bin_noise(edges: DataFrame, members: DataFrame) -> DataFrame:
    """mag1 <= mag2 and signal, the mean edge weight within (mag1 = mag2) and between bins.

    Pairs of bins without an edge count as 0 and are not listed; ``noise_frame`` sums them up.
    """
    return bin_signals(edges, members).groupBy("mag1", "mag2").agg(F.avg("w").alias("signal"))


def noise_frame(noise: DataFrame, bins: DataFrame) -> DataFrame:
    """Per bin its inner signal (0 if none), and over the other bins the sum of mean signals, how
    many have one, and the mean with the rest as 0."""
    intra = noise.where("mag1 = mag2").select(F.col("mag1").alias("_m"), F.col("signal").alias("intra"))
    inter = noise.where("mag1 != mag2")
    both = inter.select(F.col("mag1").alias("_b"), "signal").unionByName(inter.select(F.col("mag2").alias("_b"), "signal"))
    total = both.groupBy("_b").agg(F.sum("signal").alias("inter"), F.count("*").alias("others"))
    of = bins.agg((F.count("*") - 1).alias("_n"))  # one row
    found = bins.select("bin").join(intra, F.col("bin") == F.col("_m"), "left").join(total, F.col("bin") == F.col("_b"), "left").join(F.broadcast(of))
    zero = F.lit(0.0)
    return found.select("bin", F.coalesce("intra", zero).alias("intra"), F.coalesce("inter", zero).alias("inter"), F.coalesce("others", F.lit(0)).alias("others"), F.coalesce(F.try_divide(F.coalesce("inter", zero), F.col("_n")), zero).alias("mean_inter"))


def log_scaled(df: DataFrame, column: str) -> DataFrame:
    """Adds log10 of a signal and that scaled to 0..1 over all rows (null where all are equal)."""
    log = F.log10(F.col(column) + 1e-10)
    span = df.agg(F.min(log).alias("_lo"), F.max(log).alias("_hi"))  # one row
    out = df.join(F.broadcast(span)).withColumn(f"log_{column}", log)
    return out.withColumn(f"scaled_{column}", F.try_divide(F.col(f"log_{column}") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def host_signals(edges: DataFrame, elements: DataFrame, hosts: DataFrame) -> DataFrame:
    """mge, mag, signal, percent, contigs: contacts of mobile bins with host bins.

    ``elements`` (id, mge) and ``hosts`` (id, mag). percent is of all the element's signal to
    hosts; contigs counts the host's contigs that it meets.
    """
    around = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w").unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "w"))
    met = around.join(elements.select(F.col("id").alias("_e"), "mge"), F.col("a") == F.col("_e")).join(hosts.select(F.col("id").alias("_h"), "mag"), F.col("b") == F.col("_h"))
    own = met.groupBy("mge", "mag").agg(F.sum("w").alias("signal"), F.countDistinct("b").alias("contigs"))
    share = F.try_divide(F.col("signal") * F.lit(100.0), F.sum("signal").over(Window.partitionBy("mge")))
    return own.withColumn("percent", share).select("mge", "mag", "signal", "percent", "contigs")


def hosts_above(signals: DataFrame, percent: float = 10.0, min_contigs: int = 5) -> DataFrame:
    """The host signals that are strong and wide enough to name a host."""
    return signals.where((F.col("percent") >= percent) & (F.col("contigs") >= min_contigs))


def host_histogram(found: DataFrame, elements: DataFrame, top: int = 5) -> DataFrame:
    """n_hosts (``top`` and more together) and n_mges: how many hosts the mobile bins have."""
    per = found.groupBy(F.col("mge").alias("_m")).agg(F.count("*").alias("h"))
    own = elements.select("mge").distinct().join(per, F.col("mge") == F.col("_m"), "left")
    return own.groupBy(F.least(F.coalesce("h", F.lit(0)), F.lit(top)).cast("long").alias("n_hosts")).agg(F.count("*").alias("n_mges"))


def guest_histogram(found: DataFrame, hosts: DataFrame, top: int = 3) -> DataFrame:
    """n_guests (``top`` and more together) and n_mags: how many mobile bins the hosts have."""
    per = found.groupBy(F.col("mag").alias("_m")).agg(F.count("*").alias("g"))
    own = hosts.select("mag").distinct().join(per, F.col("mag") == F.col("_m"), "left")
    return own.groupBy(F.least(F.coalesce("g", F.lit(0)), F.lit(top)).cast("long").alias("n_guests")).agg(F.count("*").alias("n_mags"))


def signal_counts(noise: DataFrame, bins: DataFrame, quality: DataFrame) -> DataFrame:
    """The frame behind the noise plot, equal rows once: mag, type, class, signal, log_signal, scaled_signal, n.

    One row per bin for its inner signal (0 if none), and one per pair of different bins and side
    that meet; ``n`` is 1 there. The bins that a bin doesn't meet have the signal 0 alike: they are
    one row, and ``n`` is their number. Logarithms are scaled over each type. The number of rows
    is that of the signals, not that of pairs of bins.
    """
    own = bins.select(F.col("bin").alias("mag")).distinct()
    one = F.lit(1).cast("long").alias("n")
    inner = noise.where("mag1 = mag2").select(F.col("mag1").alias("_m"), "signal")
    intra = own.join(inner, F.col("mag") == F.col("_m"), "left").select("mag", F.lit("intra").alias("type"), F.coalesce("signal", F.lit(0.0)).alias("signal"), one)
    between = noise.where("mag1 != mag2")
    both = between.select(F.col("mag1").alias("_m"), "signal").unionByName(between.select(F.col("mag2").alias("_m"), "signal"))
    met = both.groupBy("_m").agg(F.count("*").alias("_k"))
    others = own.agg((F.count("*") - 1).alias("_n"))  # one row
    apart = own.join(met, F.col("mag") == F.col("_m"), "left").join(F.broadcast(others)).select("mag", F.lit("inter").alias("type"), F.lit(0.0).alias("signal"), (F.col("_n") - F.coalesce("_k", F.lit(0))).alias("n"))
    inter = both.join(own, F.col("_m") == F.col("mag"), "left_semi").select(F.col("_m").alias("mag"), F.lit("inter").alias("type"), "signal", one).unionByName(apart.where("n > 0"))
    frame = log_scaled(intra, "signal").unionByName(log_scaled(inter, "signal"))
    return frame.join(quality.select(F.col("bin").alias("_q"), "class"), F.col("mag") == F.col("_q"), "left").select("mag", "type", F.coalesce("class", F.lit("Unknown")).alias("class"), "signal", "log_signal", "scaled_signal", "n")


def signal_frame(noise: DataFrame, bins: DataFrame, quality: DataFrame) -> DataFrame:
    """``signal_counts`` with each row as often as it counts: mag, type, class, signal, log_signal,
    scaled_signal. As many rows as pairs of bins, as plotted; sums need the counts alone."""
    counts = signal_counts(noise, bins, quality)
    return counts.withColumn("_x", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("_x", "n")
