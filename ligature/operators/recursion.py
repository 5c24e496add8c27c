"""Recursive decontamination: contaminated bins are clustered again until no part is better."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release, scratch
from .community import cluster
from .consensus import close_cores, core_bins, core_members, label_vectors, overlapping_bins
from .layout import recursive_ids
from .network import induced
from .quality import compare_generations, contaminated

#: Steps, at most.
MAX_STEPS = 9


def recluster(edges: DataFrame, members: DataFrame, iterations: int = 10, overlap: float = 0.9, algorithm: str = "louvain", seed: int = 0) -> DataFrame:
    """over_id, label, id: new bins inside each bin of ``members`` (id, bin as over_id).

    All bins are clustered in one pass, a group per bin and iteration. Labels never match across
    bins, as ids of different bins are never in one graph: the bin is part of each label vector.
    """
    inside = induced(edges, members)
    runs = cluster(inside, iterations, algorithm, seed=seed, by="bin")
    vectors = materialize(label_vectors(runs), "labels")
    whole = vectors.join(members.select(F.col("id").alias("_i"), "bin"), F.col("id") == F.col("_i"))
    split = materialize(whole.select("id", F.transform("labels", lambda x: F.concat_ws("/", "bin", x.cast("string"))).alias("labels")), "labels")
    cores = materialize(core_bins(split), "cores")
    found = overlapping_bins(close_cores(cores, overlap), cores, overlap)
    named = core_members(split, cores).join(found.withColumnRenamed("bin", "label"), "core_id").select("id", "label")
    return named.join(members.select(F.col("id").alias("_i"), F.col("bin").alias("over_id")), F.col("id") == F.col("_i")).select("over_id", "label", "id")


def decontaminate(edges: DataFrame, contigs: DataFrame, bins: DataFrame, quality_of: Callable[[DataFrame], DataFrame], size: int = 500_000, iterations: int = 10, overlap: float = 0.9, algorithm: str = "louvain", seed: int = 0, max_steps: int = MAX_STEPS) -> DataFrame:
    """id, bin, step, parent: the final bin of each contig that has one.

    ``bins`` is (id, bin); ``quality_of`` turns members (id, bin) into bin, completeness and
    redundancy, by whatever tool estimates them. Each step takes contaminated bins that are still
    recursive, clusters inside them, keeps parts larger than ``size``, compares generations, and
    goes on with what was accepted.
    """
    members = materialize(bins.select("id", F.col("bin").cast("string").alias("bin")), "members")
    known = materialize(quality_of(members).select("bin", "completeness", "redundancy", F.lit(True).alias("recursive"), F.lit(0).alias("step"), F.lit(None).cast("string").alias("parent")), "quality")
    for step in range(1, max_steps + 1):
        with scratch() as keep:  # of a step only its bins and their quality outlive it
            open_bins = materialize(contaminated(known.where("recursive")).select("bin"), "open")
            if open_bins.isEmpty():
                break
            inside = materialize(members.join(open_bins, "bin", "left_semi").select("id", "bin"), "inside")
            parts = materialize(recluster(edges, inside, iterations, overlap, algorithm, seed + 1000 * step), "parts")
            last = parts.select("over_id").distinct().withColumn("rec_id", F.lit(0))
            ids = recursive_ids(parts, contigs, last, size)
            child = parts.join(ids, ["over_id", "label"]).select("id", F.col("over_id").alias("parent"), F.concat_ws(".", "over_id", F.format_string("%05d", "rec_id")).alias("bin"))
            child = materialize(child, "children")
            judged = quality_of(child.select("id", "bin")).join(child.select(F.col("bin").alias("_b"), "parent").distinct(), F.col("bin") == F.col("_b")).drop("_b")
            now = compare_generations(known.join(open_bins, "bin", "left_semi").select("bin", "completeness", "redundancy"), judged, step)
            kept = known.join(open_bins, "bin", "left_anti").select("bin", "completeness", "redundancy", "recursive", "step", "parent")
            accepted = materialize(now.where("recursive"), "accepted")
            stayed = now.where("not recursive").drop("step", "parent").join(known.select(F.col("bin").alias("_b"), "step", "parent"), F.col("bin") == F.col("_b")).drop("_b")
            judged_all = keep(materialize(kept.unionByName(stayed).unionByName(accepted.select(kept.columns)), "quality"))
            moved = child.join(accepted.select("bin"), "bin", "left_semi").select("id", "bin")
            replaced = accepted.select(F.col("parent").alias("bin")).distinct()
            placed = keep(materialize(members.join(replaced, "bin", "left_anti").select("id", "bin").unionByName(moved), "members"))
            done = accepted.isEmpty()
        release(known, members)
        known, members = judged_all, placed
        if done:
            break
    return members.join(known.select(F.col("bin").alias("_b"), "step", "parent"), F.col("bin") == F.col("_b")).select("id", "bin", "step", "parent")
