"""The user's commands as functions that compose operators: network, partition, validation,
pipeline, qc, contact map, scaffold, mobile elements, hosts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import site_pattern
from ..operators import community, consensus, layout, mobile, quality, recursion, scaffold
from ..operators import network as net
from ..operators.pairs import drop_duplicates, join_mates, keep_alignments, one_based, unknown_contigs, upper_triangle
from ..sources import readers
from ..storage import materialize, measured_side

NEEDS = {"abundance": ["coverage"], "rs": ["rs"], "theoritical_hit": ["coverage", "rs"]}


def check_options(normalisation: str, contig_columns: list[str], algorithm: str = "louvain") -> None:
    """What a mode needs must be there: a depth file for coverage, an enzyme for sites."""
    if normalisation not in ("none", *net.FACTORS):
        raise ValueError(f"normalisation {normalisation!r} is not known")
    missing = [c for c in NEEDS.get(normalisation, []) if c not in contig_columns]
    if missing:
        raise ValueError(f"normalisation {normalisation!r} needs {', '.join(missing)}")
    if algorithm not in community.ALGORITHMS:
        raise ValueError(f"algorithm {algorithm!r} is not known")


def pairs_from_alignments(forward: DataFrame, reverse: DataFrame, min_quality: int = 30) -> DataFrame:
    """Filtered, joined, ordered pairs of two alignment tables (positions from 0)."""
    sides = [one_based(keep_alignments(side, min_quality)) for side in (forward, reverse)]
    return upper_triangle(join_mates(*sides))


@dataclass
class Network:
    contigs: DataFrame
    hits: DataFrame
    edges: DataFrame
    ratio: DataFrame


def build_network(pairs: DataFrame, contigs: DataFrame, normalisation: str = "empirical_hit", edge: int = 0, self_contacts: bool = False, per_sample: bool = False) -> Network:
    """Contact network, hits and ratios. Pairs on unknown contigs are an error."""
    check_options(normalisation, contigs.columns)
    stray = unknown_contigs(pairs, contigs).limit(3).collect()
    if stray:
        raise KeyError(f"pairs name contigs that are not listed: {[r.contig for r in stray]}")
    return Network(contigs, net.hits(pairs), net.network(pairs, contigs, normalisation, edge, self_contacts, per_sample), net.contact_ratio(pairs, contigs, edge))


def network_of_files(spark: SparkSession, fasta: str | list[str], pairs: str | list[str], depth: str | None = None, enzymes: str | None = None, normalisation: str = "empirical_hit", edge: int = 0, self_contacts: bool = False) -> Network:
    """From an assembly, pairs and a depth table, as files, to the network.

    Contigs get ids in the order of the assembly; pairs name contigs, and names become ids.
    """
    contigs = materialize(readers.assembly(spark, fasta, depth, site_pattern(enzymes) if enzymes else None), "contigs")
    named = readers.read_pairs(spark, pairs)
    stray = unknown_contigs(named, contigs, "name").limit(3).collect()
    if stray:
        raise KeyError(f"pairs name contigs that are not listed: {[r.contig for r in stray]}")
    for k in ("1", "2"):
        side = contigs.select(F.col("id").alias(f"_i{k}"), F.col("name").alias(f"_n{k}"))
        named = named.join(side, F.col(f"c{k}") == F.col(f"_n{k}")).withColumn(f"c{k}", F.col(f"_i{k}")).drop(f"_i{k}", f"_n{k}")
    rows = materialize(upper_triangle(named.withColumn("sample", F.lit(0))), "pairs")
    return build_network(rows, contigs, normalisation, edge, self_contacts)


@dataclass
class Partition:
    table: DataFrame
    members: DataFrame
    cores: DataFrame
    agreement: DataFrame
    bins: DataFrame

    def matrix(self) -> DataFrame:
        """The clustering matrix, made only on demand."""
        return consensus.clustering_matrix(self.members, self.agreement)


def partition(edges: DataFrame, contigs: DataFrame, algorithm: str = "louvain", iterations: int = 100, overlap: float = 0.8, resolution: float = 1.0, seed: int = 0, labels: DataFrame | None = None) -> Partition:
    """Core and overlapping bins. ``labels`` (id, iteration, label) of another clusterer may stand in."""
    runs = labels if labels is not None else community.cluster(edges, iterations, algorithm, resolution, seed)
    vectors = materialize(consensus.label_vectors(runs), "vectors")
    cores = materialize(consensus.core_bins(vectors), "cores")
    members = materialize(consensus.core_members(vectors, cores), "members")
    bins = materialize(consensus.overlapping_bins(consensus.close_cores(cores, overlap), cores, overlap), "bins")
    return Partition(consensus.partition_table(contigs, members, cores, bins), members, cores, consensus.core_agreement(cores), bins)


def validate(edges: DataFrame, contigs: DataFrame, bins: DataFrame, quality_of: Callable[[DataFrame], DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """Final bins of contigs, and a summary of each bin with quality and abundance."""
    final = materialize(recursion.decontaminate(edges, contigs, bins, quality_of, **options), "final")
    own = contigs.join(final.select(F.col("id").alias("_i"), "bin"), F.col("id") == F.col("_i"), "left").drop("_i")
    summary = quality_of(final.select("id", "bin")).join(final.select("bin", "step", "parent").distinct(), "bin")
    if "hit" in contigs.columns and "coverage" in contigs.columns:
        summary = summary.join(quality.abundance(own), "bin", "left")
    return own.withColumn("bin", F.coalesce("bin", F.lit("ND"))), summary


def pipeline(pairs: DataFrame, contigs: DataFrame, quality_of: Callable[[DataFrame], DataFrame], normalisation: str = "empirical_hit", algorithm: str = "louvain", iterations: int = 100, overlap: float = 0.8, size: int = 500_000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Pairs to validated bins."""
    edges = materialize(build_network(pairs, contigs, normalisation).edges, "edges")
    found = partition(edges, contigs, algorithm, iterations, overlap, seed=seed)
    placed = found.members.join(found.bins, "core_id")
    large = consensus.bin_stats(placed, contigs).where(F.col("size") >= size)
    bins = placed.join(large.select("bin"), "bin", "left_semi").select("id", F.format_string("%05d", "bin").alias("bin"))
    return validate(edges, contigs, bins, quality_of, size=size, seed=seed)


def library_quality(pairs: DataFrame, contigs: DataFrame, bin_quality: DataFrame, sites: DataFrame, loop_sites: int, uncut_sites: int, completeness: float = 0.7, redundancy: float = 1.15, size: int = 100_000) -> DataFrame:
    """Events and ratios over pairs of good contigs. Thresholds are given, never guessed."""
    good = materialize(quality.good_contigs(contigs, bin_quality, completeness, redundancy, size), "good")
    own = quality.fragment_index(quality.pairs_of(pairs, measured_side(good)), sites)
    return quality.library_ratios(quality.library_events(own, loop_sites, uncut_sites), good.select("bin").distinct().count())


def object_map(pairs: DataFrame, contigs: DataFrame, column: str, value: str, bin_size: int = 5000, min_size: int = 5000, unique: bool = True) -> DataFrame:
    """The contact map of one object, with duplicates dropped first."""
    own = layout.object_contigs(contigs, column, value, min_size).withColumn("_object", F.lit(value))
    inside = pairs.join(own.select(F.col("id").alias("_a")), F.col("c1") == F.col("_a"), "left_semi").join(own.select(F.col("id").alias("_b")), F.col("c2") == F.col("_b"), "left_semi")
    return layout.contact_map(drop_duplicates(inside) if unique else inside, layout.map_bins(own, bin_size, "_object"), bin_size)


def scaffold_bins(pairs: DataFrame, contigs: DataFrame, window: int = 5000, threshold: float = 0.05) -> DataFrame:
    """Scaffolds of every bin of ``contigs`` (id, name, size, bin), all at once."""
    place = materialize(consensus.ordinals(scaffold.numbered(contigs), ["id"], "all").select("id", "name", "size", "bin", "nth", "all"), "places")
    scores = _scores(pairs, place.withColumnRenamed("nth", "_k").withColumnRenamed("all", "nth"), window)
    ends = place.select(F.explode(F.array(F.struct((F.col("all") * 2).alias("g"), (F.col("nth") * 2).alias("e")), F.struct((F.col("all") * 2 + 1).alias("g"), (F.col("nth") * 2 + 1).alias("e")))).alias("x"), "bin").select("x.g", "x.e", "bin")
    for k in ("i", "j"):
        scores = scores.join(ends.select(F.col("g").alias(f"_g{k}"), F.col("e").alias(f"l{k}"), F.col("bin").alias(f"b{k}")), F.col(f"end_{k}") == F.col(f"_g{k}"))
    local = scores.where("bi = bj").select(F.col("bi").alias("bin"), F.col("li").cast("long").alias("end_i"), F.col("lj").cast("long").alias("end_j"), "score")
    return scaffold.scaffold_table(scaffold.scaffolds(local, place, threshold), place)


def _scores(pairs: DataFrame, contigs: DataFrame, window: int) -> DataFrame:
    counts = materialize(layout.edge_contacts(pairs, layout.edge_windows(contigs, window)), "edge-counts")
    return layout.edge_scores(counts, layout.edge_norms(pairs, contigs, counts, window))


def mobile_bins(pairs: DataFrame, elements: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Bins of mobile contigs (id, name, size, gc, hit), and their summary."""
    counts = materialize(mobile.element_contacts(pairs, elements), "element-contacts")
    bins = materialize(mobile.bin_elements(counts, elements, threshold), "element-bins")
    own = elements.join(bins.select(F.col("id").alias("_i"), "bin", "score"), F.col("id") == F.col("_i")).drop("_i")
    scores = bins.groupBy(F.col("bin").alias("_b")).agg(F.min("score").alias("score"))
    return bins, mobile.element_summary(own).join(scores, F.col("bin") == F.col("_b")).drop("_b")


def annotate_hosts(edges: DataFrame, elements: DataFrame, hosts: DataFrame, percent: float = 10.0, min_contigs: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Host associations, and how many hosts and guests there are."""
    found = materialize(mobile.hosts_above(mobile.host_signals(edges, elements, hosts), percent, min_contigs), "hosts")
    return found, mobile.host_histogram(found, elements), mobile.guest_histogram(found, hosts)
