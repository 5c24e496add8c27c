"""The contact network: hits, contact counts and their normalisation.

Counts are plain aggregations, which combine within tasks before they shuffle. The contig side of
a join is broadcast by Spark where statistics allow it and shuffled where not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pairs import away_from_ends, locate


def hits(pairs: DataFrame) -> DataFrame:
    """id, hit: ends of pairs on each contig; a pair within a contig counts twice."""
    return pairs.select(F.explode(F.array("c1", "c2")).alias("id")).groupBy("id").agg(F.count("*").alias("hit"))


def hits_by_sample(pairs: DataFrame, samples: list[int]) -> DataFrame:
    """id and hit_<sample> for each sample."""
    ends = pairs.select("sample", F.explode(F.array("c1", "c2")).alias("id"))
    return ends.groupBy("id").agg(*[F.count(F.when(F.col("sample") == s, 1)).alias(f"hit_{s}") for s in samples])


def contact_ratio(pairs: DataFrame, contigs: DataFrame, edge: int = 0) -> DataFrame:
    """sample (null: all together), contacts, inter_contacts and their ratio.

    Contacts between contigs count if both reads are away from the ends.
    """
    far = [F.col(f"pos{k}") > edge for k in (1, 2)] + [F.col(f"size{k}") - F.col(f"pos{k}") > edge for k in (1, 2)]
    inter = far[0] & far[1] & far[2] & far[3] & (F.col("c1") != F.col("c2"))
    flagged = locate(pairs, contigs).select("sample", inter.alias("inter"))
    counted = flagged.rollup("sample").agg(F.count("*").alias("contacts"), F.count_if("inter").alias("inter_contacts"))
    return counted.withColumn("ratio", F.try_divide(F.col("inter_contacts"), F.col("contacts")))


def contacts(pairs: DataFrame, contigs: DataFrame, edge: int = 0, self_contacts: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """src < dst and n: contacts of each pair of contigs (src = dst with ``self_contacts``)."""
    kept = away_from_ends(locate(pairs, contigs), edge, self_contacts)
    return kept.groupBy(*by, F.least("c1", "c2").alias("src"), F.greatest("c1", "c2").alias("dst")).agg(F.count("*").alias("n"))


def _both(f: Callable[[str], Column]) -> Column:
    return F.sqrt(f("1") * f("2"))


def _per(a: str, b: str) -> Callable[[str], Column]:
    """a / b at an end; null where b is 0, which makes the weight 0."""
    return lambda k: F.try_divide(F.col(f"{a}{k}"), F.col(f"{b}{k}"))


#: The factor that divides the count, by mode; of hit, size, coverage and rs at both ends.
FACTORS: dict[str, Column | Callable[[], Column]] = {
    "abundance": lambda: _both(lambda k: F.col(f"coverage{k}")),
    "length": lambda: _both(_per("hit", "size")),
    "rs": lambda: F.lit(0.01) * _both(_per("hit", "rs")),
    "empirical_hit": lambda: _both(lambda k: F.col(f"hit{k}")),
    "theoritical_hit": lambda: _both(lambda k: F.col(f"coverage{k}") * F.lit(10) * F.sqrt(F.col(f"size{k}") * F.col(f"rs{k}"))),
}


def normalise(edges: DataFrame, contigs: DataFrame, mode: str | None = "empirical_hit") -> DataFrame:
    """Adds w to (src, dst, n): n over the mode's factor, 0 where that is 0 or not defined.

    ``contigs`` has id, hit, size, coverage and rs, as far as the mode needs them.
    """
    if mode is None or mode == "none":
        return edges.withColumn("w", F.col("n").cast("double"))
    if mode not in FACTORS:
        raise ValueError(f"normalisation {mode!r} is none of {['none', *FACTORS]}")
    need = {"abundance": ["coverage"], "length": ["hit", "size"], "rs": ["hit", "rs"], "empirical_hit": ["hit"], "theoritical_hit": ["coverage", "size", "rs"]}[mode]
    located = locate(edges.withColumnsRenamed({"src": "c1", "dst": "c2"}), contigs, tuple(need))
    factor = F.coalesce(FACTORS[mode](), F.lit(0.0))
    w = F.when(factor == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("n"), factor))
    return located.select(*[F.col({"src": "c1", "dst": "c2"}.get(c, c)).alias(c) for c in edges.columns], w.alias("w"))


def network(pairs: DataFrame, contigs: DataFrame, mode: str | None = "empirical_hit", edge: int = 0, self_contacts: bool = False, per_sample: bool = False) -> DataFrame:
    """src, dst, n, w; with ``per_sample`` also sample, still weighted by hits over all samples."""
    with_hits = contigs
    if mode in ("length", "rs", "empirical_hit"):
        with_hits = contigs.join(hits(pairs).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").drop("_id").withColumn("hit", F.coalesce("hit", F.lit(0)))
    edges = contacts(pairs, contigs, edge, self_contacts, ("sample",) if per_sample else ())
    return normalise(edges, with_hits, mode)


def contig_table(contigs: DataFrame, pairs: DataFrame, gc: Column) -> DataFrame:
    """The contig table of the network stage: ID, Name, Size, GC_content, Hit, Shotgun_coverage,
    Restriction_site."""
    own = contigs.join(hits(pairs).withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    return own.select(F.col("id").alias("ID"), F.col("name").alias("Name"), F.col("size").alias("Size"), gc.alias("GC_content"), F.coalesce("hit", F.lit(0)).alias("Hit"), F.col("coverage").alias("Shotgun_coverage"), F.col("rs").alias("Restriction_site"))


def without_isolates(ids: DataFrame, edges: DataFrame, keep: bool = True) -> DataFrame:
    """The ids that an edge names, or with ``keep=False`` those that none does."""
    named = edges.select(F.explode(F.array("src", "dst")).alias("_id")).distinct()
    return ids.join(named, F.col("id") == F.col("_id"), "left_semi" if keep else "left_anti")


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends in one bin, for all bins at once: bin, src, dst, and the rest."""
    one, two = members.select(F.col("id").alias("_i1"), F.col("bin").alias("bin")), members.select(F.col("id").alias("_i2"), F.col("bin").alias("_b2"))
    found = edges.join(one, F.col("src") == F.col("_i1")).join(two, (F.col("dst") == F.col("_i2")) & (F.col("bin") == F.col("_b2")))
    return found.select("bin", *edges.columns)
