"""Read pairs: alignment filters, mate joins, ordering, de-duplication.

A pair table has c1, pos1, strand1, c2, pos2, strand2 (positions from 1) and may have read_id,
sample and mapq. Contigs are ids or names; their order is that of the column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENDS = ["c1", "pos1", "strand1", "c2", "pos2", "strand2"]


def keep_alignments(alignments: DataFrame, min_quality: int = 30) -> DataFrame:
    """Primary alignments of the two plain flags with enough quality: read_id, contig, pos, strand.

    Positions stay as they are in the input; ``one_based`` moves them.
    """
    kept = alignments.where((F.col("mapq") >= min_quality) & F.col("flag").isin(0, 16))
    return kept.select("read_id", "contig", "pos", F.when(F.col("flag") == 16, "-").otherwise("+").alias("strand"))


def one_based(alignments: DataFrame) -> DataFrame:
    """Positions from 0 to positions from 1."""
    return alignments.withColumn("pos", F.col("pos") + 1)


def join_mates(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Pairs from the alignments of both reads. Read ids are unique on each side, by contract."""
    one = forward.select("read_id", F.col("contig").alias("c1"), F.col("pos").alias("pos1"), F.col("strand").alias("strand1"))
    two = reverse.select("read_id", F.col("contig").alias("c2"), F.col("pos").alias("pos2"), F.col("strand").alias("strand2"))
    return one.join(two, "read_id")


def pair_interleaved(alignments: DataFrame, min_quality: int = 30, strict: bool = False) -> DataFrame:
    """Pairs from one table with both mates (``first`` tells which), by the read's name.

    Both mates must be mapped, not supplementary, and have the quality. Positions from 0 become
    positions from 1, each mate's its own. With ``strict`` a read whose mate is missing from the
    table, so that the two do not stand under one name, is an error when the result is read.
    """
    bits = F.col("flag")
    kept = alignments.where(bits.bitwiseAND(F.lit(2048 | 256)) == 0)
    end = F.struct("contig", (F.col("pos") + 1).alias("pos"), F.when(bits.bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), "mapq")
    first, mapped = bits.bitwiseAND(F.lit(64)) != 0, bits.bitwiseAND(F.lit(4)) == 0
    mates = kept.groupBy("read_id").agg(F.max(F.when(first & mapped, end)).alias("a"), F.max(F.when(~first & mapped, end)).alias("b"), F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"))
    if strict:
        alone = F.concat(F.lit("reads should be paired: "), F.col("read_id"))
        mates = mates.where(F.when((F.col("n1") == 1) & (F.col("n2") == 1), F.lit(True)).otherwise(F.raise_error(alone).cast("boolean")))
    both = mates.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.least("a.mapq", "b.mapq") >= min_quality))
    return both.select("read_id", F.col("a.contig").alias("c1"), F.col("a.pos").alias("pos1"), F.col("a.strand").alias("strand1"), F.col("b.contig").alias("c2"), F.col("b.pos").alias("pos2"), F.col("b.strand").alias("strand2"))


def upper_triangle(pairs: DataFrame) -> DataFrame:
    """Swap the ends of pairs so that (c1, pos1) is never after (c2, pos2)."""
    keep = ((F.col("c1") == F.col("c2")) & (F.col("pos1") <= F.col("pos2"))) | (F.col("c1") < F.col("c2"))

    def pick(a: str, b: str) -> Column:
        return F.when(keep, F.col(a)).otherwise(F.col(b))

    rest = [c for c in pairs.columns if c not in ENDS]
    return pairs.select(*rest, *[pick(f"{n}{a}", f"{n}{b}").alias(f"{n}{a}") for a, b in ((1, 2), (2, 1)) for n in ("c", "pos", "strand")])


def locate(pairs: DataFrame, contigs: DataFrame, columns: tuple[str, ...] = ("size",), key: str = "id") -> DataFrame:
    """Add contig columns of both ends, as ``<column>1`` and ``<column>2``.

    Pairs on contigs that are not listed drop out; ``unknown_contigs`` finds them first.
    """
    for end in ("1", "2"):
        side = contigs.select(F.col(key).alias(f"_k{end}"), *[F.col(c).alias(f"{c}{end}") for c in columns])
        pairs = pairs.join(side, F.col(f"c{end}") == F.col(f"_k{end}")).drop(f"_k{end}")
    return pairs


def unknown_contigs(pairs: DataFrame, contigs: DataFrame, key: str = "id") -> DataFrame:
    """Contigs that pairs name but the table does not list."""
    named = pairs.select(F.explode(F.array("c1", "c2")).alias("contig")).distinct()
    return named.join(contigs, F.col("contig") == F.col(key), "left_anti")


def away_from_ends(located: DataFrame, edge: int = 0, self_contacts: bool = False) -> DataFrame:
    """Pairs between contigs with both reads more than ``edge`` from the contigs' ends.

    With ``self_contacts`` all pairs stay, those within a contig as well, and ``edge`` is not
    looked at. Needs size1 and size2.
    """
    if self_contacts:
        return located
    far = [F.col("pos1") > edge, F.col("pos2") > edge, F.col("size1") - F.col("pos1") > edge, F.col("size2") - F.col("pos2") > edge]
    return located.where(far[0] & far[1] & far[2] & far[3] & (F.col("c1") != F.col("c2")))


def drop_duplicates(pairs: DataFrame, strands: bool = True) -> DataFrame:
    """One pair for each set of coordinates (amplification duplicates)."""
    return pairs.dropDuplicates(ENDS if strands else ["c1", "pos1", "c2", "pos2"])


def union_samples(tables: list[DataFrame]) -> DataFrame:
    """Pair tables one after another, numbered in ``sample``."""
    out = tables[0].withColumn("sample", F.lit(0))
    for k, t in enumerate(tables[1:], 1):
        out = out.unionByName(t.withColumn("sample", F.lit(k)))
    return out


def in_regions(pairs: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs with each end in a listed region (contig, start, end; from 1, end included).

    One join per end on the contig with a range condition, in place of a query per pair of
    regions. A pair counts once for every pair of regions that hold it: r1, r2.
    """
    for end in ("1", "2"):
        side = regions.select(F.col("contig").alias(f"_c{end}"), F.col("start").alias(f"_s{end}"), F.col("end").alias(f"_e{end}"), F.col("region").alias(f"r{end}"))
        pairs = pairs.join(side, (F.col(f"c{end}") == F.col(f"_c{end}")) & F.col(f"pos{end}").between(F.col(f"_s{end}"), F.col(f"_e{end}"))).drop(f"_c{end}", f"_s{end}", f"_e{end}")
    return pairs
