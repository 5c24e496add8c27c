"""The driver's tables seen as contact data, by whole-number arithmetic.

``part`` gives contigs, ``lineitem`` read pairs, ``supplier`` bin quality; 20 contigs in a row form
a bin. Each view also exists as SQL (``SQL``), in the order in which they build on one another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Labels per contig in ``vectors``.
ITERATIONS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, size, coverage, rs, kind, seq."""
    p = table(spark, sf_dir, "part")
    return p.select(
        (F.col("p_partkey") + 1).alias("id"), F.concat(F.lit("NODE_"), F.col("p_partkey") + 1).alias("name"), (F.col("p_size") * 1000).cast("long").alias("size"),
        (F.col("p_retailprice") / 100).alias("coverage"), (F.col("p_size") * 4 + 1).cast("long").alias("rs"), F.col("p_size").cast("long").alias("kind"), F.col("p_name").alias("seq"),
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample, c1, pos1, strand1, c2, pos2, strand2, mapq and the read's name, as sequenced."""
    line = table(spark, sf_dir, "lineitem")
    size = contigs(spark, sf_dir).select("id", "size")
    c1 = F.col("l_partkey") + 1
    ends = line.select(
        (F.col("l_orderkey") % 2).cast("int").alias("sample"), c1.alias("c1"), F.when(F.col("l_linenumber") <= 2, c1).otherwise(F.col("l_suppkey") * 20 + F.col("l_linenumber") * 2 + 1).alias("c2"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("a"), (F.col("l_quantity").cast("long") * 997 + F.col("l_suppkey") * 31).alias("b"),
        F.when(F.col("l_returnflag") != "R", "+").otherwise("-").alias("strand1"), F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand2"),
        (F.round(F.col("l_discount") * 100).cast("int") * 6).alias("mapq"),
        F.concat_ws("_", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("read_id"),
    )
    one, two = size.toDF("i1", "s1"), size.toDF("i2", "s2")
    placed = ends.join(one, F.col("c1") == F.col("i1")).join(two, F.col("c2") == F.col("i2"))
    return placed.select("read_id", "sample", "c1", (F.col("a") % F.col("s1") + 1).alias("pos1"), "strand1", "c2", (F.col("b") % F.col("s2") + 1).alias("pos2"), "strand2", "mapq")


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, size, coverage, block, bin (ND: unbinned), mobile."""
    c = contigs(spark, sf_dir)
    block = F.floor((F.col("id") - 1) / 20).cast("long")
    return c.select("id", "name", "size", "coverage", block.alias("block"), F.when(F.col("kind") % 7 == 0, "ND").otherwise(F.format_string("bin_%05d_00000", block + 1)).alias("bin"), (F.col("kind") % 10 == 0).alias("mobile"))


def bin_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin, completeness, redundancy, and by the other marker set arch_completeness."""
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.format_string("bin_%05d_00000", F.col("s_suppkey") + 1).alias("bin"), ((F.col("s_acctbal") + 1000) / 11000).alias("completeness"), (1 + F.col("s_nationkey") / F.lit(100.0)).alias("redundancy"),
        ((F.col("s_suppkey") * 37 % 100) / F.lit(100.0)).alias("arch_completeness"), (1 + F.col("s_suppkey") * 13 % 25 / F.lit(100.0)).alias("arch_redundancy"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, labels: one label per clustering iteration."""
    c = contigs(spark, sf_dir)
    block = F.floor((F.col("id") - 1) / 20).cast("long")
    return c.select("id", F.array(*[((block + F.col("kind") % (k + 2)) % 50).cast("int") for k in range(ITERATIONS)]).alias("labels"))


SQL = {
    "contigs": """SELECT p_partkey + 1 AS id, 'NODE_' || (p_partkey + 1) AS name, CAST(p_size * 1000 AS BIGINT) AS size, p_retailprice / 100 AS coverage,
        CAST(p_size * 4 + 1 AS BIGINT) AS rs, CAST(p_size AS BIGINT) AS kind, p_name AS seq FROM part""",
    "ends": """SELECT concat_ws('_', l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS read_id, CAST(l_orderkey % 2 AS INTEGER) AS sample, l_partkey + 1 AS c1,
        CASE WHEN l_linenumber <= 2 THEN l_partkey + 1 ELSE l_suppkey * 20 + l_linenumber * 2 + 1 END AS c2, CAST(round(l_extendedprice * 100) AS BIGINT) AS a, CAST(l_quantity AS BIGINT) * 997 + l_suppkey * 31 AS b,
        CASE WHEN l_returnflag <> 'R' THEN '+' ELSE '-' END AS strand1, CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand2, CAST(round(l_discount * 100) AS INTEGER) * 6 AS mapq FROM lineitem""",
    "pairs": """SELECT read_id, sample, c1, a % x.size + 1 AS pos1, strand1, c2, b % y.size + 1 AS pos2, strand2, mapq FROM ends JOIN contigs x ON c1 = x.id JOIN contigs y ON c2 = y.id""",
    "bins": """SELECT id, name, size, coverage, (id - 1) // 20 AS block, CASE WHEN kind % 7 = 0 THEN 'ND' ELSE 'bin_' || lpad(CAST((id - 1) // 20 + 1 AS VARCHAR), 5, '0') || '_00000' END AS bin, kind % 10 = 0 AS mobile FROM contigs""",
    "bin_quality": """SELECT 'bin_' || lpad(CAST(s_suppkey + 1 AS VARCHAR), 5, '0') || '_00000' AS bin, (s_acctbal + 1000) / 11000 AS completeness, 1 + s_nationkey / 100.0::DOUBLE AS redundancy,
        (s_suppkey * 37 % 100) / 100.0::DOUBLE AS arch_completeness, 1 + s_suppkey * 13 % 25 / 100.0::DOUBLE AS arch_redundancy FROM supplier""",
    "vectors": """SELECT id, [CAST(((id - 1) // 20 + kind % 2) % 50 AS INTEGER), CAST(((id - 1) // 20 + kind % 3) % 50 AS INTEGER), CAST(((id - 1) // 20 + kind % 4) % 50 AS INTEGER),
        CAST(((id - 1) // 20 + kind % 5) % 50 AS INTEGER), CAST(((id - 1) // 20 + kind % 6) % 50 AS INTEGER)] AS labels FROM contigs""",
}


def with_views(body: str, recursive: bool = False) -> str:
    """DuckDB SQL in which all views can be named; ``body`` may go on with further ones."""
    views = ",\n".join(f"{k} AS ({v})" for k, v in SQL.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{views}{', ' if not body.lstrip().upper().startswith('SELECT') else ' '}{body}"
