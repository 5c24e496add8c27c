"""Contact counts kept up to date over a stream of pairs.

Hits and contact counts are sums, so an append-only stream of pairs maintains them with the same
aggregations as a batch, in update mode: each trigger writes the rows that changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pair_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New Parquet files of pairs in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def running_hits(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("c1", "c2")).alias("id")).groupBy("id").agg(F.count("*").alias("hit"))


def running_contacts(pairs: DataFrame, contigs: DataFrame, edge: int = 0) -> DataFrame:
    """src < dst and n so far; the contig table is a static side of the join."""
    from ..operators.network import contacts

    return contacts(pairs, contigs, edge)


def keep_updated(counts: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Write each trigger's changed rows to ``path`` under its number; ``latest`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])
