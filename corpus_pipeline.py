"""From raw documents to packed training sequences, in five stages.

Each stage works on all that its predecessor kept: documents that the quality classifier rejects
go, repeated passages go, one document of each group of near copies stays, contaminated documents
go, and what is left is packed. All stages but the last return the columns of ``documents``. The
module needs ``ligature.llm`` and can't be imported without it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ligature.llm import registry
from ligature.llm.decontaminate import find_passages
from ligature.llm.line_dedup import dedup_lines
from ligature.llm.ngram_join import ngram_jaccard_join, set_keys
from ligature.llm.packing import pack
from ligature.llm.quality_model import features, judge, learn
from ligature.storage import materialize, scratch, small_side

#: Word shingles and similarity of the near-copy stage.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 4, 5
#: Words that a worker keeps while packing; other stages need the executor's memory as well.
MEMO_WORDS = 250_000
#: Rows that go to a Python worker at once, at most. Whole documents in larger batches cost an
#: executor more memory, on either side, than they save time.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Lowers the session's setting where it is higher, or unlimited."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents predicted to be good; learns from the labelled ones that aren't held out.

    Null and empty texts score as empty ones. Rows with the same or a null id are each judged; a
    null id isn't learned from. Without labels of both classes nothing is learned and every row
    stays. An empty table stays empty; other columns pass through whatever their names.
    """
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.select(F.col("doc_id").alias("labelled")).where("labelled is not null").distinct()
    few = small_side(known)
    # Only labelled texts are measured for learning, if a broadcast can tell them.
    own = docs.join(few, docs["doc_id"] == few["labelled"], "left_semi") if few is not known else docs
    with scratch():  # written in between, so that no task needs two Python workers at once
        model = learn(materialize(features(own), "quality-features"), labels)
    return judge(docs, model, carry=True).where("predicted = 1").select("row.*") if model else docs


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of passages; documents that were nothing else go.

    Documents without a line that holds a word stay, null and empty texts among them. A null id
    is the earliest; repeated rows are one document and change alike, so all of them stay or go;
    rows that share an id are ordered by a hash of the text. ``n_chars``, where there is one,
    follows the text. An empty table stays empty; other columns pass through.
    """
    shorter = dedup_lines(docs).where("n_lines = 0 or n_removed < n_lines").select("row.*")
    return shorter.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else shorter


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id.

    Documents without a word stay, null and empty texts among them, and so do rows with a null
    id. Of rows that share an id, those of one group count as its copies and those of different
    groups as different documents. An empty table stays empty; other columns pass through.
    """
    _small_batches(spark)
    found = materialize(ngram_jaccard_join(docs, NEAR_WORDS, NEAR_NUM, NEAR_DEN, keys=True), "near").where("doc_id is not null and n_shingles > 0")
    gone = materialize(found.where("doc_id != component_id").select(F.col("doc_id").alias("gone")).distinct(), "near-gone")
    shared = materialize(docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("shared")).agg(F.count("*").alias("c")).where("c > 1").select("shared"), "near-shared")
    if shared.isEmpty():
        return docs.join(small_side(gone), docs["doc_id"] == gone["gone"], "left_anti")
    few = small_side(shared)
    alone = docs.join(few, docs["doc_id"] == few["shared"], "left_anti")
    alone = alone.join(small_side(gone), alone["doc_id"] == gone["gone"], "left_anti")
    first = found.groupBy("component_key").agg(F.min(F.struct("doc_id", "set_key")).alias("first")).select("first.*").distinct()
    keyed = set_keys(docs.join(few, docs["doc_id"] == few["shared"], "left_semi"), NEAR_WORDS)
    copies = keyed.join(first, ["doc_id", "set_key"], "left_semi").groupBy("doc_id", "set_key").agg(F.min_by("row", F.struct(F.length("row.text"), "row.text")).alias("row"))
    return alone.unionByName(keyed.where("set_key is null").select("row.*")).unionByName(copies.select("row.*"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated.

    Null, empty and wordless texts are clean; rows with the same or a null id are each judged;
    with an empty benchmark all stay. An empty table stays empty; other columns pass through.
    """
    _small_batches(spark)
    found = find_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=True)
    return found.where("not contaminated").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in the packed sequences.

    Null and empty texts are the end id alone; rows with the same or a null id are each packed.
    An empty table gives no piece; other columns are not read.
    """
    _small_batches(spark)
    return pack(docs, registry._tokenizer(registry.BYTE_TOKENIZER), registry.END_ID, registry.CAPACITY, memo_words=MEMO_WORDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising and the discriminant have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:  # what a stage wrote for itself goes with it
            docs = keep(materialize(stage(spark, docs, sf_dir), name))
    return STAGES[-1][1](spark, docs, sf_dir)
