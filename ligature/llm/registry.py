"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

#: Parameters of the queries.
WORD_TOKENIZER, BYTE_TOKENIZER, PIECE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID, CAPACITY = 2, 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of ``documents`` with the forest's verdict; trained amid lines of the same table."""
    from .secrets import dictionary, plain_lines, sample_findings, scan, train

    docs, known = _table(spark, sf_dir, "documents"), dictionary(_tokenizer(WORD_TOKENIZER))
    return scan(docs, train(sample_findings(known, plain_lines(docs)), known), known)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of ``documents``, learned from ``labels`` outside the held-out fold."""
    from .quality_model import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles of ``documents`` at 0.9."""
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), 3, 90, 100)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the piece vocabulary for ``documents``."""
    from .token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), _tokenizer(PIECE_TOKENIZER))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store of ``documents``, written and read again."""
    from .token_store import token_store

    return token_store(_table(spark, sf_dir, "documents"), _tokenizer(WORD_TOKENIZER), END_ID)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` packed into sequences of 1024 ids."""
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"), _tokenizer(BYTE_TOKENIZER), END_ID, CAPACITY)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of ``benchmark`` in ``documents``, with a digest of the items."""
    from .decontaminate import find_passages

    found = find_passages(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without passages that repeat earlier ones."""
    from .line_dedup import dedup_lines

    return dedup_lines(_table(spark, sf_dir, "documents")).select("row.doc_id", "n_lines", "n_removed", "row.text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of ``documents`` under the policies base and v1."""
    from .quality_rules import apply_policy, ledger

    book = apply_policy(apply_policy(ledger(_table(spark, sf_dir, "documents")), "base", "base_kept"), "v1")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents``, learned outside the held-out fold."""
    from .language_id import identify, learn
    from .rowwise import held_out

    docs = _table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")


def queries() -> dict[str, Query]:
    """Every query of this subpackage by name; each takes (spark, sf_dir)."""
    own = [op1_secret_scan, op2_quality_classifier, op3_ngram_jaccard_join, op4_token_counts, op5_token_store, op6_best_fit_packing, op7_benchmark_decontamination, op8_line_dedup, op9_quality_rules, op10_language_id]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express on whole tables."""
    from . import line_dedup, quality_rules

    return {"op8_line_dedup": line_dedup.sql(), "op9_quality_rules": quality_rules.sql()}
