"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document into one bit of ``failed``, beside the measurements it
used. A policy is a versioned set of rules, that is a mask: applying, changing or ablating one is
integer arithmetic over the ledger, and texts are not read again. DataFrame functions only; the
ledger is a projection of the documents without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SPACE, _SPACES = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"

#: Rules in bit order, as conditions over the measurements. Whole numbers only.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "capitals": "2 * n_capitals > word_chars",
}

#: Policies by version: the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "duplicate_lines", "short_words", "long_words", "capitals"],
}

_MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]


def mask(rules: list[str]) -> int:
    """The bits of some rules."""
    return sum(1 << list(RULES).index(r) for r in rules)


def _measure(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the measurements.

    Repeated windows of three words are found by sorting pairs of the window's 64-bit hash and
    its position. Positions of equal neighbours are those of repeated windows; the words
    that they cover are summed over their sorted gaps. Every column below is used more than once
    by the next projection, so none is worked out again for each element.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    none, no_keys = F.array().cast("array<bigint>"), F.array().cast("array<struct<h:bigint,at:bigint>>")
    t = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.btrim(text, F.lit(_SPACE)).alias("body"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    split = t.select(
        "doc_id",
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", _SPACES)).alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.octet_length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
    )
    n = F.size("words")
    counted = split.select(
        "doc_id", "words", "n_symbols", "n_capitals", n.cast("long").alias("n_words"), F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    words = F.col("words")
    key = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.cast("long").alias("at")))
    keyed = counted.withColumn("keys", F.sort_array(F.when(n >= 3, key).otherwise(no_keys)))
    keys, m = F.col("keys"), F.size("keys")

    def same(a: Column, b: Column) -> Column:
        return keys[a]["h"] == keys[b]["h"]

    again = F.filter(F.sequence(F.lit(0), m - 1), lambda k: ((k > 0) & same(k, F.greatest(k - 1, F.lit(0)))) | ((k < m - 1) & same(k, F.least(k + 1, m - 1))))
    places = F.transform(again, lambda k: keys[k]["at"])
    found = keyed.withColumn("at", F.sort_array(F.when(m >= 2, places).otherwise(none)))
    at = F.col("at")
    gaps = F.aggregate(F.sequence(F.lit(1), F.size("at") - 1), F.lit(3).cast("long"), lambda s, k: s + F.least(F.lit(3).cast("long"), at[k] - at[k - 1]))
    repeats = F.when(F.size("at") >= 2, gaps).otherwise(F.lit(0).cast("long"))
    return found.select("doc_id", *[c for c in _MEASURES if c != "n_repeat_words"], repeats.alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measurements, and ``failed``, a bit for every rule.

    Null and empty texts have no words and fail ``few_words``; rows with the same or a null id
    each have their row; an empty table gives an empty ledger; other columns are not read.
    """
    measured = _measure(docs, id_col, text_col)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measured.withColumn("failed", failed.cast("long"))


def apply_policy(book: DataFrame, version: str, name: str = "kept") -> DataFrame:
    """Adds ``name``: whether a document passes all rules of a policy."""
    return book.withColumn(name, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0)


def ablation(book: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and the policy's total.

    ``only`` is what the policy would keep without the rule. One pass over the ledger.
    """
    rules = POLICIES[version]
    own = F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long"))
    sums = [F.count(F.when(own != 0, 1)).alias("rejected")]
    for r in rules:
        bit = F.lit(mask([r])).cast("long")
        sums += [F.count(F.when(own.bitwiseAND(bit) != 0, 1)).alias(f"{r}_fails"), F.count(F.when(own == bit, 1)).alias(f"{r}_only")]
    total = book.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_fails").alias("fails"), F.col(f"{r}_only").alias("only")) for r in rules])).alias("x")
    return total.select(rows, "rejected").select(F.lit(version).alias("version"), "x.rule", "x.fails", "x.only", "rejected")


def sql() -> str:
    """The query's columns over ``documents`` in DuckDB."""
    base, rest = (" OR ".join(f"({RULES[r]})" for r in POLICIES[v]) for v in ("base", "v1"))
    return rf"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
    ), runs AS (
      SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
    ), again AS (
      SELECT r, i FROM runs QUALIFY count(*) OVER (PARTITION BY r, g) > 1
    ), covered AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r
    ), lines AS (
      SELECT r, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
    ), m AS (
      SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_capitals
      FROM d LEFT JOIN covered c ON c.r = d.r LEFT JOIN lines l ON l.r = d.r
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) AS base_failed, NOT ({rest}) AS kept FROM m
    """
