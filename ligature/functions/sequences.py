"""Scalar functions over sequences and names, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Recognition sites of restriction enzymes (N: any base).
SITES = {
    "AluI": "AGCT",
    "ApoI": "RAATTY",
    "BamHI": "GGATCC",
    "BfaI": "CTAG",
    "BglII": "AGATCT",
    "CviAII": "CATG",
    "DdeI": "CTNAG",
    "DpnII": "GATC",
    "EcoRI": "GAATTC",
    "EcoRV": "GATATC",
    "HaeIII": "GGCC",
    "HindIII": "AAGCTT",
    "HinfI": "GANTC",
    "HpaII": "CCGG",
    "MboI": "GATC",
    "MluCI": "AATT",
    "MseI": "TTAA",
    "MspI": "CCGG",
    "NcoI": "CCATGG",
    "NlaIII": "CATG",
    "Sau3AI": "GATC",
    "TaqI": "TCGA",
}
# What ambiguous letters stand for.
AMBIGUOUS = {"N": ".", "R": "[AG]", "Y": "[CT]", "W": "[AT]", "S": "[CG]", "K": "[GT]", "M": "[AC]"}


def site_pattern(enzymes: str | list[str]) -> str:
    """A pattern for the sites of enzymes given by name or as a comma-separated list."""
    names = enzymes.split(",") if isinstance(enzymes, str) else enzymes
    missing = [n for n in names if n.strip() not in SITES]
    if missing:
        raise ValueError(f"unknown enzymes: {', '.join(missing)}")
    sites = sorted({"".join(AMBIGUOUS.get(c, c) for c in SITES[n.strip()]) for n in names})
    return "|".join(sites)


def _letters(seq: Column, letters: str) -> Column:
    """How often any of the letters occurs."""
    return F.octet_length(F.regexp_replace(seq, f"[^{re.escape(letters)}]+", "")).cast("long")


def acgt_count(seq: Column) -> Column:
    return _letters(seq, "ACGTacgt")


def gc_content(seq: Column, over: str = "acgt") -> Column:
    """Percent of G and C, cut after 13 decimals of the share; null for no letters.

    ``over``: of A, C, G and T ("acgt"), or of the whole length ("length").
    """
    total = acgt_count(seq) if over == "acgt" else F.char_length(seq).cast("long")
    share = F.try_divide(_letters(seq, "GCgc") * F.lit(100.0), total)
    return F.floor(share * F.lit(1e11)) / F.lit(1e11)


def restriction_sites(seq: Column, pattern: str) -> Column:
    """Fragments that the sites cut a sequence into: non-overlapping matches and one."""
    return (F.regexp_count(seq, F.lit(pattern)) + 1).cast("long")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def fetch(seq: Column, start: Column, end: Column, is_reverse: Column) -> Column:
    """Bases start to end (from 0, end not included), of the other strand if reversed."""
    part = F.substring(seq, start + 1, end - start)
    return F.when(is_reverse, reverse_complement(part)).otherwise(part)


def bin_name(prefix: str, over_id: Column, rec_id: Column) -> Column:
    """prefix_00001_00000."""
    return F.format_string(prefix + "_%05d_%05d", over_id, rec_id)


def bin_parts(name: Column) -> tuple[Column, Column]:
    """The overlapping and the recursive id in a bin's name."""
    parts = F.split(name, "_")
    return F.element_at(parts, -2), F.element_at(parts, -1)


def natural_key(name: Column) -> Column:
    """Orders names as people do: digits by value, however many, before other characters."""
    parts = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"))

    def key(part: Column) -> Column:
        value = F.ltrim(part, F.lit("0"))  # of two numbers without leading zeros the longer is larger
        digits = F.struct(F.lit(0).alias("kind"), F.char_length(value).alias("size"), value.alias("text"))
        return F.when(part.rlike("^[0-9]"), digits).otherwise(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("size"), part.alias("text")))

    return F.transform(parts, key)


def composition(seqs: DataFrame, pattern: str, name: str = "name", seq: str = "seq") -> DataFrame:
    """name, length, gc, rs of a sequence table."""
    s = F.col(seq)
    return seqs.select(F.col(name).alias("name"), F.char_length(s).cast("long").alias("length"), gc_content(s).alias("gc"), restriction_sites(s, pattern).alias("rs"))
