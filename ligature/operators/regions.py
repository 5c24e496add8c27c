"""Intervals of contigs, and edits of a bin that is laid out as a row of segments.

A segment table has bin, rank, name, start, end, is_reverse: stretches of contigs (from 0, end not
included) one after another in each bin. Edits name places in the bin, one edit for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = ["bin", "rank", "name", "start", "end", "is_reverse"]


def middle(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def overlap(name1: Column, start1: Column, end1: Column, name2: Column, start2: Column, end2: Column) -> Column:
    """Bases that two stretches share, 0 on different contigs."""
    shared = F.least(end1, end2) - F.greatest(start1, start2)
    return F.when((name1 == name2) & (shared > 0), shared).otherwise(F.lit(0).cast("long"))


def split_stretch(start: Column, end: Column, is_reverse: Column, at: Column) -> tuple[Column, Column]:
    """The two parts of a stretch, cut ``at`` bases from where it begins in its orientation."""
    cut = F.when(is_reverse, end - at).otherwise(start + at)
    one = F.struct(F.when(is_reverse, cut).otherwise(start).alias("start"), F.when(is_reverse, end).otherwise(cut).alias("end"))
    two = F.struct(F.when(is_reverse, start).otherwise(cut).alias("start"), F.when(is_reverse, cut).otherwise(end).alias("end"))
    return one, two


def placed(segments: DataFrame) -> DataFrame:
    """Adds ``at`` and ``to``, where each segment lies in its bin."""
    to = F.sum(F.col("end") - F.col("start")).over(Window.partitionBy("bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return segments.withColumn("to", to).withColumn("at", F.col("to") - (F.col("end") - F.col("start")))


def _cut(segments: DataFrame, edits: DataFrame, places: list[str]) -> DataFrame:
    """Segments cut at the places of their bin's edit, with ``at``, ``to`` and the edit's columns.

    A place outside the bin is an error. Bins without an edit have null there.
    """
    own = placed(segments)
    length = own.groupBy(F.col("bin").alias("_l")).agg(F.max("to").alias("length"))
    asked = edits.withColumnRenamed("bin", "_e").join(length, F.col("_e") == F.col("_l"))
    inside = F.lit(True)
    for p in places:
        inside &= (F.col(p) >= 0) & (F.col(p) <= F.col("length"))
    asked = asked.where(F.when(inside, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("a place is outside the bin "), "_e")).cast("boolean"))).drop("_l", "length")
    joined = own.withColumnsRenamed({"start": "_s", "end": "_t"}).join(asked, F.col("bin") == F.col("_e"), "left")
    cuts = F.array(*[F.col(p) for p in places])
    borders = F.array_distinct(F.concat(F.array("at"), F.array_sort(F.filter(cuts, lambda c: (c > F.col("at")) & (c < F.col("to")))), F.array("to")))
    pieces = F.transform(F.sequence(F.lit(1), F.size("borders") - 1), lambda k: F.struct(F.element_at("borders", k).alias("at"), F.element_at("borders", k + 1).alias("to")))
    cut = joined.withColumn("borders", borders).where("size(borders) > 1").withColumn("piece", F.explode(pieces))
    lo, hi = F.col("piece.at") - F.col("at"), F.col("piece.to") - F.col("at")
    start = F.when(F.col("is_reverse"), F.col("_t") - hi).otherwise(F.col("_s") + lo)
    end = F.when(F.col("is_reverse"), F.col("_t") - lo).otherwise(F.col("_s") + hi)
    return cut.select("bin", "name", start.alias("start"), end.alias("end"), "is_reverse", F.col("piece.at").alias("at"), F.col("piece.to").alias("to"), *[c for c in edits.columns if c != "bin"])


def _ranked(rows: DataFrame, *order: Column | str) -> DataFrame:
    rank = (F.row_number().over(Window.partitionBy("bin").orderBy(*order)) - 1).cast("long")
    return rows.withColumn("rank", rank).select(*SEGMENT)


def invert(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Turns the stretch from ``lo`` to ``hi`` of each bin of ``edits`` (bin, lo, hi) around."""
    rows = _cut(segments, edits, ["lo", "hi"])
    inside = F.coalesce((F.col("at") >= F.col("lo")) & (F.col("to") <= F.col("hi")), F.lit(False))
    at = F.when(inside, F.col("lo") + F.col("hi") - F.col("to")).otherwise(F.col("at"))
    return _ranked(rows.withColumn("is_reverse", F.col("is_reverse") != inside).withColumn("at", at), "at")


def delete(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Takes the stretch from ``lo`` to ``hi`` out of each bin of ``edits`` (bin, lo, hi)."""
    rows = _cut(segments, edits, ["lo", "hi"])
    return _ranked(rows.where(~F.coalesce((F.col("at") >= F.col("lo")) & (F.col("to") <= F.col("hi")), F.lit(False))), "at")


def insert(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """Puts a stretch into each bin of ``edits`` (bin, place, name, start, end, is_reverse)."""
    rows = _cut(segments, edits.select("bin", "place"), ["place"]).withColumn("new", F.lit(False))
    new = edits.select("bin", "name", "start", "end", "is_reverse", F.col("place").alias("at"), F.lit(True).alias("new"))
    return _ranked(rows.select(new.columns).unionByName(new), "at", F.col("new").desc())


def between(segments: DataFrame, edits: DataFrame) -> DataFrame:
    """The segments from ``lo`` to ``hi`` of each bin of ``edits`` (bin, lo, hi), cut to that stretch."""
    return _ranked(_cut(segments, edits, ["lo", "hi"]).where("at >= lo and to <= hi"), "at")


def breakpoints(segments: DataFrame) -> DataFrame:
    """Where one segment follows another: bin, rank of the first, and of both name, place and sign.

    The place is the end of the first and the start of the second segment as they stand in the
    table; a sign is whether the contig goes on from there in its own direction.
    """
    over = Window.partitionBy("bin").orderBy("rank")
    two = {c: F.lead(c).over(over) for c in ("name", "start", "end", "is_reverse")}
    rows = segments.select("bin", "rank", "name", "start", "end", "is_reverse", *[c.alias(f"{n}2") for n, c in two.items()]).where("name2 is not null")
    return rows.select("bin", "rank", F.col("name").alias("name1"), F.col("end").alias("pos1"), (~F.col("is_reverse")).alias("sign1"), "name2", F.col("start2").alias("pos2"), F.col("is_reverse2").alias("sign2"), F.col("start").alias("start1"), F.col("end").alias("end1"), "start2", "end2")


def connectable(points: DataFrame, min_overlap: int = 1000) -> DataFrame:
    """Pairs of breakpoints (bin, rank and bin2, rank2) of which the first leads to the second.

    The first's second contig is the second's first, the signs there differ, and some contig of
    the one shares ``min_overlap`` bases with one of the other. A join on the contig.
    """
    b = points.select(*[F.col(c).alias(f"o_{c}") for c in points.columns])
    met = points.join(b, (F.col("name2") == F.col("o_name1")) & (F.col("sign2") != F.col("o_sign1")))
    shared = [overlap(F.col(f"name{i}"), F.col(f"start{i}"), F.col(f"end{i}"), F.col(f"o_name{j}"), F.col(f"o_start{j}"), F.col(f"o_end{j}")) for i in (1, 2) for j in (1, 2)]
    return met.where(F.greatest(*shared) >= min_overlap).select("bin", "rank", F.col("o_bin").alias("bin2"), F.col("o_rank").alias("rank2"), F.greatest(*shared).alias("shared"))
