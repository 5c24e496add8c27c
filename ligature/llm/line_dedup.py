"""Deletion of passages that repeat earlier ones, by winnowing over line hashes.

The lines of a document that hold a word form a sequence of hashes. Windows over it hold
``min_words`` words at least and no line more than they need: one begins at every line and grows
to the right, one ends at every line and grows to the left. The line of the least hash in a
window, the first of equals, is a fingerprint; most windows share theirs with their neighbours.
Two places with the same window select the same line of it, so a run of lines that occurs again
has a fingerprint in common with its earlier place, and fingerprints that occur once are done.

Positions join on the fingerprint. Each is compared with the first place of its fingerprint: the
match is extended line by line to both sides, as far as the windows reach that selected the line,
and if it holds one of them, it goes. A common line may stand in many contexts, so windows that
the first place doesn't match may still match another place; only they are compared as wholes, by
a hash of their lines, with the first place of each.

A line goes if and only if it lies in a run of lines of ``min_words`` words or more that occurs,
line for line, at an earlier place (smaller document id, or above in the document). The first
occurrence of every line therefore stays. Lines without a word are passed over when runs are
compared; those inside a deleted run go with it.

DataFrame functions only. Windows are found per document with range frames over word counts; first
places are partial aggregations, so a passage in a third of all documents reaches the shuffle once
a task; the later places then join the first, a join that Spark may split where a passage is hot.
No pair of later places is compared, and row counts stay linear in the number of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release, scratch, small_side
from .rowwise import whole_row

#: ASCII white space, as characters to trim and as a pattern between words.
_SPACE, _SPACES = " \t\n\x0b\x0c\r", r"[\x20\x09-\x0D]+"


def _row_key(id_col: str, text_col: str) -> list[Column]:
    """Rows with the same id and text are one document; a null id sorts first."""
    return [F.col(id_col).cast("long").alias("k0"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("k1")]


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k0, k1, pos, h, w: lines with a word, their hashes and numbers of words."""
    split = docs.select(*_row_key(id_col, text_col), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    line = split.select("k0", "k1", "pos", F.btrim("line", F.lit(_SPACE)).alias("line")).where("line != ''")
    hashed = line.select("k0", "k1", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", _SPACES)).cast("long").alias("w"))
    return hashed.repartition("k0", "k1").distinct()


def _fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """k0, k1, p, h, windows: the lines p that some window selects, and the windows (lo, hi) that
    do. Lines are counted by ``i``, from 1 in each document."""
    by_doc = Window.partitionBy("k0", "k1")
    upto = F.sum("w").over(by_doc.orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    placed = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("w"))

    def frame(over) -> Column:
        return F.struct(F.sum("w").over(over).alias("w"), F.min("i").over(over).alias("lo"), F.max("i").over(over).alias("hi"), F.min(F.struct("h", "i")).over(over).alias("least"))

    right = frame(by_doc.orderBy("before").rangeBetween(0, min_words - 1))
    left = frame(by_doc.orderBy("upto").rangeBetween(1 - min_words, 0))
    framed = placed.select("k0", "k1", right.alias("right"), left.alias("left"))
    both = framed.select("k0", "k1", F.explode(F.array("right", "left")).alias("f")).where(F.col("f.w") >= min_words)
    return both.groupBy("k0", "k1", F.col("f.least.i").alias("p"), F.col("f.least.h").alias("h")).agg(F.collect_set(F.struct("f.lo", "f.hi")).alias("windows"))


def _with_context(found: DataFrame, lines: DataFrame) -> DataFrame:
    """Adds ``lo`` and ``held``: the first line that the windows of a fingerprint reach, and the
    hashes and positions of all that they reach."""
    lo, hi = F.array_min(F.transform("windows", lambda w: w["lo"])), F.array_max(F.transform("windows", lambda w: w["hi"]))
    reach = found.select("k0", "k1", "p", F.explode(F.sequence(lo, hi)).alias("i"))
    own = lines.select(F.col("k0").alias("d0"), F.col("k1").alias("d1"), F.col("i").alias("at"), "h", "pos")
    lined = reach.join(own, F.col("k0").eqNullSafe(F.col("d0")) & (F.col("k1") == F.col("d1")) & (F.col("i") == F.col("at")))
    held = lined.groupBy("k0", "k1", "p").agg(F.array_sort(F.collect_list(F.struct("i", "h", "pos"))).alias("held"))
    held = held.withColumnsRenamed({"k0": "d0", "k1": "d1", "p": "dp"})
    return found.join(held, F.col("k0").eqNullSafe(F.col("d0")) & (F.col("k1") == F.col("d1")) & (F.col("p") == F.col("dp"))).select("k0", "k1", "p", "h", "windows", F.col("held")[0]["i"].alias("lo"), "held")


def _run(a: Column, b: Column) -> Column:
    """How many lines two sequences have in common from their beginnings."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop == 0, F.size(same).cast("long")).otherwise(stop - 1)


def repeated_ranges(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k0, k1, ranges: per document that repeats earlier lines, the positions that go.

    ``ranges`` are disjoint (lo, hi) in ascending order, counted in lines from 0.
    """
    numbered = _lines(docs, id_col, text_col).withColumn("i", F.row_number().over(Window.partitionBy("k0", "k1").orderBy("pos")))
    lines = materialize(numbered, "lines")
    found = materialize(_fingerprints(lines, min_words), "fingerprints")
    place = F.struct("k0", "k1", "p")
    several = materialize(found.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("h"), "repeated")
    known = materialize(_with_context(found.join(small_side(several), "h", "left_semi"), lines), "contexts")
    release(lines, found, several)

    # Extension from the first place of each fingerprint.
    first = known.groupBy("h").agg(F.min(F.struct("k0", "k1", "p", "lo", "held")).alias("e"))
    first = materialize(first.select("h", "e.*").toDF("h", "e0", "e1", "ep", "elo", "eheld"), "first-places")
    later = known.join(small_side(first), "h").where(place > F.struct(F.col("e0").alias("k0"), F.col("e1").alias("k1"), F.col("ep").alias("p")))
    at, at_first = F.col("p") - F.col("lo"), F.col("ep") - F.col("elo")
    right = _run(F.slice("held", at + 1, F.size("held")), F.slice("eheld", at_first + 1, F.size("eheld")))
    left = _run(F.reverse(F.slice("held", F.lit(1), at)), F.reverse(F.slice("eheld", F.lit(1), at_first)))
    extended = later.select("k0", "k1", "lo", "held", "windows", (F.col("p") - left).alias("from"), (F.col("p") + right - 1).alias("to"))
    extended = materialize(extended, "extended")

    def inside(w: Column) -> Column:
        return (w["lo"] >= F.col("from")) & (w["hi"] <= F.col("to"))

    def pos(i: Column) -> Column:
        return F.element_at("held", (i - F.col("lo") + 1).cast("int"))["pos"]

    matched = extended.where(F.exists("windows", inside)).select("k0", "k1", pos(F.col("from")).alias("lo"), pos(F.col("to")).alias("hi"))

    # Windows that the first place doesn't match, as wholes.
    rest = extended.withColumn("w", F.explode(F.filter("windows", lambda w: ~inside(w))))
    lines_of = F.transform(F.slice("held", F.col("w.lo") - F.col("lo") + 1, F.col("w.hi") - F.col("w.lo") + 1), lambda x: x["h"])
    whole = materialize(rest.select("k0", "k1", pos(F.col("w.lo")).alias("lo"), pos(F.col("w.hi")).alias("hi"), F.xxhash64(lines_of).alias("match")), "unmatched")
    place = F.struct("k0", "k1", "lo")
    again = materialize(whole.groupBy("match").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last").select("match", "first"), "first-windows")
    others = whole.join(small_side(again), "match").where(place > F.col("first")).select("k0", "k1", "lo", "hi")

    in_doc = Window.partitionBy("k0", "k1").orderBy("lo", "hi")
    reached = F.max("hi").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    begins = (F.coalesce(reached, F.lit(-2)) < F.col("lo") - 1).cast("long")
    islands = matched.unionByName(others).withColumn("begins", begins).withColumn("island", F.sum("begins").over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("k0", "k1", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("k0", "k1").agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def _worded(lines: Column) -> Column:
    """How many of the lines hold a word."""
    return F.size(F.filter(lines, lambda x: F.btrim(x, F.lit(_SPACE)) != "")).cast("long")


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the shortened text, in ``row``; n_lines and n_removed beside it.

    n_lines counts the \\n-split lines that hold a word, n_removed those of them that went. Null
    texts stay null and have no lines; empty texts stay empty; a null id counts as the smallest;
    repeated rows (same id and text) are one document and change alike; rows that share an id but
    not a text are ordered by a hash of it; an empty table gives an empty result; other columns
    pass through in ``row`` whatever their names.
    """
    with scratch() as keep:
        ranges = small_side(keep(materialize(repeated_ranges(docs, min_words, id_col, text_col), "line-ranges")))
    keyed = docs.select(whole_row(docs).alias("row"), *_row_key(id_col, text_col))
    joined = keyed.withColumnsRenamed({"k0": "d0", "k1": "d1"}).join(ranges, F.col("d0").eqNullSafe(F.col("k0")) & (F.col("d1") == F.col("k1")), "left")
    text = F.col("row").getField(text_col)
    lines = joined.select("row", "ranges", F.split(text, "\n").alias("lines"))

    def between(k: Column) -> Column:
        """Lines between range k - 1 and range k; past the last for k = size."""
        lo = F.when(k == 0, 0).otherwise(F.try_element_at("ranges", k).getField("hi") + 1)
        hi = F.when(k == F.size("ranges"), F.size("lines")).otherwise(F.try_element_at("ranges", k + 1).getField("lo"))
        return F.slice("lines", lo + 1, F.greatest(hi - lo, F.lit(0)))

    left = F.when(F.col("ranges").isNull(), F.col("lines")).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.size("ranges")), between)))
    kept = lines.select("row", "ranges", "lines", left.alias("left"))
    shorter = F.when(F.col("ranges").isNull(), text).otherwise(F.array_join("left", "\n"))
    n_lines = F.coalesce(_worded(F.col("lines")), F.lit(0).cast("long"))
    n_left = F.coalesce(_worded(F.col("left")), F.lit(0).cast("long"))
    n_removed = F.when(F.col("ranges").isNull(), F.lit(0).cast("long")).otherwise(n_lines - n_left)
    fields = [(shorter if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return kept.select(F.struct(*fields).alias("row"), n_lines.alias("n_lines"), n_removed.alias("n_removed"))


def sql(min_words: int = 50) -> str:
    """The same over ``documents`` in DuckDB: doc_id, n_lines, n_removed, text."""
    return rf"""
    WITH split AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
    ), trimmed AS (
      SELECT doc_id, pos, line, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM split
    ), lines AS (
      SELECT doc_id, pos, body, len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS w FROM trimmed WHERE body <> ''
    ), placed AS (
      SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) - w AS before FROM lines
    ), windows AS (
      SELECT doc_id, sum(w) OVER r AS w, min(pos) OVER r AS lo, max(pos) OVER r AS hi, list(body) OVER r AS held FROM placed
      WINDOW r AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND {min_words - 1} FOLLOWING)
      UNION ALL
      SELECT doc_id, sum(w) OVER l, min(pos) OVER l, max(pos) OVER l, list(body) OVER l FROM placed
      WINDOW l AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN {min_words - 1} PRECEDING AND CURRENT ROW)
    ), whole AS (
      SELECT doc_id, lo, hi, array_to_string(held, chr(10)) AS held FROM windows WHERE w >= {min_words}
    ), firsts AS (
      SELECT held, min((doc_id, lo)) AS first FROM whole GROUP BY held
    ), later AS (
      SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS pos FROM whole JOIN firsts USING (held) WHERE (doc_id, lo) > first
    ), kept AS (
      SELECT t.doc_id, string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (l.pos IS NULL) AS text, count(*) FILTER (t.body <> '') AS n_lines, count(*) FILTER (t.body <> '' AND l.pos IS NOT NULL) AS n_removed
      FROM trimmed t LEFT JOIN later l ON t.doc_id = l.doc_id AND t.pos = l.pos GROUP BY t.doc_id
    )
    SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """
