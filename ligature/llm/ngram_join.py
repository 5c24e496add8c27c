"""Similarity join of documents' word n-gram sets under Jaccard, by vertical partitioning.

n-grams are 64-bit hashes, and the order of the hashes is cut into fragments. That cuts every
document's sorted set into segments, and whatever is counted is counted per fragment and summed.

*Support.* The support of a set is how many of its n-grams some other set holds. A set of size n
has a link only if its support reaches the threshold's share of n. Every fragment holds all
occurrences of its n-grams, so supports are counted there, fragment by fragment, and summed per
set. Most sets end here.

*Candidates.* The n-grams of the sets that are left are ordered by how many of these sets hold
them, rarest first. Two sets of sizes m and n that link share at least a n-grams, where a follows
from the threshold and m + n. At the first n-gram that they share, in that order, a n-grams are
left in both, it included. So sets meet on n-grams near the beginning of their order, and a place
too far down for the two sizes rules a pair out. Rare n-grams that nobody shares come first, so
sets with many of them don't meet on the common ones.

*Overlaps.* The overlap of a candidate pair is counted per fragment, where only two segments
meet, and the partial counts are summed per pair.

Copies and hot groups: equal sets are one vertex. Where many sets meet, all are compared with one
of them, the best supported, and those that are still in another component with the best of
these. Only then are the pairs across components compared, and only where the places allow it. So
no group is expanded into all its pairs, while every link between components is found and the
components are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize, release, scratch, ship, small_side
from . import words as W
from .rowwise import per_document, small_batches, trim

_U = np.uint64
#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: n-grams in a fragment in which supports are counted, and in a batch of documents there; both
#: bound the memory of a task.
FRAGMENT_GRAMS, BATCH_GRAMS = 1 << 21, 1 << 18
_SETS = "doc_id long, key long, n long"
_CUTS = "fragment int, keys binary, sizes binary, base binary, grams binary, common binary"
_COUNTS = "bucket int, keys binary, counts binary"
_SEGMENTS = "key long, n long, fragment int, grams array<long>"


def _gram_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document, its sorted distinct n-grams); a shorter text's words are one n-gram."""
    for c in W.chunks(texts, W.SPACED_LOWER):
        grams = W.grams(c.hashes, n)
        for i in range(len(c.bounds) - 1):
            a, b = int(c.bounds[i]), int(c.bounds[i + 1])
            if b - a >= n:
                yield c.first + i, np.unique(grams[a : b - n + 1])
            elif b > a:
                yield c.first + i, W.grams(c.hashes[a:b], b - a)
            else:
                yield c.first + i, np.zeros(0, np.uint64)


def _key(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = W.mix(grams ^ _U(0xDA942042E4DD58B5)).sum(dtype=np.uint64)
        return int(W.mix(np.array([total + _U(len(grams))], np.uint64)).view(np.int64)[0])


def _need(n, num: int, den: int):
    """The least support of a set of size n that has a link."""
    return (n * num + den - 1) // den


def _sets(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Per document the key and size of its set; no key without words."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for i, grams in _gram_sets(batch.column(1), n):
                sizes[i] = len(grams)
                keys[i] = _key(grams)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(keys, mask=sizes == 0), pa.array(sizes)], ["doc_id", "key", "n"])
        trim()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _SETS)


def _packed(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of a number of values of one width for each row."""
    ends = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths * values.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """All values of such a column, row after row."""
    parts = [np.zeros(0, kind)]
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], np.int32, len(chunk) + 1, 4 * chunk.offset)
            parts.append(np.frombuffer(chunk.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(kind))
    return np.concatenate(parts)


def _cut_batch(sets: list[tuple[int, np.ndarray]], fragments: int, home: int, num: int, den: int) -> pa.RecordBatch:
    """The n-grams of different sets (key, n-grams) by fragment, as rows of ``_CUTS``.

    ``keys`` and ``sizes`` say whose ``grams`` follow; these are the last 32 bits, which tell
    n-grams of one fragment apart well enough (what they confuse only adds to a support).
    ``common`` are n-grams of several of the sets, sent once and counted here. One more row, for
    the fragment ``home``, has ``base`` in place of sizes: that count less what each set needs.
    """
    keys = np.array([k for k, _ in sets], np.int64)
    lengths = np.array([len(g) for _, g in sets], np.int64)
    flat, own = np.concatenate([g for _, g in sets]), np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(flat)
    flat, own = flat[order], own[order]
    first = np.ones(len(flat), bool)
    first[1:] = flat[1:] != flat[:-1]
    several = ~first
    several[:-1] |= ~first[1:]
    base = (np.bincount(own[several], minlength=len(sets)) - _need(lengths, num, den)).astype(np.int32)

    def fragment_of(grams: np.ndarray) -> np.ndarray:
        return (((grams >> _U(32)) * _U(fragments)) >> _U(32)).astype(np.int64)

    once, by, common = flat[~several], own[~several], flat[several & first]
    f = fragment_of(once)
    order = np.argsort(f * len(sets) + by, kind="stable")
    once, by, f = once[order], by[order], f[order]
    start = np.ones(len(f), bool)
    start[1:] = (f[1:] != f[:-1]) | (by[1:] != by[:-1])
    at = np.flatnonzero(start)
    sizes, whose, where = np.diff(at, append=len(f)).astype(np.int32), by[at], f[at]
    fc = fragment_of(common)
    shown = np.unique(np.concatenate([f, fc]))

    def rows(of: np.ndarray) -> np.ndarray:
        """How many of the sorted values belong to each fragment, and to ``home`` at the end."""
        return np.append(np.searchsorted(of, shown, "right") - np.searchsorted(of, shown), 0)

    last, own_row = np.uint64(0xFFFFFFFF), np.zeros(len(shown) + 1, np.int64)
    own_row[-1] = len(sets)
    arrays = [
        pa.array(np.append(shown, home).astype(np.int32)),
        _packed(np.concatenate([keys[whose], keys]), rows(where) + own_row),
        _packed(sizes, rows(where)),
        _packed(base, own_row),
        _packed((once & last).astype(np.uint32), rows(f)),
        _packed((common & last).astype(np.uint32), rows(fc)),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["fragment", "keys", "sizes", "base", "grams", "common"])


def _count_fragment(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """From a fragment's rows of ``_CUTS`` to rows of ``_COUNTS``, by the bucket of the key.

    Per set with n-grams in the fragment, how many of these another set holds, plus its ``base``.
    """

    def run(cut: pa.Table) -> pa.Table:
        home = pc.not_equal(pc.binary_length(cut["base"]), 0)
        fixed, cut = cut.filter(home), cut.filter(pc.invert(home))
        keys, sizes = _unpacked(cut["keys"], np.int64), _unpacked(cut["sizes"], np.int32)
        grams, common = _unpacked(cut["grams"], np.uint32), _unpacked(cut["common"], np.uint32)
        names, rank = np.unique(keys, return_inverse=True)
        both = np.concatenate([grams, common]).astype(np.uint64)
        both <<= _U(32)
        both[: len(grams)] |= np.repeat(rank.astype(np.uint32), sizes)
        both[len(grams) :] |= _U(len(names))  # common ones: as if of a set of no name
        both.sort()
        first = np.ones(len(both), bool)
        first[1:] = (both[1:] ^ both[:-1]) > _U(0xFFFFFFFF)
        own = both.astype(np.uint32)  # the lower half; sorted within a gram
        del both
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(own)) if len(own) else starts
        held = np.repeat(own[starts] != own[ends - 1], ends - starts)
        sums = np.bincount(own[held], minlength=len(names) + 1)[: len(names)]
        some = np.flatnonzero(sums)
        keys = np.concatenate([names[some], _unpacked(fixed["keys"], np.int64)])
        counts = np.concatenate([sums[some].astype(np.int32), _unpacked(fixed["base"], np.int32)])
        bucket = keys % buckets
        order = np.argsort(bucket, kind="stable")
        shown, n = np.unique(bucket, return_counts=True)
        return pa.table({"bucket": shown.astype(np.int32), "keys": _packed(keys[order], n), "counts": _packed(counts[order], n)})

    return run


def _sum_counts(rows: pa.Table) -> pa.Table:
    """The keys of a bucket whose counts sum to no less than 0."""
    keys, at = np.unique(_unpacked(rows["keys"], np.int64), return_inverse=True)
    sums = np.bincount(at, weights=_unpacked(rows["counts"], np.int32), minlength=len(keys))
    return pa.table({"key": keys[sums >= 0]})


def _supported(docs: DataFrame, n: int, num: int, den: int, fragments: int, buckets: int, text_col: str) -> DataFrame:
    """The keys of sets whose support allows a link.

    Each row of a set sends the n-grams and, once, what is missing to the need; so a set with
    several rows has a multiple of its surplus, of the same sign.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        total = made = 0
        for batch in batches:
            for _, grams in _gram_sets(batch.column(0), n):
                if len(grams) and (key := _key(grams)) not in held:
                    held[key] = grams
                    total += len(grams)
                    if total >= BATCH_GRAMS:
                        yield _cut_batch(list(held.items()), fragments, made % fragments, num, den)
                        held, total, made = {}, 0, made + 1
        if held:
            yield _cut_batch(list(held.items()), fragments, made % fragments, num, den)
        held = {}
        trim()

    cut = docs.select(F.col(text_col).alias("text")).mapInArrow(run, _CUTS)
    counted = cut.groupBy("fragment").applyInArrow(_count_fragment(buckets), _COUNTS)
    return counted.groupBy("bucket").applyInArrow(_sum_counts, "key long")


def _wanted(sets: DataFrame) -> DataFrame:
    """Where the text of each key is read: key, its smallest doc_id, and whether that id has the
    key in several rows. The id is null if all rows of a key have none."""
    rows = sets.groupBy("key", "doc_id").agg(F.count("*").alias("c"))
    least = rows.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "c")).alias("at"))
    return least.select("key", "at.doc_id", (F.col("at.c") > 1).alias("repeated"))


def _segments(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Sets of the wanted keys (see ``_wanted``), one row per key and fragment of the order.

    Rows that repeat an id and its key each come out of the join; only they are shuffled, to keep
    one of each.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    borders = np.array([(i << 64) // FRAGMENTS for i in range(1, FRAGMENTS)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                keys, sizes, grams, lengths = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                want = some.column(0).to_pylist()
                for i, g in _gram_sets(some.column(1), n):
                    if not len(g) or _key(g) != want[i]:  # another text under the same id
                        continue
                    keys.append(want[i])
                    sizes.append(len(g))
                    grams.append(g)
                    lengths.append(np.diff(np.concatenate([[0], np.searchsorted(g, borders), [len(g)]])))
                arrays = [
                    pa.array(np.repeat(np.array(keys, np.int64), FRAGMENTS)), pa.array(np.repeat(np.array(sizes, np.int64), FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(keys))),
                    W.ragged(W.signed(np.concatenate(grams)), np.concatenate(lengths)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "fragment", "grams"])
        trim()

    def cut_up(some: DataFrame) -> DataFrame:
        return texts.join(small_side(some), F.col("id").eqNullSafe(F.col("doc_id"))).select("key", "text").mapInArrow(run, _SEGMENTS)

    repeated = wanted.where("repeated")
    if repeated.isEmpty():
        return cut_up(wanted)
    return cut_up(wanted.where("not repeated")).unionByName(cut_up(repeated).dropDuplicates(["key", "fragment"]))


def _verify(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold: partial overlaps per fragment, summed per pair."""
    left = segments.select(F.col("key").alias("a"), F.col("n").alias("na"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("key").alias("b"), F.col("n").alias("nb"), "fragment", F.col("grams").alias("gb"))
    met = pairs.join(left, "a").join(right, ["b", "fragment"])
    partial = met.select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("shared"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"))
    return total.where(den * F.col("shared") >= num * (F.col("na") + F.col("nb") - F.col("shared"))).select("a", "b")


def _postings(segments: DataFrame, num: int, den: int) -> DataFrame:
    """gram, key, n, rest, alone: the n-grams on which sets may meet another.

    ``rest`` is how many n-grams of the set are left from this one on, in the order of rarity,
    and ``alone`` the share of those that no other set holds.
    """
    single = segments.select("key", "n", F.explode("grams").alias("gram"))
    often = single.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("key")
    shared = single.join(often, "gram").select("key", "n", "gram", F.count("*").over(own).alias("s"), F.row_number().over(own.orderBy("df", "gram")).alias("nth"))
    placed = shared.withColumn("rest", F.col("s") - F.col("nth") + 1)
    return placed.where(den * F.col("rest") >= num * F.col("n")).select("gram", "key", "n", "rest", ((F.col("n") - F.col("s")) / F.col("n")).alias("alone"))


def _may_link(num: int, den: int) -> Column:
    """Whether two sets that first meet here (n, rest and n2, rest2) may reach the threshold."""
    return (num + den) * F.least("rest", "rest2") >= num * (F.col("n") + F.col("n2"))


def _star(met: DataFrame, num: int, den: int, first: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of all sets that meet on an n-gram with the best supported of them.

    ``met``: postings with ``part``, the component; pairs within one are left out. With ``first``
    (gram, of) the best is taken among those outside the component ``of``.
    """
    best = F.min(F.struct("alone", "key", "n", "rest", "part")).alias("head")
    among = met if first is None else met.join(small_side(first), "gram").where(F.col("part") != F.col("of"))
    heads = among.groupBy("gram").agg(best).select("gram", F.col("head.key").alias("b"), F.col("head.n").alias("n2"), F.col("head.rest").alias("rest2"), F.col("head.part").alias("part2"))
    heads = materialize(heads, "heads")
    return met.join(small_side(heads), "gram").where((F.col("part") != F.col("part2")) & _may_link(num, den)).select(F.col("key").alias("a"), "b").distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", keys: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without ASCII white space after lowering A-Z; a set holds the distinct
    n-word shingles, or the whole sequence as one if there are fewer words. Documents link when
    ``den * intersection >= num * union``; component_id is the smallest doc_id that links reach.
    Null, empty and blank texts have no shingles, link with nothing and are their own component;
    every row is a document of its own, so repeated rows and rows that share an id are each
    answered, and rows with a null id take part (component_id null if all of a component are);
    an empty table gives no rows; other columns are not read. ``keys`` adds set_key (see
    ``set_keys``) and component_key, which tell rows and components of one id apart; both are
    null without words.
    """
    with small_batches(docs.sparkSession), scratch() as keep:
        sets = keep(materialize(_sets(docs, n, id_col, text_col), "gram-sets"))
        parts = _components(docs, sets, n, num, den, id_col, text_col)
        shared = keep(materialize(_smallest(sets, parts), "shared-keys"))
    own = sets.withColumnRenamed("key", "set_key").join(small_side(shared), F.col("set_key") == F.col("key"), "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id")
    part = F.coalesce("part", "set_key").alias("component_key")
    return own.select("doc_id", F.col("n").alias("n_shingles"), component, *["set_key", part] * keys)


def _smallest(sets: DataFrame, parts: DataFrame) -> DataFrame:
    """key, part, smallest: component and its least doc_id, of sets with several rows or a link."""
    per = sets.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("c"))
    placed = per.join(small_side(parts), F.col("key") == F.col("node"), "left").where("c > 1 or component is not null")
    placed = materialize(placed.select("key", "component", "least"), "placed-keys")
    of = placed.where("component is not null").groupBy(F.col("component").alias("of")).agg(F.min("least").alias("smallest"))
    found = placed.join(small_side(materialize(of, "smallest")), F.col("component") == F.col("of"), "left")
    return found.select("key", F.coalesce("component", "key").alias("part"), F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("smallest")).alias("smallest"))


def set_keys(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_key and ``row``, the input row as a struct; rows with the same set have the same key."""

    def make():
        def kernel(texts: pa.Array) -> list[pa.Array]:
            found = [None] * len(texts)
            for i, grams in _gram_sets(texts, n):
                found[i] = _key(grams) if len(grams) else None
            return [pa.array(found, pa.int64())]

        return kernel

    return per_document(docs, make, "set_key long", id_col, text_col, carry=True)


def _components(docs: DataFrame, sets: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """node and component, both keys, of the sets that have a link."""
    total = sets.agg(F.sum("n")).first()[0] or 0
    # Enough buckets that the counts of one stay small.
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total >> 22)
    able = materialize(_supported(docs, n, num, den, max(1, -(-total // FRAGMENT_GRAMS)), buckets, text_col), "able")
    wanted = materialize(_wanted(sets.join(small_side(able), "key", "left_semi")), "wanted")
    segments = materialize(_segments(docs, wanted, n, id_col, text_col), "segments")
    release(able, wanted)
    postings = materialize(_postings(segments, num, den), "postings")

    pairs = materialize(_star(postings.withColumn("part", F.col("key")), num, den), "pairs")
    links = materialize(_verify(pairs, segments, num, den), "links")
    release(pairs)
    for last in (False, True):
        parts = materialize(connected_components(links, "a", "b"), "parts")
        placed = postings.join(small_side(parts), F.col("key") == F.col("node"), "left").select(*postings.columns, F.coalesce("component", "key").alias("part"))
        best = placed.groupBy("gram").agg(F.min("part").alias("one"), F.max("part").alias("two"), F.min(F.struct("alone", "key", "part")).alias("head"))
        mixed = materialize(best.where("one != two").select("gram", F.col("head.part").alias("of")), "mixed")
        met = materialize(placed.join(small_side(mixed.select("gram")), "gram"), "met")
        if not last:
            pairs = _star(met, num, den, mixed)
        else:  # what is outside the best one's component, with all across
            here = materialize(met.join(small_side(mixed), "gram").where(F.col("part") != F.col("of")).drop("of", "alone"), "apart")
            there = met.select("gram", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "rest", "part")])
            across = small_side(here).join(there, "gram").where((F.col("part") != F.col("part2")) & _may_link(num, den))
            pairs = across.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()
        pairs = materialize(pairs, "pairs")
        found = materialize(_verify(pairs, segments, num, den), "links")
        release(pairs, met, mixed, parts)
        links = materialize(links.union(found), "links")
    return materialize(connected_components(links, "a", "b"), "parts")
