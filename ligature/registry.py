"""The queries over contact data, by name, and the SQL that each must agree with.

Every query runs over whole tables. Names say the kind of operator first. SQL is given where it
can express a query; the rest are seeded or sequential kernels, which tests hold against brute
force and invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import projection as P
from .functions import sequences as S
from .operators import community, consensus, layout, mobile, pairs, quality, scaffold
from .operators import network as net
from .projection import with_views
from .storage import materialize

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Parameters of the queries.
MAP_BIN, WINDOW, SITE_GAP, LOOP_SITES, UNCUT_SITES = 5000, 5000, 400, 4, 6
ENZYMES = "HinfI,MluCI"
OVERLAP, STEP = 0.8, 1


def _query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    """Every query of the library by name; each takes (spark, sf_dir)."""
    from . import registry_tables  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    from . import registry_tables  # noqa: F401

    return dict(_SQL)


# Views that several SQL texts share.
_UPPER = """ordered AS (SELECT read_id, sample, mapq, (c1 = c2 AND pos1 <= pos2) OR c1 < c2 AS k, * EXCLUDE (read_id, sample, mapq) FROM pairs),
 upper AS (SELECT CASE WHEN k THEN c1 ELSE c2 END AS c1, CASE WHEN k THEN pos1 ELSE pos2 END AS pos1, CASE WHEN k THEN strand1 ELSE strand2 END AS strand1,
   CASE WHEN k THEN c2 ELSE c1 END AS c2, CASE WHEN k THEN pos2 ELSE pos1 END AS pos2, CASE
 WHEN k THEN strand2 ELSE strand1 END AS strand2, sample, mapq, read_id FROM ordered)"""
_HITS = "hits AS (SELECT id, count(*) AS hit FROM (SELECT c1 AS id FROM pairs UNION ALL SELECT c2 FROM pairs) GROUP BY id)"
_FAR = "pos1 > {e} AND pos2 > {e} AND x.size - pos1 > {e} AND y.size - pos2 > {e} AND c1 <> c2"
_EDGES = f"""edges AS (SELECT {{s}}least(c1, c2) AS src, greatest(c1, c2) AS dst, count(*) AS n FROM pairs JOIN contigs x ON x.id = c1 JOIN contigs y ON y.id = c2
 WHERE {_FAR.format(e=0)} GROUP BY ALL)"""
_FACTOR = {
    "none": None,
    "abundance": "sqrt(x.coverage * y.coverage)",
    "length": "sqrt((hx.hit / x.size) * (hy.hit / y.size))",
    "rs": "0.01 * sqrt((hx.hit / x.rs) * (hy.hit / y.rs))",
    "empirical_hit": "sqrt(CAST(hx.hit AS DOUBLE) * hy.hit)",
    "theoritical_hit": "sqrt(x.coverage * 10 * sqrt(CAST(x.size * x.rs AS DOUBLE)) * (y.coverage * 10 * sqrt(CAST(y.size * y.rs AS DOUBLE))))",
}


def _network_sql(mode: str, per_sample: bool = False) -> str:
    """Edges with their weight in one mode, rounded."""
    factor = _FACTOR[mode]
    weight = "CAST(n AS DOUBLE)" if factor is None else f"CASE WHEN {factor} = 0 THEN 0 ELSE n / ({factor}) END"
    return f"""{_HITS}, {_EDGES.format(s="sample, " if per_sample else "")},
 network AS (SELECT {"sample, " if per_sample else ""}src, dst, n, {weight} AS w FROM edges JOIN contigs x ON x.id = src
 JOIN contigs y ON y.id = dst JOIN hits hx ON hx.id = src JOIN hits hy ON hy.id = dst)"""


_NET = _network_sql("empirical_hit")
_CORES = """grouped AS (SELECT labels, count(*) AS n, min(id) AS min_id FROM vectors GROUP BY labels),
 cores AS (SELECT row_number() OVER (ORDER BY min_id) - 1 AS core_id, labels, n, min_id FROM grouped),
 each AS (SELECT core_id, unnest(labels) AS label, generate_subscripts(labels, 1) AS k FROM cores),
 agreement AS (SELECT a.core_id AS core_a, b.core_id AS core_b, count(*) / 5 AS agreement FROM each a JOIN each b ON a.k = b.k
 AND a.label = b.label AND a.core_id <= b.core_id GROUP BY 1, 2),
 members AS (SELECT v.id, c.core_id FROM vectors v JOIN cores c ON v.labels = c.labels)"""
_MATRIX = """SELECT least(x.id, y.id) AS i, greatest(x.id, y.id) AS j, least(1.0, agreement) AS value FROM agreement JOIN members x ON x.core_id = core_a JOIN members y ON y.core_id = core_b WHERE core_a <> core_b OR x.id <= y.id"""
_REACH = f"""link AS (SELECT core_a AS a, core_b AS b FROM agreement WHERE agreement >= {OVERLAP} - 1e-10 UNION SELECT core_b, core_a FROM agreement
 WHERE agreement >= {OVERLAP} - 1e-10),
 reach AS (SELECT core_id AS a, core_id AS low FROM cores UNION SELECT link.b, reach.low FROM reach JOIN link ON link.a = reach.a WHERE reach.low < link.b),
 component AS (SELECT a AS core_id, min(low) AS low FROM reach GROUP BY a), overlapping AS (SELECT core_id, dense_rank() OVER (ORDER BY low) AS bin FROM component)"""
_SIZES = "sizes AS (SELECT bin, sum(size)::BIGINT AS size FROM bins WHERE bin <> 'ND' GROUP BY bin)"


# ---- scans, filters, joins -------------------------------------------------------------------


def _upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.upper_triangle(P.pairs(spark, sf_dir))


@_query(with_views(f"{_UPPER} SELECT c1, pos1, strand1, c2, pos2, strand2 FROM upper"))
def scan_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upper(spark, sf_dir).select(*pairs.ENDS)


@_query(with_views(f"""{_UPPER} SELECT r.region AS r1, s.region AS r2, count(*) AS n FROM upper
 JOIN (SELECT id, 'a' || (id % 3) AS region, 1 AS lo, size // 2 AS hi FROM contigs) r ON r.id = c1 AND pos1 BETWEEN r.lo AND r.hi
 JOIN (SELECT id, 'a' || (id % 3) AS region, 1 AS lo, size // 2 AS hi FROM contigs) s ON s.id = c2 AND pos2 BETWEEN s.lo AND s.hi
 GROUP BY 1, 2"""))
def join_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = P.contigs(spark, sf_dir).select(F.col("id").alias("contig"), F.concat(F.lit("a"), F.col("id") % 3).alias("region"), F.lit(1).alias("start"), F.floor(F.col("size") / 2).alias("end"))
    return pairs.in_regions(_upper(spark, sf_dir), regions).groupBy("r1", "r2").agg(F.count("*").alias("n"))


# ---- hits, contacts, networks ----------------------------------------------------------------


@_query(with_views(f"{_HITS} SELECT id, hit FROM hits"))
def agg_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.hits(P.pairs(spark, sf_dir))


@_query(with_views("""SELECT id, count(*) FILTER (sample = 0) AS hit_0, count(*) FILTER (sample = 1) AS hit_1 FROM (SELECT c1 AS id, sample FROM pairs UNION ALL
 SELECT c2, sample FROM pairs) GROUP BY id"""))
def agg_hits_by_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.hits_by_sample(P.pairs(spark, sf_dir), [0, 1])


@_query(with_views(f"""SELECT sample, count(*) AS contacts, count(*) FILTER ({_FAR.format(e=0)}) AS inter_contacts,
 round(count(*) FILTER ({_FAR.format(e=0)}) / count(*), 6) AS ratio FROM pairs JOIN contigs x ON x.id = c1 JOIN contigs y ON y.id = c2
 GROUP BY GROUPING SETS ((sample), ())"""))
def agg_3d_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.contact_ratio(P.pairs(spark, sf_dir), P.contigs(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@_query(with_views(f"{_EDGES.format(s='')} SELECT src, dst, n FROM edges"))
def agg_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.contacts(P.pairs(spark, sf_dir), P.contigs(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str, mode: str = "empirical_hit", **options) -> DataFrame:
    return net.network(P.pairs(spark, sf_dir), P.contigs(spark, sf_dir), mode, **options)


for _mode in _FACTOR:
    _query(with_views(f"{_network_sql(_mode)} SELECT src, dst, n, round(w, 6) AS w FROM network"), f"network_{_mode}")(lambda spark, sf_dir, mode=_mode: _edges(spark, sf_dir, mode).withColumn("w", F.round("w", 6)))


@_query(with_views(f"{_network_sql('empirical_hit', True)} SELECT sample, src, dst, n, round(w, 6) AS w FROM network"))
def network_per_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir, per_sample=True).withColumn("w", F.round("w", 6))


_GC = """CASE
 WHEN length(regexp_replace({s}, '[^ACGTacgt]', '', 'g')) > 0 THEN floor(length(regexp_replace({s}, '[^GCgc]', '', 'g')) * 100.0::DOUBLE / length(regexp_replace({s}, '[^ACGTacgt]', '', 'g')) * 1e11) / 1e11 END"""


@_query(with_views(f"""{_HITS} SELECT c.id AS ID, name AS Name, size AS Size, round({_GC.format(s='seq')}, 8) AS GC_content, coalesce(hit, 0) AS Hit,
 coverage AS Shotgun_coverage, rs AS Restriction_site FROM contigs c LEFT JOIN hits h ON h.id = c.id"""))
def contig_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.contig_table(P.contigs(spark, sf_dir), P.pairs(spark, sf_dir), F.round(S.gc_content(F.col("seq")), 8))


# ---- scalar functions ------------------------------------------------------------------------


@_query(f"SELECT doc_id, round({_GC.format(s='text')}, 8) AS gc, length(regexp_replace(text, '[^ACGTacgt]', '', 'g')) AS n_acgt FROM documents")
def fn_gc_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", F.round(S.gc_content(F.col("text")), 8).alias("gc"), S.acgt_count(F.col("text")).alias("n_acgt"))


@_query(f"SELECT doc_id, len(regexp_extract_all(upper(text), '{S.site_pattern(ENZYMES)}')) + 1 AS n_sites FROM documents")
def fn_restriction_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", S.restriction_sites(F.upper("text"), S.site_pattern(ENZYMES)).alias("n_sites"))


@_query(with_views("SELECT DISTINCT bin, string_split(bin, '_')[-2] AS over_id, string_split(bin, '_')[-1] AS rec_id FROM bins WHERE bin <> 'ND'"))
def fn_bin_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    over, rec = S.bin_parts(F.col("bin"))
    return P.bins(spark, sf_dir).where("bin != 'ND'").select("bin").distinct().select("bin", over.alias("over_id"), rec.alias("rec_id"))


@_query("SELECT doc_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS digest FROM documents")
def fn_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", F.md5(S.reverse_complement(F.col("text")).cast("binary")).alias("digest"))


# ---- consensus -------------------------------------------------------------------------------


def _cores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = P.vectors(spark, sf_dir)
    return vectors, materialize(consensus.core_bins(vectors), "cores")


@_query(with_views(f"{_CORES} SELECT core_id, n, min_id FROM cores"))
def agg_core_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cores(spark, sf_dir)[1].select("core_id", "n", "min_id")


@_query(with_views(f"{_CORES} SELECT core_a, core_b, agreement FROM agreement"))
def join_core_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.core_agreement(_cores(spark, sf_dir)[1])


def _overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, cores = _cores(spark, sf_dir)
    found = consensus.overlapping_bins(materialize(consensus.core_agreement(cores), "agreement"), cores, OVERLAP)
    return consensus.core_members(vectors, cores).join(found, "core_id").select("id", "bin")


@_query(with_views(f"{_CORES}, {_REACH} SELECT id, bin FROM members JOIN overlapping USING (core_id)", recursive=True))
def graph_overlapping_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlapping(spark, sf_dir)


@_query(with_views(f"""{_CORES}, {_REACH} SELECT bin, count(*) AS contigs, sum(size)::BIGINT AS size FROM members JOIN overlapping USING (core_id)
 JOIN contigs USING (id) GROUP BY bin""", recursive=True))
def agg_bin_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.bin_stats(_overlapping(spark, sf_dir), P.contigs(spark, sf_dir))


@_query(with_views(f"""{_CORES}, {_REACH}, own AS (SELECT bin, sum(size) AS size FROM members JOIN overlapping USING (core_id) JOIN contigs USING (id)
 GROUP BY bin) SELECT count(*) AS bins, coalesce(sum(size), 0)::BIGINT AS size FROM own WHERE size >= 500000""", recursive=True))
def agg_large_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus.large_bins(consensus.bin_stats(_overlapping(spark, sf_dir), P.contigs(spark, sf_dir)), 500_000)


@_query(with_views(f"{_CORES} {_MATRIX}"))
def join_clustering_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, cores = _cores(spark, sf_dir)
    return consensus.clustering_matrix(consensus.core_members(vectors, cores), consensus.core_agreement(cores))


@_query(with_views(f"""{_NET}, shared AS (SELECT src AS i, dst AS j, 1.0::DOUBLE AS value FROM network), {_CORES}, matrix AS ({_MATRIX}) SELECT i, j,
 round(sum(value) / 2, 6) AS value FROM (SELECT i, j, value FROM matrix UNION ALL SELECT i, j, value FROM shared) GROUP BY i, j"""))
def agg_mean_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = _edges(spark, sf_dir).select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(1.0).alias("value"))
    vectors, cores = _cores(spark, sf_dir)
    return consensus.clustering_mean(consensus.core_members(vectors, cores), consensus.core_agreement(cores), shared, 6)


def _strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return net.contacts(P.pairs(spark, sf_dir), P.contigs(spark, sf_dir)).where("n >= 2")


for _keep, _word in ((True, "IN"), (False, "NOT IN")):
    _query(with_views(f"{_EDGES.format(s='')} SELECT id FROM contigs WHERE id {_word} (SELECT src FROM edges WHERE n >= 2 UNION SELECT dst FROM edges WHERE n >= 2)"), "filter_isolates" if _keep else "filter_isolates_anti")(
        lambda spark, sf_dir, keep=_keep: net.without_isolates(P.contigs(spark, sf_dir).select("id"), _strong(spark, sf_dir), keep))


@_query(with_views(f"""{_NET} SELECT x.bin, src, dst, round(w, 6) AS w FROM network JOIN bins x ON x.id = src JOIN bins y ON y.id = dst AND y.bin = x.bin
 WHERE x.bin <> 'ND'"""))
def join_induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.bins(spark, sf_dir).where("bin != 'ND'").select("id", "bin")
    return net.induced(_edges(spark, sf_dir).select("src", "dst", F.round("w", 6).alias("w")), own)


# ---- bin quality -----------------------------------------------------------------------------


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bins(spark, sf_dir).where("bin != 'ND'").groupBy("bin").agg(F.sum("size").alias("size"))


@_query(with_views("""SELECT bin, CASE WHEN completeness >= arch_completeness THEN completeness ELSE arch_completeness END AS completeness, CASE
 WHEN completeness >= arch_completeness THEN redundancy ELSE arch_redundancy END AS redundancy, CASE
 WHEN completeness >= arch_completeness THEN 'Bacteria' ELSE 'Archaea' END AS markers FROM bin_quality"""))
def join_marker_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = P.bin_quality(spark, sf_dir)
    return quality.merge_marker_sets(q, q.select("bin", F.col("arch_completeness").alias("completeness"), F.col("arch_redundancy").alias("redundancy")))


@_query(with_views("SELECT bin FROM bin_quality WHERE completeness >= 0.33 AND (redundancy - 1) / completeness >= 0.05"))
def filter_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.contaminated(P.bin_quality(spark, sf_dir)).select("bin")


_CHILDREN = """children AS (SELECT bin AS parent, bin || '.' || (kind % 3) AS bin, (sum(kind) * 7 % 100) / 100.0::DOUBLE AS completeness, 1.0::DOUBLE AS redundancy
 FROM bins JOIN contigs USING (id) WHERE bin <> 'ND' GROUP BY bin, kind % 3)"""


def _children(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.bins(spark, sf_dir).where("bin != 'ND'").select(F.col("id").alias("_i"), F.col("bin").alias("parent")).join(P.contigs(spark, sf_dir), F.col("_i") == F.col("id"))
    return own.groupBy("parent", F.concat_ws(".", "parent", F.col("kind") % 3).alias("bin")).agg((F.sum("kind") * 7 % 100 / F.lit(100.0)).alias("completeness"), F.lit(1.0).alias("redundancy"))


@_query(with_views(f"""{_CHILDREN}, best AS (SELECT parent, max(completeness) AS best FROM children GROUP BY parent), judged AS (SELECT q.*,
 coalesce(best - 0.4::DOUBLE > (completeness - 0.4::DOUBLE) / 1.6::DOUBLE, false) AS ok FROM bin_quality q LEFT
 JOIN best b ON b.parent = q.bin)
 SELECT bin, false AS recursive, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS parent, round(completeness, 6) AS completeness,
 round(redundancy, 6) AS redundancy FROM judged WHERE NOT ok UNION ALL SELECT c.bin, true, {STEP}, c.parent, c.completeness, c.redundancy
 FROM children c JOIN judged j ON j.bin = c.parent AND j.ok"""))
def agg_compare_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.compare_generations(P.bin_quality(spark, sf_dir).select("bin", "completeness", "redundancy"), _children(spark, sf_dir), STEP)
    return found.select("bin", "recursive", "step", "parent", F.round("completeness", 6).alias("completeness"), F.round("redundancy", 6).alias("redundancy"))


@_query(with_views(f"""{_HITS}, own AS (SELECT bin, size, coverage, coalesce(hit, 0) AS hit FROM bins b LEFT JOIN hits h ON h.id = b.id) SELECT bin,
 round(sum(hit) * 100.0::DOUBLE / (SELECT sum(hit) FROM own) / 2, 6) AS hic_abundance,
 round(sum(size * coverage) * 100.0::DOUBLE / (SELECT sum(size * coverage) FROM own), 6) AS sg_abundance FROM own WHERE bin <> 'ND'
 GROUP BY bin"""))
def agg_bin_abundance(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = net.hits(P.pairs(spark, sf_dir)).withColumnRenamed("id", "_i")
    own = P.bins(spark, sf_dir).join(h, F.col("id") == F.col("_i"), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    found = quality.abundance(own)
    return found.select("bin", F.round("hic_abundance", 6).alias("hic_abundance"), F.round("sg_abundance", 6).alias("sg_abundance"))


_CLASS_SQL = {
    "fig": "CASE WHEN c < 0.5 THEN 'Other' WHEN r > 1.1 THEN 'Contaminated' WHEN c >= 0.9 AND r <= 1.05 THEN 'HQ' WHEN c >= 0.7 THEN 'MQ' ELSE 'LQ' END",
    "host": "CASE WHEN r > 1.1 THEN 'Contaminated' WHEN c > 0.9 AND r <= 1.05 THEN 'Complete' WHEN c > 0.9 AND r > 1.05 AND r < 1.1 THEN 'HQ' WHEN c > 0.7 AND r < 1.1 THEN 'MQ' WHEN c > 0.5 AND r < 1.1 THEN 'LQ' WHEN c < 0.5 AND r < 1.1 THEN 'PQ' ELSE 'None' END",
    "log": "CASE WHEN c < 0.5 THEN 'Other' WHEN (r - 1) / c > 0.1 THEN 'Contaminated' WHEN c >= 0.9 AND (r - 1) / c <= 0.05 THEN 'HQ' WHEN c >= 0.7 THEN 'MQ' ELSE 'LQ' END",
}
for _rule, _case in _CLASS_SQL.items():
    _query(with_views(f"{_SIZES}, q AS (SELECT bin, completeness AS c, redundancy AS r FROM bin_quality) SELECT {_case} AS class, count(*) AS n, coalesce(sum(size), 0)::BIGINT AS size FROM q LEFT JOIN sizes USING (bin) GROUP BY 1"), f"fn_quality_class_{_rule}")(
        lambda spark, sf_dir, rule=_rule: quality.class_counts(P.bin_quality(spark, sf_dir), _sizes(spark, sf_dir), rule))


@_query(with_views("SELECT id, bin FROM bins WHERE size > 30000 AND bin IN (SELECT bin FROM bin_quality WHERE completeness > 0.7 AND redundancy < 1.15)"))
def filter_hq_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.good_contigs(P.bins(spark, sf_dir), P.bin_quality(spark, sf_dir), size=30_000)


def _frag(pos: str) -> str:
    """How many of the sites k * SITE_GAP + k * 37 % 211, k = 1, 2, ..., lie before a position."""
    k = f"(({pos} - 1) // {SITE_GAP})"
    return f"CASE WHEN {k} >= 1 THEN {k} - 1 + CAST({k} * {SITE_GAP} + {k} * 37 % 211 < {pos} AS INTEGER) ELSE 0 END"


_EVENTS = f"""good AS (SELECT id, bin FROM bins WHERE size > 10000 AND bin IN (SELECT bin FROM bin_quality WHERE completeness > 0.3 AND redundancy < 1.3)),
 located AS (SELECT c1 = c2 AS same, x.bin = y.bin AS close, CASE
 WHEN pos1 > pos2 THEN strand2 || strand1 ELSE strand1 || strand2 END AS kind, abs({_frag('pos1')} - {_frag('pos2')}) AS apart FROM upper
 JOIN good x ON x.id = c1 JOIN good y ON y.id = c2),
 classed AS (SELECT same, CASE WHEN NOT same THEN CASE WHEN close THEN 'informative_inter' ELSE 'noise' END WHEN apart = 0
 AND kind IN ('++', '--') THEN 'weird' WHEN apart <= {LOOP_SITES} AND kind = '-+' THEN 'loops' WHEN apart <= {UNCUT_SITES}
 AND kind = '+-' THEN 'religated' ELSE 'informative_intra' END AS event FROM located),
 counted AS (SELECT count(*) FILTER (event = 'weird') AS weird, count(*) FILTER (event = 'loops') AS loops,
 count(*) FILTER (event = 'religated') AS religated, count(*) FILTER (event = 'informative_intra') AS informative_intra,
 count(*) FILTER (event = 'informative_inter') AS informative_inter, count(*) FILTER (event = 'noise') AS noise,
 count(*) FILTER (same) AS intra_contigs FROM classed)"""


@_query(with_views(f"""{_UPPER}, {_EVENTS}, bins_n AS (SELECT count(DISTINCT bin) AS k FROM good),
 spread AS (SELECT *, noise / (k * (k - 1) / 2) AS x, (intra_contigs + informative_inter) / k AS y FROM counted, bins_n)
 SELECT weird, loops, religated, informative_intra, informative_inter, noise, intra_contigs,
 round((informative_intra + informative_inter) * 100.0::DOUBLE / (intra_contigs + informative_inter + noise), 6) AS info_ratio,
 round(noise * 100.0::DOUBLE / (intra_contigs + informative_inter + noise), 6) AS noise_ratio, round(x / (y + x), 6) AS noise_score
 FROM spread"""))
def agg_qc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, ratios and noise score of the library, over sites at uneven distances."""
    from .plans.facade import library_quality

    each = F.transform(F.sequence(F.lit(1).cast("long"), F.floor(F.col("size") / SITE_GAP).cast("long")), lambda k: k * SITE_GAP + k * 37 % 211)
    own = P.contigs(spark, sf_dir).select("id", "size").repartition(4 * spark.sparkContext.defaultParallelism, "id")  # one small file would be one task
    sites = own.select(F.col("id").alias("contig"), each.alias("sites"))
    found = library_quality(_upper(spark, sf_dir), P.bins(spark, sf_dir), P.bin_quality(spark, sf_dir), sites, LOOP_SITES, UNCUT_SITES, 0.3, 1.3, 10_000)
    return found.select(*quality.COUNTS, *[F.round(c, 6).alias(c) for c in ("info_ratio", "noise_ratio", "noise_score")])


# ---- positions -------------------------------------------------------------------------------


@_query(with_views("""SELECT bin, id, (sum(size) OVER w - size)::BIGINT AS start, (sum(size) OVER w)::BIGINT AS "end" FROM bins WINDOW w AS (PARTITION BY bin
 ORDER BY id)"""))
def win_cumulative_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cumulative_offsets(P.bins(spark, sf_dir))


_MAP = f"""lengths AS (SELECT bin, sum(size) // {MAP_BIN} + 1 AS k FROM bins WHERE bin <> 'ND' GROUP BY bin), firsts AS (SELECT bin,
 coalesce(sum(k) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM lengths),
 mapped AS (SELECT id, (f + (sum(size) OVER w - size) // {MAP_BIN})::BIGINT AS start, ((sum(size) OVER w - size) % {MAP_BIN})::BIGINT AS init
 FROM bins JOIN firsts USING (bin) WINDOW w AS (PARTITION BY bin ORDER BY id))"""


@_query(with_views(f"{_MAP} SELECT id, start, init FROM mapped"))
def win_map_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.map_bins(P.bins(spark, sf_dir).where("bin != 'ND'"), MAP_BIN)


@_query(with_views(f"""{_MAP}, places AS (SELECT x.start + (x.init + pos1 - 1) // {MAP_BIN} AS a, y.start + (y.init + pos2 - 1) // {MAP_BIN} AS b FROM pairs
 JOIN mapped x ON x.id = c1 JOIN mapped y ON y.id = c2) SELECT least(a, b) AS f1, greatest(a, b) AS f2, count(*) AS n FROM places
 GROUP BY 1, 2"""))
def agg_contact_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.contact_map(P.pairs(spark, sf_dir), layout.map_bins(P.bins(spark, sf_dir).where("bin != 'ND'"), MAP_BIN), MAP_BIN)


_LABELS = "SELECT (id - 1) // 20 AS over_id, kind % 4 AS label, id FROM contigs"


@_query(with_views(f"""labels AS ({_LABELS}), large AS (SELECT over_id, label, sum(size) AS size FROM labels JOIN contigs USING (id) GROUP BY 1, 2),
 kept AS (SELECT * FROM large WHERE size > 100000) SELECT over_id, label, (over_id % 3 + row_number() OVER (PARTITION BY over_id
 ORDER BY label))::BIGINT AS rec_id FROM kept"""))
def win_recursive_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = P.contigs(spark, sf_dir).select(F.floor((F.col("id") - 1) / 20).cast("long").alias("over_id"), (F.col("kind") % 4).alias("label"), "id")
    last = labels.select("over_id").distinct().withColumn("rec_id", F.col("over_id") % 3)
    return layout.recursive_ids(labels, P.contigs(spark, sf_dir), last, 100_000).withColumn("rec_id", F.col("rec_id").cast("long"))


_WINDOWS = f"""ends AS (SELECT id, 2 * (id - 1) AS e, 0 AS lo, least(size, {WINDOW}) AS hi FROM contigs UNION ALL
 SELECT id, 2 * (id - 1) + 1, greatest(size - {WINDOW}, 0), size FROM contigs),
 met AS (SELECT least(x.e, y.e) AS end_i, greatest(x.e, y.e) AS end_j, count(*) AS n FROM pairs JOIN ends2 x ON x.id = c1 AND pos1 - 1 >= x.lo AND pos1 - 1 < x.hi JOIN ends2 y ON y.id = c2 AND pos2 - 1 >= y.lo AND pos2 - 1 < y.hi WHERE x.e <> y.e GROUP BY 1, 2)""".replace("ends AS (", "ends2 AS (", 1)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.contigs(spark, sf_dir).select("id", "name", "size", (F.col("id") - 1).alias("nth"))


def _edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.edge_contacts(P.pairs(spark, sf_dir), layout.edge_windows(_numbered(spark, sf_dir), WINDOW))


@_query(with_views(f"{_WINDOWS} SELECT end_i, end_j, n FROM met"))
def join_edge_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_counts(spark, sf_dir)


def _edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = materialize(_edge_counts(spark, sf_dir), "edge-counts")
    return layout.edge_scores(counts, layout.edge_norms(P.pairs(spark, sf_dir), _numbered(spark, sf_dir), counts, WINDOW))


@_query(with_views(f"""{_WINDOWS}, inner_pairs AS (SELECT c1 AS id, least(pos1, pos2) - 1 AS a, greatest(pos1, pos2) - 1 AS b FROM pairs WHERE c1 = c2),
 local AS (SELECT c.id, count(*) FILTER (a < {WINDOW} AND b >= {WINDOW} AND b < 2 * {WINDOW}) AS l,
 count(*) FILTER (a >= size - 2 * {WINDOW} AND a < size - {WINDOW} AND b >= size - {WINDOW}) AS r FROM contigs c LEFT
 JOIN inner_pairs p ON p.id = c.id WHERE size > 2 * {WINDOW} GROUP BY c.id, size),
 norms AS (SELECT 2 * (id - 1) AS e, CAST(l AS DOUBLE) AS norm FROM local UNION ALL SELECT 2 * (id - 1) + 1, r FROM local UNION ALL
 SELECT unnest([2 * (id - 1), 2 * (id - 1) + 1]), (SELECT max(n) FROM met) * sqrt(2.0) FROM contigs WHERE size <= 2 * {WINDOW})
 SELECT end_i, end_j, round(CASE WHEN x.norm * y.norm = 0 THEN 0 ELSE n / sqrt(x.norm * y.norm) END, 6) AS score FROM met
 JOIN norms x ON x.e = end_i JOIN norms y ON y.e = end_j WHERE end_j - end_i > 2 OR end_i % 2 = 1"""))
def fn_edge_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edge_scores(spark, sf_dir).withColumn("score", F.round("score", 6))


# ---- sets and sorts --------------------------------------------------------------------------


@_query(with_views(f"{_UPPER} SELECT row_number() OVER (ORDER BY c1, c2, pos1, pos2, strand1, strand2) AS place, c1, c2, pos1, pos2, strand1, strand2 FROM upper"))
def sort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["c1", "c2", "pos1", "pos2", "strand1", "strand2"]
    return consensus.ordinals(_upper(spark, sf_dir).select(*order), order, "place", 1)


@_query(with_views("SELECT name, row_number() OVER (ORDER BY id) AS place FROM contigs"))
def sort_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = P.contigs(spark, sf_dir).select("name", S.natural_key(F.col("name")).alias("key"))
    return consensus.ordinals(keyed, ["key"], "place", 1).select("name", "place")


# ---- mobile elements and hosts ---------------------------------------------------------------


@_query(with_views("""SELECT least(c1, c2) AS i, greatest(c1, c2) AS j, count(*) AS n FROM pairs WHERE c1 IN (SELECT id FROM bins WHERE mobile)
 AND c2 IN (SELECT id FROM bins WHERE mobile) AND (c1 <> c2 OR abs(pos1 - pos2) > 1000) GROUP BY 1, 2"""))
def agg_mge_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mobile.element_contacts(P.pairs(spark, sf_dir), P.bins(spark, sf_dir).where("mobile"))


@_query(with_views(f"""{_HITS} SELECT block AS bin, sum(b.size)::BIGINT AS length, round(sum(kind * 1.0::DOUBLE * b.size) / sum(b.size), 6) AS gc,
 sum(coalesce(hit, 0))::BIGINT AS hit, count(*) AS n, string_agg(b.name, ',' ORDER BY b.id) AS contigs FROM bins b
 JOIN contigs c ON c.id = b.id LEFT JOIN hits h ON h.id = b.id WHERE mobile GROUP BY block"""))
def agg_mge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = P.bins(spark, sf_dir).where("mobile").select("id", "name", "size", F.col("block").alias("bin"))
    gc = P.contigs(spark, sf_dir).select(F.col("id").alias("_g"), F.col("kind").cast("double").alias("gc"))
    h = net.hits(P.pairs(spark, sf_dir)).withColumnRenamed("id", "_h")
    rows = own.join(gc, F.col("id") == F.col("_g")).join(h, F.col("id") == F.col("_h"), "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    return mobile.element_summary(rows).withColumn("gc", F.round("gc", 6))


_SIGNALS = """signals AS (SELECT least(x.bin, y.bin) AS mag1, greatest(x.bin, y.bin) AS mag2, w FROM network JOIN bins x ON x.id = src
 JOIN bins y ON y.id = dst WHERE x.bin <> 'ND' AND y.bin <> 'ND')"""


def _binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.bins(spark, sf_dir).where("bin != 'ND'").select("id", "bin")


@_query(with_views(f"{_NET}, {_SIGNALS} SELECT mag1, mag2, round(avg(w), 6) AS signal FROM signals GROUP BY 1, 2"))
def agg_mag_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mobile.bin_noise(_edges(spark, sf_dir), _binned(spark, sf_dir)).withColumn("signal", F.round("signal", 6))


@_query(with_views(f"""{_NET}, {_SIGNALS}, mean AS (SELECT mag1, mag2, avg(w) AS s FROM signals GROUP BY 1, 2), own AS (SELECT DISTINCT bin FROM bins
 WHERE bin <> 'ND'), half AS (SELECT mag1 AS b, s FROM mean WHERE mag1 <> mag2 UNION ALL SELECT mag2, s FROM mean WHERE mag1 <> mag2)
 SELECT bin, round(coalesce((SELECT s FROM mean WHERE mag1 = bin AND mag2 = bin), 0), 6) AS intra, round(coalesce(sum(s), 0), 6) AS inter,
 count(s) AS others, round(coalesce(sum(s), 0) / ((SELECT count(*) FROM own) - 1), 6) AS mean_inter FROM own LEFT JOIN half ON b = bin
 GROUP BY bin"""))
def agg_mag_noise_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _binned(spark, sf_dir)
    found = mobile.noise_frame(materialize(mobile.bin_noise(_edges(spark, sf_dir), own), "noise"), own.select("bin").distinct())
    return found.select("bin", *[F.round(c, 6).alias(c) for c in ("intra", "inter", "mean_inter")], "others")


_HOSTS = """around AS (SELECT src AS a, dst AS b, w FROM network UNION ALL SELECT dst, src, w FROM network),
 met AS (SELECT x.block AS mge, y.bin AS mag, w, b FROM around JOIN bins x ON x.id = a AND x.mobile JOIN bins y ON y.id = b AND NOT y.mobile AND y.bin <> 'ND'),
 found AS (SELECT mge, mag, sum(w) AS signal, count(DISTINCT b) AS contigs FROM met GROUP BY 1, 2),
 shared AS (SELECT mge, mag, signal, signal * 100 / sum(signal) OVER (PARTITION BY mge) AS percent, contigs FROM found)"""


def _host_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = P.bins(spark, sf_dir)
    return b.where("mobile").select("id", F.col("block").alias("mge")), b.where("not mobile and bin != 'ND'").select("id", F.col("bin").alias("mag"))


@_query(with_views(f"{_NET}, {_HOSTS} SELECT mge, mag, round(signal, 6) AS signal, round(percent, 4) AS percent, contigs FROM shared"))
def join_mge_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mobile.host_signals(_edges(spark, sf_dir), *_host_sides(spark, sf_dir))
    return found.select("mge", "mag", F.round("signal", 6).alias("signal"), F.round("percent", 4).alias("percent"), "contigs")


@_query(with_views(f"""{_NET}, {_HOSTS}, per AS (SELECT mge, count(*) FILTER (round(percent, 6) >= 2 AND contigs >= 2) AS h FROM shared GROUP BY mge),
 own AS (SELECT DISTINCT block AS mge FROM bins WHERE mobile) SELECT least(coalesce(h, 0), 5)::BIGINT AS n_hosts, count(*) AS n_mges FROM own
 LEFT JOIN per USING (mge) GROUP BY 1"""))
def agg_host_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, hosts = _host_sides(spark, sf_dir)
    signals = mobile.host_signals(_edges(spark, sf_dir), elements, hosts).withColumn("percent", F.round("percent", 6))
    return mobile.host_histogram(mobile.hosts_above(signals, 2.0, 2), elements)


@_query(with_views(f"""{_NET}, {_HOSTS}, per AS (SELECT mag, count(*) FILTER (round(percent, 6) >= 2 AND contigs >= 2) AS g FROM shared GROUP BY mag),
 own AS (SELECT DISTINCT bin AS mag FROM bins WHERE NOT mobile AND bin <> 'ND') SELECT least(coalesce(g, 0), 3)::BIGINT AS n_guests,
 count(*) AS n_mags FROM own LEFT JOIN per USING (mag) GROUP BY 1"""))
def agg_guest_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, hosts = _host_sides(spark, sf_dir)
    signals = mobile.host_signals(_edges(spark, sf_dir), elements, hosts).withColumn("percent", F.round("percent", 6))
    return mobile.guest_histogram(mobile.hosts_above(signals, 2.0, 2), hosts)


# ---- kernels ---------------------------------------------------------------------------------


def _clusters(spark: SparkSession, sf_dir: str, algorithm: str) -> DataFrame:
    return community.cluster(_edges(spark, sf_dir), 4, algorithm, seed=1)


@_query()
def graph_louvain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, "louvain")


@_query()
def graph_leiden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir, "leiden")


@_query()
def graph_mge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = P.bins(spark, sf_dir).where("mobile").select("id")
    return mobile.bin_elements(materialize(mobile.element_contacts(P.pairs(spark, sf_dir), elements), "element-contacts"), elements, 0.8)


@_query()
def graph_scaffolds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.facade import scaffold_bins

    return scaffold_bins(P.pairs(spark, sf_dir), P.bins(spark, sf_dir).where("bin != 'ND'").select("id", "name", "size", "bin"), WINDOW)


@_query()
def graph_balanced_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.balance(materialize(agg_contact_map(spark, sf_dir).select(F.col("f1").alias("i"), F.col("f2").alias("j"), "n"), "map"), 10).withColumn("value", F.round("value", 6))


@_query()
def pipeline_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators.recursion import decontaminate

    blocks = P.bins(spark, sf_dir).select("id", F.format_string("%05d", F.floor(F.col("block") / 5).cast("long")).alias("bin"))

    def estimate(members: DataFrame) -> DataFrame:
        """A stand-in for a marker tool: from sizes alone."""
        own = members.select(F.col("id").alias("_i"), "bin").join(P.contigs(spark, sf_dir), F.col("id") == F.col("_i")).groupBy("bin").agg(F.sum("kind").alias("k"), F.count("*").alias("n"))
        return own.select("bin", (F.lit(0.4) + F.col("k") % 60 / 100).alias("completeness"), (1 + F.col("n") % 50 / 100).alias("redundancy"))

    edges = materialize(_edges(spark, sf_dir), "edges")
    return decontaminate(edges, P.contigs(spark, sf_dir), blocks, estimate, size=100_000, iterations=3, max_steps=2)
