"""Contact operators: golden values, kernels against brute force, and every query against SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ligature.registry import oracle_sql, queries
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_sql(spark, sf_dir, duck, name):
    got, want = rows(queries()[name](spark, sf_dir)), rows(duck.sql(oracle_sql()[name]))
    assert len(got) == len(want)
    assert got == want


def test_kernel_queries(spark, sf_dir):
    """What must hold of the seeded kernels whatever they find."""
    from ligature import projection as P
    from ligature.registry import _edges

    found = {n: queries()[n](spark, sf_dir) for n in set(queries()) - set(oracle_sql())}
    edges = _edges(spark, sf_dir).where("src != dst and w > 0").select("src", "dst").collect()
    nodes = {v for r in edges for v in (r.src, r.dst)}
    for name in ("graph_louvain", "graph_leiden"):
        labels = found[name].collect()
        assert len(labels) == len({(r.id, r.iteration) for r in labels}) and {r.id for r in labels} == nodes
        of = {(r.id, r.iteration): r.label for r in labels}
        inside = sum(of[r.src, 0] == of[r.dst, 0] for r in edges) / len(edges)
        sizes = np.bincount([k for (_, it), k in of.items() if it == 0])
        assert inside > ((sizes / sizes.sum()) ** 2).sum()  # more edges within than by chance
    mobile = {r.id for r in P.bins(spark, sf_dir).where("mobile").collect()}
    assert sorted(r.id for r in found["graph_mge_bins"].collect()) == sorted(mobile)
    binned = {(r.bin, r.name): r.size for r in P.bins(spark, sf_dir).where("bin != 'ND'").collect()}
    table = found["graph_scaffolds"].collect()
    assert sorted((r.bin, r.name) for r in table) == sorted(binned) and all(r.end == binned[r.bin, r.name] for r in table)
    for key in {(r.bin, r.scaffold) for r in table}:
        assert sorted(r["rank"] for r in table if (r.bin, r.scaffold) == key) == list(range(sum((r.bin, r.scaffold) == key for r in table)))
    assert {(r.i, r.j) for r in found["graph_balanced_map"].collect()} == {(r.f1, r.f2) for r in queries()["agg_contact_map"](spark, sf_dir).collect()}
    recursive = found["pipeline_recursive"].collect()
    assert sorted(r.id for r in recursive) == sorted(r.id for r in P.contigs(spark, sf_dir).collect()) and {r.step for r in recursive} <= {0, 1, 2}
    assert set(found) == {"graph_louvain", "graph_leiden", "graph_mge_bins", "graph_scaffolds", "graph_balanced_map", "pipeline_recursive"}


# Contigs (size, hit, coverage, sites) of the normalisation examples.
NODES = {1: (642311, 30795, 41.1565, 0), 6: (505338, 5533054, 1330.17, 2505), 8: (416773, 206333, 97.6355, 3496), 10: (400000, 100, 0.0, 100)}


@pytest.mark.parametrize(
    ("mode", "a", "b", "n", "want", "off"),
    [("length", 1, 6, 52, 71.77, 0.01), ("abundance", 1, 8, 2004, 31.61, 0.01), ("abundance", 6, 10, 275, 0, 0), ("rs", 6, 8, 800, 221.57, 0.01), ("empirical_hit", 1, 8, 2022, 2.54e-2, 1e-4), ("theoritical_hit", 6, 8, 3333, 2.51e-5, 1e-7), ("rs", 1, 8, 2004, 0, 0), ("none", 1, 8, 7, 7, 0)],
)
def test_normalisation(spark, mode, a, b, n, want, off):
    from ligature.operators.network import normalise

    contigs = spark.createDataFrame([(k, *v) for k, v in NODES.items()], "id long, size long, hit long, coverage double, rs long")
    edges = spark.createDataFrame([(a, b, n)], "src long, dst long, n long")
    assert normalise(edges, contigs, mode).first().w == pytest.approx(want, abs=off)


# The published example of ten contigs' labels in five iterations.
VECTORS = ["0;13;0;10;5", "0;6;3;10;5", "7;0;7;0;0", "7;0;7;0;0", "1;1;7;10;0", "2;8;1;13;1", "8;11;6;4;1", "6;9;15;4;13", "10;7;3;2;8", "2;8;1;13;1"]


def test_consensus(spark):
    """Cores, agreement, bins and matrix of the example, with its published sums."""
    from ligature.operators import consensus as C

    vectors = C.parse_vectors(spark.createDataFrame([(k + 1, v) for k, v in enumerate(VECTORS)], "id long, vector string")).cache()
    cores = C.core_bins(vectors).cache()
    members = C.core_members(vectors, cores)
    got = {}
    for r in members.collect():
        got.setdefault(r.core_id, []).append(r.id)
    assert {k: sorted(v) for k, v in got.items()} == {0: [1], 1: [2], 2: [3, 4], 3: [5], 4: [6, 10], 5: [7], 6: [8], 7: [9]}
    agreement = C.core_agreement(cores).cache()
    share = {(r.core_a, r.core_b): r.agreement for r in agreement.collect()}
    labels = {k: VECTORS[v[0] - 1].split(";") for k, v in got.items()}
    same = {(a, b): sum(x == y for x, y in zip(labels[a], labels[b], strict=True)) / 5 for a in range(8) for b in range(a, 8)}
    assert share == {k: v for k, v in same.items() if v}
    full = {**share, **{(b, a): v for (a, b), v in share.items()}}
    assert sum(v for (a, _), v in full.items() if a == 0) == pytest.approx(1.8) and sum(a == 0 for a, _ in full) == 3
    assert sum(full.values()) == pytest.approx(12) and len(full) == 22
    want = {1: [1, 2], 2: [3, 4], 3: [5], 4: [6, 10], 5: [7], 6: [8], 7: [9]}
    for edges in (agreement, C.close_cores(cores, 0.6)):
        placed = {}
        for r in members.join(C.overlapping_bins(edges, cores, 0.6), "core_id").collect():
            placed.setdefault(r.bin, []).append(r.id)
        assert {k: sorted(v) for k, v in placed.items()} == want
    matrix = {(r.i, r.j): r.value for r in C.clustering_matrix(members, agreement).collect()}
    core_of = {m: k for k, ms in got.items() for m in ms}
    pairs = {(i, j): 1.0 if core_of[i] == core_of[j] else full.get((core_of[i], core_of[j]), 0) for i in range(1, 11) for j in range(i, 11)}
    assert matrix == {k: v for k, v in pairs.items() if v}
    assert sum(matrix.values()) == pytest.approx(14.6) and len(matrix) == 21


@pytest.mark.parametrize(("of", "overlap"), [(5, 0.6), (10, 0.8), (7, 1.0), (4, 0.01), (1, 0.5)])
def test_close_cores(spark, of, overlap):
    from ligature.operators import consensus as C

    rng = np.random.default_rng(of)
    labels = sorted({tuple(int(x) for x in rng.integers(0, 3, of)) for _ in range(60)})
    cores = spark.createDataFrame([(k, list(v)) for k, v in enumerate(labels)], "core_id long, labels array<int>")
    want = {}
    for a in range(len(labels)):
        for b in range(a + 1, len(labels)):
            share = sum(x == y for x, y in zip(labels[a], labels[b], strict=True)) / of
            if share >= overlap - 1e-10:
                want[a, b] = share
    got = C.close_cores(cores, overlap).collect()
    assert {(r.core_a, r.core_b): r.agreement for r in got} == want and len(got) == len(want)
    assert C.close_cores(cores.limit(0), overlap).collect() == []


def test_components(spark):
    from ligature.operators.components import connected_components

    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(5, None), (7000, 7000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    made = spark.createDataFrame(edges, "src long, dst long").repartition(3)
    assert {(r.node, r.component) for r in connected_components(made).collect()} == {(x, root(x)) for x in list(parent)}
    assert connected_components(made.limit(0)).collect() == []


def planted(groups=4, each=15, seed=0):
    rng = np.random.default_rng(seed)
    n = groups * each
    return [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i // each == j // each else 0.02)]


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_clustering(spark, algorithm):
    from ligature.operators.community import ALGORITHMS, Graph, cluster

    edges = spark.createDataFrame(planted(), "src long, dst long, w double")
    got = cluster(edges, 3, algorithm, seed=5).cache()
    again = cluster(edges.repartition(5), 3, algorithm, seed=5)
    assert rows(got) == rows(again)
    for it in range(3):
        of = {r.id: r.label for r in got.where(F.col("iteration") == it).collect()}
        assert len(of) == 60
        assert all(len({of[k] for k in range(g * 15, g * 15 + 15)}) == 1 for g in range(4)) and len(set(of.values())) == 4
    a, b, w = (np.array(c) for c in zip(*planted(seed=3), strict=True))
    g = Graph(60, a, b, w)
    label = ALGORITHMS[algorithm](g, 1)
    assert g.modularity(label) > g.modularity(np.arange(60)) and g.modularity(label) > 0.5
    assert rows(cluster(edges, 3, algorithm, seed=5, sent_edges=10)) == rows(got)  # a copy of the edges for each iteration
    two = edges.withColumn("g", F.lit("one")).unionByName(edges.withColumn("g", F.lit("two")))
    each = cluster(two, 3, algorithm, seed=5, by="g")
    assert rows(each.where("g = 'two'").drop("g")) == rows(got) and each.count() == 2 * got.count()
    assert cluster(edges.limit(0), 2, algorithm).collect() == []
    with pytest.raises(ValueError):
        cluster(edges, 1, "spinglass")


def test_greedy_merges():
    from ligature.operators.mobile import bins_of_merges, merge_greedily

    def brute(raw, threshold):
        n = len(raw)
        m = [[float(raw[min(i, j)][max(i, j)]) for j in range(n)] for i in range(n)]
        score = [[m[i][j] / math.sqrt(m[i][i] * m[j][j]) if j > i and m[i][i] * m[j][j] else 0.0 for j in range(n)] for i in range(n)]
        out = []
        while n:
            best = max(max(r) for r in score)
            if best <= threshold:
                return out
            i, j = next((i, j) for i in range(n) for j in range(n) if score[i][j] == best)
            out.append((i, j, best))
            m[i][i] += m[j][j] + m[i][j]
            for k in range(n):
                if k not in (i, j):
                    m[i][k] = m[k][i] = m[i][k] + m[j][k]
            for k in range(n):
                m[j][k] = m[k][j] = 0.0
                score[j][k] = score[k][j] = 0.0
            m[i][j] = m[j][i] = 0.0
            for k in range(n):
                if k != i:
                    a, b = min(i, k), max(i, k)
                    score[a][b] = m[i][k] / math.sqrt(m[i][i] * m[k][k]) if m[i][i] * m[k][k] else 0.0
        return out

    rng = np.random.default_rng(1)
    for _ in range(20):
        raw = np.triu(rng.integers(0, 6, (9, 9)))
        np.fill_diagonal(raw, rng.integers(0, 9, 9))
        sparse = [(i, j, float(raw[i, j])) for i in range(9) for j in range(i, 9) if raw[i, j]]
        got, want = merge_greedily(sparse, 0.5), brute(raw, 0.5)
        assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want])
        binned = bins_of_merges(list(range(9)), got)
        assert sorted(b[0] for b in binned) == list(range(9))
        joined = {i: {i} for i in range(9)}
        for i, j, _ in got:
            both = joined[i] | joined[j]
            for k in both:
                joined[k] = both
        of = {i: b for i, b, _ in binned}
        assert all((of[i] == of[j]) == (j in joined[i]) for i in range(9) for j in range(9))


def test_matching_and_paths(spark):
    from ligature.operators.scaffold import match_ends, paths, scaffold_sequences, scaffold_table, scaffolds

    def dense(n, scores, threshold, sure=5.0):
        """The rule as a whole matrix, looked through anew for every pair."""
        m = np.zeros((2 * n, 2 * n))
        for i, j, s in scores:
            if i // 2 != j // 2:
                m[i, j] = m[j, i] = s
        pairs = []
        while m.max() > threshold:
            lone = [m[r].max() for r in range(2 * n) if (m[r] > threshold).sum() == 1]
            pick = max(lone) if lone and max(lone) > sure * threshold else m.max()
            i, j = next((i, j) for i in range(2 * n) for j in range(2 * n) if m[i, j] == pick)
            pairs.append((i, j))
            m[[i, j]] = 0.0
            m[:, [i, j]] = 0.0
        return pairs

    assert match_ends([(1, 2, 0.9), (0, 3, 0.5)], 0.1) == [(1, 2), (0, 3)]
    assert match_ends([(1, 2, 0.9), (1, 4, 0.6)], 0.1) == [(1, 2)]
    assert match_ends([(1, 2, 0.9), (1, 4, 0.8), (2, 5, 0.85), (0, 3, 0.7)], 0.1)[0] == (2, 5)  # sure and alone
    assert paths(1, []) == [(0, 0, 0, False, False)]
    assert paths(2, [(1, 3)]) == [(0, 0, 0, False, False), (0, 1, 1, True, False)]
    assert paths(3, [(1, 2), (3, 4), (5, 0)]) == [(0, 0, 0, False, True), (0, 1, 1, False, True), (0, 2, 2, False, True)]
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = int(rng.integers(1, 9))
        ends = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 2 * n, 12), rng.integers(0, 2 * n, 12), rng.random(12), strict=True) if a != b]
        ends = [(a, b, round(s, 1)) for a, b, s in {(min(a, b), max(a, b)): (a, b, s) for a, b, s in ends}.values()]  # many ties
        pairs = match_ends(ends, 0.2)
        assert pairs == dense(n, ends, 0.2) and match_ends(ends, 0.1) == dense(n, ends, 0.1)
        used = [e for p in pairs for e in p]
        assert len(used) == len(set(used))
        placed = paths(n, pairs)
        assert sorted(p[2] for p in placed) == list(range(n))
        mate = dict(pairs) | {b: a for a, b in pairs}
        for (s, _, c, rev, _), (t, _, d, rev2, _) in zip(placed, placed[1:], strict=False):
            if s == t:
                assert mate[2 * c + (not rev)] == 2 * d + rev2
    scores = spark.createDataFrame([("x", 1, 3, 0.9), ("y", 1, 2, 0.01)], "bin string, end_i long, end_j long, score double")
    contigs = spark.createDataFrame([("x", 0, "a", 4), ("x", 1, "b", 3), ("y", 0, "c", 2), ("y", 1, "d", 1)], "bin string, nth long, name string, size long")
    table = scaffold_table(scaffolds(scores, contigs), contigs)
    seqs = spark.createDataFrame([("a", "AACG"), ("b", "GTT"), ("c", "CC"), ("d", "A")], "name string, seq string")
    got = {(r.bin, r.scaffold): r.seq for r in scaffold_sequences(table, seqs).collect()}
    assert got == {("x", "scaffold_0001"): "AACGNNNNNAAC", ("y", "scaffold_0001"): "CC", ("y", "scaffold_0002"): "A"}


def test_marker_sets_and_generations(spark):
    from ligature.operators.quality import compare_by_half, compare_generations, contaminated, merge_marker_sets

    b = spark.createDataFrame([("1", 0.2, 1.0), ("2", 0.9, 1.1), ("3", 0.5, 1.0)], "bin string, completeness double, redundancy double")
    a = spark.createDataFrame([("1", 0.8, 1.2), ("2", 0.9, 1.0)], b.schema)
    assert {r.bin: r.markers for r in merge_marker_sets(b, a).collect()} == {"1": "Archaea", "2": "Bacteria", "3": "Bacteria"}
    q = spark.createDataFrame([("p", 0.9, 1.2), ("q", 0.9, 1.2), ("r", 0.3, 2.0), ("s", 0.0, 1.0)], b.schema)
    assert {r.bin for r in contaminated(q).collect()} == {"p", "q"}
    kids = spark.createDataFrame([("p", "p.1", 0.8, 1.0), ("p", "p.2", 0.1, 1.0), ("q", "q.1", 0.5, 1.0)], "parent string, bin string, completeness double, redundancy double")
    assert {(r.bin, r.recursive) for r in compare_generations(q, kids, 1).collect()} == {("p.1", True), ("p.2", True), ("q", False), ("r", False), ("s", False)}
    big = q.withColumn("completeness", F.col("completeness") * 100)
    assert {r.bin for r in compare_by_half(big, kids.withColumn("completeness", F.col("completeness") * 100)).collect()} == {"p.1", "p.2", "q", "r", "s"}


def test_recursion_splits_and_stops(spark):
    from ligature.plans.facade import pipeline

    edges = planted(2, 12, 1)
    pairs = spark.createDataFrame([(0, i, 10, "+", j, 10, "-") for i, j, _ in edges], "sample int, c1 long, pos1 long, strand1 string, c2 long, pos2 long, strand2 string")
    contigs = spark.createDataFrame([(k, f"c{k}", 1000, 2.0, 5) for k in range(24)], "id long, name string, size long, coverage double, rs long")

    def estimate(members):
        own = members.groupBy("bin").agg(F.countDistinct(F.floor(F.col("id") / 12)).alias("kinds"), F.count("*").alias("n"))
        return own.select("bin", F.lit(0.9).alias("completeness"), (F.col("kinds").cast("double")).alias("redundancy"))

    table, summary = pipeline(pairs, contigs, estimate, iterations=4, size=2000)
    of = {r.id: r.bin for r in table.collect()}
    assert len({of[k] for k in range(12)}) == 1 and len({of[k] for k in range(12, 24)}) == 1 and of[0] != of[12]
    assert summary.count() == 2

    from ligature.plans.facade import validate

    whole = contigs.select("id", F.lit("00001").alias("bin"))
    edges_df = spark.createDataFrame(edges, "src long, dst long, w double")
    final, _ = validate(edges_df, contigs, whole, estimate, size=2000, iterations=4)
    of = {r.id: r.bin for r in final.collect()}
    assert {of[k] for k in range(12)} != {of[k] for k in range(12, 24)} and len(set(of.values())) == 2


def test_balance(spark):
    from ligature.operators.layout import balance

    m = np.array([[4, 2, 0], [2, 5, 1], [0, 1, 3.0]])
    want = m.copy()
    for _ in range(6):
        want = want / np.linalg.norm(want, axis=0)
        want = want / np.linalg.norm(want, axis=1)[:, None]
    made = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(3) for j in range(i, 3) if m[i, j]], "i long, j long, n double")
    assert all(r.value == pytest.approx(want[r.i, r.j]) for r in balance(made, 6).collect())


def test_balance_moves_factors_not_entries(spark):
    """Many blocks, rows of zeros, a star, whose factors drift apart; entries shuffle once."""
    from ligature.operators.layout import balance

    rng = np.random.default_rng(3)
    cells = {(min(a, b), max(a, b)): float(n) for a, b, n in zip(*rng.integers(0, 60, (2, 400)).tolist(), rng.integers(1, 50, 400).tolist(), strict=True)}
    cells |= {(100, k): 3.0 for k in range(101, 140)} | {(200, 200): 0.0}
    m = np.zeros((201, 201))
    for (a, b), n in cells.items():
        m[a, b] = m[b, a] = n
    for _ in range(9):
        for axis in (0, 1):
            norm = np.linalg.norm(m, axis=axis, keepdims=True)
            m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
    made = spark.createDataFrame([(a, b, n) for (a, b), n in cells.items()], "i long, j long, n double")
    got = balance(made, 9, block_entries=100)
    assert {(r.i, r.j): r.value for r in got.collect()} == {k: pytest.approx(m[k], abs=1e-12) for k in cells}
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.executorSummary("driver").totalShuffleWrite()
    wide = spark.range(40_000).select((F.col("id") % 200).alias("i"), (F.col("id") % 200 + F.floor(F.col("id") / 200)).alias("j"), (F.col("id") % 7 + 1).alias("n"))
    assert balance(wide, 6).count() == 40_000
    assert store.executorSummary("driver").totalShuffleWrite() - before < 4_000_000


def test_signals_grow_with_contacts_not_with_pairs_of_bins(spark):
    """100,000 bins, two that meet: 5 billion pairs of bins are counted, not made."""
    from ligature.operators.mobile import signal_counts, signal_frame

    noise = spark.createDataFrame([("b1", "b1", 0.5), ("b1", "b2", 0.01)], "mag1 string, mag2 string, signal double")
    classes = spark.createDataFrame([("b1", "HQ")], "bin string, class string")
    bins = lambda k: spark.range(1, k + 1).select(F.concat(F.lit("b"), "id").alias("bin"))
    many = signal_counts(noise, bins(100_000), classes)
    assert many.count() == 100_000 + 100_000 + 2
    assert {(r.signal, r["class"], r.n, round(r.scaled_signal, 6)) for r in many.where("mag = 'b1'").collect()} == {(0.5, "HQ", 1, 1.0), (0.01, "HQ", 1, 1.0), (0.0, "HQ", 99_998, 0.0)}
    assert many.where("type = 'inter'").agg(F.sum("n")).first()[0] == 100_000 * 99_999
    assert rows(signal_frame(noise, bins(3), classes).groupBy("mag", "type", "signal").count()) == rows(signal_counts(noise, bins(3), classes).groupBy("mag", "type", "signal").agg(F.sum("n").alias("count")))
    assert signal_counts(noise.limit(0), bins(1), classes).count() == 1


def test_sites_are_cut_where_they_are(spark):
    """Stretches of a contig come from its own row: nothing shuffles, and no site is a row."""
    from ligature.operators.quality import site_buckets

    sites = spark.createDataFrame([(1, [5, 9, 10, 31]), (2, [25]), (3, []), (4, None), (5, [-3, 2])], "contig long, sites array<long>")
    made = site_buckets(sites, 10)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate [" not in plan and "Join" not in plan
    want = [(1, 0, 3, 0, [5, 9]), (1, 1, 3, 2, [0]), (1, 2, 3, 3, []), (1, 3, 3, 3, [1]), (2, 0, 2, 0, []), (2, 1, 2, 0, []), (2, 2, 2, 0, [5]), (5, 0, 0, 1, [2])]
    assert sorted((r.contig, r.bucket, r.last, r.base, r.near) for r in made.collect()) == want


def test_pairing_and_options(spark):
    from ligature.operators.pairs import pair_interleaved, unknown_contigs
    from ligature.plans.facade import build_network, check_options, pairs_from_alignments

    reads = spark.createDataFrame([("r", 0x40 | 1, "a", 9, 40), ("r", 0x80 | 0x10 | 1, "b", 19, 35), ("s", 0x40 | 1, "a", 1, 10), ("s", 0x80 | 1, "b", 1, 60), ("r", 0x840, "c", 0, 60)], "read_id string, flag int, contig string, pos int, mapq int")
    assert rows(pair_interleaved(reads)) == [("a", "b", 10, 20, "r", "+", "-")]
    one = spark.createDataFrame([("r", 16, "b", 4, 50), ("t", 4, "b", 4, 50)], reads.schema)
    two = spark.createDataFrame([("r", 0, "a", 7, 30), ("t", 0, "a", 7, 29)], reads.schema)
    assert rows(pairs_from_alignments(one, two)) == [("a", "b", 8, 5, "r", "+", "-")]
    with pytest.raises(ValueError):
        check_options("abundance", ["id"])
    with pytest.raises(ValueError):
        check_options("other", [])
    pairs = spark.createDataFrame([(0, 1, 5, "+", 9, 5, "+")], "sample int, c1 long, pos1 long, strand1 string, c2 long, pos2 long, strand2 string")
    contigs = spark.createDataFrame([(1, 100)], "id long, size long")
    assert [r.contig for r in unknown_contigs(pairs, contigs).collect()] == [9]
    with pytest.raises(KeyError):
        build_network(pairs, contigs)
    alone = spark.createDataFrame([("r", 65, "a", 9, 40), ("r", 129, "b", 19, 35), ("s", 65, "a", 1, 60)], reads.schema)
    assert pair_interleaved(alone).count() == 1
    with pytest.raises(Exception, match="should be paired: s"):
        pair_interleaved(alone, strict=True).collect()


def test_fragments_of_uneven_sites(spark):
    from ligature.operators.quality import fragment_index

    rng = np.random.default_rng(5)
    sites = {c: sorted({int(x) for x in rng.integers(1, 90_000, n)}) for c, n in ((1, 60), (2, 1), (3, 7))}
    pairs = [(k, int(rng.integers(1, 5)), int(rng.integers(1, 120_000)), int(rng.integers(1, 5)), int(rng.integers(1, 120_000))) for k in range(200)]
    made = spark.createDataFrame(list(sites.items()), "contig long, sites array<long>")
    got = {r.k: (r.frag1, r.frag2) for r in fragment_index(spark.createDataFrame(pairs, "k long, c1 long, pos1 long, c2 long, pos2 long"), made, 10_000).collect()}
    before = lambda c, pos: sum(s < pos for s in sites.get(c, []))
    assert got == {k: (before(c1, p1), before(c2, p2)) for k, c1, p1, c2, p2 in pairs}


def test_edits_of_a_bin(spark):
    """Against a list of single bases, edited one by one."""
    from ligature.operators import regions as R

    rng = np.random.default_rng(9)
    layout = {b: [(f"c{b}{k}", int(s), int(s + n), bool(r)) for k, (s, n, r) in enumerate(zip(rng.integers(0, 5, 4), rng.integers(1, 9, 4), rng.integers(0, 2, 4), strict=True))] for b in range(6)}
    segments = spark.createDataFrame([(b, k, *s) for b, ss in layout.items() for k, s in enumerate(ss)], "bin long, rank long, name string, start long, end long, is_reverse boolean")

    def bases(rows):
        return [(n, p, r) for n, s, e, r in rows for p in (range(e - 1, s - 1, -1) if r else range(s, e))]

    def of(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: (r.bin, r["rank"])):
            out.setdefault(r.bin, []).append((r.name, r.start, r.end, r.is_reverse))
        return {b: bases(v) for b, v in out.items()}

    whole = {b: bases(v) for b, v in layout.items()}
    spans = {b: sorted(int(x) for x in rng.choice(len(whole[b]) + 1, 2, replace=False)) for b in range(5)}
    asked = spark.createDataFrame([(b, *v) for b, v in spans.items()], "bin long, lo long, hi long")
    turned = {b: v if b not in spans else v[: spans[b][0]] + [(n, p, not r) for n, p, r in reversed(v[spans[b][0] : spans[b][1]])] + v[spans[b][1] :] for b, v in whole.items()}
    assert of(R.invert(segments, asked)) == turned
    assert of(R.between(segments, asked)) == {b: whole[b][lo:hi] for b, (lo, hi) in spans.items()}
    assert of(R.delete(segments, asked)) == {b: v for b, v in ((b, v if b not in spans else v[: spans[b][0]] + v[spans[b][1] :]) for b, v in whole.items()) if v}
    new = spark.createDataFrame([(b, lo, "n", 2, 5, True) for b, (lo, _) in spans.items()], "bin long, place long, name string, start long, end long, is_reverse boolean")
    assert of(R.insert(segments, new)) == {b: v if b not in spans else v[: spans[b][0]] + bases([("n", 2, 5, True)]) + v[spans[b][0] :] for b, v in whole.items()}
    with pytest.raises(Exception, match="outside the bin"):
        R.invert(segments, spark.createDataFrame([(0, 0, 999)], asked.schema)).collect()


def test_matrix_of_parts_of_cores(spark, monkeypatch):
    from ligature.operators import consensus as C

    monkeypatch.setattr(C, "BLOCK", 3)
    members = spark.createDataFrame([(k, k * 7 % 3) for k in range(20)], "id long, core_id long")
    agreement = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (2, 2, 1.0), (0, 2, 0.6)], "core_a long, core_b long, agreement double")
    core, value = {k: k * 7 % 3 for k in range(20)}, {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 1.0, (0, 2): 0.6}
    want = {(i, j): value[a] for i in range(20) for j in range(i, 20) if (a := tuple(sorted((core[i], core[j])))) in value}
    made = C.clustering_matrix(members, agreement)
    got = made.collect()
    assert {(r.i, r.j): r.value for r in got} == want and len(got) == len(want)
    # entries are made by the last step and not shuffled
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "Exchange" not in plan[: plan.index("Generate explode(ys")] and "Aggregate" not in plan[: plan.index("Generate explode(ys")]
    # with a sparse matrix: entries in both, in one, of nodes without a core, given twice
    other = spark.createDataFrame([(0, 3, 1.0), (2, 8, 1.0), (0, 1, 1.0), (1, 4, 1.0), (4, 4, 1.0), (5, 99, 1.0), (2, 8, 0.5), (0, 0, 1.0)], "i long, j long, value double")
    mean = C.clustering_mean(members, agreement, other, 6).collect()
    plain = {(r.i, r.j): round(r.value, 6) for r in C.mean_matrix(made, other).collect()}
    assert {(r.i, r.j): r.value for r in mean} == plain and len(mean) == len(plain)


@pytest.mark.parametrize("algorithm", ["louvain", "leiden"])
def test_clustering_by_component(spark, algorithm):
    """A large graph is clustered a component at a time, with the weight of the whole graph."""
    from ligature.operators import community

    one = planted()
    listed = [(a + 60 * k, b + 60 * k, w) for k in range(3) for a, b, w in one] + [(180, 181, 1.0)]
    made = community.cluster(spark.createDataFrame(listed, "src long, dst long, w double"), 2, algorithm, seed=5, sent_edges=10)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().analyzed().toString()
    got = made.collect()
    alone = community.Graph(60, *(np.array(c) for c in zip(*sorted((min(a, b), max(a, b), w) for a, b, w in one), strict=True)), total=sum(w for _, _, w in listed))
    for it in range(2):
        of = {r.id: r.label for r in got if r.iteration == it}
        assert len(of) == 182 and of[180] == of[181]
        apart = [{of[k] for k in ids} for ids in (range(60), range(60, 120), range(120, 180), (180, 181))]
        assert sum(len(x) for x in apart) == len(set(of.values()))
        want = community.ALGORITHMS[algorithm](alone, 5 + it)
        for c in range(3):
            assert np.unique([of[k + 60 * c] for k in range(60)], return_inverse=True)[1].tolist() == np.unique(want, return_inverse=True)[1].tolist()
