"""Readers, writers, streaming and scalar functions, by round trip."""

import bz2
import gzip
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from ligature.functions import sequences as S
from ligature.sources import readers as R
from ligature.sources import sinks as K
from tests.conftest import rows

PAIRS = "## pairs format v1.0\n#columns: readID chr1 pos1 chr2 pos2 strand1 strand2\nr1\tNODE_2\t5\tNODE_10\t7\t+\t-\nr2\tNODE_1\t1\tNODE_1\t9\t-\t+\n"


def test_pairs_and_compression(spark, tmp_path):
    (tmp_path / "a.pairs").write_text(PAIRS)
    (tmp_path / "b.pairs.gz").write_bytes(gzip.compress(PAIRS.encode()))
    want = rows(R.read_pairs(spark, str(tmp_path / "a.pairs")))
    assert len(want) == 2 and rows(R.read_pairs(spark, str(tmp_path / "b.pairs.gz"))) == want
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("x", PAIRS)
    (tmp_path / "d.dat").write_bytes(bz2.compress(PAIRS.encode()))
    (tmp_path / "e.dat").write_bytes(gzip.compress(PAIRS.encode()))
    for name in ("a.pairs", "c.zip", "d.dat", "e.dat"):
        assert [r.value for r in R.read_any_text(spark, str(tmp_path / name)).collect()] == PAIRS.splitlines()
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("x", "1")
        z.writestr("y", "2")
    with pytest.raises(Exception, match="one member"):
        R.read_any_text(spark, str(tmp_path / "two.zip")).collect()


def test_pairs_store_and_export(spark, tmp_path):
    (tmp_path / "a.pairs").write_text(PAIRS)
    pairs = R.read_pairs(spark, str(tmp_path / "a.pairs"))
    store = str(tmp_path / "store")
    made = K.stored_pairs(spark, store, lambda: pairs)
    assert rows(made) == rows(pairs) == rows(K.stored_pairs(spark, store))
    with pytest.raises(Exception, match="(?i)exist"):
        K.store_pairs(pairs, store)
    K.store_pairs(pairs, store, force=True)
    found = K.region(spark.read.parquet(store), "NODE_1", 1, 5, "NODE_1", 1, 9)
    assert [r.read_id for r in found.collect()] == ["r2"]
    assert "PushedFilters: [IsNotNull(c1)" in found._jdf.queryExecution().toString()
    contigs = spark.createDataFrame([(1, "NODE_1", 9), (2, "NODE_2", 8), (10, "NODE_10", 7)], "id int, name string, size int")
    K.export_pairs(pairs, contigs, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text.splitlines()[3:6] == ["#chromsize: NODE_1 9", "#chromsize: NODE_2 8", "#chromsize: NODE_10 7"]
    assert text.splitlines()[-2:] == ["r2\tNODE_1\t1\tNODE_1\t9\t-\t+", "r1\tNODE_2\t5\tNODE_10\t7\t+\t-"]


def bam(records):
    head = b"BAM\x01" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for name, size in (("a", 10), ("b", 20)):
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for name, flag, ref, pos, mapq in records:
        body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, 0, flag, 0, -1, -1, 0) + name.encode() + b"\0"
        head += struct.pack("<i", len(body)) + body
    half = len(head) // 2
    return gzip.compress(head[:half]) + gzip.compress(head[half:])


def test_alignments(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(bam([("r1", 0, 0, 4, 60), ("read2", 16, 1, 7, 3), ("r3", 4, -1, -1, 0)]))
    (tmp_path / "x.sam").write_text("@HD\tVN:1\nr1\t0\ta\t5\t60\nread2\t16\tb\t8\t3\nr3\t4\t*\t0\t0\n")
    got = rows(R.read_bam(spark, str(tmp_path / "x.bam")))
    assert got == rows(R.read_sam(spark, str(tmp_path / "x.sam"))) and len(got) == 3


def test_sequences(spark, tmp_path):
    (tmp_path / "bins").mkdir()
    (tmp_path / "bins" / "one.fa").write_text(">a some text\nACGT\nGG\n>b\nTTAA\n")
    (tmp_path / "bins" / "two.fa").write_text(">c\r\nAC\r\nGT\r\n")
    assert {(r.name, r.seq) for r in R.read_fasta(spark, str(tmp_path / "bins")).collect()} == {("a", "ACGTGG"), ("b", "TTAA"), ("c", "ACGT")}
    folder = R.read_bin_folder(spark, str(tmp_path / "bins"))
    assert {(r.bin, r.name) for r in folder.collect()} == {("one", "a"), ("one", "b"), ("two", "c")}
    assert R.looks_like_fasta(spark, str(tmp_path / "bins" / "one.fa"))
    K.write_bin_sequences(folder.select("bin", "name"), folder, str(tmp_path / "out"))
    assert rows(R.read_fasta(spark, f"{tmp_path}/out/bin=one").select("name", "seq")) == [("a", "ACGTGG"), ("b", "TTAA")]
    members = spark.createDataFrame([("m", 2, "a"), ("m", 1, "b")], "bin string, id int, name string")
    assert K.joined_sequences(members, folder, 3).first().seq == "TTAANNNACGTGG"
    seq = F.col("seq")
    made = spark.createDataFrame([("ACGTGGATCCNN",), ("",), ("nnn",)], "seq string")
    got = made.select(S.gc_content(seq), S.gc_content(seq, "length"), S.restriction_sites(seq, S.site_pattern("DpnII,HinfI")), S.reverse_complement(seq), S.fetch(seq, F.lit(1), F.lit(4), F.lit(True))).collect()
    assert tuple(got[0]) == (60.0, 50.0, 2, "NNGGATCCACGT", "ACG")
    assert got[1][0] is None and got[1][2] == 1 and got[2][0] is None
    assert S.site_pattern(["HinfI", "DpnII", "MboI"]) == "GA.TC|GATC"
    with pytest.raises(ValueError):
        S.site_pattern("Nothing")
    names = spark.createDataFrame([("n10",), ("n9",), ("n9b",), ("m",), ("n" + "9" * 30,), ("n1" + "0" * 30,), ("n007",)], "name string")
    assert [r.name for r in names.orderBy(S.natural_key(F.col("name"))).collect()] == ["m", "n007", "n9", "n9b", "n10", "n" + "9" * 30, "n1" + "0" * 30]


def test_assembly_in_the_order_of_its_files(spark, tmp_path):
    """Ids follow the records, whatever the sizes of the files and of the parts read at once."""
    names = []
    for k, n in enumerate((3, 400, 20)):
        own = [f"f{k}r{j}" for j in range(n)]
        (tmp_path / f"{k}.fa").write_text("".join(f">{x} about\n{'ACGT' * (j % 9)}\nA\n" for j, x in enumerate(own)))
        names += own
    (tmp_path / "depth.txt").write_text("n\tl\td\n" + "".join(f"{x}\t1\t{j}.5\n" for j, x in enumerate(reversed(names[:100]))))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        got = R.assembly(spark, f"{tmp_path}/*.fa", f"{tmp_path}/depth.txt", S.site_pattern("MboI")).orderBy("id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.id, r.name) for r in got] == list(enumerate(names, 1))
    assert [r.coverage for r in got[:101]] == [99.5 - j for j in range(100)] + [None] and got[4].size == 5
    assert R.kind_of(spark, f"{tmp_path}/0.fa") == "fasta" and R.kind_of(spark, f"{tmp_path}/depth.txt") == "table"
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "a.pairs.gz").write_bytes(gzip.compress(PAIRS.encode()))
    (tmp_path / "lib" / "b.pairs.gz").write_bytes(gzip.compress(PAIRS.encode()))
    assert {(r.library, r.read_id) for r in R.read_pairs_folder(spark, f"{tmp_path}/lib").collect()} == {(x, r) for x in "ab" for r in ("r1", "r2")}


def test_tables(spark, tmp_path):
    own = spark.createDataFrame([(1, "NODE_1", 100, 50.5, 3, None, 4, "00001", 1, 100, None, None, None)], R.PARTITION)
    K.write_table(own, str(tmp_path / "t"))
    assert rows(R.read_contigs(spark, str(tmp_path / "t"), R.PARTITION)) == rows(own)
    edges = spark.createDataFrame([(2, 1, 0.5), (1, 2, 0.25), (3, 4, 1.0)], R.NETWORK)
    K.write_network(edges, str(tmp_path / "n"))
    assert rows(R.read_network(spark, str(tmp_path / "n"))) == [(2, 1, 0.75), (4, 3, 1.0)]
    by_sample = spark.createDataFrame([(1, 5, 6)], "id int, hit_0 long, hit_1 long")
    assert K.write_hits(by_sample, own.select(F.col("ID").alias("id"), F.col("Name").alias("name")), str(tmp_path / "h"))
    assert spark.read.text(str(tmp_path / "h")).first().value == "1\tNODE_1\t5\t6"
    assert not K.write_hits(by_sample.drop("hit_1"), own, str(tmp_path / "h1"))
    matrix = spark.createDataFrame([(1, 2, 0.25)], "i int, j int, value double")
    K.write_matrix(matrix, str(tmp_path / "m"), 3)
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["3\t3\t1", "1\t2\t0.250"]
    (tmp_path / "marks.tsv").write_text("# made by a tool\nName\tLength\tGC\tP\tC\tR\n00001\t100\t0.5\t10\t0.9\t1.1\t0.8\t1.0\t3\t50\t1\t20\t2\t9\tx\n")
    marks = R.read_markers(spark, str(tmp_path / "marks.tsv"))
    assert [(r.bin, r.completeness, r.cds) for r in marks.collect()] == [("00001", 0.9, 9)]
    summary = marks.withColumns({"recursive": F.lit(True), "step": F.lit(0), "parent": F.lit(None).cast("string"), "hic_abundance": F.lit(1.23456), "sg_abundance": F.lit(2.0)})
    K.write_bin_summary(summary, str(tmp_path / "s"))
    back = R.read_bin_summary(spark, str(tmp_path / "s")).first()
    assert (back.bin, back.hic_abundance, back.redundancy, back.parent) == ("00001", 1.2346, 1.1, None)
    (tmp_path / "binning.txt").write_text("c1_split_1 b1\nc2 b1\n")
    assert rows(R.read_binning(spark, str(tmp_path / "binning.txt"))) == [("b1", "c1"), ("b1", "c2")]
    (tmp_path / "names.txt").write_text("c2 more\n\n c3\n")
    names = R.read_names(spark, str(tmp_path / "names.txt"))
    assert rows(names) == [("c2",), ("c3",)]
    contigs = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "Name string")
    assert rows(R.element_table(contigs, names, R.read_binning(spark, str(tmp_path / "binning.txt")))) == [("c1", "b1", False), ("c2", "b1", True), ("c9", "ND", False)]
    line = "  " + "  ".join(["b1", "k__B", "(UID1)", "1", "2", "3", "91.5", "2.5", "0.0", "1000", "0", "5", "4", "7", "300", "1", "1", "2", "500", "55.5", "0.1", "88.0"])
    (tmp_path / "report.txt").write_text("-----\n  Bin Id  x\n-----\n" + line + "\n-----\n")
    (tmp_path / "taxa.txt").write_text("---\n  Bin Id  a\n  b1  1  2  k__B;p__P\n")
    got = R.read_lineage_report(spark, str(tmp_path / "report.txt"), str(tmp_path / "taxa.txt")).first()
    assert (got.bin, got.completeness, got.contamination, got.n50, got.taxonomy) == ("b1", 91.5, 2.5, 300, "k__B;p__P")
    assert R.read_lineage_report(spark, str(tmp_path / "report.txt")).first().taxonomy == "-"
    (tmp_path / "depth.txt").write_text("contigName\tcontigLen\ttotalAvgDepth\tx\nNODE_2\t7\t1.5\t0\n")
    assert rows(R.read_depth(spark, str(tmp_path / "depth.txt"))) == [(1.5, 7, "NODE_2")]


def test_streaming_counts(spark, tmp_path):
    from ligature.operators.network import contacts, hits
    from ligature.streaming.contacts import keep_updated, latest, pair_stream, running_contacts, running_hits

    schema = "c1 long, pos1 long, strand1 string, c2 long, pos2 long, strand2 string"
    one = spark.createDataFrame([(1, 5, "+", 2, 5, "+"), (1, 6, "+", 1, 8, "+")], schema)
    two = spark.createDataFrame([(2, 5, "+", 1, 7, "+"), (3, 1, "+", 2, 5, "+")], schema)
    contigs = spark.createDataFrame([(k, 100) for k in (1, 2, 3)], "id long, size long").cache()
    for name, make, keys, batch in (("h", running_hits, ["id"], hits), ("c", lambda p: running_contacts(p, contigs), ["src", "dst"], lambda p: contacts(p, contigs))):
        folder, out = f"{tmp_path}/{name}-in", f"{tmp_path}/{name}-out"
        for part in (one, two):
            part.coalesce(1).write.mode("append").parquet(folder)
            keep_updated(make(pair_stream(spark, folder, schema)), out, keys, f"{tmp_path}/{name}-ck").awaitTermination()
        assert rows(latest(spark, out, keys)) == rows(batch(one.union(two)))


def test_scratch_tables(spark, tmp_path):
    """Tables of a scope go at its end, but those that are kept, also through scopes inside."""
    from pathlib import Path

    from ligature.storage import materialize, release, scratch

    made = {}
    outside = materialize(spark.range(3), "outside")
    with scratch() as keep:
        made["kept"] = keep(materialize(spark.range(5), "kept"))
        made["gone"] = materialize(spark.range(2), "gone")
        with scratch() as inner:
            made["up"] = inner(materialize(spark.range(1), "up"))
            made["inner"] = materialize(spark.range(1), "inner")
        assert made["up"].count() == 1 and not Path(made["inner"]._ligature_path).exists()
        release(materialize(spark.range(1), "released"))
    assert {k: Path(v._ligature_path).exists() for k, v in made.items()} == {"kept": True, "gone": False, "up": False, "inner": False}
    assert made["kept"].count() == 5 and outside.count() == 3


def test_one_file_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "RANGE_ROWS", 10)
    matrix = spark.range(100).select((F.col("id") % 7).alias("i"), F.col("id").alias("j"), F.lit(0.5).alias("value"))
    K.write_matrix(matrix, str(tmp_path / "m"), 100)
    files = list((tmp_path / "m").glob("part-*"))
    lines = files[0].read_text().splitlines()
    assert len(files) == 1 and lines[0] == "100\t100\t100"
    assert [tuple(map(int, x.split("\t")[:2])) for x in lines[1:]] == sorted((k % 7, k) for k in range(100))
    # packed as members that follow one another, and streamed where the name tells the kind
    spark.read.text(str(tmp_path / "m")).repartition(4).write.text(str(tmp_path / "four"))
    K.pack_text(spark, str(tmp_path / "four"), str(tmp_path / "gz"))
    (packed,) = (tmp_path / "gz").glob("part-*.gz")
    assert sorted(gzip.decompress(packed.read_bytes()).decode().splitlines()) == sorted(lines)
    found = R.read_any_text(spark, str(tmp_path / "gz" / "*.gz"))
    assert "binaryFile" not in found._jdf.queryExecution().toString()
    assert sorted(r.value for r in found.collect()) == sorted(lines)
