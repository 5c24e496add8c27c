"""Readers of the formats that contact analyses exchange, each with an explicit schema.

Text formats are read by Spark, in parallel and by any file system it knows; gz and bz2 go by
their extension. ``binary`` readers take what has no splittable text form.
"""

from __future__ import annotations

import bz2
import gzip
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import gc_content, restriction_sites
from ..operators.consensus import ordinals
from ..storage import ship

PAIRS = "read_id string, c1 string, pos1 int, c2 string, pos2 int, strand1 string, strand2 string"
ALIGNMENTS = "read_id string, flag int, contig string, pos int, mapq int"
DEPTH = "name string, length long, coverage double"
CONTIGS = "ID int, Name string, Size long, GC_content double, Hit long, Shotgun_coverage double, Restriction_site int"
PARTITION = CONTIGS + ", Core_bin_ID string, Core_bin_contigs int, Core_bin_size long, Overlapping_bin_ID string, Overlapping_bin_contigs int, Overlapping_bin_size long"
FINAL = PARTITION + ", Recursive_bin_ID string, Recursive_bin_contigs int, Recursive_bin_size long, Final_bin string"
NETWORK = "src int, dst int, w double"
MARKERS = "bin string, length long, gc double, present_markers int, completeness double, redundancy double, weighted_completeness double, weighted_redundancy double, contigs int, n50 long, l50 int, n90 long, l90 int, cds int"


def _tsv(spark: SparkSession, path: str | list[str], schema: str, header: bool = False, null: str = "-", **options) -> DataFrame:
    return spark.read.csv(path, schema=schema, sep="\t", header=header, nullValue=null, **options)


def read_pairs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pairs as text: # lines are skipped, the first seven columns are kept."""
    return _tsv(spark, path, PAIRS, comment="#", null="")


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments as text: read_id, flag, contig, pos (from 0), mapq. Header lines are skipped."""
    cols = F.split("value", "\t")
    lines = spark.read.text(path).where("not startswith(value, '@')")
    return lines.select(cols[0].alias("read_id"), cols[1].cast("int").alias("flag"), cols[2].alias("contig"), (cols[3].cast("int") - 1).alias("pos"), cols[4].cast("int").alias("mapq"))


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Alignments of BAM files: the same columns as ``read_sam``.

    A file is one task and 2 GB at most, the limit of Spark's binary files; it is held packed and
    unpacked as it is read. Larger libraries come as several files or as text.
    """
    ship(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                rows = []
                for row in _bam_rows(gzip.GzipFile(fileobj=io.BytesIO(raw.as_py()))):
                    rows.append(row)
                    if len(rows) == 50_000:
                        yield _alignments(rows)
                        rows = []
                yield _alignments(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(decode, ALIGNMENTS)


def _alignments(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["read_id", "flag", "contig", "pos", "mapq"])


def _bam_rows(raw: io.IOBase) -> Iterator[tuple]:
    """Records of an unpacked stream, one after the other."""

    def number() -> int:
        return struct.unpack("<i", raw.read(4))[0]

    if raw.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    raw.read(number())
    names = []
    for _ in range(number()):
        names.append(raw.read(number())[:-1].decode())
        raw.read(4)
    while len(head := raw.read(4)) == 4:
        body = raw.read(struct.unpack("<i", head)[0])
        ref, pos, name_size, mapq, _, _, flag = struct.unpack_from("<iiBBHHH", body)
        yield body[32 : 31 + name_size].decode(), flag, names[ref] if ref >= 0 else "*", pos, mapq


def read_any_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines (value) of files whose kind is told by their first bytes: gz, bz2, zip or plain.

    Files whose names tell their kind are streamed by Spark. Misnamed files and zip archives, which
    must have one member, are read whole, by one task each and up to 2 GB.
    """
    ship(spark)
    plain, path = _by_names(spark, [path] if isinstance(path, str) else path)
    if plain:
        streamed = spark.read.text(plain)
        return streamed.unionByName(_whole_files(spark, path)) if path else streamed
    return _whole_files(spark, path)


def _by_names(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """The files of paths (files, patterns, folders of files) that Spark's reader of text takes for
    what their first bytes say, and the rest."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    told, rest = [], []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        found = list(fs.globStatus(at) or [])
        files = [f for s in found for f in (fs.listStatus(s.getPath()) if s.isDirectory() else [s]) if f.getPath().getName()[0] not in "_."]
        if not files or any(f.isDirectory() for f in files):
            rest.append(path)
            continue
        for f in files:
            stream = fs.open(f.getPath())
            try:
                first = bytes(max(stream.read(), 0) for _ in range(min(4, f.getLen())))
            finally:
                stream.close()
            ending = {b"\x1f\x8b": ".gz", b"BZ": ".bz2", b"PK": None}.get(first[:2], "")
            codec = codecs.getCodec(f.getPath())
            named = "" if codec is None else codec.getDefaultExtension()
            (told if named == ending else rest).append(f.getPath().toString())
    return told, rest


def _whole_files(spark: SparkSession, path: list[str]) -> DataFrame:
    """Lines of files that are opened by their first bytes."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                text = io.TextIOWrapper(opened(raw.as_py()), "utf-8")
                while some := text.readlines(1 << 22):
                    yield pa.RecordBatch.from_pydict({"value": [x.rstrip("\r\n") for x in some]})

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(lines, "value string")


def opened(raw: bytes) -> io.IOBase:
    """A binary stream over the bytes of a file of any of the four kinds."""
    if raw[:2] == b"\x1f\x8b":
        return gzip.GzipFile(fileobj=io.BytesIO(raw))
    if raw[:3] == b"BZh":
        return bz2.BZ2File(io.BytesIO(raw))
    if raw[:4] == b"PK\x03\x04":
        archive = zipfile.ZipFile(io.BytesIO(raw))
        if len(archive.namelist()) != 1:
            raise ValueError("a zip archive must have one member")
        return archive.open(archive.namelist()[0])
    return io.BytesIO(raw)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """name (up to the first white space), description and seq of each record, its file, and its
    ``place``, which orders records as they stand in their files."""
    records = spark.read.option("lineSep", ">").text(path).where("value != ''").withColumn("file", F.input_file_name())
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    seq = F.regexp_replace(F.regexp_replace("value", r"^[^\r\n]*", ""), r"\s+", "")
    # Where a record lies: its file, its part of the file, and its turn there.
    place = F.struct("file", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    return records.select(F.split(head, r"\s+")[0].alias("name"), head.alias("description"), seq.alias("seq"), "file", place.alias("place"))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """name, length, coverage. Joined to contigs by name, never by place."""
    return _tsv(spark, path, DEPTH, header=True, enforceSchema=True)


def read_contigs(spark: SparkSession, path: str, schema: str = CONTIGS) -> DataFrame:
    """A contig table of any stage (CONTIGS, PARTITION, FINAL). Padded ids stay text, - is null."""
    return _tsv(spark, path, schema, header=True)


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """src < dst and w; edges that are given twice are added up."""
    edges = _tsv(spark, path, NETWORK)
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker-gene reports, # lines skipped; further columns are dropped."""
    rows = _tsv(spark, path, MARKERS, comment="#")
    return rows.where("completeness is not null")


def read_bin_summary(spark: SparkSession, path: str) -> DataFrame:
    """A bin summary as ``sinks.write_bin_summary`` writes it."""
    return _tsv(spark, path, MARKERS + ", recursive boolean, step int, parent string, hic_abundance double, sg_abundance double", header=True)


def read_lineage_report(spark: SparkSession, results: str, taxonomy: str | None = None) -> DataFrame:
    """Fixed-width quality reports: bin, lineage, completeness, contamination, size, contigs, n50,
    longest_contig, gc, coding_density, taxonomy (- where a bin has none)."""
    places = {"lineage": 1, "completeness": 6, "contamination": 7, "size": 9, "contigs": 12, "n50": 14, "longest_contig": 18, "gc": 19, "coding_density": 21}
    kinds = {"lineage": "string", "size": "long", "contigs": "int", "n50": "long", "longest_contig": "long"}
    rows = _fixed(spark, results)
    token: Column = F.col("t")
    found = rows.select(token[0].alias("bin"), *[F.get(token, F.lit(p)).try_cast(kinds.get(n, "double")).alias(n) for n, p in places.items()])
    if taxonomy is None:
        return found.withColumn("taxonomy", F.lit("-"))
    names = _fixed(spark, taxonomy).select(token[0].alias("_b"), F.get(token, F.lit(3)).alias("taxonomy"))
    return found.join(names, F.col("bin") == F.col("_b"), "left").drop("_b").withColumn("taxonomy", F.coalesce("taxonomy", F.lit("-")))


def _fixed(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("startswith(value, ' ')").select(F.split(F.trim("value"), r"\s+").alias("t"))
    return lines.where("t[0] != 'Bin'")


def read_binning(spark: SparkSession, path: str) -> DataFrame:
    """contig and bin from two columns; what follows _split in a contig's name is dropped."""
    cols = F.split("value", r"\s+")
    return spark.read.text(path).where("trim(value) != ''").select(F.split(cols[0], "_split")[0].alias("contig"), cols[1].alias("bin"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """The first word of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("name")).where("name != ''")


def read_bin_folder(spark: SparkSession, folder: str, suffix: str = ".fa") -> DataFrame:
    """bin, name and seq from a folder of FASTA files named after their bins."""
    found = read_fasta(spark, f"{folder.rstrip('/')}/*{suffix}")
    return found.select(_stem(suffix).alias("bin"), "name", "seq", F.element_at(F.split("file", "/"), -1).alias("file_name"))


def _stem(suffix: str) -> Column:
    """A file's name without folder and suffix."""
    return F.regexp_extract("file", rf"([^/]*){re.escape(suffix)}$", 1)


def read_pairs_folder(spark: SparkSession, folder: str, suffix: str = ".pairs.gz") -> DataFrame:
    """The pairs of all files of a folder, with the name of each one's file as ``library``."""
    rows = read_pairs(spark, f"{folder.rstrip('/')}/*{suffix}").withColumn("file", F.input_file_name())
    return rows.withColumn("library", _stem(suffix)).drop("file")


def assembly(spark: SparkSession, fasta: str | list[str], depth: str | None = None, pattern: str | None = None) -> DataFrame:
    """The contigs of FASTA files: id (from 1, in the order of the files), name, size, gc, and with
    a depth table coverage, with a pattern rs.

    The depth table is joined by name; a contig without a row there has no coverage.
    """
    seqs = read_fasta(spark, fasta)
    own = seqs.select("place", "name", F.char_length("seq").cast("long").alias("size"), gc_content(F.col("seq")).alias("gc"), *([restriction_sites(F.upper("seq"), pattern).alias("rs")] if pattern else []))
    made = ordinals(own, ["place"], "id", 1).drop("place")
    if depth is not None:
        made = with_depth(made, read_depth(spark, depth))
    return made.select("id", *[c for c in ("name", "size", "gc", "coverage", "rs") if c in made.columns])


def with_depth(contigs: DataFrame, depth: DataFrame) -> DataFrame:
    """Adds coverage by the contig's name, never by the place in the table; null without a row."""
    return contigs.join(depth.select(F.col("name").alias("_d"), "coverage"), F.col("name") == F.col("_d"), "left").drop("_d")


def looks_like_fasta(spark: SparkSession, path: str) -> bool:
    """Whether the first line begins a FASTA record."""
    return kind_of(spark, path) == "fasta"


def kind_of(spark: SparkSession, path: str) -> str:
    """fasta, pairs, sam or table, by a file's first line; empty if it has none."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return "empty"
    line = first[0].value
    starts = {">": "fasta", "## pairs": "pairs", "@HD\t": "sam", "@SQ\t": "sam"}
    return next((kind for start, kind in starts.items() if line.startswith(start)), "table")


def element_table(contigs: DataFrame, elements: DataFrame, binning: DataFrame) -> DataFrame:
    """The contig table with ``mobile`` and ``bin`` (ND for none), from a list and a binning."""
    marked = contigs.join(elements.select(F.col("name").alias("_n")).distinct().withColumn("mobile", F.lit(True)), F.col("Name") == F.col("_n"), "left").drop("_n")
    placed = marked.join(binning.select(F.col("contig").alias("_c"), "bin"), F.col("Name") == F.col("_c"), "left").drop("_c")
    return placed.withColumn("mobile", F.coalesce("mobile", F.lit(False))).withColumn("bin", F.coalesce("bin", F.lit("ND")))
