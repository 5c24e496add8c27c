"""Writers of pairs, tables, networks, matrices and sequences.

Parquet is the working format: pairs are stored in ranges of (c1, c2) and sorted inside them, so
that region queries skip most row groups. Text is for export and may be one file.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.sequences import natural_key
from ..operators.consensus import ordinals
from ..storage import _remove, materialize, scratch, shared_folder

ORDER = ["c1", "c2", "pos1", "pos2", "strand1"]


def store_pairs(pairs: DataFrame, path: str, force: bool = False) -> None:
    """Sorted by ORDER. An existing store is an error, or replaced with ``force``."""
    pairs.repartitionByRange("c1", "c2").sortWithinPartitions(*ORDER).write.mode("overwrite" if force else "errorifexists").parquet(path)


def stored_pairs(spark: SparkSession, path: str, build=None, force: bool = False) -> DataFrame:
    """The store at ``path``; built from ``build()`` where there is none, or with ``force``."""
    if not force:
        try:
            return spark.read.parquet(path)
        except AnalysisException:
            if build is None:
                raise
    store_pairs(build(), path, True)
    return spark.read.parquet(path)


def region(pairs: DataFrame, c1: str, start1: int, end1: int, c2: str, start2: int, end2: int) -> DataFrame:
    """Pairs in a rectangle, ends included. The conditions reach the Parquet scan."""
    return pairs.where((F.col("c1") == c1) & F.col("pos1").between(start1, end1) & (F.col("c2") == c2) & F.col("pos2").between(start2, end2))


def export_pairs(pairs: DataFrame, contigs: DataFrame, path: str, single: bool = True) -> None:
    """Text with its header: contigs with their sizes, then pairs in natural order.

    One file, or with ``single`` false the header below ``path/head`` and the pairs
    below ``path/body``, in sorted ranges by as many tasks; the files read one after the other
    are the same text.
    """
    spark = pairs.sparkSession
    line = F.concat_ws("\t", "read_id", "c1", "pos1", "c2", "pos2", "strand1", "strand2").alias("value")
    body = pairs.select(line, F.struct(natural_key(F.col("c1").cast("string")), natural_key(F.col("c2").cast("string")), "pos1", "pos2", "strand1").alias("place"))
    one = lambda text: spark.createDataFrame([(text,)], "value string").coalesce(1)
    sizes = contigs.select(F.concat(F.lit("#chromsize: "), "name", F.lit(" "), "size").alias("value"), F.col("id").alias("place"))
    head = [one("## pairs format v1.0\n#sorted: chr1-chr2-pos1-pos2\n#shape: upper triangle"), _ranges(sizes), one("#columns: readID chr1 pos1 chr2 pos2 strand1 strand2")]
    if single:
        return _one_file([*head, _ranges(body)], path)
    _one_file(head, f"{path.rstrip('/')}/head")
    _ranges(body).write.text(f"{path.rstrip('/')}/body")


#: Rows of a sorted range, about.
RANGE_ROWS = 2_000_000


def _ranges(rows: DataFrame) -> DataFrame:
    """The values of rows (value, place) in sorted ranges, as many as their number needs."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // RANGE_ROWS))
    return rows.repartitionByRange(tasks, "place").sortWithinPartitions("place").select("value")


def _one_file(pieces: list[DataFrame], path: str, **options: str) -> None:
    """Pieces of text (value), each in the order of its partitions, as one file below ``path``.

    Tasks write parts to the shared folder; their bytes are then joined, which holds none of them.
    With a compression of members that may follow one another (gzip, bzip2) the parts are packed.
    """
    spark = pieces[0].sparkSession
    folder = f"{shared_folder(spark)}/parts-{uuid.uuid4().hex[:8]}"
    try:
        for k, piece in enumerate(pieces):
            piece.write.options(**options).text(f"{folder}/{k}")
        _join_files(spark, [f"{folder}/{k}" for k in range(len(pieces))], path)
    finally:
        _remove(folder)


def _join_files(spark: SparkSession, folders: list[str], path: str) -> None:
    """The part files of folders, in the order of folders and names, as the only file below ``path``."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    target = at(path)
    fs = target.getFileSystem(conf)
    if fs.exists(target):
        raise FileExistsError(f"{path} already exists")
    out, ending = fs.create(at(f"{path.rstrip('/')}/_joining"), False), ""
    try:
        for folder in folders:
            source = at(folder).getFileSystem(conf)
            for name in sorted(s.getPath().getName() for s in source.listStatus(at(folder)) if s.getPath().getName().startswith("part-")):
                ending = name[name.index(".") :]
                part = source.open(at(f"{folder}/{name}"))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
                finally:
                    part.close()
    finally:
        out.close()
    if not fs.rename(at(f"{path.rstrip('/')}/_joining"), at(f"{path.rstrip('/')}/part-00000{ending or '.txt'}")):
        raise OSError(f"cannot name the file below {path}")
    fs.create(at(f"{path.rstrip('/')}/_SUCCESS"), True).close()


def pack_text(spark: SparkSession, text: str, path: str) -> None:
    """A text file as one gzip file, whose members many tasks pack."""
    _one_file([spark.read.text(text)], path, compression="gzip")


def write_table(df: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """Tab-separated; null is -."""
    (df.coalesce(1) if single else df).write.csv(path, sep="\t", header=header, nullValue="-")


def write_final_table(contigs: DataFrame, path: str) -> None:
    """The final contig table, with the row's number from 0 as a first column ``index``."""
    numbered = ordinals(contigs, ["ID"], "index")
    write_table(numbered.select("index", *contigs.columns), path)


def write_hits(by_sample: DataFrame, names: DataFrame, path: str) -> bool:
    """id, name and a column per sample without a header, if there is more than one sample."""
    hits = [c for c in by_sample.columns if c.startswith("hit_")]
    if len(hits) < 2:
        return False
    write_table(names.select(F.col("id"), "name").join(by_sample.withColumnRenamed("id", "_i"), F.col("id") == F.col("_i")).select("id", "name", *hits), path, header=False)
    return True


def write_network(edges: DataFrame, path: str) -> None:
    """src, dst, w without a header; a folder per sample if there are samples."""
    out = edges.select(*[c for c in ("sample", "src", "dst", "w") if c in edges.columns]).write.option("sep", "\t")
    (out.partitionBy("sample") if "sample" in edges.columns else out).csv(path)


def write_bin_sequences(members: DataFrame, seqs: DataFrame, path: str) -> None:
    """A folder of FASTA for each bin of (bin, name)."""
    own = members.select("bin", F.col("name").alias("_n")).join(seqs.select("name", "seq"), F.col("_n") == F.col("name"))
    _by_bin(own.select("bin", F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value")), path)


def _by_bin(rows: DataFrame, path: str) -> None:
    """A folder for each bin with one file."""
    rows.repartition("bin").write.partitionBy("bin").text(path)


def joined_sequences(members: DataFrame, seqs: DataFrame, spacer: int = 200) -> DataFrame:
    """bin and seq: a bin's contigs (bin, id, name) in id order, ``spacer`` N between them."""
    own = members.select("bin", "id", F.col("name").alias("_n")).join(seqs.select("name", "seq"), F.col("_n") == F.col("name"))
    return own.groupBy("bin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "seq"))), lambda x: x.seq), "N" * spacer).alias("seq"))


def write_bin_summary(summary: DataFrame, path: str) -> None:
    """Abundances with four decimals, other fractions with two."""
    cols = []
    for f in summary.schema.fields:
        c = F.col(f.name)
        if f.dataType.typeName() == "double":
            c = F.format_string("%.4f" if f.name.endswith("abundance") else "%.2f", c)
        cols.append(F.when(F.col(f.name).isNotNull(), c).alias(f.name))
    write_table(summary.select(*cols), path, single=True)


def write_element_summary(summary: DataFrame, path: str) -> None:
    """Fractions with two decimals; null is NA."""
    cols = [F.when(F.col(f.name).isNotNull(), F.format_string("%.2f", f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in summary.schema.fields if f.name != "tmp"]
    summary.select(*cols).coalesce(1).write.csv(path, sep="\t", header=True, nullValue="NA")


def write_matrix(matrix: DataFrame, path: str, n: int) -> None:
    """Text: rows, columns and entries, then i, j, value with three decimals."""
    with scratch():
        made = materialize(matrix, "matrix")
        size = made.agg(F.format_string(f"{n}\t{n}\t%d", F.count("*")).alias("value")).coalesce(1)
        body = made.select(F.format_string("%d\t%d\t%1.3f", "i", "j", "value").alias("value"), F.struct("i", "j").alias("place"))
        _one_file([size, _ranges(body)], path)


def map_as_bedgraph(counts: DataFrame, bins: DataFrame) -> DataFrame:
    """Seven columns: contig, start, end of both map bins, and n. ``bins``: bin, name, start, end."""
    out = counts
    for k in ("1", "2"):
        out = out.join(bins.select(F.col("bin").alias(f"_b{k}"), F.col("name").alias(f"name{k}"), F.col("start").alias(f"start{k}"), F.col("end").alias(f"end{k}")), F.col(f"f{k}") == F.col(f"_b{k}"))
    return out.select("name1", "start1", "end1", "name2", "start2", "end2", "n")


def map_as_fragments(counts: DataFrame, bins: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two tables of a fragment-based map: fragments (id, chrom, start_pos, end_pos, size, from 1
    in each contig, with the place in the map before them) and entries (row, col, n)."""
    nth = F.row_number().over(Window.partitionBy("name").orderBy("start"))
    fragments = bins.select(F.col("bin").alias("place"), nth.alias("id"), F.col("name").alias("chrom"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), (F.col("end") - F.col("start")).alias("size"))
    return fragments, counts.select(F.col("f1").alias("row"), F.col("f2").alias("col"), "n")


def write_scaffold_report(table: DataFrame, path: str) -> None:
    """Per scaffold a line with its form and length, then contig, start, end and strand."""
    line = F.concat_ws("\t", "name", "start", "end", "strand")
    rows = table.groupBy("bin", "scaffold").agg(F.max("circular").alias("circular"), F.sum("end").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x.line), "\n").alias("lines"))
    head = F.concat(F.lit(">"), "scaffold", F.when(F.col("circular"), " circular").otherwise(" linear"), F.lit(" length: "), F.col("length").cast("string"), F.lit("\n"))
    _by_bin(rows.select("bin", F.concat(head, "lines").alias("value")), path)


def write_hosts(found: DataFrame, path: str) -> None:
    """Signals with six decimals, shares with two."""
    write_table(found.select("mge", "mag", F.format_string("%.6f", "signal").alias("signal"), F.format_string("%.2f", "percent").alias("percent"), "contigs"), path, single=True)
