"""Token-id output: documents' ids as Elias-Fano shards in ascending document id order.

One range shuffle puts the texts in order; each task encodes its range and closes a shard every
``shard_tokens`` ids. Shards are cells of a Parquet table, so they are committed atomically to
any file system that Spark writes, a lost task is simply run again, and no worker needs a mount.
A shard is self-contained (``elias_fano.Shard``) and ``export_shards`` writes them as files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder, ship
from .elias_fano import Shard, write_shard
from .tokens import Facts, memo

#: Ids in a shard; a longer document has a shard of its own.
SHARD_TOKENS = 1 << 20
_SHARDS = "part int, seq int, before long, n_docs long, n_tokens long, shard binary"
_INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _width(tokenizer: str, end_id: int, width: int | None) -> int:
    from tokenizers import Tokenizer

    last = max([end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values()])
    need = 2 if last < 1 << 16 else 4
    if width is not None and (width not in (2, 4) or width < need):
        raise ValueError(f"ids up to {last} need {need} bytes, not {width}")
    return width or need


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int | None = None, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write the shards to ``path``.

    ``width`` is the bytes of an id, 2 or 4; by default what the vocabulary and the end id need,
    and a smaller one is refused. Null texts are empty and have
    the end id alone; null ids come first; rows that share an id keep a row each, ordered by
    their texts; an empty table gives an empty store. Other columns are not read.
    """
    ship(docs.sparkSession)
    width, facts = _width(tokenizer, end_id, width), Facts.of(tokenizer)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = memo(tokenizer, facts=facts), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int | None] = []
        parts: list[bytes] = []
        seq = before = held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, before, held, ids, parts
            lengths = np.array([len(b) // 4 for b in parts], np.int64)
            shard = write_shard(ids, lengths, np.frombuffer(b"".join(parts), "<u4"), width)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "before": [before], "n_docs": [len(ids)], "n_tokens": [held], "shard": [shard]})
            seq, before, held, ids, parts = seq + 1, before + held, 0, [], []
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                for d, b in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                    if ids and held + len(b) // 4 + 1 > shard_tokens:
                        yield close()
                    ids.append(d)
                    parts.append(b + end)
                    held += len(b) // 4 + 1
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(encode, _SHARDS).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the shards: doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it. It needs one number for each task that
    wrote the store; these are summed up on the driver, and the shards themselves do not move.
    """
    ship(spark)
    shards = spark.read.schema(_SHARDS).parquet(path)
    totals = {r.part: r.total for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("total")).collect()}  # a row per task
    bases = dict(zip(sorted(totals), np.cumsum([0, *(totals[p] for p in sorted(totals))]).tolist(), strict=False))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard(batch.column(2)[i].as_py())
                base = bases[batch.column(0)[i].as_py()] + batch.column(1)[i].as_py()
                ends = shard.ends.decode()
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                wide = shard.data.astype("<u4")
                crcs = [zlib.crc32(wide[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(shard.doc_ids(), pa.int64()), "start": starts + base, "n_tokens": ends - starts, "ids_crc32": pa.array(crcs, pa.int64())})

    return shards.select("part", "before", "shard").mapInArrow(index, _INDEX)


def export_shards(spark: SparkSession, path: str, uri: str) -> DataFrame:
    """Write each shard of a store as the file ``<part>-<seq>.lts`` below ``uri``.

    ``uri`` names a folder that every executor reaches through pyarrow's file systems. Returns
    the files' names and sizes; the files are written when the result is read.
    """
    ship(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(uri)
        where.create_dir(folder, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{row['part']:06d}-{row['seq']:06d}.lts"
                trial = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with where.open_output_stream(trial) as f:
                    f.write(row["shard"])
                where.move(trial, f"{folder}/{name}")
                yield pa.RecordBatch.from_pydict({"file": [name], "n_bytes": [len(row["shard"])]})

    return spark.read.schema(_SHARDS).parquet(path).select("part", "seq", "shard").mapInArrow(write, "file string, n_bytes long")


def token_store(docs: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write the store below the shared folder and return its index, read from the files."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex[:8]}"
    write_store(docs, path, tokenizer, end_id, **options)
    return read_store(spark, path)
