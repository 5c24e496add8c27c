"""Arrow kernels that give one row per document, with the document's own row carried on request."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import ship

#: Rows that a kernel gets at once; bounds its working memory.
SLICE_ROWS = 1024

#: From texts to the output columns.
Kernel = Callable[[pa.Array], list[pa.Array]]


def column(name: str) -> Column:
    """A column by its name as it stands, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_row(docs: DataFrame) -> Column:
    """The row as a struct."""
    return F.struct(*[column(c) for c in docs.columns])


def trim() -> None:
    """Give freed memory back to the system; workers live on for the next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: Rows that go to a Python worker at once, at most, where an operator or pipeline says so. Whole
#: documents in larger batches cost an executor more memory, on either side, than they save time.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Lowers the session's batch size for the actions inside, where it is higher or unlimited."""
    before = spark.conf.get(_BATCH)
    if not 0 < int(before) <= rows:
        spark.conf.set(_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def per_document(docs: DataFrame, make: Callable[[], Kernel], columns: str, id_col: str, text_col: str, carry: bool = False, slice_rows: int | None = SLICE_ROWS) -> DataFrame:
    """``doc_id`` and the kernel's columns; with ``carry`` also ``row``, the input row as a struct.

    Only the id and the text are read unless rows are carried, so other columns and their names
    do not matter. ``make`` runs once per task; a kernel gets ``slice_rows`` texts at once, or
    with None a whole batch.
    """
    ship(docs.sparkSession)
    made = T._parse_datatype_string(columns) if isinstance(columns, str) else columns
    id_at, text_at = (docs.columns.index(c) for c in (id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            step = slice_rows or max(batch.num_rows, 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row = part.column(0) if carry else None
                ids, texts = (pc.struct_field(row, id_at), pc.struct_field(row, text_at)) if carry else (part.column(0), part.column(1))
                arrays = [ids.cast(pa.int64()), *kernel(texts)] + ([row] if carry else [])
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *made.names] + ["row"] * carry)
        trim()

    schema = T.StructType([T.StructField("doc_id", T.LongType()), *made.fields])
    if carry:
        rows = docs.select(whole_row(docs).alias("row"))
        schema.add(T.StructField("row", docs.schema))
    else:
        rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id's decimal text modulo 4; fold 2 is held out of learning."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % 4


def held_out(id_col: str | Column) -> Column:
    """Whether a row is held out; a null id isn't, and isn't learned from either."""
    return F.coalesce(fold(id_col) == 2, F.lit(False))
