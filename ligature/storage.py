"""Shared storage for intermediate tables and shipping of this package to executors.

Iterative plans and tables that are read more than once are cut by writing them as Parquet
below the folder that the cluster names in ``spark.checkpoint.dir``: the copy is replicated by
that file system, so a lost executor costs a re-read and never a wrong or failed result.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

_folders: dict[str, str] = {}
_scopes: list[list[DataFrame]] = []
_shipped: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``, removed when the driver ends.

    Where the setting is missing, a local master gets a temporary folder; a cluster is refused,
    because executors there do not see the driver's disk.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="ligature-")
        _folders[app] = f"{root.rstrip('/')}/ligature-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, _folders[app])
    return _folders[app]


def _remove(folder: str) -> None:
    sc = SparkContext._active_spark_context
    try:
        if sc is not None and sc._jsc is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone at exit; nothing is left to clean with
        pass


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._ligature_path = path
    if _scopes:
        _scopes[-1].append(made)
    return made


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are materialised inside, at the end.

    Gives a function ``keep``: a table that was passed to it outlives the scope. What is returned
    from inside must be a kept table, as plans over deleted ones fail.
    """
    own: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        own[:] = [x for x in own if x is not table]
        if len(_scopes) > 1:
            _scopes[-2].append(table)
        return table

    _scopes.append(own)
    try:
        yield keep
    finally:
        _scopes.pop()
        release(*own)


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan will read any more."""
    for t in tables:
        _remove(t._ligature_path)
        for scope in _scopes:
            scope[:] = [x for x in scope if x is not t]


def small_side(df: DataFrame, max_rows: int = 1_000_000, max_elements: int = 1_000_000) -> DataFrame:
    """Hint a broadcast only when a count proves that the side is small; else Spark shuffles it.

    ``df`` should be cheap to count (a materialised table). Rows are counted, and where columns
    are arrays their elements as well, so the bounds keep the broadcast in the tens of megabytes.
    """
    arrays = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    if not arrays:
        return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
    sized = df.limit(max_rows + 1).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).alias(f"e{i}") for i, c in enumerate(arrays)]).first()
    return F.broadcast(df) if sized.n <= max_rows and sum(sized[1:]) <= max_elements else df


def measured_side(df: DataFrame) -> DataFrame:
    """``small_side``, but a side that isn't small is never broadcast, even if its files look small:
    what compresses well takes many times their size in memory."""
    side = small_side(df)
    return side if side is not df else df.hint("merge")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ligature-"), f"{top.name}.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
