import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[" + os.environ.get("TEST_CPUS", "4") + "]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        name = f.removesuffix(".parquet")
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def rows(df):
    """Rows as comparable tuples, columns by name."""
    cols = sorted(df.columns)

    def plain(v):
        return round(float(v), 5) if isinstance(v, float) else bool(v) if type(v).__name__ == "bool_" else v

    def order(t):
        return [(v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in t]

    got = df.collect() if hasattr(df, "rdd") else [dict(zip(df.columns, r, strict=True)) for r in df.fetchall()]
    return sorted((tuple(plain(r[c]) for c in cols) for r in got), key=order)
