import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")  # for the Python workers
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    folder = tempfile.mkdtemp(prefix="spark-")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.local.dir", folder)
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip(f"no tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def same():
    """Holds a query's rows against those of its SQL, whatever their order."""
    import math

    import duckdb

    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6)
        if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
            return tuple(map(plain, v))
        if type(v).__name__ == "Decimal":
            return round(float(v), 6)
        return v

    def check(df, sql, sf_dir, tables=None):
        con = duckdb.connect()
        for name in sorted(os.listdir(sf_dir)):
            t = name.removesuffix(".parquet")
            path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
        columns = sorted(df.columns)
        got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(names) == columns
        wanted = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
        assert got == wanted

    return check
