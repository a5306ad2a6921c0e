import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no stack is looked up for each column
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-test-"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="spark-wh-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def same(spark, sf_dir):
    """Compares a registered query with its SQL, rows in any order."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v if v is None else str(v)

    def check(name):
        df = entry.queries()[name](spark, sf_dir)
        got = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
        rel = con.sql(entry.oracle_sql()[name])
        cols = rel.columns
        assert sorted(cols) == sorted(df.columns)
        want = sorted(str([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in rel.fetchall())
        assert got == want

    return check
