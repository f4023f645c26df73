import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows_of(frame):
    """Rows as strings, sorted, with columns by name and floats rounded."""
    frame = frame[sorted(frame.columns)]
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame = frame.assign(**{c: frame[c].round(6) + 0.0})  # no negative zero
    return sorted(tuple(map(str, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def compare(ours, theirs):
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows_of(ours) == rows_of(theirs)

    return compare


@pytest.fixture(scope="session")
def run_elsewhere():
    def run(name, folder):
        """Runs a registered query to its last row in a session of its own, whose Python workers don't have this repository on their path."""
        import subprocess

        script = f"""
import os, sys
sys.path.insert(0, {ROOT!r})
os.environ.pop("PYTHONPATH", None)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(folder)!r}).getOrCreate()
def found(_):
    import importlib.util
    return [importlib.util.find_spec("locusloom") is not None]
assert spark.sparkContext.parallelize([0], 1).mapPartitions(found).collect() == [False]
import __spark_entry__
__spark_entry__.queries()[{name!r}](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
"""
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", script], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]

    return run
