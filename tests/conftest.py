import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def at():
    """Time of a number of seconds after 2021-01-05."""
    return lambda s: dt.datetime(2021, 1, 5) + dt.timedelta(seconds=s)


READINGS = "reading_id long, endpoint_name string, timestamp timestamp_ntz, value_raw double, value_cal double, memo string, arrived timestamp_ntz"


@pytest.fixture
def readings(spark, at):
    """Readings from (id, endpoint, seconds, value[, memo])."""

    def make(rows):
        full = [(r[0], r[1], None if r[2] is None else at(r[2]), r[3], None, r[4] if len(r) > 4 else None, None) for r in rows]
        return spark.createDataFrame(full, READINGS)

    return make


SOURCE = "/root/testdata/sf0.001"


@pytest.fixture(params=["empty", "nulls"], scope="session")
def odd_tables(request, spark, tmp_path_factory):
    """(kind, folder) of the test tables, empty, or with NULLs in every column, repeated rows and an extra column."""
    from pyspark.sql import functions as F

    if not os.path.isdir(SOURCE):
        pytest.skip("no test data")
    folder = tmp_path_factory.mktemp(request.param)
    for p in os.listdir(SOURCE):
        df = spark.read.parquet(f"{SOURCE}/{p}")
        out = df.limit(0)
        if request.param == "nulls":
            base = df.limit(10)
            out = base.union(base).union(df.limit(2).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema)))
            for f in df.schema:
                out = out.union(df.limit(1).withColumn(f.name, F.lit(None).cast(f.dataType)))
            out = out.withColumn("unit_x", F.lit(1))
        out.coalesce(1).write.parquet(f"{folder}/{p}")
    return request.param, str(folder)


_ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
readings = spark.range(200).select(F.col("id").alias("reading_id"), F.lit("a").alias("endpoint_name"), F.expr("timestamp_ntz '2021-01-05' + make_dt_interval(0, 0, 0, id)").alias("timestamp"), (F.col("id") % 7 * 1.0).alias("value_raw"))
"""


@pytest.fixture
def elsewhere(tmp_path):
    """Runs code in a Python process of its own whose working folder isn't the repository, with ``spark`` and ``readings``."""
    import subprocess

    def run(code):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", _ELSEWHERE.format(root=root) + code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-3000:]

    return run
