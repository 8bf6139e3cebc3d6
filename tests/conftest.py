import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp"))
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-local-", dir="/tmp"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frames(spark):
    """Make frames from (token, time, f0[, speaker, tone, intensity]) rows."""

    def make(rows):
        full = [(*r, *("S", "T", None)[len(r) - 3 :]) for r in rows]
        return spark.createDataFrame(full, "token string, time double, f0 double, speaker string, tone string, intensity double")

    return make
