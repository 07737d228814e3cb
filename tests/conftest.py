import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


KPI_ROWS = [
    ("2025-01", "南宁", 1000.0, 1200.0, 100.0, 0.90),
    ("2025-01", "柳州", 800.0, 1000.0, 80.0, 0.85),
    ("2025-02", "南宁", 1100.0, 1200.0, 110.0, 0.92),
    ("2025-02", "柳州", 900.0, 1000.0, 85.0, 0.88),
    ("2025-03", "南宁", 1200.0, 1200.0, 105.0, 0.91),
    ("2025-03", "柳州", 950.0, 1000.0, 88.0, 0.87),
    ("2025-04", "南宁", 1300.0, 1200.0, 108.0, 0.93),
    ("2025-04", "柳州", 980.0, 1000.0, 90.0, 0.89),
]
KPI_SCHEMA = (
    "`月份` string, `地市` string, `业务收入` double, `目标收入` double, "
    "`用户数` double, `满意度` double, seq int"
)


@pytest.fixture(scope="session")
def kpi(spark):
    rows = [(*r, i) for i, r in enumerate(KPI_ROWS)]
    return spark.createDataFrame(rows, KPI_SCHEMA).cache()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def mapped(df, key, value):
    return {r[key]: r[value] for r in df.collect()}
