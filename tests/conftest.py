import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    made = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(base / "shared")).config("spark.sql.warehouse.dir", str(base / "warehouse")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture
def log(spark):
    """Rows (key, ts_ns, value or None for a tombstone[, seq]) as a log."""

    def make(*rows):
        full = [(r[0], r[1], r[2] is None, None if r[2] is None else r[2].encode(), r[3] if len(r) > 3 else n) for n, r in enumerate(rows)]
        return spark.createDataFrame(full, "key string, ts_ns long, tombstone boolean, value binary, seq long")

    return make
