import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def crashes(spark):
    def build(lats, lons, deaths=None):
        deaths = deaths if deaths is not None else [0] * len(lats)
        rows = [(i, float(a), float(b), int(d)) for i, (a, b, d) in enumerate(zip(lats, lons, deaths))]
        return spark.createDataFrame(rows, "Crash_ID long, Latitude double, Longitude double, Death_Cnt int")
    return build

