import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def one(spark):
    """one(f, *values): what a Column function gives for one row of strings."""
    from pyspark.sql import functions as F

    def run(f, *values):
        names = [f"c{k}" for k in range(len(values))]
        df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
        return df.select(f(*(F.col(n) for n in names)).alias("x")).first()["x"]

    return run
