import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("siteflux-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build a daily frame: ``series({"a": [1.0, None]}, "v")`` starts on 2001-01-01."""

    def build(data, *names, start=dt.date(2001, 1, 1)):
        rows = []
        for site, values in data.items():
            for i, value in enumerate(values):
                value = value if isinstance(value, tuple) else (value,)
                rows.append((site, start + dt.timedelta(days=i), *value))
        schema = "sitename STRING, date DATE, " + ", ".join(f"{n} DOUBLE" for n in names)
        return spark.createDataFrame(rows, schema)

    return build


def column(df, name, order=("sitename", "date")):
    return [r[name] for r in df.orderBy(*order).select(name).collect()]
