import random

from conftest import column
from pyspark.sql import functions as F

from siteflux.operators.series import fill_gaps, interpolate_at_x, interpolate_linear


def _line(values, edges):
    """Plain loops: linear by row number, with the nearest known value at the edges if ``edges``."""
    known = [i for i, v in enumerate(values) if v is not None]
    out = []
    for i, v in enumerate(values):
        before, after = max((k for k in known if k <= i), default=None), min((k for k in known if k >= i), default=None)
        if v is None and None not in (before, after):
            v = values[before] + (values[after] - values[before]) * (i - before) / (after - before)
        elif v is None and edges and known:
            v = values[before if after is None else after]
        out.append(v)
    return out


def test_gaps_over_many_batches_and_ranges_are_filled_in_one_pass(spark, series):
    rng = random.Random(3)
    sites = {f"s{i}": [rng.random() if rng.random() < 0.2 else None for _ in range(rng.choice([1, 2, 40, 150]))] for i in range(12)}
    sites["s3"] = [None] * 30
    df = series(sites, "v").withColumn("sitename", F.when(F.col("sitename") != "s5", F.col("sitename"))).repartition(5)
    sites = {None if k == "s5" else k: v for k, v in sites.items()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in (3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            for edges in (False, True):
                found = fill_gaps(df, ["v"]) if edges else interpolate_linear(df, ["v"], ["sitename"], block=F.year("date"))
                got = {}
                for r in found.orderBy("sitename", "date").collect():
                    got.setdefault(r.sitename, []).append(None if r.v is None else round(r.v, 9))
                assert got == {k: [None if x is None else round(x, 9) for x in _line(v, edges)] for k, v in sites.items()}
                # the rows are neither windowed nor dealt again after they were written
                plan = found._jdf.queryExecution().optimizedPlan().toString()
                assert "Window" not in plan and "Repartition" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_edges_by_position_need_the_number_of_rows_over_all_batches(spark, series):
    df = series({"a": [None, 2.0, None, 4.0, None], "b": [None, None, 1.0]}, "v")
    df = df.withColumn("year_dec", F.dayofyear("date").cast("double"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
        assert column(interpolate_at_x(df, ["v"]), "v") == [2.0, 2.0, 3.0, 4.0, 4.0, None, None, 1.0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
