"""Calendars made by many tasks, and their gaps filled in one pass."""

import contextlib
import datetime as dt
import io
import random

from pyspark.sql import functions as F

from siteflux.operators.joins import calendar_spine
from siteflux.operators.series import fill_gaps
from siteflux.plans.inputs import prepare_climate


def _plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_days_of_one_table_of_sites_are_made_by_many_tasks(spark):
    sites = spark.createDataFrame([(i, 2001, 2003) for i in range(40)], "sitename LONG, year_start INT, year_end INT").coalesce(1)
    days = calendar_spine(sites)
    parts = days.groupBy(F.spark_partition_id()).count().count()
    assert parts > 1 and days.count() == 40 * 1095 == days.distinct().count()


def test_bounded_gaps_are_filled_like_others(spark):
    rng = random.Random(3)
    rows = []
    for site in [None, *range(9)]:
        for i in range(rng.choice([1, 2, 40, 700])):
            a, b = (None if site == 4 or rng.random() < 0.7 else rng.random() for _ in range(2))
            row = (site, dt.date(2001, 1, 1) + dt.timedelta(days=i), a, b, None if i % 3 else 2.0)
            rows += [row] * (1 if site is None or site % 2 else 2)  # a site may be listed twice
    df = spark.createDataFrame(rows, "sitename LONG, date DATE, a DOUBLE, b DOUBLE, rain DOUBLE")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    plain = fill_gaps(df, ["a", "b"], zero=["rain"])
    try:
        for size in (7, 10_000):  # groups of many batches, batches of many groups
            spark.conf.set(key, size)
            bounded = fill_gaps(df, ["a", "b"], zero=["rain"], bounded=True)
            assert bounded.schema.names == plain.schema.names
            values = [sorted(map(tuple, t.collect()), key=str) for t in (bounded, plain)]
            assert values[0] == values[1]
    finally:
        spark.conf.set(key, before)
    assert fill_gaps(df.limit(0), ["a"], bounded=True).count() == 0


def test_climate_is_filled_without_dealing_the_filled_days_again(spark):
    sites = spark.createDataFrame([(1, 2001, 2002), (None, 2001, 2001)], "sitename LONG, year_start INT, year_end INT")
    day = dt.date(2001, 1, 3)
    tower = spark.createDataFrame([(1, day, 1.0), (1, day + dt.timedelta(days=2), 3.0)], "sitename LONG, date DATE, temp DOUBLE")
    out = prepare_climate(sites, {"tower": tower})
    rows = {(r.sitename, r.date): r for r in out.collect()}
    assert len(rows) == 730 + 365
    assert [rows[1, dt.date(2001, 1, d)].temp for d in (1, 3, 4, 5, 6)] == [1.0, 1.0, 2.0, 3.0, 3.0]
    assert rows[None, day].temp is None and rows[None, day].prec == 0.0
    assert rows[1, dt.date(2002, 1, 1)].year_dec == 2002.0
    assert "Window" not in _plan(out)
