"""Forcing by year, and exact rounding of wide tables."""

import contextlib
import datetime as dt
import io
import random
import re

from pyspark.sql import functions as F

from checks.base import rounded
from siteflux.plans.lightuse import light_use_forcing, score_light_use


def _plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_days_are_not_dealt_by_year(spark):
    daily = spark.createDataFrame([(1, dt.date(2001, 1, 1)), (1, dt.date(2002, 1, 1)), (1, None)], "sitename LONG, date DATE")
    sites = spark.createDataFrame([(1, 10.0)], "sitename LONG, elv DOUBLE")
    co2 = spark.createDataFrame([(2001, 370.0)], "year INT, co2 DOUBLE")
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, -1)
        out = light_use_forcing(daily, sites, co2)
        assert "hashpartitioning(year" not in _plan(out)
        assert sorted((r.year or 0, r.co2) for r in out.collect()) == [(0, None), (2001, 370.0), (2002, None)]
    finally:
        spark.conf.set(key, before)


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(5)
    values = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf"), 1e300, 5e-324, -1e-9, 5e-7, -5e-7, 0.1234565, 2.5e-6, 123456789.1234565]
    values += [rng.uniform(-1, 1) * 10 ** rng.uniform(-10, 14) for _ in range(3000)]
    values += [(rng.randrange(-(10**9), 10**9) + 0.5 + rng.choice([0, 1e-3, -1e-3, 1e-9])) / 1e6 for _ in range(3000)]
    df = spark.createDataFrame([(i, v, str(i)) for i, v in enumerate(values)], "`a.id` LONG, `v w` DOUBLE, t STRING")
    mine = {r[0]: repr(r[1]) for r in rounded(df).collect()}
    assert mine == {r[0]: repr(r[1]) for r in df.select("`a.id`", F.round("v w", 6)).collect()}
    assert rounded(df).dtypes == df.dtypes


def test_generated_methods_of_rounded_scores_are_compiled(spark):
    """The JVM compiles methods of up to 8,000 bytes; a longer one is interpreted."""
    columns = "sitename LONG, date DATE, temp DOUBLE, fapar DOUBLE, ppfd DOUBLE, vpd DOUBLE, co2 DOUBLE, elv DOUBLE, alpha DOUBLE"
    scored = score_light_use(spark.createDataFrame([], columns), "full", cpalpha="alpha")
    names = "ca gstar kmm ns_star chi m mprime lue gpp ci gs vcmax vcmax_unitiabs factor25_vcmax vcmax25 rd rd_unitfapar actnv transp".split()
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", _plan(rounded(scored.select("sitename", "date", *names)), "codegen"))
    assert sizes and max(map(int, sizes)) <= 8000
