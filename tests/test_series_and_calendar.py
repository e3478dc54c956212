import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import column
from siteflux.functions import atmosphere as P
from siteflux.functions import calendar as T
from siteflux.operators import downscale as X
from siteflux.operators import series as W
from siteflux.operators.balance import bounded_running_balance
from siteflux.operators.scan import ordered_ranges
from siteflux.operators.joins import align_model_obs, calendar_spine, on_calendar

D = dt.date


def dates(spark, values, expr):
    df = spark.createDataFrame([(v,) for v in values], "d DATE" if isinstance(values[0], D) else "d INT").coalesce(1)
    return [r[0] for r in df.select(expr(F.col("d"))).collect()]


def test_weeks_restart_on_new_year(spark):
    assert dates(spark, [D(2001, 1, 1), D(2001, 1, 7), D(2001, 1, 8), D(2004, 12, 31)], T.week_of_year) == [1, 1, 2, 53]


@pytest.mark.parametrize("k", [5, 7, 8])
def test_xday_bins_at_year_end(spark, k):
    days = [D(y, 1, 1) + dt.timedelta(days=i - 1) for y in (2003, 2004) for i in (1, k, k + 1, 360, 361, 364, 365)] + [D(2004, 12, 31)]
    got = dates(spark, days, lambda d: T.xday_bin(d, k))
    last = math.ceil(365 / k) - 1
    for day, start in zip(days, got):
        doy = day.timetuple().tm_yday
        assert start == D(day.year, 1, 1) + dt.timedelta(days=min((doy - 1) // k, last) * k)
        assert start.year == day.year and start <= day


def test_xday_bin_range(spark):
    got = dates(spark, [D(1989, 12, 31), D(1990, 1, 1), D(2018, 12, 26), D(2018, 12, 27), D(2019, 1, 1)], lambda d: T.xday_bin(d, 5, 1990, 2018))
    assert got == [None, D(1990, 1, 1), D(2018, 12, 22), None, None]


def test_noleap_365_skips_only_feb_29(spark):
    got = dates(spark, list(range(365 * 5)), lambda d: T.noleap_to_date(d, "2001-01-01"))
    expected = [D(2001, 1, 1) + dt.timedelta(days=i) for i in range(365 * 5 + 2)]
    expected = [d for d in expected if (d.month, d.day) != (2, 29)][: 365 * 5]
    assert got == expected


def test_noleap_360_skips_31sts(spark):
    got = dates(spark, list(range(360 * 4)), lambda d: T.noleap_to_date(d, "2001-01-01", 360))
    assert got == sorted(set(got))
    for year in (2001, 2002, 2003, 2004):
        mine = [d for d in got if d.year == year]
        assert len(mine) == 360
        missing = {D(year, 1, 1) + dt.timedelta(days=i) for i in range(366)} - set(mine)
        missing = {d for d in missing if d.year == year}
        ends = {(5, 31), (7, 31), (8, 31), (10, 31), (12, 31)} | ({(3, 31)} if year == 2004 else set())
        assert {(d.month, d.day) for d in missing} == ends


def test_spine_lengths(spark):
    sites = spark.createDataFrame([("a", 2003, 2004), ("b", 2004, 2004)], "sitename STRING, year_start INT, year_end INT")
    count = lambda df: {r.sitename: r["count"] for r in df.groupBy("sitename").count().collect()}
    assert count(calendar_spine(sites)) == {"a": 731, "b": 366}
    assert count(calendar_spine(sites, noleap=True)) == {"a": 730, "b": 365}
    months = calendar_spine(sites, freq="months")
    assert count(months) == {"a": 24, "b": 12}
    assert {r.d for r in months.select(F.dayofmonth("date").alias("d")).collect()} == {15}


def test_on_calendar_keeps_every_day(spark, series):
    spine = calendar_spine(spark.createDataFrame([("a", 2001, 2001)], "sitename STRING, year_start INT, year_end INT"))
    out = on_calendar(series({"a": [1.0, None, 3.0], "b": [9.0]}, "v"), spine)
    assert out.count() == 365
    assert column(out, "v")[:4] == [1.0, None, 3.0, None]


def brute_linear(v, x=None):
    x = x or list(range(len(v)))
    known = [i for i, y in enumerate(v) if y is not None]
    out = []
    for i, y in enumerate(v):
        lo = [k for k in known if k <= i]
        hi = [k for k in known if k >= i]
        if y is not None or not lo or not hi:
            out.append(y)
        else:
            a, b = lo[-1], hi[0]
            out.append(v[a] + (v[b] - v[a]) * (x[i] - x[a]) / (x[b] - x[a]))
    return out


def same(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert (g is None) == (e is None)
        if e is not None:
            assert g == pytest.approx(e)


GAPPY = {
    "none": [None] * 40,
    "single": [None] * 20 + [5.0] + [None] * 19,
    "full": [float(i * i % 7) for i in range(40)],
    "mixed": [None, None, 1.0, None, 4.0] + [None] * 28 + [2.0, None, 8.0, None, None, None, None],
}


@pytest.mark.parametrize("how", ["bounded", "blocks", "ranges", "many ranges"])
def test_interpolation_across_blocks(series, how):
    # blocks of a month: 2001-01-20 on spans two months
    df = series(GAPPY, "v", start=D(2001, 1, 20))
    block = F.year("date") * 12 + F.month("date") if how == "blocks" else None
    out = W.interpolate_linear(
        df, ["v"], ["sitename"], block=block, bounded=how == "bounded", ranges=29 if how == "many ranges" else None
    )
    for site, values in GAPPY.items():
        same(column(out.where(F.col("sitename") == site), "v"), brute_linear(values))


def test_fill_gaps_extends_edges_and_zeroes_rain(series):
    rows = {k: [(v, v) for v in x] for k, x in GAPPY.items()}
    out = W.fill_gaps(series(rows, "t", "rain", start=D(2001, 12, 20)), ["t"], zero=["rain"])
    for site, values in GAPPY.items():
        got = out.where(F.col("sitename") == site)
        known = [v for v in values if v is not None]
        expected = brute_linear(values)
        if known:
            first = next(i for i, v in enumerate(values) if v is not None)
            last = len(values) - 1 - next(i for i, v in enumerate(values[::-1]) if v is not None)
            expected = [known[0] if i < first else known[-1] if i > last else e for i, e in enumerate(expected)]
        same(column(got, "t"), expected)
        assert column(got, "rain") == [v if v is not None else 0.0 for v in values]


def test_interpolate_at_x_uses_spacing(spark):
    x = [2000.0, 2000.1, 2000.4, 2000.5, 2001.2, 2001.3]
    v = [None, 1.0, None, 2.0, None, None]
    rows = [("a", a, b) for a, b in zip(x, v)] + [("b", a, b) for a, b in zip(x, [3.0, None, None, None, 9.0, None])]
    df = spark.createDataFrame(rows, "sitename STRING, year_dec DOUBLE, v DOUBLE")
    out = W.interpolate_at_x(df, ["v"])
    a = column(out.where("sitename = 'a'"), "v", ("year_dec",))
    same(a, [1.0, 1.0, 1.75, 2.0, None, None])
    b = column(out.where("sitename = 'b'"), "v", ("year_dec",))
    same(b, [*brute_linear([3.0, None, None, None, 9.0], x[:5]), 9.0])


def test_neighbour_months_at_the_ends(spark):
    rows = [("a", y, m, float(y * 100 + m)) for y in (2001, 2002) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "sitename STRING, year INT, moy INT, v DOUBLE")
    out = {(r.year, r.moy): (r.v_prev, r.v_next) for r in W.neighbour_months(df, ["v"]).collect()}
    assert out[2001, 1] == (200112.0, 200102.0)
    assert out[2002, 1] == (200112.0, 200202.0)
    assert out[2002, 12] == (200211.0, 200201.0)


def test_monthly_curve_keeps_means(spark):
    rows = [("a", y, m, 20 * math.sin(2 * math.pi * m / 12)) for y in (2003, 2004) for m in range(1, 13)]
    monthly = spark.createDataFrame(rows, "sitename STRING, year INT, moy INT, v DOUBLE")
    daily = X.monthly_to_daily(monthly, "v")
    assert daily.count() == 731
    means = daily.groupBy(F.year("date").alias("y"), F.month("date").alias("m")).agg(F.avg("v").alias("v")).collect()
    want = {(y, m): v for _, y, m, v in rows}
    assert all(abs(r.v - want[r.y, r.m]) < 1e-2 for r in means)
    step = X.monthly_to_daily(monthly, "v", "step", noleap=True)
    assert step.count() == 730


def test_totals_are_conserved_without_threshold(spark, series):
    totals = spark.createDataFrame([("a", 2001, 1, 12.0)], "sitename STRING, year INT, moy INT, p DOUBLE")
    df = series({"a": [float(i % 3) for i in range(31)]}, "w")
    exact = column(X.allocate_period_total(df, "w", totals, "p", threshold=0.0, min_weight_sum=0.0), "prec")
    assert sum(exact) == pytest.approx(12.0)
    cut = column(X.allocate_period_total(df, "w", totals, "p", threshold=0.5), "prec")
    assert all(v == 0 or v >= 0.5 for v in cut)


def plain_balance(inflow, outflow, kind, cap, spinup):
    def step(s, a, b):
        runoff = max(0.0, s + a - cap) if kind == "bucket" else 6e-5 * a + 0.01 * s
        return min(max(0.0, s + a - b - runoff), cap)

    s = cap
    for a, b in list(zip(inflow, outflow))[:spinup]:
        s = step(s, a, b)
    out = []
    for a, b in zip(inflow, outflow):
        s = step(s, a, b)
        out.append(s)
    return out


@pytest.mark.parametrize("ranges", [None, 7])
@pytest.mark.parametrize("kind", ["bucket", "keenan"])
def test_balance_equals_the_plain_loop(series, kind, ranges):
    rng = random.Random(5)
    inflow = [rng.choice([0.0, 0.0, 30 * rng.random()]) for _ in range(800)]
    outflow = [rng.uniform(-2, 9) for _ in range(800)]
    df = series({"a": list(zip(inflow, outflow))}, "p", "e", start=D(2001, 11, 1))
    got = column(bounded_running_balance(df, "p", "e", kind=kind, ranges=ranges), "soilm")
    same(got, plain_balance(inflow, outflow, kind, 220.0, 365))


def test_ranges_follow_the_rows_and_their_order(series):
    df = series({"long": [1.0] * 3000, "short": [2.0] * 40}, "v")
    rows = [(r.part, r.sitename, r.date) for r in ordered_ranges(df, ["sitename"], "date", "part", 8).collect()]
    sizes = [sum(r[0] == i for r in rows) for i in range(8)]
    assert sum(sizes) == 3040 and max(sizes) < 2 * 3040 / 8
    assert sorted(rows, key=lambda r: r[1:]) == sorted(rows)


@pytest.mark.parametrize("ranges", [None, 3, 50])
def test_balance_of_many_sites_over_ranges(series, ranges):
    """Sites shorter and longer than the spin-up and than a range, one of them without a name."""
    rng = random.Random(8)
    data = {s: [(rng.uniform(0, 12), rng.uniform(-2, 9)) for _ in range(n)] for s, n in (("a", 1), ("b", 5), ("c", 900), ("d", 30))}
    df = series(data, "p", "e").withColumn("more", F.lit("x"))
    df = df.withColumn("sitename", F.nullif("sitename", F.lit("d")))
    out = bounded_running_balance(df, "p", "e", cap=40.0, spinup=12, ranges=ranges)
    assert out.columns == [*df.columns, "soilm"]
    for site, rows in data.items():
        got = column(out.where(F.col("sitename").eqNullSafe(None if site == "d" else site)), "soilm")
        same(got, plain_balance([p for p, _ in rows], [e for _, e in rows], "bucket", 40.0, 12))


@pytest.mark.parametrize("ranges", [None, 9])
def test_balance_stops_at_an_unknown_input(series, ranges):
    rows = [(1.0, 2.0)] * 900
    late = list(rows)
    late[500] = (None, 2.0)
    early = list(rows)
    early[10] = (1.0, None)
    out = bounded_running_balance(series({"late": late, "early": early}, "p", "e"), "p", "e", ranges=ranges)
    got = column(out.where("sitename = 'late'"), "soilm")
    assert all(v is not None for v in got[:500]) and all(v is None for v in got[500:])
    assert set(column(out.where("sitename = 'early'"), "soilm")) == {None}


def test_vpd_is_floored_per_row(spark):
    df = spark.createDataFrame([(20.0, 500.0), (0.0, 5000.0), (None, 500.0), (10.0, None)], "t DOUBLE, e DOUBLE").coalesce(1)
    got = [r[0] for r in df.select(P.vpd(F.col("t"), eact=F.col("e"))).collect()]
    assert got[0] == pytest.approx(611 * math.exp(17.27 * 20 / 257.3) - 500)
    assert got[1:] == [0.0, None, None]
    monthly = [r[0] for r in df.select(P.vpd_monthly(F.col("t"), F.col("e") / 100)).collect()]
    assert monthly[1] == pytest.approx(611 - 5000)


def test_alignment_fails_on_unmatched_rows(series):
    obs, mod = series({"a": [1.0, 2.0]}, "o"), series({"a": [1.0]}, "m")
    assert align_model_obs(obs.limit(1), mod).count() == 1
    with pytest.raises(Exception, match="same keys"):
        align_model_obs(obs, mod).collect()


def test_anomalies_average_to_zero(series):
    df = series({"a": [(float(i % 7), float(i % 5)) for i in range(40)]}, "gpp_obs", "gpp_mod")
    means = df.groupBy("sitename").agg(F.avg("gpp_obs").alias("obs_mean"), F.avg("gpp_mod").alias("mod_mean"))
    out = W.anomalies(df, means, ["sitename"])
    assert sum(column(out, "gpp_obs")) == pytest.approx(0)
    fitted = column(W.add_fitted(df.withColumn("gpp_obs", F.when(F.dayofmonth("date") != 3, F.col("gpp_obs")))), "fitted")
    assert fitted[2] is None and fitted[3] is not None
