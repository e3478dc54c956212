"""Months to days for several columns, sources to finished inputs, and all variables written in one job."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siteflux.operators.downscale import allocate_period_total, monthly_to_daily, months_to_days
from siteflux.operators.grid import GridSpec
from siteflux.plans import inputs as I
from siteflux.sources import readers as R


@pytest.fixture
def months(spark):
    rows = [(s, 2000 + m // 12, m % 12 + 1, (m * 7 % 11) + 0.5, None if m == 5 else float(m * 5 % 13)) for s in ("a", "b") for m in range(26)]
    return spark.createDataFrame(rows, "sitename STRING, year INT, moy INT, x DOUBLE, y DOUBLE")


@pytest.mark.parametrize("method", ["polynom", "step"])
@pytest.mark.parametrize("noleap", [False, True])
def test_columns_together_equal_columns_alone(months, method, noleap):
    both = months_to_days(months, {"x": "u", "y": "v"}, method, noleap, carry=("x",))
    alone = monthly_to_daily(months, "x", method, "u", noleap).join(monthly_to_daily(months, "y", method, "v", noleap), ["sitename", "date"])
    keys = ("sitename", "date")
    assert both.select(*keys, "u", "v").orderBy(*keys).collect() == alone.select(*keys, "u", "v").orderBy(*keys).collect()
    feb = both.where("year(date) = 2000 AND month(date) = 2")
    assert {r.ndays for r in feb.collect()} == {28 if noleap else 29} and feb.count() == 2 * (28 if noleap else 29)


def test_station_rain_follows_weights_or_spreads_evenly(spark, series):
    spec = GridSpec(lon0=0.0, lat0=0.0, dlon=1.0, dlat=1.0, nlon=10, nlat=10)
    grid = spark.createDataFrame(
        [(3, 4, 2000, m, 50.0 + m, 31.0 * m, 10.0 + m, 8.0) for m in range(1, 13)],
        "lon_idx LONG, lat_idx LONG, year INT, moy INT, cld DOUBLE, pre DOUBLE, tmp DOUBLE, vap DOUBLE",
    )
    sites = spark.createDataFrame([("a", 3.1, 4.1), ("b", 3.2, 4.2)], "sitename STRING, lon DOUBLE, lat DOUBLE")
    even = I.station_at_sites(sites, grid, spec)
    assert even.count() == 730 and even.columns == ["sitename", "date", "temp", "ccov", "vpd", "prec"]
    march = even.where("sitename = 'a' AND month(date) = 3")
    assert {r.prec for r in march.collect()} == {3.0}
    weights = series({"a": [float(i % 4) for i in range(366)], "b": [None] * 366}, "weight", start=dt.date(2000, 1, 1))
    got = I.station_at_sites(sites, grid, spec, weights=weights).select("sitename", "date", "prec")
    days = even.select("sitename", "date").join(weights, ["sitename", "date"], "left").fillna(0.0, ["weight"])
    totals = grid.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sitename"), "year", "moy", "pre")
    want = allocate_period_total(days, "weight", totals, "pre").select("sitename", "date", "prec")
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()


def test_inputs_take_the_sources_that_are_given(spark, tmp_path):
    sites = spark.createDataFrame([("AA-One", 3.1, 4.1, 100.0, 2001, 2001)], "sitename STRING, lon DOUBLE, lat DOUBLE, elv DOUBLE, year_start INT, year_end INT")
    (tmp_path / "in").mkdir()
    name = tmp_path / "in" / "FLX_AA-One_FLUXNET2015_FULLSET_DD_2001-2001_1-3.csv"
    name.write_text("TIMESTAMP,TA_F,P_F,VPD_F\n20010101,5,1.5,2\n20010104,8,-9999,-9999\n")
    index = spark.createDataFrame([("AA-One", dt.date(2001, 1, 1), 0.4)], "sitename STRING, date DATE, fapar DOUBLE")
    out = I.inputs_from_sources(spark, sites, [str(name)], vegetation=index, path=str(tmp_path / "out"))
    days = {r.date.timetuple().tm_yday: r for r in out.collect()}
    assert len(days) == 365 and [days[i].temp for i in (1, 2, 4, 200)] == [5.0, 6.0, 8.0, 8.0]
    assert days[1].prec == 1.5 and days[4].prec == 0.0 and days[9].vpd == 200.0
    assert days[1].fapar == 0.4 and days[9].fapar is None and days[1].ppfd is None
    files = {p.parts[-4]: p for p in Path(tmp_path / "out").glob("variable=*/sitename=AA-One/year=2001/part-*")}
    assert set(files) == {f"variable=d{v}" for v in ("temp", "prec", "fsun", "vpd", "ppfd", "fapar")}
    lines = files["variable=dtemp"].read_text().splitlines()
    assert lines[:4] == [f"{v:16.6f}" for v in (5, 6, 7, 8)] and len(lines) == 365
    assert set(files["variable=dppfd"].read_text().splitlines()) == {f"{-9999:16.6f}"}
    back = R.read_fixed_width(spark, str(tmp_path / "out" / "variable=dppfd"), 1, 16, "ppfd")
    assert back.count() == 365 and back.where("ppfd IS NOT NULL").isEmpty()
    assert I.inputs_from_sources(spark, sites).where("temp IS NULL AND prec = 0").count() == 365
