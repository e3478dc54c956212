"""Rows of an unknown site, sites outside a grid, calendars that start in mid-year, folders no one shares."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siteflux.functions.calendar import noleap_to_date
from siteflux.operators.balance import bounded_running_balance
from siteflux.operators.grid import GridSpec, locate
from siteflux.operators.groups import with_stats
from siteflux.operators.series import fill_gaps, interpolate_linear, neighbour_months
from siteflux.sources import sinks

DAY = dt.date(2001, 1, 1)


@pytest.fixture
def unknown_site(spark):
    rows = [(site, DAY + dt.timedelta(days=i), v) for site in ("a", None) for i, v in enumerate([1.0, None, 3.0, None])]
    return spark.createDataFrame(rows, "sitename STRING, date DATE, v DOUBLE")


def values(df, name):
    got = {}
    for r in df.orderBy("date").collect():
        got.setdefault(r.sitename, []).append(r[name])
    return got


def test_unknown_site_is_a_series_with_and_without_blocks(unknown_site):
    assert values(fill_gaps(unknown_site, ["v"]), "v") == {k: [1.0, 2.0, 3.0, 3.0] for k in ("a", None)}
    for block in (None, F.year("date")):
        got = values(interpolate_linear(unknown_site, ["v"], ["sitename"], block=block), "v")
        assert got == {k: [1.0, 2.0, 3.0, None] for k in ("a", None)}
    assert {r.sitename: r.n for r in with_stats(unknown_site, ["sitename"], n=F.count("v")).collect()} == {"a": 2, None: 2}


def test_running_balance_keeps_unknown_sites_and_dates(spark, unknown_site):
    more = unknown_site.union(spark.createDataFrame([("b", None, 1.0)], unknown_site.schema))
    out = bounded_running_balance(more.withColumn("e", F.lit(0.0)), "v", "e", spinup=1)
    assert out.count() == 9 and {r.sitename for r in out.collect()} == {"a", "b", None}


def test_neighbour_months_over_a_missing_year(spark):
    rows = [("a", y, m, y * 100.0 + m) for y in (2001, 2003) for m in range(1, 13)]
    out = neighbour_months(spark.createDataFrame(rows, "sitename STRING, year INT, moy INT, v DOUBLE"), ["v"])
    got = {(r.year, r.moy): (r.v_prev, r.v_next) for r in out.collect()}
    assert got[2001, 12] == (200111.0, 200101.0) and got[2003, 1] == (200312.0, 200302.0)
    assert got[2001, 1] == (200112.0, 200102.0) and got[2003, 12] == (200311.0, 200301.0)


def test_sites_outside_a_regional_grid_have_no_cell(spark):
    sites = spark.createDataFrame([(5.2, 45.2), (20.0, 60.0), (5.2, None)], "lon DOUBLE, lat DOUBLE")
    got = [(r.lon_idx, r.lat_idx) for r in locate(sites, GridSpec(lon0=5.0, lat0=45.0, nlon=5, nlat=5)).collect()]
    assert got == [(0, 0), (None, None), (0, None)]
    globe = [(r.lon_idx, r.lat_idx) for r in locate(spark.createDataFrame([(180.0, 90.0)], "lon DOUBLE, lat DOUBLE"), GridSpec()).collect()]
    assert globe == [(0, 359)]


def test_calendars_start_in_january():
    with pytest.raises(ValueError, match="January"):
        noleap_to_date(F.lit(0), "2000-07-01")


def test_local_warehouse_on_a_cluster_is_an_error(spark):
    class Session:
        _jvm, _jsc = spark._jvm, spark._jsc

        class conf:
            @staticmethod
            def get(key, default=None):
                return "file:/tmp/warehouse" if key == "spark.sql.warehouse.dir" else default

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="shared folder"):
        sinks.scratch_dir(Session)
    assert sinks.scratch_dir(Session, "hdfs://x/y").startswith("hdfs://x/y/siteflux-")
    Session.sparkContext.master = "local[4]"
    assert sinks.scratch_dir(Session).startswith("file:/tmp/warehouse/siteflux-")
