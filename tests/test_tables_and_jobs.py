import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import column
from checks import jobs
from siteflux.operators import aggregate as A
from siteflux.operators import grid as G
from siteflux.operators import metadata as E
from siteflux.operators import skill as S
from siteflux.plans import calibrate as C
from siteflux.plans import learn as L
from siteflux.plans import lightuse as U
from siteflux.plans.observations import build_observations
from siteflux.sources import readers as R
from siteflux.sources import sinks


def test_annual_sum_needs_days_and_known_values(series):
    df = series({"a": [1.0] * 365, "b": [1.0] * 364, "c": [1.0] * 364 + [None]}, "gpp_mod")
    got = {r.sitename: r.gpp_mod for r in A.annual_sum(df).collect()}
    assert got == {"a": 365.0, "b": None, "c": None}
    assert {r.sitename: r.gpp_mod for r in A.annual_sum(df, min_days=10).collect()} == {"a": 365.0, "b": 364.0, "c": None}


def test_roll_up_keeps_years_apart(series):
    df = series({"a": [1.0] * 800}, "gpp")
    months = A.roll_up(df, "month").collect()
    assert len(months) == 27 and {r.gpp for r in months} <= {28.0, 30.0, 31.0, 11.0}


def test_skill_edge_cases(series):
    df = series(
        {"two": [(1.0, 2.0), (2.0, 1.0)], "flat": [(1.0, float(i)) for i in range(5)], "none": [(None, 1.0)],
         "ok": [(2.0 * i + (i % 2), float(i)) for i in range(9)]},
        "gpp_obs", "gpp_mod",
    )
    got = {r.sitename: r for r in S.skill(df, ["sitename"]).collect()}
    assert got["two"].rsq is None and got["flat"].rsq is None
    assert got["none"].nvals == 0 and got["none"].rmse is None and got["none"].slope is None
    x = np.arange(9.0)
    y = 2 * x + x % 2
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    assert got["ok"].rsq == pytest.approx(1 - (1 - r2) * 8 / 7)
    assert got["ok"].slope == pytest.approx(np.polyfit(x, y, 1)[0])
    assert got["ok"].bias == pytest.approx((x - y).mean())
    ext = S.skill_extended(df.where("sitename = 'ok'")).first()
    assert ext.nse == pytest.approx(1 - ((x - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert ext.nse_ref == pytest.approx(1 - ((x - y) ** 2).sum() / ((x - x.mean()) ** 2).sum())


def test_normalise_ranges(series):
    df = series({"a": [1.0, 3.0, None, 5.0], "b": [2.0, 2.0, 2.0]}, "x")
    assert column(A.normalise(df, ["x"], "minmax"), "x") == [0.0, 0.5, None, 1.0, None, None, None]
    assert column(A.normalise(df, ["x"], "max"), "x")[:4] == [0.2, 0.6, None, 1.0]


def test_nearest_cell_goes_round_and_prefers_east(spark):
    sites = spark.createDataFrame([("own", 3, 0), ("tie", 5, 0), ("wrap", 9, 1), ("none", 1, 2)], "sitename STRING, lon_idx INT, lat_idx INT")
    grid = spark.createDataFrame(
        [(3, 0, 30.0), (4, 0, None), (7, 0, 70.0), (1, 1, 11.0), (5, 1, 15.0), (0, 2, None)], "lon_idx INT, lat_idx INT, value DOUBLE"
    )
    got = {r.sitename: (r.lon_idx_found, r.value) for r in G.nearest_valid_cell_same_latitude(sites, grid, 10).collect()}
    assert got == {"own": (3, 30.0), "tie": (7, 70.0), "wrap": (1, 11.0), "none": (None, None)}


def test_nearest_cell_matches_brute_force(spark):
    import random

    rng = random.Random(1)
    n = 24
    field = {(i, j): (float(i + 100 * j) if rng.random() < 0.25 else None) for i in range(n) for j in range(6)}
    sites = [(f"s{k}", rng.randrange(n), rng.randrange(6)) for k in range(60)]
    grid = spark.createDataFrame([(i, j, v) for (i, j), v in field.items()], "lon_idx INT, lat_idx INT, value DOUBLE")
    got = {
        r.sitename: r.lon_idx_found
        for r in G.nearest_valid_cell_same_latitude(
            spark.createDataFrame(sites, "sitename STRING, lon_idx INT, lat_idx INT"), grid, n
        ).collect()
    }
    for name, i, j in sites:
        found = None
        for step in range(n):
            east, west = (i + step) % n, (i - step) % n
            if field[east, j] is not None:
                found = east
                break
            if field[west, j] is not None:
                found = west
                break
        assert got[name] == found


def test_grid_index(spark):
    spec = G.GridSpec()
    df = spark.createDataFrame([(-179.75, -89.75), (179.9, 89.9), (180.2, 0.1)], "lon DOUBLE, lat DOUBLE").coalesce(1)
    got = [(r.lon_idx, r.lat_idx) for r in G.locate(df, spec).collect()]
    assert got == [(0, 0), (719, 359), (0, 180)]


EAV = [
    # site, group, variable group, variable, value
    ("A", "1", "GRP_REF", "REFERENCE_PAPER", "first"),
    ("A", "2", "GRP_REF", "REFERENCE_PAPER", "second"),
    ("A", "9", "GRP_TEAM_MEMBER", "TEAM", "x"),
    ("A", "9", "GRP_TEAM_MEMBER", "TEAM", "y"),
    ("B", "1", "GRP_LOC", "LOCATION_COMMENT", E.REINSTALLED),
    ("B", "1", "GRP_LOC", "LOCATION_LAT", "10"),
    ("B", "2", "GRP_LOC", "LOCATION_COMMENT", "the tower"),
    ("B", "2", "GRP_LOC", "LOCATION_LAT", "20"),
    ("C", "1", "GRP_FLUX", "FLUX_MEASUREMENTS_VARIABLE", "CH4"),
    ("C", "1", "GRP_FLUX", "FLUX_MEASUREMENTS_METHOD", "Eddy Covariance"),
    ("C", "2", "GRP_FLUX", "FLUX_MEASUREMENTS_VARIABLE", "CO2"),
    ("C", "2", "GRP_FLUX", "FLUX_MEASUREMENTS_METHOD", "Chambers"),
    ("C", "3", "GRP_FLUX", "FLUX_MEASUREMENTS_VARIABLE", "CO2"),
    ("C", "3", "GRP_FLUX", "FLUX_MEASUREMENTS_METHOD", "Eddy Covariance"),
    ("C", "4", "GRP_FLUX", "FLUX_MEASUREMENTS_VARIABLE", "CO2"),
    ("C", "4", "GRP_FLUX", "FLUX_MEASUREMENTS_METHOD", "Eddy Covariance"),
    ("D", "1", "GRP_H", "HEIGHT", "9"),
    ("D", "2", "GRP_H", "HEIGHT", "10"),
    ("D", "3", "GRP_T", "TEXT", "b"),
    ("D", "4", "GRP_T", "TEXT", "a"),
    ("D", "5", "GRP_N", "NETWORK", "n"),
]


def test_metadata_rules(spark):
    rows = [(*r, i) for i, r in enumerate(EAV)]
    df = spark.createDataFrame(rows, "SITE_ID STRING, GROUP_ID STRING, VARIABLE_GROUP STRING, VARIABLE STRING, DATAVALUE STRING, line INT")
    out = E.dedupe_eav(df)
    got = {(r.SITE_ID, r.VARIABLE): (r.GROUP_ID, r.DATAVALUE) for r in out.collect()}
    assert got == {
        ("A", "REFERENCE_PAPER"): ("1", "first"),
        ("B", "LOCATION_COMMENT"): ("2", "the tower"),
        ("B", "LOCATION_LAT"): ("2", "20"),
        ("C", "FLUX_MEASUREMENTS_VARIABLE"): ("3", "CO2"),
        ("C", "FLUX_MEASUREMENTS_METHOD"): ("3", "Eddy Covariance"),
        ("D", "HEIGHT"): ("2", "10"),
        ("D", "TEXT"): ("3", "b"),
    }
    wide = {r.SITE_ID: r.HEIGHT for r in E.eav_to_wide(out, ["HEIGHT", "TEXT"]).collect()}
    assert wide == {"A": None, "B": None, "C": None, "D": "10"}


# ---------------------------------------------------------------- files
FILES = {
    "FLX_AA-One_FLUXNET2015_FULLSET_DD_2001-2002_1-3.csv": "TIMESTAMP,TA_F,SWC_F_MDS_1\n20010131,1.5,-9999\n20010201,-9999,0.3\n",
    "FLX_BB-Two_FLUXNET2015_FULLSET_DD_2001-2002_1-3.csv": "TIMESTAMP,SWC_F_MDS_2,TA_F\n20010131,7,x\n",
    "FLX_AA-One_FLUXNET2015_FULLSET_WW_2001-2002_1-3.csv": "TIMESTAMP_START,TIMESTAMP_END,TA_F\n20010101,20010107,2\n",
    "FLX_AA-One_FLUXNET2015_FULLSET_MM_2001-2002_1-3.csv": "TIMESTAMP,TA_F\n200102,3\n",
    "FLX_AA-One_FLUXNET2015_FULLSET_YY_2001-2002_1-3.csv": "TIMESTAMP,TA_F\n2001,-9999\n",
}


@pytest.fixture(scope="module")
def towers(tmp_path_factory):
    base = tmp_path_factory.mktemp("towers")
    for name, text in FILES.items():
        sub = base / name[:10]
        sub.mkdir(exist_ok=True)
        (sub / name).write_text(text)
    return str(base)


def test_tower_csv_by_resolution(spark, towers):
    daily = R.read_site_csv(spark, towers, "d", glob="*_DD_*.csv").orderBy("sitename", "date").collect()
    assert [(r.sitename, r.date, r.TA_F, r.SWC_F_MDS_1, r.SWC_F_MDS_2) for r in daily] == [
        ("AA-One", dt.date(2001, 1, 31), 1.5, None, None),
        ("AA-One", dt.date(2001, 2, 1), None, 0.3, None),
        ("BB-Two", dt.date(2001, 1, 31), None, None, 7.0),
    ]
    for freq, code, want in (("w", "WW", (dt.date(2001, 1, 1), 2.0)), ("m", "MM", (dt.date(2001, 2, 1), 3.0)), ("y", "YY", (dt.date(2001, 1, 1), None))):
        row = R.read_site_csv(spark, towers, freq, ["TA_F"], glob=f"*_{code}_*.csv").first()
        assert (row.date, row.TA_F) == want


def test_pick_site_files(spark):
    names = ["FLX_AA-One_FLUXNET2015_FULLSET_DD_2001-2002_1-2.csv", "FLX_AA-One_FLUXNET2015_FULLSET_DD_2001-2002_1-3.csv",
             "FLX_BB-Two_FLUXNET2015_FULLSET_DD_2001-2002_1-1.csv", "FLX_BB-Two_FLUXNET2015_FULLSET_MM_2001-2002_1-1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "file_name STRING")
    got = {r.sitename: r.file_name for r in R.pick_site_files(df, "d").collect()}
    assert got == {"AA-One": names[1], "BB-Two": names[2]}
    years = E.years_from_filenames(df.limit(1), "file_name").first()
    assert (years.mysitename, years.year_start, years.year_end) == ("AA-One", 2001, 2002)


def test_text_output_and_fixed_width(spark, series, tmp_path):
    path = str(tmp_path / "text")
    sinks.write_site_year_text(series({"a": [1.5, -2.25, 1e6]}, "v", start=dt.date(2001, 12, 30)), "v", path)
    (file,) = list((tmp_path / "text" / "sitename=a" / "year=2001").glob("part-*"))
    assert file.read_text().splitlines() == ["        1.500000", "       -2.250000"]
    back = R.read_fixed_width(spark, path, 1, 16, "v", {"year": r"year=(\d+)"})
    assert sorted((r.year, r.v) for r in back.collect()) == [("2001", -2.25), ("2001", 1.5), ("2002", 1e6)]


def test_materialise_rebuilds_only_on_request(spark, series, tmp_path):
    path, calls = str(tmp_path / "m"), []

    def build():
        calls.append(1)
        return series({"a": [float(len(calls))]}, "v")

    assert sinks.materialise_or_load(spark, path, build).first().v == 1.0
    assert sinks.materialise_or_load(spark, path, build).first().v == 1.0
    assert sinks.materialise_or_load(spark, path, build, overwrite=True).first().v == 2.0


# ---------------------------------------------------------------- jobs
def density(tc, p):
    lam = 1788.316 + 21.55053 * tc - 0.4695911 * tc**2 + 3.096363e-3 * tc**3 - 7.341182e-6 * tc**4
    po = 5918.499 + 58.05267 * tc - 1.1253317 * tc**2 + 6.6123869e-3 * tc**3 - 1.4661625e-5 * tc**4
    v = sum(c * tc**i for i, c in enumerate(jobs.SQL_VINF))
    return 1e3 / (v + lam / (po + 1e-5 * p))


def viscosity(tc, p):
    tb, rb = (tc + 273.15) / 647.096, density(tc, p) / 322.0
    mu0 = 100 * tb**0.5 / (1.67752 + 2.20462 / tb + 0.6366564 / tb**2 - 0.241605 / tb**3)
    mu1 = sum((1 / tb - 1) ** i * sum(jobs.SQL_H[j][i] * (rb - 1) ** j for j in range(7)) for i in range(6))
    return mu0 * np.exp(rb * mu1) * 1e-6


def test_light_use_over_temperature(spark):
    temps = np.linspace(0, 35, 100)
    df = spark.createDataFrame([(float(t), 0.7, 10.0, 300.0, 100.0, 300.0) for t in temps], "temp DOUBLE, fapar DOUBLE, ppfd DOUBLE, co2 DOUBLE, vpd DOUBLE, elv DOUBLE")
    got = np.array([(r.gpp, r.chi) for r in U.score_light_use(df.coalesce(1), cpalpha=None).collect()])
    patm = 101325 * (1 - 0.0065 * 300 / 298.15) ** (9.80665 * 0.028963 / (8.3143 * 0.0065))
    arr = lambda e: np.exp(e * (temps - 25) / (298.15 * 8.3145 * (temps + 273.15)))
    ca, gs = 300e-6 * patm, 4.22 * arr(37830)
    k = 39.97 * arr(79430) * (1 + 2.09476e5 * 1e-6 * patm / (2.748e4 * arr(36380)))
    ns = viscosity(temps, patm) / viscosity(25.0, 101325.0)
    xi = np.sqrt(146 * (k + gs) / (1.6 * ns))
    chi = gs / ca + (1 - gs / ca) * xi / (xi + 10)
    m = (ca - gs) / (ca + 2 * gs + 3 * gs * np.sqrt(1.6 * ns * 100 / (146 * (k + gs))))
    mp = np.sqrt(m**2 - 0.41 ** (2 / 3) * m ** (4 / 3))
    gpp = 0.7 * 10 * 0.0579 * (1 / 1.26) ** 0.25 * mp * 12.0107
    assert got[:, 1] == pytest.approx(chi)
    assert got[:, 0] == pytest.approx(gpp)


def test_scores_are_null_not_nan(spark):
    df = spark.createDataFrame([(20.0, 0.7, 10.0, 300.0, -5.0, 300.0), (None, 0.7, 10.0, 300.0, 100.0, 300.0)], "temp DOUBLE, fapar DOUBLE, ppfd DOUBLE, co2 DOUBLE, vpd DOUBLE, elv DOUBLE")
    for method in U.METHODS:
        for row in U.score_light_use(df, method).collect():
            assert row.gpp is None
            assert not any(isinstance(v, float) and math.isnan(v) for v in row)
    approx = U.score_light_use(df.fillna(1.0).withColumn("vpd", F.lit(500.0)), "approx").collect()
    assert all(r.vcmax is None and r.gpp is not None for r in approx)


def test_scale_equals_least_squares(series):
    rng = np.random.default_rng(2)
    m = rng.random(200) * 5
    o = 1.7 * m + rng.normal(0, 0.2, 200)
    df = series({"a": [(float(a), float(b), 10.0, 0.9) for a, b in zip(o, m)]}, "gpp_obs", "gpp_mod", "temp", "soilm_mean")
    row = C.calibrate_scale(df, 0.05, 5.0, 0.4).first()
    k = np.linalg.lstsq(m[:, None], o, rcond=None)[0][0]
    assert (row.kphio_corr, row.kphio_opt, row.ndays) == (pytest.approx(k), pytest.approx(0.05 * k), 200)
    tried = C.calibrate_grid(df, lambda v: F.col("gpp_mod") * v, 1.0, 3.0, steps=21, rounds=3)
    assert C.best_value(tried).first().value == pytest.approx(k, abs=2e-3)
    sweep = C.sensitivity_sweep(df, 0.05).collect()
    assert len(sweep) == 17 + 21
    assert {r.ndays for r in sweep if r.swept == "temp" and r.cutoff >= 10} == {0}


def test_gapfill_changes_only_gaps(series):
    rows = {s: [(None if i % 6 == 0 else 2.0 * (i % 9) + k, float(i % 9), 2001 + i / 365) for i in range(120)] for k, s in enumerate("ab")}
    df = series(rows, "y", "x", "year_dec")
    out = L.gapfill_regression(df, "y", ["x"], iterations=10, depth=4)
    got, raw = column(out, "y"), column(df, "y")
    assert all(g == r for g, r in zip(got, raw) if r is not None)
    want = [2.0 * (i % 9) + k for k in range(2) for i in range(120)]
    assert max(abs(g - w) for g, w in zip(got, want)) < 1.5


def test_responses_follow_the_data(series):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(600):
        t, v, f, p, s = rng.uniform(1, 30), rng.uniform(100, 2000), rng.random(), rng.uniform(5, 60), rng.random()
        rows.append((t, v, f, p, s, 0.2 * t + 3 * f, 0.25 * t + 2 * f))
    df = series({"a": [tuple(float(x) for x in r) for r in rows]}, "temp", "vpd", "fapar", "ppfd", "soilm", "gpp_obs", "gpp_mod")
    model = L.fit_additive(df, {"gpp_obs": "fit_obs", "gpp_mod": "fit_mod"})
    assert L.response_skill(df, model, "gpp_obs", "fit_obs").first().rsq > 0.98
    curve = L.response_curve(df, model, "temp", {"fit_obs": "", "fit_mod": "_mod"}, steps=5, nsample=3).orderBy("temp").collect()
    assert [r.temp for r in curve] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert curve[2].median - curve[1].median == pytest.approx(2.0, abs=0.2)
    assert all(r.q25 <= r.median <= r.q75 for r in curve)


def test_sampling_does_not_depend_on_partitions(series):
    df = series({"a": [float(i) for i in range(50)]}, "x")
    key = ["sitename", "date"]
    assert L.sampled_values(df, ["x"], 5, key) == L.sampled_values(df.repartition(7), ["x"], 5, key)


def test_observations_without_soil_water(series):
    names = ["GPP_NT_VUT_REF", "GPP_DT_VUT_REF", "LE_F_MDS", "LE_F_MDS_QC", "NEE_VUT_REF_NIGHT_QC", "NEE_VUT_REF_DAY_QC", "TA_F"]
    df = series({"a": [(1.0 + i, 2.0 + i, 10.0 + i, 1.0, 1.0, 1.0 if i else 0.1, 5.0) for i in range(5)]}, *names)
    out = build_observations(df).orderBy("date").collect()
    assert out[0].gpp_obs is None and out[1].gpp_obs == 2.5
    assert out[0].transp_obs == 864000.0 and out[0].soilm_obs_mean is None


def test_scoring_refuses_columns_called_like_its_outputs(series):
    df = series({"a": [(10.0, 0.5, 20.0, 500.0, 400.0, 100.0)]}, "temp", "fapar", "ppfd", "vpd", "co2", "elv")
    with pytest.raises(ValueError, match="gpp"):
        U.score_light_use(df.withColumn("gpp", F.lit(1.0)))


def test_leaf_nitrogen_follows_the_years_strongest_demand(series):
    names = ("temp", "fapar", "ppfd", "vpd", "co2", "elv", "lai", "dppfd", "mean_ppfd")
    days = [(10.0 + i, 0.5, 20.0, 500.0, 400.0, 100.0, 2.0, 20.0, 1e-4 * (1 + i)) for i in range(4)]
    out = U.scale_leaf_columns(U.score_light_use(series({"a": days, None: days}, *names, start=dt.date(2001, 12, 30))))
    rows = sorted(out.collect(), key=lambda r: (str(r.sitename), r.date))
    assert not {"_peak", "_year", "_cover"} & set(out.columns)
    for site in (rows[:4], rows[4:]):
        for year in (site[:2], site[2:]):
            peak = max(r.mean_ppfd * r.actnv_unitiabs for r in year)
            assert [r.leaf_n for r in year] == pytest.approx([(1 - math.exp(-1.0)) * peak / 2.0] * 2)
