"""Roll-ups of daily sums against the operators that read the days; the lattice of cutoffs against one scan each."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.operators import aggregate as A
from siteflux.operators import moments as M
from siteflux.operators.skill import skill, skill_by_site
from siteflux.plans import calibrate as C
from siteflux.plans.evaluate import evaluate, observation_tables
from siteflux.settings import EvalSettings


@pytest.fixture(scope="module")
def days(spark, series):
    rng = np.random.default_rng(4)

    def values(n, gaps):
        return [(None if rng.random() < gaps else float(rng.normal(1e4, 3)), None if rng.random() < gaps else float(rng.normal(9e3, 2))) for _ in range(n)]

    data = {"a": values(800, 0.1), "b": values(400, 0.0), "none": [(None, 1.0)] * 30, "flat": [(2.0, float(i)) for i in range(30)], "still": [(float(i), 3.0) for i in range(9)]}
    out = series(data, "gpp_obs", "gpp_mod")
    return out.union(out.where("sitename = 'b'").withColumn("sitename", F.lit(None).cast("string")))


def same(a, b, keys):
    rows = [sorted(map(tuple, df.select(*keys, *sorted(c for c in a.columns if c not in keys)).collect()), key=str) for df in (a, b)]
    assert len(rows[0]) == len(rows[1])
    for x, y in zip(*rows):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-7, abs_tol=1e-7)), (x, y)


def test_roll_ups_equal_the_operators_that_read_days(days):
    moments = M.day_moments(days, {"gpp_obs": F.col("gpp_obs"), "gpp_mod": F.col("gpp_mod")}, (F.col("gpp_obs"), F.col("gpp_mod")))
    for c in ("gpp_obs", "gpp_mod"):
        same(M.annual_of(moments, c, 300), A.annual_sum(days, c, 300), ["sitename", "year"])
        same(M.monthly_of(moments, c), A.monthly_mean(days, c), ["sitename", "year", "moy"])
        same(M.xday_of(moments, c, "n"), A.xday_aggregate(days, c, n="n"), ["sitename", "inbin"])
    same(M.skill_of(moments, ["sitename"]), skill(days, ["sitename"]), ["sitename"])
    same(M.skill_of(moments, ["sitename"], 20), skill_by_site(days, 20), ["sitename"])
    same(M.skill_of(moments), skill(days), [])
    by_site = M.pair_moments(days, ["sitename"])
    same(M.skill_of(by_site), skill(days), [])
    same(M.skill_of(M.pair_moments(days.limit(0))), skill(days.limit(0)), [])


def test_evaluation_has_every_level_and_its_stored_and_lazy_forms_agree(spark, days):
    settings = EvalSettings(min_days=30, first_year=1990, first_day="2001-01-20")
    known = days.where("sitename IS NOT NULL")
    obs, mod = known.drop("gpp_mod"), known.where("sitename <> 'b'").drop("gpp_obs")
    got = [
        evaluate(mod, observation_tables(obs, settings=settings, store=store), settings=settings, store=store)
        for store in (True, False)
    ]
    same(got[0]["metrics"], got[1]["metrics"], ["level"])
    assert got[0]["metrics"].count() == 10 and "meandoydf_byclim" not in got[0]
    assert {r.sitename for r in got[0]["ddf"].select("sitename").distinct().collect()} == {"a", "none", "flat", "still"}
    same(got[0]["idvdf_stats"], skill(got[0]["idvdf"], ["sitename"]), ["sitename"])
    late = known.where("sitename <> 'b' AND date >= '2001-01-20'")
    pooled = got[0]["metrics"].where("level = 'daily_pooled'").drop("level")
    same(pooled, skill(late), [])
    empty = evaluate(mod.limit(0), observation_tables(obs, settings=settings), settings=settings)["metrics"]
    assert {(r.level, r.nvals) for r in empty.collect()} == {(r.level, 0) for r in got[0]["metrics"].collect()}


def test_lattice_equals_one_scan_per_cutoff(spark):
    rng = np.random.default_rng(6)
    rows = [tuple(None if rng.random() < 0.05 else float(x) for x in rng.random(4) * [9, 9, 25, 1]) for _ in range(600)]
    rows += [(1.0, 2.0, 5.0, 0.4), (1.0, 2.0, 20.0, 0.9), (3.0, 1.0, 6.0, 0.5)]  # on the cutoffs
    df = spark.createDataFrame(rows, "gpp_obs DOUBLE, gpp_mod DOUBLE, temp DOUBLE, soilm_mean DOUBLE")
    for fixed in ((5.0, 0.4), (4.5, 0.33)):  # among the cutoffs and between them
        got = {(r.swept, r.cutoff): r for r in C.sensitivity_sweep(df, 0.05, temp_fixed=fixed[0], soilm_fixed=fixed[1]).collect()}
        assert len(got) == len(C.TEMP_CUTOFFS) + len(C.SOILM_CUTOFFS)
        for (swept, cutoff), r in got.items():
            t, s = (cutoff, fixed[1]) if swept == "temp" else (fixed[0], cutoff)
            kept = [x for x in rows if x[2] is not None and x[3] is not None and x[2] > t and x[3] > s]
            pairs = [x for x in kept if x[0] is not None and x[1] is not None]
            assert r.ndays == len(kept)
            if pairs:
                k = sum(x[0] * x[1] for x in pairs) / sum(x[1] ** 2 for x in pairs)
                assert r.kphio_corr == pytest.approx(k) and r.kphio_opt == pytest.approx(0.05 * k)
            else:
                assert r.kphio_corr is None
    none = C.sensitivity_sweep(df.limit(0), 0.05).collect()
    assert len(none) == len(got) and {(r.ndays, r.kphio_corr) for r in none} == {(0, None)}


def test_lattice_keeps_a_bounded_number_of_cells(spark):
    assert C.sensitivity_sweep(spark.range(5000).select(*[F.rand(i).alias(c) for i, c in enumerate(("gpp_obs", "gpp_mod", "temp", "soilm_mean"))]), 0.05).count() == 38


def test_box_closes_in_on_two_parameters_for_two_targets(spark):
    rng = np.random.default_rng(3)
    rows = [(float(x), float(z), float(0.7 * x + 2.5 * z), float(2 * (0.7 * x + 2.5 * z))) for x, z in rng.uniform(0, 9, (300, 2))]
    df = spark.createDataFrame([*rows, (1.0, None, 5.0, 5.0)], "x DOUBLE, z DOUBLE, one DOUBLE, two DOUBLE")

    def model(values):
        y = F.col("x") * values["a"] + F.col("z") * values["b"]
        return {"one": y, "two": y * 2}

    weights = {"one": 1.0, "two": 0.5}
    tried = C.calibrate_box(df, model, {"a": (0.0, 1.0), "b": (0.0, 4.0)}, weights, rounds=9)
    assert tried.columns == ["round", "candidate", "a", "b", "target", "cost"] and tried.count() == 9 * 25 * 2
    best = C.best_in_box(tried, weights).first()
    assert best.a == pytest.approx(0.7, abs=0.01) and best.b == pytest.approx(2.5, abs=0.01)
    outside = tried.where("a < 0 OR a > 1 OR b < 0 OR b > 4")
    assert outside.isEmpty()
    none = C.calibrate_box(df.limit(0), model, {"a": (0.0, 1.0), "b": (0.0, 4.0)}, weights, rounds=3)
    assert none.count() == 50 and C.best_in_box(none, weights).isEmpty()
    with pytest.raises(ValueError):
        C.calibrate_box(df, model, {"a": (0.0, 1.0), "b": (0.0, 4.0)}, weights, steps=30)
