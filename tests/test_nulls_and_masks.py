import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import column
from siteflux.functions import nulls as N
from siteflux.functions.rows import cap, class_code, class_word, is_c4, row_mean, row_weighted_mean, year_clean
from siteflux.operators import cleaning as C
from siteflux.operators import masks as K
from siteflux.operators.quantiles import hinges, quantiles


def one(spark, schema, rows, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_masks_differ_on_unknown_condition(spark):
    rows = [(1.0, True), (2.0, False), (3.0, None)]
    assert one(spark, "x DOUBLE, c BOOLEAN", rows, N.null_if(F.col("c"), F.col("x"))) == [None, 2.0, None]
    assert one(spark, "x DOUBLE, c BOOLEAN", rows, N.null_where(F.col("c"), F.col("x"))) == [None, 2.0, 3.0]
    assert one(spark, "x DOUBLE, c BOOLEAN", rows, N.not_true(F.col("c"))) == [False, True, True]


def test_strict_aggregates_and_plain_ones(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("b", 3.0), ("c", None)], "g STRING, x DOUBLE")
    got = {
        r.g: (r.s, r.m, r.plain, r.low)
        for r in df.groupBy("g")
        .agg(
            N.strict_sum(F.col("x")).alias("s"), N.strict_mean(F.col("x")).alias("m"),
            F.avg("x").alias("plain"), F.min("x").alias("low"),
        )
        .collect()
    }
    assert got == {"a": (None, None, 1.0, 1.0), "b": (4.0, 2.0, 2.0, 1.0), "c": (None, None, None, None)}


def test_finite_and_guarded_extremes(spark):
    rows = [(float("nan"),), (float("inf"),), (-float("inf"),), (2.0,), (None,)]
    assert one(spark, "x DOUBLE", rows, N.finite(F.col("x"))) == [None, None, None, 2.0, None]
    assert one(spark, "x DOUBLE", rows[3:], N.strict_least(F.col("x"), F.lit(1.0))) == [1.0, None]
    assert one(spark, "x DOUBLE", rows[3:], cap(F.col("x"), 100)) == [2.0, None]


def test_row_means(spark):
    rows = [(1.0, 3.0), (None, 3.0), (None, None)]
    a, b = F.col("a"), F.col("b")
    assert one(spark, "a DOUBLE, b DOUBLE", rows, row_mean(a, b)) == [2.0, 3.0, None]
    assert one(spark, "a DOUBLE, b DOUBLE", rows, row_mean(a, b, strict=True)) == [2.0, None, None]
    assert one(spark, "a DOUBLE, b DOUBLE", rows, row_weighted_mean([a, b], [2, 1])) == [pytest.approx(5 / 3), 3.0, None]


def test_text_and_labels(spark):
    rows = [("Cfb - mild",), ("-",), (None,)]
    assert one(spark, "t STRING", rows, class_code(F.col("t"))) == ["Cfb", "-", None]
    assert one(spark, "t STRING", rows, class_word(F.col("t"))) == ["mild", None, None]
    assert one(spark, "t STRING", [("20010315",), ("1999",), ("x",)], year_clean(F.col("t"))) == [2001, 1999, None]
    assert one(spark, "t STRING", [("C4",), ("C3C4",), ("C3",), (None,)], is_c4(F.col("t"))) == [True, True, False, None]


def test_calibration_filter_masks_unknown_temperature(series):
    df = series({"a": [(1.0, 10.0, 0.9), (2.0, None, 0.9), (3.0, 10.0, None), (4.0, 2.0, 0.9)]}, "gpp_obs", "temp", "soilm_obs_mean")
    assert column(K.calibration_filter(df, temp_min=5.0, soilm_min=0.5), "gpp_obs") == [1.0, None, None, None]
    assert column(K.calibration_filter(df, temp_min=5.0), "gpp_obs") == [1.0, None, 3.0, None]
    early = K.calibration_filter(df, date_min="2001-01-03")
    assert column(early, "gpp_obs") == [None, None, 3.0, 4.0]


def test_flagged_days_mask_uncovered_days_too(spark, series):
    df = series({"a": [1.0, 2.0, 3.0, 4.0]}, "gpp_obs")
    d = [dt.date(2001, 1, i) for i in range(1, 5)]
    flags = spark.createDataFrame(
        [("a", d[0], False, "c"), ("a", d[1], True, "c"), ("a", d[2], False, None)],
        "sitename STRING, date DATE, is_flue_drought BOOLEAN, cluster STRING",
    )
    assert column(K.mask_flagged_days(df, flags), "gpp_obs") == [1.0, None, None, None]


def test_low_quality_and_missing_flags(series):
    df = series({"a": [(1.0, 0.1), (2.0, 0.9), (3.0, None)], "b": [(1.0, None), (2.0, None)]}, "x", "q")
    assert column(K.mask_low_quality(df, "x", "q", 0.5), "x") == [None, 2.0, 3.0, 1.0, 2.0]
    # site b has no flags at all and keeps its values
    assert column(K.mask_if_no_qc_in_scope(df, "x", "q"), "x") == [1.0, 2.0, None, 1.0, 2.0]


def test_families_pair_by_name(series):
    df = series({"a": [(1.0, 2.0, 3.0, 4.0)]}, "SWC_F_MDS_2", "SWC_F_MDS_1", "SWC_F_MDS_1_QC", "SWC_F_MDS_2_QC")
    assert K.family_with_flags(df) == [("SWC_F_MDS_2", "SWC_F_MDS_2_QC"), ("SWC_F_MDS_1", "SWC_F_MDS_1_QC")]


def test_coalesce_sources_skips_absent(series):
    df = series({"a": [(None, 2.0), (1.0, 2.0)]}, "t_tower", "t_station")
    out = K.coalesce_sources(df, "t", ["t_tower", "t_reanalysis", "t_station"])
    assert column(out, "t") == [2.0, 1.0]
    assert column(K.coalesce_sources(df, "z", ["none"]), "z") == [None, None]


def brute_repeats(values, least=3, eps=1e-4):
    seen = {}
    for v in values:
        if v is not None:
            seen[v] = seen.get(v, 0) + 1
    bad = [v for v, n in seen.items() if n >= least]
    return [None if v is None or any(abs(v - b) < eps for b in bad) else v for v in values]


def test_repeated_values_match_brute_force(series):
    import random

    rng = random.Random(3)
    values = [rng.choice([None, round(rng.randrange(60) * 3.1e-5, 8), -round(rng.randrange(60) * 2.3e-5, 8)]) for _ in range(300)]
    out = C.mask_repeated_values(series({"a": values}, "x"), "x")
    assert column(out, "x") == brute_repeats(values)


def test_paired_fluxes_keep_unknown_difference(series):
    # differences 0..98 and one day with the second flux unknown
    rows = [(float(i), 0.0, 1.0, 1.0) for i in range(99)] + [(50.0, None, 1.0, 1.0), (-1.0, -2.0, None, 0.2)]
    df = series({"a": rows}, "nt", "dt", "q1", "q2")
    out = C.clean_paired_fluxes(df, "nt", "dt", "q1", "q2", 0.5)
    nt = column(out, "nt")
    res = sorted(float(i) for i in range(99))
    lo, hi = res[0] + 0.025 * 98, 0.975 * 98
    assert nt[:99] == [v if lo <= v <= hi else None for v in res]
    assert nt[99] == 50.0
    assert nt[100] is None and column(out, "dt")[100] is None


def fivenum_hinges(x):
    x = sorted(x)
    n = len(x)
    n4 = ((n + 3) // 2) / 2

    def at(d):
        lo, hi = int(d // 1), int(-(-d // 1))
        return 0.5 * (x[lo - 1] + x[hi - 1])

    return at(n4), at(n + 1 - n4)


@pytest.mark.parametrize("n", range(1, 10))
def test_hinges_small_samples(series, n):
    values = [float((7 * i) % 11) + 0.1 * i for i in range(n)]
    row = hinges(series({"a": [*values, None]}, "x"), "x", ["sitename"], "lo", "hi").first()
    assert (row.lo, row.hi) == pytest.approx(fivenum_hinges(values))


def test_quantiles_do_not_depend_on_distribution(series):
    import numpy as np

    rng = np.random.default_rng(0)
    sets = {
        "flat": rng.random(500),
        "spike": np.r_[np.zeros(400), rng.random(100)],
        "far": np.r_[rng.random(499), [1e12]],
        "same": np.full(50, 3.5),
        "one": np.array([2.0]),
    }
    got = {
        r.sitename: (r.a, r.b, r.c)
        for r in quantiles(
            series({k: [float(v) for v in x] for k, x in sets.items()}, "x"), "x", ["sitename"], {"a": 0.025, "b": 0.5, "c": 0.97}
        ).collect()
    }
    for name, x in sets.items():
        assert got[name] == pytest.approx(tuple(np.quantile(x, [0.025, 0.5, 0.97]))), name


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_quantiles_over_many_ranges(spark, ranges):
    import numpy as np

    from siteflux.operators.quantiles import values_at

    rng = np.random.default_rng(7)
    sets = {
        "hot": np.round(rng.normal(0, 5, 3000), 2),
        "far": np.r_[rng.random(300), [-1e9, 1e12]],
        "tiny": np.array([1.0, 2.0]),
        "same": np.full(200, -4.25),
    }
    rows = [(k, float(v)) for k, x in sets.items() for v in x] + [("hot", None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE").repartition(5)
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.975, "e": 1.0}
    positions = {n: (lambda n_, p=p: F.lit(1.0) + (n_ - 1) * p) for n, p in probs.items()}
    got = {r.g: (r.a, r.b, r.c, r.d, r.e) for r in values_at(df, "x", ["g"], positions, partitions=ranges).collect()}
    assert set(got) == set(sets)
    for name, x in sets.items():
        assert got[name] == pytest.approx(tuple(np.quantile(x, list(probs.values())))), name


def test_outliers_use_hinges(series):
    values = [1.0, 2.0, 3.0, 4.0, 100.0, None]
    assert column(C.mask_outliers(series({"a": values}, "x"), "x"), "x") == [1.0, 2.0, 3.0, 4.0, None, None]
