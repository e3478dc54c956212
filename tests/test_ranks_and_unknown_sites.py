"""Ranks by data-following ranges, and group statistics that return to rows of an unknown site."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.operators import cleaning as C
from siteflux.operators.aggregate import normalise, response_quantiles
from siteflux.operators.quantiles import probabilities, quantiles, ranged_counts, values_of
from siteflux.operators.series import anomalies
from siteflux.sources.sinks import stored, workspace


def test_no_range_holds_more_than_its_share(spark):
    # one group, most values in a tiny part of the range, one value repeated for a third of the rows
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0.5).when(F.col("id") < 20, F.col("id") * 1e15).otherwise(F.rand(1)).alias("x")
    )
    counted = ranged_counts(rows.withColumn("g", F.lit("a")), ["g"], "x", 10)
    sizes = [r["count"] for r in counted.groupBy("_part").count().collect()]
    assert len(sizes) == 10 and sum(sizes) > 19_000 and max(sizes) < 2 * sum(sizes) / 10


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_quantiles_of_heavy_tails_and_unknown_groups(spark, by):
    rng = np.random.default_rng(2)
    data = [(g, int(i % 2), float(v)) for g in ("a", None) for i, v in enumerate(np.exp(rng.normal(0, 20, 501)))]
    data += [("none", 0, None), ("a", 1, None)]
    df = spark.createDataFrame(data, "g STRING, h INT, x DOUBLE")
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.999}
    groups = {}
    for g, h, x in data:
        groups.setdefault(tuple({"g": g, "h": h}[k] for k in by), []).append(x)
    for empty in (False, True):
        got = {tuple(r[k] for k in by): (r.lo, r.mid, r.hi) for r in quantiles(df, "x", by, probs, empty).collect()}
        known = {k: [x for x in v if x is not None] for k, v in groups.items()}
        assert set(got) == {k for k, v in known.items() if v or empty}
        for k, value in got.items():
            want = tuple(np.quantile(known[k], list(probs.values()))) if known[k] else (None, None, None)
            assert value == pytest.approx(want)


def test_several_columns_share_one_table_and_nothing_else_stays(spark):
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("*/*"))
    df = spark.createDataFrame([(1, 1.0, None), (1, 3.0, 10.0), (2, None, None)], "step INT, a DOUBLE, b DOUBLE")
    rows = {r.series: (r.m, r.n) for r in values_of(df, ["a", "b"], [], probabilities({"m": 0.5, "n": 1.0})).collect()}
    assert rows == {"a": (2.0, 3.0), "b": (10.0, 10.0)}
    got = {r.step: (r.median, r.q75_x, r.median_x) for r in response_quantiles(df, "step", {"a": "", "b": "_x"}).collect()}
    assert got == {1: (2.0, 10.0, 10.0), 2: (None, None, None)}
    assert [p.name for p in set(shared.glob("*/*")) - before] == ["quantiles"] * 2


def test_workspace_is_deleted_after_an_error(spark, tmp_path):
    with pytest.raises(RuntimeError), workspace(spark, str(tmp_path)) as folder:
        stored(spark.range(3), "x", folder)
        assert len(list(tmp_path.iterdir())) == 1
        raise RuntimeError
    assert not list(tmp_path.iterdir())


def test_rows_of_an_unknown_site_are_cleaned_too(spark):
    days = [(s, i, v) for s in ("a", None) for i, v in enumerate([1.0, 2.0, 3.0, 4.0, 1e6])]
    df = spark.createDataFrame(days, "sitename STRING, date INT, x DOUBLE")
    assert {r.sitename for r in C.mask_outliers(df, "x").where("x IS NULL").collect()} == {"a", None}
    assert normalise(df, ["x"], "p97").where("x IS NULL").isEmpty()
    repeated = spark.createDataFrame([(s, i, 5.0) for s in ("a", None) for i in range(3)], "sitename STRING, date INT, x DOUBLE")
    assert C.mask_repeated_values(repeated, "x").where("x IS NOT NULL").isEmpty()
    means = spark.createDataFrame([("a", 1.0, 2.0), (None, 3.0, 4.0)], "sitename STRING, mod_mean DOUBLE, obs_mean DOUBLE")
    pair = spark.createDataFrame([("a", 1.0, 2.0), (None, 3.0, 4.0)], "sitename STRING, gpp_mod DOUBLE, gpp_obs DOUBLE")
    assert anomalies(pair, means, ["sitename"]).where("gpp_mod <> 0 OR gpp_obs <> 0 OR gpp_mod IS NULL").isEmpty()
