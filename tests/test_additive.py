"""Penalised splines from sums against least squares on the whole design matrix."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteflux.plans import additive as S
from siteflux.plans import learn as L


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(12)
    x = rng.uniform(0, 10, (400, 2))
    y = np.sin(x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([tuple(map(float, (*a, b, 2 * a[0] + 1))) for a, b in zip(x, y)], "u DOUBLE, v DOUBLE, y DOUBLE, line DOUBLE")
    return x, y, df.withColumn("temp", F.lit(1.0))


def design(x, model):
    parts = [np.ones((len(x), 1))]
    for i, (breaks, pieces) in enumerate(model.splines.values()):
        at = np.clip(np.searchsorted(breaks, x[:, i], "right") - 1, 0, len(pieces) - 1)
        gap = x[:, i] - breaks[at]
        parts.append(np.einsum("nbp,np->nb", pieces[at], gap[:, None] ** np.arange(pieces.shape[2])))
    return np.hstack(parts)


def fitted(df, model, name="fit"):
    return np.array([r[name] for r in model.transform(df).select(name).collect()])


def test_basis_functions_sum_to_one_and_join_smoothly():
    breaks = np.array([0.0, 0.5, 2.0, 2.25, 7.0])
    pieces = S.spline_pieces(breaks, 3)
    assert pieces.shape == (4, 7, 4)
    for a, b, coef in zip(breaks[:-1], breaks[1:], pieces):
        for gap in np.linspace(0, b - a, 5):
            assert (coef @ gap ** np.arange(4)).sum() == pytest.approx(1) and (coef @ gap ** np.arange(4)).min() > -1e-12
    for i in range(3):
        gap = breaks[i + 1] - breaks[i]
        for order in range(3):  # value, slope and curvature agree on both sides of a break
            factor = np.array([np.prod(np.arange(p, p - order, -1)) if p >= order else 0.0 for p in range(4)])
            left = pieces[i] @ (factor * gap ** np.maximum(np.arange(4) - order, 0))
            assert left == pytest.approx(pieces[i + 1][:, order] * factor[order], abs=1e-8)


def test_roughness_is_the_integral_of_squared_curvature():
    breaks = np.array([0.0, 1.0, 3.0, 4.0])
    pieces = S.spline_pieces(breaks, 3)
    weights = np.random.default_rng(0).normal(size=pieces.shape[1])
    total = 0.0
    for a, b, coef in zip(breaks[:-1], breaks[1:], pieces):
        c = weights @ coef
        gap = (np.arange(20000) + 0.5) / 20000 * (b - a)
        total += np.mean((2 * c[2] + 6 * c[3] * gap) ** 2) * (b - a)
    assert weights @ S.roughness(breaks, pieces) @ weights == pytest.approx(total, rel=1e-6)


def test_without_penalty_it_is_least_squares(data):
    x, y, df = data
    model = S.fit_splines(df.repartition(5), {"y": "fit"}, ("u", "v"), knots=4, smoothness=0.0)
    matrix = design(x, model)
    want = matrix @ np.linalg.lstsq(matrix, y, rcond=None)[0]
    assert fitted(df, model) == pytest.approx(want, abs=1e-6)
    assert model.fits["fit"].freedom == pytest.approx(np.linalg.matrix_rank(matrix), abs=1e-6)
    assert model.fits["fit"].rss == pytest.approx(((want - y) ** 2).sum(), rel=1e-6)


def test_with_penalty_it_is_least_squares_on_a_longer_matrix(data):
    x, y, df = data
    model = S.fit_splines(df, {"y": "fit"}, ("u", "v"), knots=4, smoothness=0.01)
    matrix = design(x, model)
    extra, at = [], 1
    for breaks, pieces in model.splines.values():
        rough, part = S.roughness(breaks, pieces), matrix[:, at : at + pieces.shape[1]]
        value, vectors = np.linalg.eigh(rough)
        root = (vectors * np.sqrt(np.maximum(value, 0))).T * np.sqrt(0.01 * (part**2).sum() / np.trace(rough))
        extra.append(np.hstack([np.zeros((len(root), at)), root, np.zeros((len(root), matrix.shape[1] - at - len(root)))]))
        at += pieces.shape[1]
    longer, values = np.vstack([matrix, *extra]), np.append(y, np.zeros(sum(map(len, extra))))
    want = matrix @ np.linalg.lstsq(longer, values, rcond=None)[0]
    assert fitted(df, model) == pytest.approx(want, abs=1e-6)


def test_chosen_smoothness_follows_the_data(data):
    x, y, df = data
    model = L.fit_additive(df, {"y": "fit", "line": "straight"}, ("u", "v"), knots=12)
    rough = S.fit_splines(df, {"y": "fit"}, ("u", "v"), knots=12, smoothness=0.0)
    stiff = S.fit_splines(df, {"y": "fit"}, ("u", "v"), knots=12, smoothness=1e8)
    assert stiff.fits["fit"].freedom < 4 < model.fits["fit"].freedom < rough.fits["fit"].freedom
    assert model.fits["straight"].freedom == pytest.approx(3, abs=0.05)
    truth = np.sin(x[:, 0]) + 0.3 * x[:, 1]
    assert np.sqrt(np.mean((fitted(df, model) - truth) ** 2)) < 0.04
    assert fitted(df, model, "straight") == pytest.approx(2 * x[:, 0] + 1, abs=1e-5)
    beyond = df.sparkSession.createDataFrame([(-5.0, 5.0), (30.0, 5.0), (None, 1.0)], "u DOUBLE, v DOUBLE")
    low, high, unknown = fitted(beyond, model, "straight")
    assert low == pytest.approx(-9, abs=1e-3) and high == pytest.approx(61, abs=1e-3) and unknown is None


def test_constant_predictors_ties_and_no_rows(spark):
    df = spark.createDataFrame([(1.0, float(i % 2), float(i % 2) * 3) for i in range(50)], "u DOUBLE, v DOUBLE, y DOUBLE")
    model = S.fit_splines(df, {"y": "fit"}, ("u", "v"), knots=5)
    assert list(model.splines) == ["v"]
    assert fitted(df, model) == pytest.approx([float(i % 2) * 3 for i in range(50)], abs=1e-6)
    none = S.fit_splines(df.limit(0), {"y": "fit"}, ("u", "v"))
    assert {r.fit for r in none.transform(df).collect()} == {None}


def test_folds_do_not_see_their_rows(spark, series):
    """Changing the known values of one site-year changes no prediction in it."""
    rng = np.random.default_rng(9)
    rows = {}
    for s in "abcd":
        rows[s] = [(float(x), None if rng.random() < 0.2 else float(3 * x + ord(s) + rng.normal(0, 0.1)), 2001 + i / 365) for i, x in enumerate(rng.uniform(0, 5, 800))]
    df = series(rows, "x", "y", "year_dec")
    one = F.expr("sitename = 'b' AND year_dec >= 2002 AND year_dec < 2003")
    other = df.withColumn("y", F.when(one & F.col("y").isNotNull(), F.col("y") * 100 - 7).otherwise(F.col("y")))
    keys = ["sitename", "year_dec"]

    def gaps(frame):
        filled, quality = L.gapfill_out_of_fold(frame, "y", ["x"])
        table = filled.join(frame.select(*keys, F.col("y").alias("raw")), keys)
        return table.where(one & F.col("raw").isNull()).orderBy(*keys).collect(), table, quality.first()

    first, table, quality = gaps(df)
    second, _, _ = gaps(other)
    assert len(first) > 20 and [r.y for r in first] == pytest.approx([r.y for r in second], rel=1e-6)
    assert table.where("raw IS NOT NULL AND raw <> y OR y IS NULL").isEmpty() and table.count() == 3200
    truth = {s: ord(s) for s in "abcd"}
    wrong = [abs(r.y - 3 * r.x - truth[r.sitename]) for r in table.where("raw IS NULL").collect()]
    assert max(wrong) < 1.0 and quality.rsq > 0.99 and quality.nvals == table.where("raw IS NOT NULL").count()


def test_out_of_fold_with_few_rows(series):
    df = series({"a": [(1.0, None, 2001.0), (2.0, None, 2001.5)], "b": [(None, 1.0, 2001.0), (None, 2.0, 2001.5)]}, "x", "y", "year_dec")
    filled, quality = L.gapfill_out_of_fold(df, "y", ["x"])
    assert filled.columns == df.columns and filled.where("sitename = 'b'").where("y IS NULL").isEmpty() and filled.count() == 4
    assert quality.first().nvals == 0
    assert L.gapfill_out_of_fold(df.limit(0), "y", ["x"])[0].count() == 0
