"""Additive smooth model: penalised splines fitted from one matrix of sums.

Each predictor enters as a spline over breaks at its exact quantiles. One pass sums the products of all basis columns and
targets; the tasks' sums are added by Spark, and what reaches the driver has a size that the number of breaks fixes. The
fit, the smoothness of each predictor and the generalised cross-validation that chooses it follow from these sums
alone, without another look at the rows. Fitted splines are piecewise polynomials, so predictions are plain columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux.operators.quantiles import probabilities, values_of

#: Smoothness tried per predictor, relative to the weight of its data; rounds over the predictors.
SMOOTHNESS = tuple(10.0**e for e in range(-8, 9))
ROUNDS = 3


def spline_pieces(breaks: np.ndarray, degree: int) -> np.ndarray:
    """Coefficients (interval, basis function, power) of the B-splines on ``breaks``, in powers of the distance from
    the interval's left end."""
    knots = np.concatenate([np.repeat(breaks[0], degree), breaks, np.repeat(breaks[-1], degree)])

    def basis(x: np.ndarray) -> np.ndarray:
        out = ((knots[:-1] <= x[:, None]) & (x[:, None] < knots[1:])).astype(float)
        for d in range(1, degree + 1):
            left, right = knots[: -d - 1], knots[d + 1 :]
            with np.errstate(divide="ignore", invalid="ignore"):
                rising = np.nan_to_num((x[:, None] - left) / (knots[d:-1] - left), nan=0.0, posinf=0.0, neginf=0.0)
                falling = np.nan_to_num((right - x[:, None]) / (right - knots[1:-d]), nan=0.0, posinf=0.0, neginf=0.0)
            out = rising * out[:, :-1] + falling * out[:, 1:]
        return out

    inner = (np.arange(degree + 1) + 0.5) / (degree + 1)
    pieces = []
    for a, b in zip(breaks[:-1], breaks[1:]):
        # a power series in the share of the interval is well conditioned; then back to the distance
        shares = np.linalg.solve(np.vander(inner, increasing=True), basis(a + (b - a) * inner))
        pieces.append((shares / (b - a) ** np.arange(degree + 1)[:, None]).T)
    return np.array(pieces)


def roughness(breaks: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """Integrals of the products of second derivatives of the basis functions."""
    out = np.zeros((pieces.shape[1],) * 2)
    at, weight = np.polynomial.legendre.leggauss(pieces.shape[2])
    for a, b, coef in zip(breaks[:-1], breaks[1:], pieces):
        for x, w in zip((at + 1) / 2 * (b - a), weight * (b - a) / 2):
            second = sum((p * (p - 1) * coef[:, p] * x ** (p - 2) for p in range(2, coef.shape[1])), np.zeros(len(coef)))
            out += w * np.outer(second, second)
    return out


def _summing(
    splines: dict[str, tuple[np.ndarray, np.ndarray]], targets: list[str], folds: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function of the pass: products of all columns of (1, basis functions, targets), summed per task.

    With folds there is a sum for each, of the rows outside it; a predictor that is a list has one value per fold.
    """

    def products(columns: dict[str, np.ndarray]) -> np.ndarray:
        n = len(columns[targets[0]])
        parts = [np.ones((n, 1))]
        for name, (breaks, pieces) in splines.items():
            x = columns[name]
            at = np.clip(np.searchsorted(breaks, x, "right") - 1, 0, len(pieces) - 1)
            gap = x - breaks[at]
            value = np.zeros((len(x), pieces.shape[1]))
            for power in range(pieces.shape[2]):
                value += pieces[at, :, power] * (gap**power)[:, None]
            parts.append(value)
        rows = np.hstack([*parts, *[columns[t][:, None] for t in targets]])
        return rows.T @ rows

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            columns = {}
            for name, column in zip(batch.schema.names, batch.columns):
                values = column.flatten() if pa.types.is_list(column.type) else column
                columns[name] = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            for fold in range(folds) if folds else [-1]:
                used = slice(None) if fold < 0 else columns["_fold"][:, 0] != fold
                chosen = {n: c[used, max(fold, 0) if c.shape[1] > 1 else 0] for n, c in columns.items()}
                if folds:  # a row whose list has nothing for this fold has no place in its sum
                    known = ~np.any([np.isnan(chosen[n]) for n in splines], axis=0) if splines else slice(None)
                    chosen = {n: c[known] for n, c in chosen.items()}
                totals[fold] = totals.get(fold, 0.0) + products(chosen)
        for fold, total in totals.items():
            i, j = np.triu_indices(len(total))
            arrays = [pa.array(np.full(len(i), fold), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])]
            yield pa.record_batch(arrays, ["fold", "i", "j", "v"])

    return sums


def gram_matrices(
    train: DataFrame, splines: dict[str, tuple[np.ndarray, np.ndarray]], targets: list[str], folds: int = 0
) -> list[np.ndarray]:
    """Sums of products of (1, basis functions, targets), one of all rows or, per fold (column ``_fold``), one of the
    rows outside it. Only their entries reach the driver."""
    rows = train.select(*dict.fromkeys([*splines, *targets]), *(["_fold"] if folds else []))
    sums = rows.mapInArrow(_summing(splines, targets, folds), "fold int, i int, j int, v double")
    size = 1 + sum(p.shape[1] for _, p in splines.values()) + len(targets)
    out = np.zeros((max(folds, 1), size, size))
    for r in sums.groupBy("fold", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[max(r.fold, 0), r.i, r.j] = out[max(r.fold, 0), r.j, r.i] = r.v
    return list(out)


@dataclass(frozen=True)
class Fit:
    """Weights of (1, basis functions) for one target, with what the choice of smoothness left."""

    weights: np.ndarray
    smoothness: tuple[float, ...]
    freedom: float
    rss: float


def penalised_fit(xx: np.ndarray, xy: np.ndarray, yy: float, blocks: list[tuple[slice, np.ndarray]], smoothness: list[float] | None = None) -> Fit:
    """Least squares with a roughness penalty per block, from sums alone.

    Without ``smoothness`` each block's is chosen from ``SMOOTHNESS`` so that n * rss / (n - freedom)^2 is least. Directions
    that the data do not fix (each block's level beside the constant) take the smallest weights.
    """
    n = xx[0, 0]
    scale = [np.trace(xx[s, s]) / t if (t := np.trace(p)) > 0 else 0.0 for s, p in blocks]

    def fit(chosen: list[float]) -> tuple[float, Fit]:
        a = xx.copy()
        for (s, penalty), strength, unit in zip(blocks, chosen, scale):
            a[s, s] += strength * unit * penalty
        size = np.sqrt(np.maximum(np.diag(a), 1e-300))  # columns of one size make the cut-off meaningful
        inverse = np.linalg.pinv(a / np.outer(size, size), rcond=1e-12, hermitian=True) / np.outer(size, size)
        weights = inverse @ xy
        rss = max(yy - 2 * weights @ xy + weights @ xx @ weights, 0.0)
        freedom = float(np.trace(inverse @ xx))
        score = n * rss / max(n - freedom, 1e-9) ** 2
        return score, Fit(weights, tuple(chosen), freedom, float(rss))

    if smoothness is not None:
        return fit(smoothness)[1]
    # a tie goes to the smoother one
    best = min((fit([s] * len(blocks)) for s in reversed(SMOOTHNESS)), key=lambda x: x[0])
    for _ in range(ROUNDS):
        before = best[1].smoothness
        for i in range(len(blocks)):
            tried = [[*best[1].smoothness[:i], s, *best[1].smoothness[i + 1 :]] for s in reversed(SMOOTHNESS)]
            best = min([best, *map(fit, tried)], key=lambda x: x[0])
        if best[1].smoothness == before:
            break
    return best[1]


def _curve(x: Column, breaks: np.ndarray, coef: np.ndarray) -> Column:
    """The piecewise polynomial (interval, power) as a column, going on as a line beyond the outer breaks."""

    def polynomial(start: float, c: np.ndarray) -> Column:
        gap = x - float(start)
        return reduce(lambda high, low: F.lit(float(low)) + gap * high, reversed(c[:-1].tolist()), F.lit(float(c[-1])))

    last = breaks[-1] - breaks[-2]
    powers = np.arange(coef.shape[1])
    end = float(coef[-1] @ last**powers)
    slope = float(coef[-1, 1:] @ (powers[1:] * last ** (powers[1:] - 1)))
    out = F.when(x < float(breaks[0]), F.lit(float(coef[0, 0])) + (x - float(breaks[0])) * float(coef[0, 1]))
    for start, stop, c in zip(breaks[:-1], breaks[1:], coef):
        out = out.when(x <= float(stop), polynomial(start, c))
    return out.otherwise(F.lit(end) + (x - float(breaks[-1])) * slope)


@dataclass(frozen=True)
class Additive:
    """A fitted additive model: ``transform`` adds one prediction column per target."""

    splines: dict[str, tuple[np.ndarray, np.ndarray]]
    fits: dict[str, Fit | None]

    def column(self, name: str) -> Column:
        """The prediction; null where a predictor is unknown or nothing could be fitted."""
        fit = self.fits[name]
        if fit is None:
            return F.lit(None).cast("double")
        terms, at = [F.lit(float(fit.weights[0]))], 1
        for predictor, (breaks, pieces) in self.splines.items():
            weights = fit.weights[at : at + pieces.shape[1]]
            terms.append(_curve(F.col(predictor).cast("double"), breaks, np.einsum("ibp,b->ip", pieces, weights)))
            at += pieces.shape[1]
        return reduce(add, terms)

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({name: self.column(name) for name in self.fits})


def fit_splines(
    train: DataFrame,
    targets: dict[str, str],
    predictors: tuple[str, ...],
    knots: int = 8,
    degree: int = 3,
    smoothness: float | None = None,
) -> Additive:
    """Fit on complete rows (a stored table is read twice); ``targets`` maps a column to the name of its prediction.

    ``knots`` inner breaks per predictor lie at its quantiles, equal ones counted once; a constant predictor has no
    spline. ``degree`` 1 without knots is a straight line. ``smoothness`` fixes what is otherwise chosen per predictor.
    """
    doubles = train.select(*[F.col(c).cast("double").alias(c) for c in dict.fromkeys([*predictors, *targets])])
    splines = splines_at_quantiles(doubles, predictors, knots, degree)
    sums = gram_matrices(doubles, splines, list(targets))[0]
    return Additive(splines, _fits(sums, splines, list(targets.values()), smoothness))


def splines_at_quantiles(train: DataFrame, predictors: tuple[str, ...], knots: int, degree: int = 3) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Breaks and pieces per predictor that is not constant."""
    probs = {f"q{i}": i / (knots + 1) for i in range(knots + 2)}
    table = values_of(train, list(predictors), [], probabilities(probs))
    quantiles = {r.series: [r[q] for q in probs] for r in table.collect()}
    breaks = {p: np.unique(quantiles.get(p, [])) for p in predictors}
    return {p: (b, spline_pieces(b, degree)) for p, b in breaks.items() if len(b) > 1}


def _fits(
    sums: np.ndarray, splines: dict[str, tuple[np.ndarray, np.ndarray]], names: list[str], smoothness: float | None = None
) -> dict[str, Fit | None]:
    size = len(sums) - len(names)
    blocks, at = [], 1
    for breaks, pieces in splines.values():
        blocks.append((slice(at, at + pieces.shape[1]), roughness(breaks, pieces)))
        at += pieces.shape[1]
    fixed = None if smoothness is None else [smoothness] * len(blocks)
    return {
        name: penalised_fit(sums[:size, :size], sums[:size, y], sums[y, y], blocks, fixed) if sums[0, 0] else None
        for y, name in enumerate(names, size)
    }


def fit_out_of_fold(
    train: DataFrame, target: str, predictors: tuple[str, ...], lists: tuple[str, ...], folds: int, knots: int = 8
) -> list[Additive]:
    """One model per fold (column ``_fold``) that has seen none of its rows, all from one pass.

    A predictor in ``lists`` is an array with one value per fold, for what must itself be made without the fold; the
    model of a fold reads that fold's value, as a straight line, since quantiles would know all folds.
    """
    line = np.array([0.0, 1.0])
    splines = splines_at_quantiles(train, tuple(p for p in predictors if p not in lists), knots)
    splines |= {p: (line, spline_pieces(line, 1)) for p in lists}
    sums = gram_matrices(train, splines, [target], folds)
    return [Additive(splines, _fits(s, splines, ["_prediction"])) for s in sums]
