"""Calibration as aggregates: one pass over the rows for all candidate values, none of them multiplied."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflux import SITE
from siteflux.functions.nulls import all_known
from siteflux.functions.rows import keep_not_c4
from siteflux.operators.masks import calibration_filter, mask_flagged_days, threshold_filter
from siteflux.operators.skill import cost_column
from siteflux.settings import CalibSettings
from siteflux.sources.sinks import stored, workspace


def frange(start: float, stop: float, step: float) -> list[float]:
    """``start`` to ``stop`` inclusive."""
    return [round(start + i * step, 10) for i in range(int(round((stop - start) / step)) + 1)]


# Cutoffs of the sensitivity study.
SOILM_CUTOFFS = tuple(frange(0.1, 0.9, 0.05))
TEMP_CUTOFFS = tuple(frange(0.0, 20.0, 1.0))


def calibration_days(
    obs: DataFrame, settings: CalibSettings = CalibSettings(), sites: DataFrame | None = None,
    flags: DataFrame | None = None,
) -> DataFrame:
    """Observations with the target masked outside the calibration conditions, on the wanted sites."""
    out = calibration_filter(obs, settings.target, settings.temp_min, settings.temp_max, settings.soilm_min)
    if flags is not None:
        out = mask_flagged_days(out, flags, settings.target)
    if sites is not None:
        out = out.join(sites.where(keep_not_c4(F.col("c4"))).select(SITE), SITE, "left_semi")
    return out


def _scale_columns(obs: str, mod: str, kphio_used: float) -> list[Column]:
    pair = all_known(F.col(obs), F.col(mod))
    mo = F.sum(F.when(pair, F.col(mod) * F.col(obs)))
    mm = F.sum(F.when(pair, F.col(mod) * F.col(mod)))
    k = F.try_divide(mo, mm)
    return [
        k.alias("kphio_corr"),
        (k * kphio_used).alias("kphio_opt"),
        F.count(F.lit(1)).alias("ndays"),
    ]


def calibrate_scale(
    df: DataFrame,
    kphio_used: float,
    temp_cutoff: float | None = None,
    soilm_cutoff: float | None = None,
    obs: str = "gpp_obs",
    mod: str = "gpp_mod",
    temp: str = "temp",
    soilm: str = "soilm_mean",
) -> DataFrame:
    """Least-squares factor through the origin, on warm and moist days."""
    if temp_cutoff is not None and soilm_cutoff is not None:
        df = threshold_filter(df, temp_cutoff, soilm_cutoff, temp, soilm)
    return df.agg(*_scale_columns(obs, mod, kphio_used))


def cutoffs_passed(value: Column, cutoffs: list[float]) -> Column:
    """How many of the cutoffs a value exceeds; an unknown value exceeds none."""
    return reduce(add, [F.when(value > F.lit(c), 1).otherwise(0) for c in cutoffs], F.lit(0))


def sensitivity_sweep(
    df: DataFrame,
    kphio_used: float,
    temp_cutoffs: tuple[float, ...] = TEMP_CUTOFFS,
    soilm_cutoffs: tuple[float, ...] = SOILM_CUTOFFS,
    temp_fixed: float = 5.0,
    soilm_fixed: float = 0.4,
    obs: str = "gpp_obs",
    mod: str = "gpp_mod",
    temp: str = "temp",
    soilm: str = "soilm_mean",
) -> DataFrame:
    """The scale for each soil moisture cutoff and for each temperature cutoff: ``swept, cutoff`` and its results.

    The cutoffs span a lattice. A row falls into the cell of the cutoffs that it passes in each direction, and three
    sums per cell are all that is kept of the rows: as many cells as there are pairs of cutoffs, whatever the input. The
    result at a cutoff is the sum over the cells from it on, a suffix sum along the swept direction. Cutoffs that no
    row passes have no days and an unknown scale.
    """
    directions = {"soilm": (soilm, sorted({*map(float, soilm_cutoffs)})), "temp": (temp, sorted({*map(float, temp_cutoffs)}))}
    known = all_known(F.col(obs), F.col(mod))
    cells = df.groupBy(
        *[cutoffs_passed(F.col(c), cutoffs).alias(f"_{name}") for name, (c, cutoffs) in directions.items()],
        F.coalesce(F.col(temp) > temp_fixed, F.lit(False)).alias("_warm"),
        F.coalesce(F.col(soilm) > soilm_fixed, F.lit(False)).alias("_moist"),
    ).agg(
        F.sum(F.when(known, F.col(mod) * F.col(obs))).alias("_mo"),
        F.sum(F.when(known, F.col(mod) * F.col(mod))).alias("_mm"),
        F.count(F.lit(1)).alias("_n"),
    )
    # one cell feeds both directions; the cutoffs themselves are rows without days
    sides = F.array(
        *[
            F.when(F.col(fixed), F.struct(F.lit(name).alias("swept"), F.col(f"_{name}").alias("step"), F.lit(None).cast("double").alias("cutoff")))
            for name, fixed in (("soilm", "_warm"), ("temp", "_moist"))
        ]
    )
    lines = cells.select(F.explode(sides).alias("_s"), "_mo", "_mm", "_n").where("_s IS NOT NULL").select("_s.*", "_mo", "_mm", "_n")
    steps = [(name, i, c, None, None, 0) for name, (_, cutoffs) in directions.items() for i, c in enumerate(cutoffs, 1)]
    spine = df.sparkSession.createDataFrame(steps, "swept STRING, step INT, cutoff DOUBLE, _mo DOUBLE, _mm DOUBLE, _n LONG")
    levels = lines.unionByName(spine).groupBy("swept", "step").agg(
        F.max("cutoff").alias("cutoff"), *[F.sum(c).alias(c) for c in ("_mo", "_mm", "_n")]
    )
    onwards = Window.partitionBy("swept").orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sums = levels.select("swept", "cutoff", *[F.sum(c).over(onwards).alias(c) for c in ("_mo", "_mm", "_n")])
    scale = F.try_divide("_mo", "_mm")
    return sums.where("cutoff IS NOT NULL").select(
        "swept", "cutoff", scale.alias("kphio_corr"), (scale * kphio_used).alias("kphio_opt"), F.col("_n").alias("ndays")
    )


def cost_sweep(
    df: DataFrame,
    model: Callable[[float], Column],
    values: list[float],
    kind: str = "rmse",
    obs: str = "gpp_obs",
    by: list[str] | None = None,
) -> DataFrame:
    """Cost of each candidate value; ``model`` gives the modelled column for a value."""
    named = df.withColumns({f"_m{i}": model(v) for i, v in enumerate(values)})
    parts = [
        F.struct(F.lit(float(v)).alias("value"), cost_column(kind, obs, f"_m{i}").alias("cost"))
        for i, v in enumerate(values)
    ]
    keys = by or []
    return named.groupBy(*keys).agg(F.array(*parts).alias("_cases")).select(*keys, F.inline("_cases"))


def best_value(costs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return costs.groupBy(*(by or [])).agg(F.min_by("value", "cost").alias("value"), F.min("cost").alias("cost"))


def calibrate_grid(
    df: DataFrame,
    model: Callable[[float], Column],
    lower: float,
    upper: float,
    steps: int = 11,
    rounds: int = 2,
    kind: str = "rmse",
    obs: str = "gpp_obs",
    store: bool = True,
) -> DataFrame:
    """Search a parameter range on a grid and refine around the best value.

    A round is one aggregate over the rows; only its ``steps`` costs reach the driver. The rows are written
    once (``store``), so that a round does not repeat what led to them; pass only the columns ``model``
    and ``obs`` need. Returns ``round, value, cost`` for every value tried.
    """
    df = stored(df, "calibration_rows") if store else df
    low, high, tried = lower, upper, []
    for number in range(1, rounds + 1):
        gap = (high - low) / (steps - 1)
        values = [low + i * gap for i in range(steps)]
        rows = cost_sweep(df, model, values, kind, obs).collect()
        tried += [(number, r.value, r.cost) for r in rows]
        known = [r for r in rows if r.cost is not None]
        if not known:
            break
        best = min(known, key=lambda r: r.cost).value
        low, high = max(lower, best - gap), min(upper, best + gap)
    return df.sparkSession.createDataFrame(tried, "round INT, value DOUBLE, cost DOUBLE")


#: Candidates of one round: each is a few sums of one aggregate over the rows.
MOST_CANDIDATES = 512


def calibrate_box(
    df: DataFrame,
    model: Callable[[dict[str, float]], dict[str, Column]],
    box: dict[str, tuple[float, float]],
    weights: dict[str, float],
    steps: int = 5,
    rounds: int = 3,
    kind: str = "rmse",
) -> DataFrame:
    """Search several parameters at once against several targets, in a box that is halved around the best each round.

    ``model`` gives, for values of the parameters, the modelled column of every observed one; ``weights`` names the
    observed columns and what their cost counts in the sum that is minimised. A round tries ``steps`` values per
    parameter, ends included, and all its candidates are one aggregate over the rows, which are written once and
    deleted at the end; only a cost per target and candidate reaches the driver. Pass only the columns the model needs.
    Returns ``round, candidate, <parameters>, target, cost``; a target without a pair has no cost, and its candidate
    cannot be the best.
    """
    if steps < 2 or steps ** len(box) > MOST_CANDIDATES:
        raise ValueError(f"a round of {steps} steps for {len(box)} parameters must have 2 to {MOST_CANDIDATES} candidates")
    names, now, tried = list(box), dict(box), []
    with workspace(df.sparkSession) as folder:
        rows = stored(df, "calibration_rows", folder)
        for number in range(1, rounds + 1):
            axes = [[low + (high - low) / (steps - 1) * i for i in range(steps)] for low, high in now.values()]
            candidates = [dict(zip(names, values)) for values in product(*axes)]
            modelled = rows.select(
                *weights, *[model(c)[t].alias(f"_m{i}_{j}") for i, c in enumerate(candidates) for j, t in enumerate(weights)]
            )
            costs = modelled.agg(
                *[cost_column(kind, t, f"_m{i}_{j}").alias(f"c{i}_{j}") for i in range(len(candidates)) for j, t in enumerate(weights)]
            ).first()
            totals = {}
            for i, c in enumerate(candidates):
                own = [costs[f"c{i}_{j}"] for j in range(len(weights))]
                tried += [(number, i, *map(float, c.values()), t, cost) for t, cost in zip(weights, own)]
                if None not in own:
                    totals[i] = sum(w * cost for w, cost in zip(weights.values(), own))
            if not totals:
                break
            best = candidates[min(totals, key=totals.__getitem__)]
            now = {
                n: (max(box[n][0], best[n] - (high - low) / 4), min(box[n][1], best[n] + (high - low) / 4))
                for n, (low, high) in now.items()
            }
    parameters = ", ".join(f"`{n}` DOUBLE" for n in names)
    return df.sparkSession.createDataFrame(tried, f"round INT, candidate INT, {parameters}, target STRING, cost DOUBLE")


def best_in_box(tried: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The parameters of the least weighted sum of costs, and that sum."""
    fixed = {"round", "candidate", "target", "cost"}
    names = [c for c in tried.columns if c not in fixed]
    weight = F.create_map(*[F.lit(x) for t, w in weights.items() for x in (t, float(w))])
    total = F.when(F.count("cost") == len(weights), F.sum(F.element_at(weight, F.col("target")) * F.col("cost")))
    sums = tried.groupBy("round", "candidate", *names).agg(total.alias("cost")).where("cost IS NOT NULL")
    best = sums.agg(F.min(F.struct("cost", "round", "candidate", *names)).alias("b"))
    return best.where("b IS NOT NULL").select(*[F.col(f"b.{n}").alias(n) for n in names], F.col("b.cost").alias("cost"))
