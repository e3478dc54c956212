"""Mergeable sums of daily series: one table that is read from the days once and rolled up to every other level.

A row sums up the days of one site, year, month and k-day bin. Counts, sums and extremes of a column give its means and
strict sums by bin, month or year; regression moments of complete pairs give skill by site or pooled. Moments are kept
centred within a row, so that merging loses no more than the rounding of the rows' means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.calendar import xday_bin
from siteflux.functions.nulls import all_known

#: What the days are grouped by: months and bins cut each other.
CELL = [SITE, "year", "moy", "inbin"]


def _series_columns(name: str, value: Column) -> list[Column]:
    value = value.cast("double")
    return [
        F.count(value).alias(f"{name}_n"),
        F.sum(value).alias(f"{name}_sum"),
        F.min(value).alias(f"{name}_min"),
        F.max(value).alias(f"{name}_max"),
    ]


def _pair_columns(obs: Column, mod: Column) -> list[Column]:
    obs, mod = obs.cast("double"), mod.cast("double")
    both, gap = all_known(obs, mod), mod - obs
    return [
        F.count(obs).alias("m_obs"),
        F.regr_count(obs, mod).alias("m_n"),
        F.regr_avgx(obs, mod).alias("m_x"),
        F.regr_avgy(obs, mod).alias("m_y"),
        F.regr_sxx(obs, mod).alias("m_xx"),
        F.regr_syy(obs, mod).alias("m_yy"),
        F.regr_sxy(obs, mod).alias("m_xy"),
        F.sum(gap).alias("m_gap"),
        F.sum(gap * gap).alias("m_gap2"),
        *[fn(F.when(both, v)).alias(f"m_{side}{end}") for side, v in (("x", mod), ("y", obs)) for end, fn in (("min", F.min), ("max", F.max))],
    ]


def day_moments(
    days: DataFrame,
    series: dict[str, Column],
    pair: tuple[Column, Column] | None = None,
    rows: Column | None = None,
    k: int = 5,
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """One row per ``CELL``: ``rows`` (where the condition ``rows`` holds), four sums per series, moments of (obs, mod)."""
    counted = F.count(F.lit(1)) if rows is None else F.count(F.when(rows, 1))
    columns = [counted.alias("rows")]
    for name, value in series.items():
        columns += _series_columns(name, value)
    if pair is not None:
        columns += _pair_columns(*pair)
    date = F.col(DATE)
    cell = [F.col(SITE), F.year(date).alias("year"), F.month(date).alias("moy"), xday_bin(date, k, first_year, last_year).alias("inbin")]
    return days.groupBy(*cell).agg(*columns)


def xday_of(moments: DataFrame, name: str, n: str) -> DataFrame:
    """Mean, minimum, maximum and number of known values per k-day bin, as ``xday_aggregate`` gives from the days."""
    return (
        moments.where("rows > 0").groupBy(SITE, "inbin")
        .agg(F.sum(f"{name}_sum").alias("_s"), F.sum(f"{name}_n").alias(n), F.min(f"{name}_min").alias("_lo"), F.max(f"{name}_max").alias("_hi"))
        .select(SITE, "inbin", F.try_divide("_s", n).alias(name), F.col("_lo").alias(f"{name}_min"), F.col("_hi").alias(f"{name}_max"), n)
    )


def _strict(moments: DataFrame, name: str, by: list[str]) -> DataFrame:
    sums = moments.where("rows > 0").groupBy(*by).agg(
        F.sum(f"{name}_sum").alias("_s"), F.sum(f"{name}_n").alias("_k"), F.sum("rows").alias("n")
    )
    return sums.select(*by, F.when(F.col("_k") == F.col("n"), F.col("_s")).alias("_s"), "n")


def monthly_of(moments: DataFrame, name: str) -> DataFrame:
    """Strict mean per site-month and the row count, as ``monthly_mean`` gives from the days."""
    months = _strict(moments, name, [SITE, "year", "moy"])
    return months.select(SITE, "year", "moy", (F.col("_s") / F.col("n")).alias(name), "n")


def annual_of(moments: DataFrame, name: str, min_days: int = 365) -> DataFrame:
    """Strict sum per site-year with at least ``min_days`` rows, as ``annual_sum`` gives from the days."""
    years = _strict(moments, name, [SITE, "year"])
    return years.select(SITE, "year", F.when(F.col("n") >= min_days, F.col("_s")).alias(name), "n")


def pair_moments(df: DataFrame, by: list[str] | None = None, obs: str = "gpp_obs", mod: str = "gpp_mod") -> DataFrame:
    """Regression moments of complete pairs per group of any table."""
    return df.groupBy(*(by or [])).agg(*_pair_columns(F.col(obs), F.col(mod)))


def skill_of(moments: DataFrame, by: list[str] | None = None, min_n: int | None = None) -> DataFrame:
    """Adjusted R², RMSE, slope, bias and number of pairs, from merged moments.

    ``min_n``: only groups with more known observations. Equal to ``skill`` of the rows the moments were taken from.
    """
    n, x, y = F.col("m_n"), F.col("m_x"), F.col("m_y")
    merged = moments.groupBy(*(by or [])).agg(
        F.sum("m_obs").alias("_obs"),
        F.coalesce(F.sum("m_n"), F.lit(0)).alias("nvals"),
        F.sum(n * x).alias("_x"),
        F.sum(n * y).alias("_y"),
        (F.sum("m_xx") + F.sum(n * x * x)).alias("_xx"),
        (F.sum("m_yy") + F.sum(n * y * y)).alias("_yy"),
        (F.sum("m_xy") + F.sum(n * x * y)).alias("_xy"),
        F.sum("m_gap").alias("_gap"),
        F.sum("m_gap2").alias("_gap2"),
        *[fn(f"m_{side}{end}").alias(f"_{side}{end}") for side in "xy" for end, fn in (("min", F.min), ("max", F.max))],
    )
    n = F.col("nvals")

    def centred(a: str, b: str) -> Column:
        return F.col(f"_{a}{b}") - F.try_divide(F.col(f"_{a}") * F.col(f"_{b}"), n)

    # the extremes, not a difference of sums, tell whether a side is constant
    sxx = F.when(F.col("_xmax") > F.col("_xmin"), centred("x", "x"))
    syy = F.when(F.col("_ymax") > F.col("_ymin"), centred("y", "y"))
    sxy = centred("x", "y")
    r2 = F.when(n >= 3, F.try_divide(sxy * sxy, sxx * syy))
    if min_n is not None:
        merged = merged.where(F.col("_obs") > min_n)
    return merged.select(
        *(by or []),
        (1.0 - (1.0 - r2) * F.try_divide(n - 1, n - 2)).alias("rsq"),
        F.sqrt(F.try_divide("_gap2", n)).alias("rmse"),
        F.try_divide(sxy, sxx).alias("slope"),
        F.try_divide("_gap", n).alias("bias"),
        "nvals",
    )
