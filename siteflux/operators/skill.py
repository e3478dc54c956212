"""Model-observation skill: one pass of regression aggregates, pooled or per group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux import SITE
from siteflux.functions.nulls import all_known


def _pair(obs: str, mod: str) -> Column:
    return all_known(F.col(obs), F.col(mod))


def adjusted_r2(obs: str, mod: str) -> Column:
    """Adjusted R² of obs on mod; null below three pairs or for constant observations."""
    n = F.regr_count(obs, mod)
    in_pair = F.when(_pair(obs, mod), F.col(obs))
    r2 = F.when((n >= 3) & (F.max(in_pair) > F.min(in_pair)), F.regr_r2(obs, mod))
    return 1.0 - (1.0 - r2) * F.try_divide(n - 1, n - 2)


def rmse(obs: str, mod: str) -> Column:
    return F.sqrt(F.avg(F.pow(F.col(mod) - F.col(obs), F.lit(2.0))))


def skill_columns(obs: str, mod: str) -> list[Column]:
    return [
        adjusted_r2(obs, mod).alias("rsq"),
        rmse(obs, mod).alias("rmse"),
        F.regr_slope(obs, mod).alias("slope"),
        F.avg(F.col(mod) - F.col(obs)).alias("bias"),
        F.regr_count(obs, mod).alias("nvals"),
    ]


def skill(df: DataFrame, by: list[str] | None = None, obs: str = "gpp_obs", mod: str = "gpp_mod") -> DataFrame:
    """Adjusted R², RMSE, slope, bias and number of complete pairs."""
    columns = skill_columns(obs, mod)
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def skill_by_site(
    df: DataFrame, min_n: int | None = 2, by: list[str] | None = None, obs: str = "gpp_obs", mod: str = "gpp_mod"
) -> DataFrame:
    """Skill per site, only for sites with more than ``min_n`` known observations (``None``: all sites)."""
    out = df.groupBy(*(by or [SITE])).agg(*skill_columns(obs, mod), F.count(obs).alias("_n"))
    if min_n is not None:
        out = out.where(F.col("_n") > min_n)
    return out.drop("_n")


def skill_pooled(levels: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """One row of pooled skill per level; values are (table, observed column, modelled column)."""
    rows = [
        skill(df, obs=obs, mod=mod).select(F.lit(level).alias("level"), "*")
        for level, (df, obs, mod) in levels.items()
    ]
    return reduce(DataFrame.unionByName, rows)


def skill_extended(
    df: DataFrame, by: list[str] | None = None, obs: str = "gpp_obs", mod: str = "gpp_mod"
) -> DataFrame:
    """Skill with percent RMSE, Nash-Sutcliffe efficiency and relative bias.

    ``nse`` relates the error to the variance of the observations, ``nse_ref`` to that of the model.
    ``n_obs`` counts known observations, not pairs.
    """
    error = F.sum(F.pow(F.col(mod) - F.col(obs), F.lit(2.0)))
    columns = [
        *skill_columns(obs, mod),
        (rmse(obs, mod) * 100.0 / F.nullif(F.avg(obs), F.lit(0.0))).alias("prmse"),
        (1.0 - F.try_divide(error, F.regr_syy(obs, mod))).alias("nse"),
        (1.0 - F.try_divide(error, F.regr_sxx(obs, mod))).alias("nse_ref"),
        F.avg(F.try_divide(F.col(mod) - F.col(obs), F.col(obs))).alias("rel_bias"),
        F.count(obs).alias("n_obs"),
    ]
    return df.groupBy(*by).agg(*columns) if by else df.agg(*columns)


def cost_column(kind: str, obs: str, mod: str, scale: Column | float = 1.0) -> Column:
    """``rmse``, ``mae``, ``inverse_rmse`` or ``scaled_rmse`` (model times ``scale``)."""
    gap = F.col(mod) - F.col(obs)
    if kind == "rmse":
        return rmse(obs, mod)
    if kind == "mae":
        return F.avg(F.abs(gap))
    if kind == "inverse_rmse":
        return F.try_divide(F.lit(1.0), rmse(obs, mod))
    if kind == "scaled_rmse":
        return F.sqrt(F.avg(F.pow(F.col(mod) * scale - F.col(obs), F.lit(2.0))))
    raise ValueError(f"unknown cost {kind!r}")


def cost(
    df: DataFrame,
    kind: str = "rmse",
    by: list[str] | None = None,
    obs: str = "gpp_obs",
    mod: str = "gpp_mod",
    scale: Column | float = 1.0,
) -> DataFrame:
    column = cost_column(kind, obs, mod, scale).alias("cost")
    return df.groupBy(*by).agg(column) if by else df.agg(column)


def anomaly_histogram(df: DataFrame, cols: list[str], bins: int = 20) -> DataFrame:
    """Density per equal-width bin, with the sample standard deviation, for each column.

    The value range and spread come from one aggregate and return to the rows as one row per named column, a number
    fixed by the call, so that these few rows are broadcast and the values are not dealt by their series.
    """
    sides = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(F.explode(sides).alias("_s")).select("_s.*").where(F.col("v").isNotNull())
    stats = long.groupBy("series").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("total"), F.stddev_samp("v").alias("sd")
    )
    width = F.col("hi") - F.col("lo")
    share = F.when(width > 0, (F.col("v") - F.col("lo")) / width).otherwise(F.lit(0.0))
    placed = long.join(F.broadcast(stats), "series").withColumn("bin", F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int"))
    # all other keys are functions of the series
    out = placed.groupBy("series", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("lo", "hi", "total", "sd")]
    )
    step = (F.col("hi") - F.col("lo")) / bins
    return out.select(
        "series",
        "bin",
        (F.col("lo") + step * F.col("bin")).alias("bin_start"),
        "n",
        F.try_divide(F.col("n"), F.col("total") * step).alias("density"),
        "sd",
    )


def metrics_table(pooled: DataFrame, digits: int = 2) -> DataFrame:
    """Display form of the pooled metrics."""
    return pooled.select(
        F.col("level").alias("Level"),
        F.col("nvals").alias("N"),
        *[F.round(c, digits).alias(n) for c, n in (("rsq", "R2"), ("rmse", "RMSE"), ("slope", "Slope"), ("bias", "Bias"))],
    )
