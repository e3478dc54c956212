"""Aggregations in time and across sites. All are partial-then-final aggregates over the natural keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from siteflux import DATE, SITE
from siteflux.functions.calendar import week_of_year, xday_bin
from siteflux.functions.nulls import strict_mean, strict_sum
from siteflux.functions.rows import hemisphere
from siteflux.operators.groups import join_keys, with_stats
from siteflux.operators.quantiles import beside, probabilities, values_of
from siteflux.operators.series import interpolate_linear

PERIODS = ("week", "month", "year")


def annual_sum(df: DataFrame, col: str = "gpp_mod", min_days: int = 365) -> DataFrame:
    """Sum per site-year, null if a day is unknown or there are fewer than ``min_days`` rows."""
    out = df.groupBy(SITE, F.year(DATE).alias("year")).agg(
        strict_sum(F.col(col)).alias(col), F.count(F.lit(1)).alias("n")
    )
    return out.withColumn(col, F.when(F.col("n") >= min_days, F.col(col)))


def monthly_mean(df: DataFrame, col: str = "gpp_mod") -> DataFrame:
    """Mean per site-month, null if a day is unknown, and the row count."""
    return df.groupBy(SITE, F.year(DATE).alias("year"), F.month(DATE).alias("moy")).agg(
        strict_mean(F.col(col)).alias(col), F.count(F.lit(1)).alias("n")
    )


def xday_aggregate(
    df: DataFrame,
    col: str = "gpp_obs",
    k: int = 5,
    n: str = "n_obs",
    first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """Mean, minimum, maximum and number of known values per k-day bin, of all years or a range of them."""
    return df.groupBy(SITE, xday_bin(F.col(DATE), k, first_year, last_year).alias("inbin")).agg(
        F.avg(col).alias(col),
        F.min(col).alias(f"{col}_min"),
        F.max(col).alias(f"{col}_max"),
        F.count(col).alias(n),
    )


def valid_count(df: DataFrame, col: str = "gpp_obs", name: str = "ndailygpp") -> DataFrame:
    return df.groupBy(SITE).agg(F.count(col).alias(name))


def multiyear_mean(annual: DataFrame, cols: tuple[str, ...] = ("gpp_obs", "gpp_mod")) -> DataFrame:
    """Mean of annual values per site: the spatial table."""
    return annual.groupBy(SITE).agg(*[F.avg(c).alias(c) for c in cols])


def _seasonal_cycle(df: DataFrame, key: str, by: list[str], obs: str, mod: str) -> DataFrame:
    stats = [
        fn(col).alias(f"{side}_{name}")
        for side, col in (("obs", obs), ("mod", mod))
        for name, fn in (("mean", F.avg), ("min", F.min), ("max", F.max))
    ]
    cycle = df.groupBy(*by, key).agg(*stats)
    # a mean cycle has at most one row per day of year, so a plain window is bounded
    return interpolate_linear(cycle, ["obs_mean", "obs_min", "obs_max"], by, key, bounded=True)


def mean_seasonal_cycle_doy(df: DataFrame, obs: str = "gpp_obs", mod: str = "gpp_mod") -> DataFrame:
    """Mean, minimum and maximum per site and day of year (366 left out); observed ones interpolated."""
    days = df.withColumn("doy", F.dayofyear(DATE)).where(F.col("doy") != 366)
    return _seasonal_cycle(days, "doy", [SITE], obs, mod)


def mean_seasonal_cycle_xoy(xdf: DataFrame, obs: str = "gpp_obs", mod: str = "gpp_mod") -> DataFrame:
    """The same by day of year of the bin start."""
    return _seasonal_cycle(xdf.withColumn("xoy", F.dayofyear("inbin")), "xoy", [SITE], obs, mod)


def zone_seasonal_cycle(
    df: DataFrame, sites: DataFrame, code: str = "koeppen_code", obs: str = "gpp_obs", mod: str = "gpp_mod"
) -> DataFrame:
    """Median and 33/66 percent quantiles per climate zone, hemisphere and day of year, sites pooled."""
    zones = sites.select(SITE, F.col(code), hemisphere(F.col("lat")).alias("hemisphere"))
    days = (
        df.withColumn("doy", F.dayofyear(DATE)).where(F.col("doy") != 366).select(SITE, "doy", obs, mod)
        .join(zones, SITE, "left")
    )
    keys = [code, "hemisphere", "doy"]
    # null-safe stand-ins keep sites without class or latitude as zones of their own
    days = days.withColumns({k: F.coalesce(F.col(k), F.lit("-")) for k in (code, "hemisphere")})
    probs = probabilities({"mean": 0.5, "min": 0.33, "max": 0.66})
    q = values_of(days.withColumnsRenamed({obs: "obs_", mod: "mod_"}), ["obs_", "mod_"], keys, probs, empty=True)
    cycle = q.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("series") == f"{s}_", F.col(n))).alias(f"{s}_{n}")
            for s in ("obs", "mod")
            for n in ("mean", "min", "max")
        ]
    )
    cycle = interpolate_linear(cycle, ["obs_mean", "obs_min", "obs_max"], [code, "hemisphere"], "doy", bounded=True)
    labelled = sites.select(
        F.coalesce(F.col(code), F.lit("-")).alias(code),
        F.coalesce(hemisphere(F.col("lat")), F.lit("-")).alias("hemisphere"),
    )
    nsites = labelled.groupBy(code, "hemisphere").agg(F.count(F.lit(1)).alias("nsites"))
    out = cycle.join(nsites, [code, "hemisphere"], "left")
    return out.withColumn("climatezone", F.concat_ws(" ", code, "hemisphere"))


def roll_up(
    df: DataFrame, freq: str, sums: tuple[str, ...] = ("gpp", "aet", "pet"), means: tuple[str, ...] = ("wcont", "fpar")
) -> DataFrame:
    """Days to weeks, months or years of one site and year; ``date`` is the first day seen."""
    if freq not in PERIODS:
        raise ValueError(f"freq must be one of {PERIODS}")
    keys = [F.col(SITE), F.year(DATE).alias("year")]
    if freq == "month":
        keys.append(F.month(DATE).alias("month"))
    elif freq == "week":
        keys.append(week_of_year(F.col(DATE)).alias("week"))
    return df.groupBy(*keys).agg(
        F.min(DATE).alias(DATE),
        *[strict_sum(F.col(c)).alias(c) for c in sums if c in df.columns],
        *[strict_mean(F.col(c)).alias(c) for c in means if c in df.columns],
    )


def monthly_mean_all(df: DataFrame) -> DataFrame:
    """Mean of every numeric column per site-month, over the known values."""
    keys = {SITE, DATE, "year", "month"}
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in keys]
    return df.groupBy(SITE, F.year(DATE).alias("year"), F.month(DATE).alias("month")).agg(
        *[F.avg(c).alias(c) for c in numeric]
    )


def distinct_legend(df: DataFrame, code: str, word: str) -> DataFrame:
    """One word per code, without the null and ``-`` entries."""
    kept = df.where(F.col(code).isNotNull() & (F.col(code) != "-"))
    return kept.groupBy(code).agg(F.min(word).alias(word)).orderBy(code)


def mean_by_doy_fill(df: DataFrame, col: str = "fapar") -> DataFrame:
    """Fill unknown values with the site's mean of that day of year."""
    # one row per site, day of year and year: the window's groups are bounded and spread a large site
    same_day = Window.partitionBy(SITE, F.dayofyear(DATE))
    return df.withColumn(col, F.coalesce(F.col(col), F.avg(col).over(same_day)))


def normalise(df: DataFrame, cols: list[str], kind: str, by: list[str] | None = None) -> DataFrame:
    """Scale per site by the maximum, by the 97 percent quantile, or from minimum to maximum."""
    by = by or [SITE]
    if kind == "p97":
        table = beside(values_of(df, cols, by, probabilities({"_q": 0.97})), by, {c: f"_{c}" for c in cols}, ["_q"])
        out = join_keys(df, table, by)
        return out.withColumns({c: F.try_divide(F.col(c), F.col(f"_q_{c}")) for c in cols}).select(*df.columns)
    stats = {f"_hi_{c}": F.max(c) for c in cols}
    if kind == "minmax":
        stats |= {f"_lo_{c}": F.min(c) for c in cols}
    elif kind != "max":
        raise ValueError("kind must be 'max', 'p97' or 'minmax'")
    low = {c: F.col(f"_lo_{c}") if kind == "minmax" else F.lit(0.0) for c in cols}
    scaled = {c: F.try_divide(F.col(c) - low[c], F.col(f"_hi_{c}") - low[c]) for c in cols}
    return with_stats(df, by, **stats).withColumns(scaled).select(*df.columns)


def run_years(sites: DataFrame, start: str = "year_start", end: str = "year_end") -> DataFrame:
    return sites.withColumn("nyears", F.col(end) - F.col(start) + 1)


def total_run_years(sites: DataFrame, start: str = "year_start", end: str = "year_end") -> DataFrame:
    return run_years(sites, start, end).agg(F.sum("nyears").alias("total_years"))


def response_quantiles(df: DataFrame, step: str, predictions: dict[str, str]) -> DataFrame:
    """Median and four quantiles of each prediction per step of one variable.

    ``predictions`` maps a column to the suffix of its outputs, for example ``{"fit_obs": ""}``. All columns come
    from one table of counted values; a step may hold any number of rows. Steps without a known prediction have nulls.
    """
    probs = {"median": 0.5, "q33": 0.33, "q66": 0.66, "q25": 0.25, "q75": 0.75}
    table = values_of(df, list(predictions), [step], probabilities(probs), empty=True)
    return beside(table, [step], predictions, list(probs))
