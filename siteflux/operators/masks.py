"""Column families, masks and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.nulls import null_if, null_where
from siteflux.operators.groups import with_stats

# Fixed value: first day with satellite data.
FIRST_SATELLITE_DAY = "2000-02-18"


def select_family(df: DataFrame, starts: str, ends: str = "", not_ends: str = "") -> list[str]:
    """Names of the columns that start (and end, or do not end) with the given text."""
    return [
        c
        for c in df.columns
        if c.startswith(starts) and c.endswith(ends) and not (not_ends and c.endswith(not_ends))
    ]


def family_with_flags(df: DataFrame, starts: str = "SWC", flag: str = "_QC") -> list[tuple[str, str | None]]:
    """Each value column of a family with its flag column, paired by name."""
    values = select_family(df, starts, not_ends=flag.lstrip("_"))
    return [(v, v + flag if v + flag in df.columns else None) for v in values]


def mask_where(df: DataFrame, col: str, cond: Column) -> DataFrame:
    """Null the column where the condition is true or unknown."""
    return df.withColumn(col, null_if(cond, F.col(col)))


def calibration_filter(
    df: DataFrame,
    target: str = "gpp_obs",
    temp_min: float | None = None,
    temp_max: float | None = None,
    soilm_min: float | None = None,
    date_min: str | None = FIRST_SATELLITE_DAY,
    temp: str = "temp",
    soilm: str = "soilm_obs_mean",
) -> DataFrame:
    """Mask the target on early, cold, hot and dry days; unknown temperature or moisture masks it too."""
    value = F.col(target)
    if date_min is not None:
        value = null_if(F.col(DATE) < F.lit(date_min).cast("date"), value)
    if temp_min is not None:
        value = null_if(F.col(temp) < temp_min, value)
    if temp_max is not None:
        value = null_if(F.col(temp) > temp_max, value)
    if soilm_min is not None:
        value = null_if(F.col(soilm) < soilm_min, value)
    return df.withColumn(target, value)


def mask_flagged_days(
    obs: DataFrame, flags: DataFrame, target: str = "gpp_obs", flag: str = "is_flue_drought", cluster: str = "cluster"
) -> DataFrame:
    """Mask the target on flagged days, and on days or sites the flag table does not cover."""
    known = flags.where(F.col(cluster).isNotNull()).select(SITE, DATE, F.col(flag).alias("_flag"))
    joined = obs.join(known, [SITE, DATE], "left")
    return mask_where(joined, target, F.col("_flag")).select(*obs.columns)


def mask_low_quality(df: DataFrame, value: str, qc: str, cutoff: float) -> DataFrame:
    """Null the value where its flag is below the cutoff; an unknown flag keeps it."""
    return df.withColumn(value, null_where(F.col(qc) < cutoff, F.col(value)))


def mask_if_no_qc_in_scope(df: DataFrame, value: str, qc: str, by: list[str] | None = None) -> DataFrame:
    """Where a site has flags at all, null the values whose flag is unknown."""
    marked = with_stats(df, by or [SITE], _has_qc=F.max(F.col(qc).isNotNull()))
    drop = F.col("_has_qc") & F.col(qc).isNull()
    return marked.withColumn(value, null_where(drop, F.col(value))).select(*df.columns)


def mask_negative(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: null_where(F.col(c) < 0, F.col(c)) for c in cols})


def complete_cases(df: DataFrame, cols: list[str], temp: str | None = None) -> DataFrame:
    """Rows with every listed column known and, if ``temp`` is named, above zero degrees."""
    out = df.dropna(subset=cols)
    return out if temp is None else out.where(F.col(temp) > 0)


def coalesce_sources(df: DataFrame, target: str, sources: list[str]) -> DataFrame:
    """First known source by priority; sources the table lacks are passed over."""
    present = [F.col(c) for c in sources if c in df.columns]
    if not present:
        return df.withColumn(target, F.lit(None).cast("double"))
    return df.withColumn(target, F.coalesce(*present))


def threshold_filter(
    df: DataFrame, temp_cutoff: float, soilm_cutoff: float, temp: str = "temp", soilm: str = "soilm_mean"
) -> DataFrame:
    return df.where((F.col(temp) > temp_cutoff) & (F.col(soilm) > soilm_cutoff))


def with_bias(df: DataFrame, mod: str = "gpp_mod", obs: str = "gpp_obs", name: str = "bias") -> DataFrame:
    return df.withColumn(name, F.col(mod) - F.col(obs))
