"""Cleaning of flux series: repeated values, paired fluxes, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux import SITE
from siteflux.functions.nulls import null_where
from siteflux.operators.groups import join_keys
from siteflux.operators.masks import mask_if_no_qc_in_scope, mask_low_quality, mask_negative
from siteflux.operators.quantiles import hinges, quantiles

# Fixed value: tolerance of the repeated-value rule.
REPEAT_EPS = 1e-4


def mask_repeated_values(
    df: DataFrame, col: str, by: list[str] | None = None, min_repeats: int = 3, eps: float = REPEAT_EPS
) -> DataFrame:
    """Null every value within ``eps`` of one that occurs at least ``min_repeats`` times in its site.

    Suspicious values are cut into bins of width ``eps``. Per bin only the extremes of the bin below, the
    bin itself and the bin above matter, so each row meets at most one partner, by equality.
    """
    by = by or [SITE]
    value = F.col(col).cast("double")

    def bin_of(v: Column) -> Column:
        return F.floor(v / eps)

    counts = df.where(F.col(col).isNotNull()).groupBy(*by, value.alias("_s")).agg(F.count(F.lit(1)).alias("_c"))
    suspicious = counts.where(F.col("_c") >= min_repeats)
    per_bin = suspicious.groupBy(*by, bin_of(F.col("_s")).alias("_b")).agg(
        F.min("_s").alias("lo"), F.max("_s").alias("hi")
    )
    offsets = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    spread = per_bin.select(*by, "lo", "hi", "_b", F.explode(offsets).alias("_o"))
    near = spread.groupBy(*by, (F.col("_b") + F.col("_o")).alias("_bin")).agg(
        F.max(F.when(F.col("_o") == 1, F.col("hi"))).alias("_below"),
        F.max(F.when(F.col("_o") == 0, F.col("lo"))).alias("_own"),
        F.min(F.when(F.col("_o") == -1, F.col("lo"))).alias("_above"),
    )
    rows = join_keys(df.withColumn("_bin", bin_of(value)), near, [*by, "_bin"])

    def within(s: str) -> Column:
        return F.coalesce(F.abs(value - F.col(s)) < eps, F.lit(False))

    hit = within("_below") | F.col("_own").isNotNull() | within("_above")
    return rows.withColumn(col, null_where(hit, F.col(col))).select(*df.columns)


def clean_paired_fluxes(
    df: DataFrame,
    first: str = "GPP_NT_VUT_REF",
    second: str = "GPP_DT_VUT_REF",
    first_qc: str = "NEE_VUT_REF_NIGHT_QC",
    second_qc: str = "NEE_VUT_REF_DAY_QC",
    cutoff: float = 0.8,
    by: list[str] | None = None,
) -> DataFrame:
    """Drop poor quality, then pairs whose difference is outside the middle 95 percent, then negatives.

    A day with an unknown difference is kept.
    """
    by = by or [SITE]
    out = mask_low_quality(df, first, first_qc, cutoff)
    out = mask_low_quality(out, second, second_qc, cutoff)
    out = out.withColumn("_res", F.col(first) - F.col(second))
    bounds = quantiles(out, "_res", by, {"_q_low": 0.025, "_q_high": 0.975})
    out = join_keys(out, bounds, by)
    outside = (F.col("_res") > F.col("_q_high")) | (F.col("_res") < F.col("_q_low"))
    out = out.withColumns({c: null_where(outside, F.col(c)) for c in (first, second)})
    return mask_negative(out, first, second).select(*df.columns)


def clean_et(
    df: DataFrame, value: str = "LE_F_MDS", qc: str = "LE_F_MDS_QC", cutoff: float = 0.2, by: list[str] | None = None
) -> DataFrame:
    """Quality cutoff, unflagged rows of flagged sites, then repeated values."""
    out = mask_low_quality(df, value, qc, cutoff)
    out = mask_if_no_qc_in_scope(out, value, qc, by)
    return mask_repeated_values(out, value, by)


def clean_swc(df: DataFrame, pairs: list[tuple[str, str | None]], cutoff: float = 0.2) -> DataFrame:
    """Quality cutoff on a family of soil water columns and their flags."""
    out = df
    for value, qc in pairs:
        if qc is not None:
            out = mask_low_quality(out, value, qc, cutoff)
    return out


def mask_outliers(df: DataFrame, col: str, coef: float = 1.5, by: list[str] | None = None) -> DataFrame:
    """Null values more than ``coef`` hinge spreads outside Tukey's hinges of their site."""
    by = by or [SITE]
    bounds = hinges(df, col, by, "_h1", "_h2")
    out = join_keys(df, bounds, by)
    reach = (F.col("_h2") - F.col("_h1")) * coef
    outside = (F.col(col) < F.col("_h1") - reach) | (F.col(col) > F.col("_h2") + reach)
    return out.withColumn(col, null_where(outside, F.col(col))).select(*df.columns)
