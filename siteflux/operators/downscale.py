"""From months to days: smooth curves that keep the mean, and totals shared out by weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.operators.series import days_in_month, neighbour_months


def months_to_days(
    monthly: DataFrame, cols: dict[str, str], method: str = "polynom", noleap: bool = False, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Daily values of several columns (``cols``: column to its daily name) from one (site, year, moy) table.

    All columns take their neighbours from one pass over the months and become days in one expansion. Columns in
    ``carry`` repeat the month's value, as does ``ndays``, the number of days the month has here. ``polynom`` lays one
    parabola per month through the means shared with the neighbouring months, such that its integral over the month
    is the month's mean; ``step`` repeats the monthly value.
    """
    if method not in ("polynom", "step"):
        raise ValueError("method must be 'polynom' or 'step'")
    year, moy = F.col("year"), F.col("moy")
    length = days_in_month(year, moy)
    ndays = F.when(moy == 2, F.least(length, F.lit(28))).otherwise(length) if noleap else length
    start = F.make_date("year", "moy", F.lit(1))
    days = F.explode(F.sequence(start, F.date_add(start, (ndays - 1).cast("int"))))
    m = monthly.select(SITE, "year", "moy", *dict.fromkeys([*cols, *carry])).withColumn("ndays", ndays)
    if method == "step":
        return m.select(SITE, days.alias(DATE), *[F.col(c).alias(name) for c, name in cols.items()], *carry, "ndays")

    m = neighbour_months(m, list(cols))
    n0 = days_in_month(year, F.when(moy == 1, F.lit(12)).otherwise(moy - 1)).cast("double")
    n2 = days_in_month(year, F.when(moy == 12, F.lit(1)).otherwise(moy + 1)).cast("double")
    # position in days of the month's start, counted from the year's first day
    m = m.withColumns({"_n0": n0, "_n1": length.cast("double"), "_n2": n2, "_t0": F.dayofyear(start) - 0.5})
    # On u in [0, 1] across the month: value(u) = left + u * (right - left) + 6 * bulge * u * (1 - u),
    # whose mean is (left + right) / 2 + bulge.
    u: Column = (F.dayofyear(DATE) - F.col("_t0")) / F.col("_n1")
    curves = {}
    for c in cols:
        this, prev, nxt = F.col(c), F.col(f"{c}_prev"), F.col(f"{c}_next")
        left = (this * F.col("_n1") + prev * F.col("_n0")) / (F.col("_n1") + F.col("_n0"))
        right = (nxt * F.col("_n2") + this * F.col("_n1")) / (F.col("_n2") + F.col("_n1"))
        curves[f"_c_{c}"] = F.struct(left.alias("l"), (right - left).alias("d"), ((this - (left + right) / 2.0) * 6.0).alias("b"))
    daily = m.withColumns(curves).select(SITE, days.alias(DATE), "_t0", "_n1", *curves, *carry, "ndays")
    values = [
        (F.col(f"_c_{c}.l") + F.col(f"_c_{c}.d") * u + F.col(f"_c_{c}.b") * u * (1.0 - u)).alias(name) for c, name in cols.items()
    ]
    return daily.select(SITE, DATE, *values, *carry, "ndays")


def monthly_to_daily(
    monthly: DataFrame, col: str, method: str = "polynom", name: str | None = None, noleap: bool = False
) -> DataFrame:
    """Daily values of one column; see ``months_to_days``."""
    return months_to_days(monthly, {col: name or col}, method, noleap).drop("ndays")


def shared_out(weight: Column, weight_sum: Column, total: Column, threshold: float = 0.1, min_weight_sum: float = 1.0) -> Column:
    """A day's part of a period's total; the sum of weights counts at least ``min_weight_sum``, parts under ``threshold`` are 0."""
    base = F.when(weight_sum < min_weight_sum, F.lit(float(min_weight_sum))).otherwise(weight_sum)
    share = F.try_divide(weight * total, base)
    return F.when(share < threshold, F.lit(0.0)).otherwise(share)


def allocate_period_total(
    daily: DataFrame,
    weight: str,
    totals: DataFrame,
    total: str,
    name: str = "prec",
    threshold: float = 0.1,
    min_weight_sum: float = 1.0,
) -> DataFrame:
    """Share monthly totals out over days in proportion to a weight.

    ``totals`` is keyed (site, year, moy). The sum of weights counts at least ``min_weight_sum``, and shares
    under ``threshold`` become 0; set both to 0 for exact conservation.
    """
    days = daily.withColumns({"year": F.year(DATE), "moy": F.month(DATE)})
    # a month of a site has at most 31 days
    days = days.withColumn("_sum", F.sum(weight).over(Window.partitionBy(SITE, "year", "moy")))
    days = days.join(totals.select(SITE, "year", "moy", F.col(total).alias("_total")), [SITE, "year", "moy"], "left")
    share = shared_out(F.col(weight), F.col("_sum"), F.col("_total"), threshold, min_weight_sum)
    return days.withColumn(name, share).select(*daily.columns, name)
