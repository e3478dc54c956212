"""Joins on site and date, dimension joins and coverage checks.

No join carries a broadcast hint: Spark broadcasts a side whose size, read from the files or measured at
run time, is under its threshold, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.calendar import decimal_year, is_leap_day


def attach_model(obs: DataFrame, mod: DataFrame, keys: list[str]) -> DataFrame:
    """Keep every observation and add the model's columns for the same keys."""
    clash = [c for c in mod.columns if c in obs.columns and c not in keys]
    return obs.join(mod.drop(*clash), list(keys), "left")


def calendar_spine(
    sites: DataFrame, start: str = "year_start", end: str = "year_end", freq: str = "days", noleap: bool = False
) -> DataFrame:
    """Every day, or the 15th of every month, from Jan 1 of ``start`` to Dec 31 of ``end`` per site.

    ``sites`` has one row per site with two integer year columns. The site-years are dealt to four tasks a core before
    their days are made, since a table of sites is small enough to be read by one.
    """
    if freq not in ("days", "months"):
        raise ValueError("freq must be 'days' or 'months'")
    dom, last_dom, step = (1, 31, "INTERVAL 1 DAY") if freq == "days" else (15, 15, "INTERVAL 1 MONTH")
    # exploding years first keeps each generated array to one year
    years = sites.where(F.col(start) <= F.col(end)).select(
        SITE, F.explode(F.sequence(F.col(start).cast("int"), F.col(end).cast("int"))).alias("_year")
    )
    # a given number of partitions is not merged again by what the few bytes of the years weigh
    years = years.repartition(4 * sites.sparkSession.sparkContext.defaultParallelism, SITE, "_year")
    first = F.make_date("_year", F.lit(1), F.lit(dom))
    last = F.make_date("_year", F.lit(12), F.lit(last_dom))
    out = years.select(SITE, F.explode(F.sequence(first, last, F.expr(step))).alias(DATE))
    if noleap:
        out = out.where(~is_leap_day(F.col(DATE)))
    return out.withColumn("year_dec", decimal_year(F.col(DATE)))


def date_spine(ranges: DataFrame, start: str = "date_start", end: str = "date_end") -> DataFrame:
    """Every day between two date columns per site."""
    kept = ranges.where(F.col(start) <= F.col(end))
    return kept.select(SITE, F.explode(F.sequence(F.col(start), F.col(end))).alias(DATE))


def on_calendar(df: DataFrame, spine: DataFrame) -> DataFrame:
    """The table on a gap-free calendar: one row per spine day, null where the table has none."""
    clash = [c for c in df.columns if c in spine.columns and c not in (SITE, DATE)]
    return spine.join(df.drop(*clash), [SITE, DATE], "left")


def attach_forcing(obs: DataFrame, climate: DataFrame, vegetation: DataFrame | None = None) -> DataFrame:
    """Add climate and vegetation index columns by site and date, dropping repeated columns first."""
    out = attach_model(obs, climate, [SITE, DATE])
    return out if vegetation is None else attach_model(out, vegetation, [SITE, DATE])


def attach_dimension(df: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(dim, list(keys), "left")


def fill_from(df: DataFrame, target: str, fallback: str) -> DataFrame:
    """Fill a missing class from a second column, then drop that column."""
    return df.withColumn(target, F.coalesce(target, fallback)).drop(fallback)


def align_model_obs(obs: DataFrame, mod: DataFrame, keys: list[str] | None = None, check: bool = True) -> DataFrame:
    """Pair model and observation rows by key.

    With ``check``, a row without partner on either side makes the query fail when it runs; no separate
    counting job is started.
    """
    keys = keys or [SITE, DATE]
    if not check:
        return obs.join(mod, keys)
    left = obs.withColumn("_in_obs", F.lit(True))
    right = mod.withColumn("_in_mod", F.lit(True))
    paired = left.join(right, keys, "full")
    matched = F.col("_in_obs").isNotNull() & F.col("_in_mod").isNotNull()
    guard = F.when(matched, F.lit(True)).otherwise(
        F.raise_error(F.lit("model and observations do not cover the same keys")).cast("boolean")
    )
    return paired.withColumn("_ok", guard).where("_ok").drop("_in_obs", "_in_mod", "_ok")


def merge_alt_target(
    obs: DataFrame, alt: DataFrame, col: str = "gpp_obs", alt_name: str = "gpp_obs_alt"
) -> DataFrame:
    """Second product of the target, joined by site and date."""
    second = alt.select(SITE, DATE, F.col(col).alias(alt_name))
    return obs.join(second, [SITE, DATE], "left")


def cartesian_sweep(columns: dict[str, list[float]], spark) -> DataFrame:
    """All combinations of short literal lists, built from one row without a join."""
    out = spark.range(1).select(
        *[F.array(*[F.lit(float(v)) for v in values]).alias(name) for name, values in columns.items()]
    )
    for name in columns:
        out = out.withColumn(name, F.explode(name))
    return out


def keep_sites(df: DataFrame, sites: DataFrame, key: str = SITE) -> DataFrame:
    return df.join(sites.select(key), key, "left_semi")


def drop_sites(df: DataFrame, sites: DataFrame, key: str = SITE) -> DataFrame:
    return df.join(sites.select(key), key, "left_anti")


def selected_sites(selection: DataFrame, site: str = "Site", use: str = "use") -> DataFrame:
    """Sites picked by hand (``use`` = 1)."""
    return selection.where(F.col(use) == 1).select(F.col(site).alias(SITE))


def missing_periods(
    available: DataFrame, first_year: int, last_year: int, by: list[str] | None = None
) -> DataFrame:
    """Year-months expected between two years and not in ``available`` (``by``, ``year``, ``moy``)."""
    by = by or []
    scope = available.select(*by).distinct() if by else available.sparkSession.range(1).select()
    expected = scope.select(
        *by, F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("year")
    ).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("moy"))
    return expected.join(available.select(*by, "year", "moy"), [*by, "year", "moy"], "left_anti")
