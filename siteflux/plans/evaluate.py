"""Evaluation of model output against observations at all time scales."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.nulls import null_if
from siteflux.functions.rows import class_code, class_word, hemisphere, period_label
from siteflux.operators.aggregate import (
    distinct_legend,
    mean_seasonal_cycle_doy,
    mean_seasonal_cycle_xoy,
    multiyear_mean,
    valid_count,
    zone_seasonal_cycle,
)
from siteflux.operators.cleaning import mask_outliers
from siteflux.operators.grid import GridSpec, sample_grid_at_sites
from siteflux.operators.joins import attach_forcing, attach_model, merge_alt_target
from siteflux.operators.moments import annual_of, day_moments, monthly_of, pair_moments, skill_of, xday_of
from siteflux.operators.series import add_fitted, anomalies
from siteflux.settings import EvalSettings
from siteflux.sources.sinks import scratch_dir, stored


def observation_tables(
    daily: DataFrame,
    monthly: DataFrame | None = None,
    annual: DataFrame | None = None,
    settings: EvalSettings = EvalSettings(),
    alt: DataFrame | None = None,
    forcing: DataFrame | None = None,
    col: str = "gpp_obs",
    store: bool = True,
) -> dict[str, DataFrame]:
    """Observations by day, k-day bin, month and year, with outlying years and early dates masked.

    Monthly (``sitename, year, moy``) and annual (``sitename, year``) tables may come from their own
    files; without them they are rolled up, like the bins, from one stored table of daily sums (``store``).
    """
    first = None if settings.first_day is None else F.lit(settings.first_day).cast("date")
    late = F.col(col) if first is None else null_if(F.col(DATE) < first, F.col(col))
    moments = day_moments(daily, {"all": F.col(col), col: late}, **settings.bins())
    if store and (annual is None or monthly is None):
        moments = stored(moments, "observed_moments")
    annual = annual_of(moments, "all", settings.min_days).withColumnRenamed("all", col).drop("n") if annual is None else annual
    annual = mask_outliers(annual, col, settings.outlier_coef)
    annual = annual.withColumn(col, null_if(F.col("year") < settings.first_year, F.col(col)))
    monthly = monthly_of(moments, "all").withColumnRenamed("all", col).drop("n") if monthly is None else monthly
    if first is not None:
        month = F.make_date("year", "moy", F.lit(1))
        monthly = monthly.withColumn(col, null_if(month < first, F.col(col)))
        daily = daily.withColumn(col, late)
    if alt is not None:
        if settings.first_day is not None:
            alt = alt.withColumn(col, null_if(F.col(DATE) < F.lit(settings.first_day).cast("date"), F.col(col)))
        daily = merge_alt_target(daily, alt, col, f"{col}_alt")
    if forcing is not None:
        daily = attach_forcing(daily, forcing)
    return {"ddf": daily, "xdf": xday_of(moments, col, "n_obs"), "mdf": monthly, "adf": annual}


def combine(
    mod: DataFrame, obs: dict[str, DataFrame], settings: EvalSettings = EvalSettings(), directory: str | None = None
) -> dict[str, DataFrame]:
    """Model output beside the observations at the four time scales, for the sites that have model output.

    Observed and modelled days, each keyed by site and date, meet in one join that keeps the days of both. ``moments``
    sums these days up; the model's bins, months and years and the skill of the days are roll-ups of it. With
    ``directory`` both tables are written there, so that the inputs are read once.
    """
    both = obs["ddf"].drop("gpp_mod").withColumn("_observed", F.lit(True)).join(
        mod.select(SITE, DATE, "gpp_mod", F.lit(True).alias("_modelled")), [SITE, DATE], "full"
    )
    if directory:
        both = stored(both, "days", directory)
    modelled = F.col("_modelled").isNotNull()
    moments = day_moments(
        both, {"gpp_mod": F.col("gpp_mod")}, (F.col("gpp_obs"), F.col("gpp_mod")), modelled, **settings.bins()
    )
    if directory:
        moments = stored(moments, "moments", directory)
    have = moments.where("rows > 0").select(SITE).distinct()
    kept = {name: table.join(have, SITE, "left_semi") for name, table in obs.items() if name != "ddf"}
    return {
        "ddf": both.where("_observed").join(have, SITE, "left_semi").drop("_observed", "_modelled"),
        "xdf": attach_model(kept["xdf"], xday_of(moments, "gpp_mod", "n_mod"), [SITE, "inbin"]),
        "mdf": attach_model(kept["mdf"], monthly_of(moments, "gpp_mod"), [SITE, "year", "moy"]),
        "adf": attach_model(kept["adf"], annual_of(moments, "gpp_mod", settings.min_days), [SITE, "year"]),
        "moments": moments,
    }


def evaluate(
    mod: DataFrame,
    obs: dict[str, DataFrame],
    sites: DataFrame | None = None,
    settings: EvalSettings = EvalSettings(),
    store: bool = True,
    code: str = "koeppen_code",
) -> dict[str, DataFrame]:
    """All tables of an evaluation; ``metrics`` has one row per pooled level.

    With ``store`` the joined days, their moments, the three coarser tables and the mean cycles are written once to the
    shared folder. The days are then read for the moments, for the mean year and for the daily anomalies, and every
    skill is a roll-up of regression moments, the pooled ones in one aggregate over all levels. ``sites``, with class
    and latitude, is needed for the table of climate zones (``meandoydf_byclim``) alone, which ranks the days at once.
    """
    directory = scratch_dir(mod.sparkSession) if store else None
    t = combine(mod, obs, settings, directory)

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stored(df, name, directory) if store else df

    t |= {name: keep(t[name], name) for name in ("xdf", "mdf", "adf")}
    t["meandf"] = multiyear_mean(t["adf"])
    t["iavdf"] = anomalies(
        t["adf"], t["meandf"].withColumnsRenamed({"gpp_mod": "mod_mean", "gpp_obs": "obs_mean"}), [SITE]
    )
    t["meandoydf"] = keep(mean_seasonal_cycle_doy(t["ddf"]), "meandoydf")
    t["idvdf"] = anomalies(t["ddf"].withColumn("doy", F.dayofyear(DATE)), t["meandoydf"], [SITE, "doy"])
    t["meanxoydf"] = keep(mean_seasonal_cycle_xoy(t["xdf"]), "meanxoydf")
    t["ixvdf"] = anomalies(t["xdf"].withColumn("xoy", F.dayofyear("inbin")), t["meanxoydf"], [SITE, "xoy"])
    if sites is not None:
        t["meandoydf_byclim"] = zone_seasonal_cycle(t["ddf"], sites, code)

    n = settings.min_values
    by_site = {name: pair_moments(t[name], [SITE]) for name in ("xdf", "adf", "mdf", "iavdf", "idvdf", "ixvdf")}
    for name, least in (("adf", n), ("mdf", n), ("iavdf", n), ("idvdf", None), ("ixvdf", None)):
        t[f"{name}_stats"] = skill_of(by_site[name], [SITE], least)
        t[f"{name}_fitted"] = add_fitted(t[name])
    levels = {
        "daily_pooled": t["moments"],
        "xdaily_pooled": by_site["xdf"],
        "annual_pooled": by_site["adf"],
        "monthly_pooled": by_site["mdf"],
        "spatial": pair_moments(t["meandf"], [SITE]),
        "anomalies_annual": by_site["iavdf"],
        "meandoy": pair_moments(t["meandoydf"], [SITE], "obs_mean", "mod_mean"),
        "anomalies_daily": by_site["idvdf"],
        "meanxoy": pair_moments(t["meanxoydf"], [SITE], "obs_mean", "mod_mean"),
        "anomalies_xdaily": by_site["ixvdf"],
    }
    sums = [c for c in by_site["adf"].columns if c.startswith("m_")]
    rows = [table.select(F.lit(level).alias("level"), *sums) for level, table in levels.items()]
    # every level has a row, also without a pair
    names = mod.sparkSession.createDataFrame([(level,) for level in levels], "level STRING")
    rows.append(names.select("level", *[F.lit(None).cast(f.dataType).alias(f.name) for f in rows[0].schema.fields[1:]]))
    t["metrics"] = skill_of(reduce(DataFrame.union, rows), ["level"])
    return t


def metrics_long(metrics: DataFrame, target: str = "gpp", source: str = "tower") -> DataFrame:
    """Metrics with the target and the observation source as columns."""
    return metrics.select(F.lit(target).alias("target"), F.lit(source).alias("source"), "*")


def climate_legend(classes: DataFrame, text: str = "koeppen_climate") -> DataFrame:
    """Code and word of every climate class in the site table."""
    kept = classes.where(F.col(text).isNotNull() & (F.col(text) != "-"))
    split = kept.select(class_code(F.col(text)).alias("Code"), class_word(F.col(text)).alias("Climate"))
    return distinct_legend(split, "Code", "Climate")


def site_overview(
    daily: DataFrame,
    sites: DataFrame,
    classes: DataFrame,
    class_grid: DataFrame,
    legend: DataFrame,
    spec: GridSpec = GridSpec(),
    col: str = "gpp_obs",
) -> DataFrame:
    """Site table with its number of observations, climate class (from the map where the table has none)
    and data period.

    ``classes``: ``sitename, koeppen_climate``; ``class_grid``: ``lon_idx, lat_idx, kgnumber``; ``legend``:
    ``kgnumber, koeppen_code_extr``.
    """
    coded = classes.select(SITE, class_code(F.col("koeppen_climate")).alias("koeppen_code"))
    out = sites.join(valid_count(daily, col), SITE, "left").join(coded, SITE, "left")
    out = sample_grid_at_sites(out, class_grid, spec, ["kgnumber"]).drop("lon_idx", "lat_idx")
    out = out.join(legend, "kgnumber", "left")
    out = out.withColumn("koeppen_code", F.coalesce("koeppen_code", "koeppen_code_extr"))
    return out.withColumns(
        {"hemisphere": hemisphere(F.col("lat")), "Period": period_label(F.col("year_start"), F.col("year_end"))}
    )
