"""Forcing of all sites on a gap-free calendar, from towers, reanalysis and station grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions import units
from siteflux.functions.atmosphere import vpd
from siteflux.functions.calendar import decimal_year, is_leap_day
from siteflux.functions.rows import cap, sunshine_fraction
from siteflux.operators.aggregate import mean_by_doy_fill
from siteflux.operators.downscale import months_to_days, shared_out
from siteflux.operators.grid import GridSpec, locate, nearest_valid_cell_same_latitude, sample_grid_at_sites
from siteflux.operators.joins import calendar_spine, on_calendar
from siteflux.operators.masks import coalesce_sources
from siteflux.operators.series import fill_gaps
from siteflux.settings import InputSettings
from siteflux.sources.readers import read_site_csv
from siteflux.sources.sinks import stored, workspace, write_variables_text

FORCING = ("temp", "prec", "nrad", "ppfd", "vpd", "ccov")


def tower_meteo(raw: DataFrame) -> DataFrame:
    """Tower variables with common names and units; net radiation is null where it is not reported."""
    radiation = F.col("NETRAD").cast("double") if "NETRAD" in raw.columns else F.lit(None).cast("double")
    return raw.select(
        SITE,
        DATE,
        F.col("TA_F").alias("temp"),
        F.col("P_F").alias("prec"),
        units.watt_to_joule_per_day(radiation).alias("nrad"),
        units.watt_to_photons(F.col("SW_IN_F")).alias("ppfd"),
        units.hpa_to_pa(F.col("VPD_F")).alias("vpd"),
        F.lit(None).cast("double").alias("ccov"),
    )


def drop_leap_days(df: DataFrame) -> DataFrame:
    return df.where(~is_leap_day(F.col(DATE)))


def reanalysis_at_sites(sites: DataFrame, grid: DataFrame, spec: GridSpec, noleap: bool = True) -> DataFrame:
    """Daily reanalysis of the nearest cell: temperature, precipitation, vapour pressure deficit and light."""
    at = sample_grid_at_sites(
        sites.select(SITE, "lon", "lat", "elv"), grid, spec, [DATE, "Tair", "Rainf", "Snowf", "Qair", "SWdown"]
    ).where(F.col(DATE).isNotNull())
    temp = units.kelvin_to_celsius(F.col("Tair"))
    out = at.select(
        SITE,
        DATE,
        temp.alias("temp"),
        units.precipitation(F.col("Rainf"), F.coalesce(F.col("Snowf"), F.lit(0.0))).alias("prec"),
        vpd(temp, qair=F.col("Qair"), elv=F.col("elv")).alias("vpd"),
        units.watt_to_photons(F.col("SWdown")).alias("ppfd"),
    )
    return drop_leap_days(out) if noleap else out


def station_cells(sites: DataFrame, land: DataFrame, spec: GridSpec) -> DataFrame:
    """Sites with the station-grid cell to read: their own, or the nearest one with data on the same row.

    ``land`` is keyed by cell with a ``value`` that is null where the grid has no data.
    """
    found = nearest_valid_cell_same_latitude(locate(sites, spec), land, spec.nlon)
    return found.withColumn("lon_idx", F.coalesce("lon_idx_found", "lon_idx")).drop("lon_idx_found", "value")


def station_at_sites(
    sites: DataFrame, grid: DataFrame, spec: GridSpec, noleap: bool = True, weights: DataFrame | None = None
) -> DataFrame:
    """Monthly station grid (``lon_idx, lat_idx, year, moy, cld, pre, tmp, vap``) as daily site series.

    Smooth variables follow mean-preserving curves; all curves of a month and its rain become days together.
    Precipitation is shared out by ``weights`` (``sitename, date, weight``) if given, else evenly over the month.
    """
    land = grid.groupBy("lon_idx", "lat_idx").agg(F.max("cld").alias("value"))
    cells = station_cells(sites.select(SITE, "lon", "lat"), land, spec).select(SITE, "lon_idx", "lat_idx")
    monthly = cells.join(grid, ["lon_idx", "lat_idx"]).select(SITE, "year", "moy", "cld", "pre", "tmp", "vap")
    monthly = monthly.withColumn("vpd", vpd(F.col("tmp"), eact=units.hpa_to_pa(F.col("vap"))))
    curves = {"tmp": "temp", "cld": "ccov", "vpd": "vpd"}
    if weights is None:
        out = months_to_days(monthly, curves, noleap=noleap, carry=("pre",))
        weight, weight_sum = F.lit(1.0), F.col("ndays").cast("double")
    else:
        weights = (drop_leap_days(weights) if noleap else weights).select(SITE, DATE, "weight")
        sums = weights.groupBy(SITE, F.year(DATE).alias("year"), F.month(DATE).alias("moy")).agg(F.sum("weight").alias("_sum"))
        monthly = monthly.join(sums, [SITE, "year", "moy"], "left")
        out = months_to_days(monthly, curves, noleap=noleap, carry=("pre", "_sum")).join(weights, [SITE, DATE], "left")
        weight, weight_sum = F.coalesce("weight", F.lit(0.0)), F.coalesce("_sum", F.lit(0.0))
    rain = shared_out(weight, weight_sum, F.col("pre"))
    return out.select(SITE, DATE, "temp", cap(F.col("ccov"), 100.0).alias("ccov"), "vpd", rain.alias("prec"))


def prepare_climate(
    sites: DataFrame, sources: dict[str, DataFrame], settings: InputSettings = InputSettings()
) -> DataFrame:
    """One gap-free forcing table from ready-made source tables keyed by site and date.

    ``sources`` maps a source name of the settings to its table. All joins use (site, date), so the spine is
    shuffled once for them, and the merged days once more, by site, for gap filling. Nothing is stored in between.
    """
    return filled_climate(merged_climate(sites, sources, settings), sources)


def merged_climate(sites: DataFrame, sources: dict[str, DataFrame], settings: InputSettings = InputSettings()) -> DataFrame:
    """The calendar of all sites with the first known value of each variable, by the priority of its sources."""
    out = calendar_spine(sites, noleap=settings.noleap)
    for source, table in sources.items():
        named = table.select(SITE, DATE, *[F.col(c).alias(f"{c}_{source}") for c in FORCING if c in table.columns])
        out = on_calendar(named, out)
    for target, order in settings.sources().items():
        out = coalesce_sources(out, target, [f"{target}_{s}" for s in order if s in sources])
    return out.select(SITE, DATE, "year_dec", *FORCING)


def filled_climate(merged: DataFrame, sources: dict[str, DataFrame]) -> DataFrame:
    """Gaps filled in those variables that a source has; days without rain known have none.

    A site's calendar has 366 days a year at most, so it fits a task. The decimal year is made again from the date, which
    costs less than to move it.
    """
    have = {c for table in sources.values() for c in table.columns}
    filled = [c for c in ("temp", "ccov", "vpd", "ppfd") if c in have]
    out = fill_gaps(merged.drop("year_dec"), filled, zero=["prec"], bounded=True)
    return out.withColumn("year_dec", decimal_year(F.col(DATE))).select(*merged.columns)


def prepare_vegetation(sites: DataFrame, index: DataFrame, noleap: bool = True) -> DataFrame:
    """Vegetation index on the calendar; days without a value take the site's mean of that day of year."""
    series = on_calendar(index.select(SITE, DATE, "fapar"), calendar_spine(sites, noleap=noleap))
    return mean_by_doy_fill(series, "fapar").drop("year_dec")


def prepare_inputs(
    sites: DataFrame,
    sources: dict[str, DataFrame],
    vegetation: DataFrame | None = None,
    settings: InputSettings = InputSettings(),
) -> DataFrame:
    """Climate and vegetation index of all sites, ready to score or to write."""
    return with_vegetation(prepare_climate(sites, sources, settings), sites, vegetation, settings)


def with_vegetation(climate: DataFrame, sites: DataFrame, vegetation: DataFrame | None, settings: InputSettings) -> DataFrame:
    """Sunshine fraction and, if there is one, the vegetation index beside the climate."""
    out = climate.withColumn("fsun", sunshine_fraction(F.col("ccov")))
    if vegetation is None:
        return out
    return out.join(prepare_vegetation(sites, vegetation, settings.noleap), [SITE, DATE], "left")


def inputs_from_sources(
    spark: SparkSession,
    sites: DataFrame,
    tower_files: list[str] | None = None,
    reanalysis: tuple[DataFrame, GridSpec] | None = None,
    station: tuple[DataFrame, GridSpec] | None = None,
    vegetation: DataFrame | None = None,
    settings: InputSettings = InputSettings(),
    path: str | None = None,
) -> DataFrame:
    """Finished inputs of all sites from their sources: tower files, reanalysis and station grids, vegetation index.

    Sources that are not given are left out of the priorities. Each is brought to site and date once; they meet on the
    calendar of the sites (``sitename, lon, lat, elv, year_start, year_end``), are merged by priority and gap-filled.
    With ``path`` the inputs are written there as text, all variables in one job. Returns the stored table.
    """
    given: dict[str, DataFrame] = {}
    if tower_files is not None:
        columns = ("TA_F", "P_F", "SW_IN_F", "VPD_F", "NETRAD")
        raw = read_site_csv(spark, tower_files, "d", lambda c: c in columns)
        lacking = {c: F.lit(None).cast("double") for c in columns if c not in raw.columns}
        tower = tower_meteo(raw.withColumns(lacking) if lacking else raw)
        given["tower"] = drop_leap_days(tower) if settings.noleap else tower
    if reanalysis is not None:
        given["reanalysis"] = reanalysis_at_sites(sites, *reanalysis, noleap=settings.noleap)
    if station is not None:
        given["station"] = station_at_sites(sites, *station, noleap=settings.noleap)
    out = filled_climate(merged_climate(sites, given, settings), given)
    out = stored(with_vegetation(out, sites, vegetation, settings), "inputs")
    if path is not None:
        write_inputs(out, path, store=False)
    return out


def write_inputs(
    df: DataFrame,
    path: str,
    variables: tuple[str, ...] = ("temp", "prec", "fsun", "vpd", "ppfd", "fapar"),
    store: bool = True,
) -> None:
    """A text folder per variable (``variable=dtemp``), split by site and year: one job, one shuffle for all variables.

    A day is a row of each variable, dealt by variable, site and year, so that a large site spreads over its years and
    every file is written by one task in date order. Unknown values are written as -9999. With ``store`` the plan of
    ``df`` runs once into a scratch folder first, which is deleted afterwards.
    """
    names = [name for name in variables if name in df.columns]
    spark, chosen = df.sparkSession, df.select(SITE, DATE, *names)
    with workspace(spark) as folder:
        rows = stored(chosen, "inputs", folder) if store else chosen
        sides = F.array(*[F.struct(F.lit(f"d{n}").alias("variable"), F.col(n).cast("double").alias("value")) for n in names])
        long = rows.select(SITE, DATE, F.explode(sides).alias("_s")).select(SITE, DATE, "_s.*")
        write_variables_text(long, path)
