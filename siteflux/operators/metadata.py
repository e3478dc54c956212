"""Long site metadata (site, group, variable, value): duplicate rules and pivot.

Every "first" is the smallest line number carried from the file, so results do not depend on partitioning.
Choices are combinable aggregates joined back on (site, variable) or site; no site is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteflux.sources.sinks import stored

LONG_COLUMNS = ("SITE_ID", "GROUP_ID", "VARIABLE_GROUP", "VARIABLE", "DATAVALUE")

# Groups and variables left out because they repeat freely.
NOISY_GROUPS = (
    "GRP_TEAM_MEMBER", "GRP_DM_FERT_M", "GRP_DM_AGRICULTURE", "GRP_DM_PESTICIDE", "GRP_DM_PLANTING", "GRP_DM_TILL",
)
NOISY_VARIABLES = ("NETWORK",)
# Variables of which the first group is used.
FIRST_GROUP_VARIABLES = (
    "REFERENCE_PAPER", "REFERENCE_USAGE", "REFERENCE_DOI", "REFERENCE_COMMENT", "DOM_DIST_MGMT", "DM_COMMENT",
    "DM_DATE", "DM_DATE_UNC", "DM_SURF", "DM_SURF_MEAS_UNC", "DM_DATE_START", "DM_DATE_END", "DM_GRAZE",
)
REINSTALLED = "Reinstallation after management activities"
LOCATION_VARIABLE = "LOCATION_COMMENT"
FLUX_VARIABLE, FLUX_VALUE = "FLUX_MEASUREMENTS_VARIABLE", "CO2"
METHOD_VARIABLE, METHOD_VALUE = "FLUX_MEASUREMENTS_METHOD", "Eddy Covariance"


def group_scope_prefer(df: DataFrame, preferred: DataFrame) -> DataFrame:
    """Keep only the preferred group's rows for the variables that group supplies.

    ``preferred`` has one row per site: ``SITE_ID, _group``.
    """
    supplied = (
        df.join(preferred, "SITE_ID")
        .where(F.col("GROUP_ID") == F.col("_group"))
        .select("SITE_ID", "VARIABLE", "_group")
        .distinct()
    )
    joined = df.join(supplied, ["SITE_ID", "VARIABLE"], "left")
    return joined.where(F.col("_group").isNull() | (F.col("GROUP_ID") == F.col("_group"))).select(*df.columns)


def _repeats(df: DataFrame) -> DataFrame:
    return df.groupBy("SITE_ID", "VARIABLE").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)


def _first_group(df: DataFrame, rank: Column | None = None) -> DataFrame:
    """First group per site by (rank, line)."""
    order = [F.col("line"), F.col("GROUP_ID").alias("g")]
    key = F.struct(*([rank.alias("r")] if rank is not None else []), *order)
    return df.groupBy("SITE_ID").agg(F.min(key).alias("_k")).select("SITE_ID", F.col("_k.g").alias("_group"))


def drop_noisy(df: DataFrame) -> DataFrame:
    return df.where(~F.col("VARIABLE_GROUP").isin(*NOISY_GROUPS) & ~F.col("VARIABLE").isin(*NOISY_VARIABLES))


def keep_first_group(df: DataFrame, variables: tuple[str, ...] = FIRST_GROUP_VARIABLES) -> DataFrame:
    """For the listed variables, rows of the group that comes first in the file."""
    firsts = (
        df.where(F.col("VARIABLE").isin(*variables))
        .groupBy("SITE_ID", "VARIABLE")
        .agg(F.min(F.struct("line", F.col("GROUP_ID").alias("g"))).alias("_k"))
        .select("SITE_ID", "VARIABLE", F.col("_k.g").alias("_group"))
    )
    joined = df.join(firsts, ["SITE_ID", "VARIABLE"], "left")
    return joined.where(F.col("_group").isNull() | (F.col("GROUP_ID") == F.col("_group"))).select(*df.columns)


def prefer_location(df: DataFrame) -> DataFrame:
    """After a re-installation, use the group whose comment is not the re-installation note."""
    sites = _repeats(df).where(F.col("VARIABLE") == LOCATION_VARIABLE).select("SITE_ID")
    other = df.where((F.col("VARIABLE") == LOCATION_VARIABLE) & (F.col("DATAVALUE") != REINSTALLED))
    return group_scope_prefer(df, _first_group(other.join(sites, "SITE_ID", "left_semi")))


def prefer_flux_method(df: DataFrame) -> DataFrame:
    """Of several measured gases and methods use CO2, by eddy covariance where that is known, else the first."""
    sites = _repeats(df).where(F.col("VARIABLE") == FLUX_VARIABLE).select("SITE_ID")
    gas = df.where((F.col("VARIABLE") == FLUX_VARIABLE) & (F.col("DATAVALUE") == FLUX_VALUE))
    eddy = (
        df.where((F.col("VARIABLE") == METHOD_VARIABLE) & (F.col("DATAVALUE") == METHOD_VALUE))
        .select("SITE_ID", "GROUP_ID", F.lit(0).alias("_eddy"))
        .distinct()
    )
    ranked = gas.join(sites, "SITE_ID", "left_semi").join(eddy, ["SITE_ID", "GROUP_ID"], "left")
    return group_scope_prefer(df, _first_group(ranked, F.coalesce(F.col("_eddy"), F.lit(1))))


def keep_maximum(df: DataFrame) -> DataFrame:
    """Of what is left per variable, the largest number, else the first row."""
    number = F.expr("try_cast(DATAVALUE AS DOUBLE)")
    rest = [c for c in df.columns if c not in ("SITE_ID", "VARIABLE")]
    key = F.struct((-number).isNull().alias("no"), (-number).alias("v"), *[F.col(c) for c in ["line", *[r for r in rest if r != "line"]]])
    best = df.groupBy("SITE_ID", "VARIABLE").agg(F.min(key).alias("_k"))
    return best.select("SITE_ID", "VARIABLE", *[F.col("_k")[c].alias(c) for c in rest]).select(*df.columns)


def dedupe_eav(df: DataFrame) -> DataFrame:
    """One row per (site, variable). ``df`` has the long columns and ``line``, the position in the file.

    A rule looks at its input several times, so the table is written between the rules.
    """
    out = stored(keep_first_group(drop_noisy(df)), "first_group")
    out = stored(prefer_location(out), "location")
    return keep_maximum(prefer_flux_method(out))


def eav_to_wide(df: DataFrame, variables: list[str]) -> DataFrame:
    """Site rows with one column per variable. Naming the variables avoids a job to find them."""
    return df.groupBy("SITE_ID").pivot("VARIABLE", variables).agg(F.first("DATAVALUE"))


def years_from_filenames(files: DataFrame, name: str = "filnam") -> DataFrame:
    """Site, start and end year from fixed positions of the file name."""
    text = F.col(name)
    return files.select(
        F.substring(text, 5, 6).alias("mysitename"),
        F.expr(f"try_cast(substring({name}, 35, 4) AS INT)").alias("year_start"),
        F.expr(f"try_cast(substring({name}, 40, 4) AS INT)").alias("year_end"),
    )


def override_years(meta: DataFrame, from_files: DataFrame) -> DataFrame:
    """Years from file names where present, else from the metadata, cut to four digits."""
    f = from_files.select(
        "mysitename", F.col("year_start").alias("_ys"), F.col("year_end").alias("_ye")
    )
    joined = meta.join(f, "mysitename", "left")

    def year(c: str, own: str) -> Column:
        clean = F.expr(f"try_cast(substring(cast({own} AS STRING), 1, 4) AS INT)")
        return F.coalesce(F.col(c), clean)

    return joined.withColumns({"year_start": year("_ys", "year_start"), "year_end": year("_ye", "year_end")}).drop(
        "_ys", "_ye"
    )
