"""Joins, spines, grids and metadata."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import fx_daily, fx_eav, fx_grid, fx_sensor, fx_site, obs_mod, query, rsql, table
from siteflux.operators import grid as G
from siteflux.operators import joins as J
from siteflux.operators import metadata as E
from siteflux.operators.aggregate import monthly_mean
from siteflux.operators.groups import with_stats
from siteflux.operators.quantiles import probabilities, values_of
from siteflux.sources.readers import union_sites

OM = "sitename, date"
KEYS = ["sitename", "date"]

query(
    "attach_model",
    rsql(
        """SELECT o.sitename, o.date, o.gpp_nt AS gpp_obs, m.v AS gpp_mod FROM fx_daily o LEFT JOIN
        (SELECT sitename, date, et AS v FROM fx_daily WHERE temp > 10) m USING (sitename, date)""",
        OM,
        "gpp_obs gpp_mod",
    ),
)(
    lambda s, d: J.attach_model(
        fx_daily(s, d).select("sitename", "date", F.col("gpp_nt").alias("gpp_obs")),
        fx_daily(s, d).where(F.col("temp") > 10).select("sitename", "date", F.col("et").alias("gpp_mod")),
        KEYS,
    )
)
query(
    "attach_model_monthly",
    rsql(
        """SELECT o.sitename, o.year, o.moy, o.gpp_obs, m.gpp_mod FROM (SELECT sitename, CAST(year(date) AS INTEGER) AS year,
        CAST(month(date) AS INTEGER) AS moy, avg(gpp_obs) AS gpp_obs FROM obs_mod GROUP BY ALL) o LEFT JOIN
        (SELECT sitename, year(date) AS year, month(date) AS moy, avg(gpp_mod) AS gpp_mod FROM obs_mod GROUP BY ALL) m
        USING (sitename, year, moy)""",
        "sitename, year, moy",
        "gpp_obs gpp_mod",
    ),
)(
    lambda s, d: J.attach_model(
        obs_mod(s, d)
        .groupBy("sitename", F.year("date").alias("year"), F.month("date").alias("moy"))
        .agg(F.avg("gpp_obs").alias("gpp_obs")),
        monthly_mean(obs_mod(s, d)).drop("n"),
        ["sitename", "year", "moy"],
    )
)
query(
    "group_mean_to_rows",
    rsql("SELECT sitename, date, et - avg(et) OVER (PARTITION BY sitename) AS dev FROM fx_daily", OM, "dev"),
)(
    lambda s, d: with_stats(fx_daily(s, d), ["sitename"], m=F.avg("et")).select(
        "sitename", "date", (F.col("et") - F.col("m")).alias("dev")
    )
)


def sensor_ranges(s, d):
    return fx_sensor(s, d).groupBy("sitename").agg(F.min("date").alias("date_start"), F.max("date").alias("date_end"))


SPINE = """SELECT sitename, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM (SELECT sitename, min(date) AS lo, max(date) AS hi FROM fx_sensor GROUP BY sitename)"""
SENSOR = f"SELECT p.sitename, p.date, f.v FROM ({SPINE}) p LEFT JOIN fx_sensor f USING (sitename, date)"


def sensor_series(s, d):
    """Dense sensor calendar with gaps."""
    return J.on_calendar(fx_sensor(s, d).select("sitename", "date", "v"), J.date_spine(sensor_ranges(s, d)))


query("on_calendar", rsql(SENSOR, OM, "v"))(sensor_series)


def site_years(s, d):
    return fx_site(s, d).select(
        "sitename", (F.lit(1995) + F.col("classid") % 3).alias("year_start"), (F.lit(1998) + F.col("classid") % 4).alias("year_end")
    )


def spine_sql(noleap: bool) -> str:
    drop = "WHERE NOT (month(date) = 2 AND day(date) = 29)" if noleap else ""
    return f"""SELECT sitename, date, year(date) + (dayofyear(date) - 1) / CASE WHEN (year(date) % 4 = 0 AND year(date) % 100 <> 0)
      OR year(date) % 400 = 0 THEN 366 ELSE 365 END AS year_dec FROM (SELECT sitename, CAST(unnest(generate_series(
      make_timestamp(1995 + classid % 3, 1, 1, 0, 0, 0.0), make_timestamp(1998 + classid % 4, 12, 31, 0, 0, 0.0), INTERVAL 1 DAY)) AS DATE) AS date
      FROM fx_site) {drop}"""


query("calendar_spine_days", rsql(spine_sql(False), OM, "year_dec"))(lambda s, d: J.calendar_spine(site_years(s, d)))
query("calendar_spine_noleap", rsql(spine_sql(True), OM, "year_dec"))(
    lambda s, d: J.calendar_spine(site_years(s, d), noleap=True)
)
query(
    "calendar_spine_months",
    rsql(
        f"SELECT * FROM ({spine_sql(False)}) WHERE day(date) = 15", OM, "year_dec"
    ),
)(lambda s, d: J.calendar_spine(site_years(s, d), freq="months"))
query(
    "attach_forcing",
    rsql(
        """SELECT o.sitename, o.date, o.gpp_nt AS gpp_obs, c.temp, v.soilm AS fapar FROM fx_daily o
        LEFT JOIN (SELECT sitename, date, temp FROM fx_daily WHERE et > 100) c USING (sitename, date)
        LEFT JOIN (SELECT sitename, date, soilm FROM fx_daily WHERE et < 500) v USING (sitename, date)""",
        OM,
        "gpp_obs temp fapar",
    ),
)(
    lambda s, d: J.attach_forcing(
        fx_daily(s, d).select("sitename", "date", F.col("gpp_nt").alias("gpp_obs")),
        fx_daily(s, d).where(F.col("et") > 100).select("sitename", "date", "temp"),
        fx_daily(s, d).where(F.col("et") < 500).select("sitename", "date", F.col("soilm").alias("fapar")),
    )
)
query(
    "attach_dimension_fill_class",
    """SELECT s.sitename, s.classid, coalesce(CASE WHEN n_regionkey <> 2 THEN n_name END, r_name) AS class FROM fx_site s
    LEFT JOIN nation ON n_nationkey = s.classid LEFT JOIN region ON r_regionkey = n_regionkey""",
)(
    lambda s, d: J.fill_from(
        J.attach_dimension(
            J.attach_dimension(
                fx_site(s, d).select("sitename", "classid"),
                table(s, d, "nation").select(
                    F.col("n_nationkey").alias("classid"),
                    F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("class"),
                    F.col("n_regionkey").alias("regionkey"),
                ),
                ["classid"],
            ),
            table(s, d, "region").select(F.col("r_regionkey").alias("regionkey"), F.col("r_name").alias("fallback")),
            ["regionkey"],
        ).drop("regionkey"),
        "class",
        "fallback",
    )
)
query(
    "align_model_obs",
    rsql("SELECT sitename, date, gpp_nt AS gpp_obs, gpp_mod FROM fx_daily", OM, "gpp_obs gpp_mod"),
)(
    lambda s, d: J.align_model_obs(
        fx_daily(s, d).select("sitename", "date", F.col("gpp_nt").alias("gpp_obs")),
        fx_daily(s, d).select("sitename", "date", "gpp_mod"),
    )
)
query(
    "merge_alt_target",
    rsql(
        """SELECT o.sitename, o.date, o.gpp_nt AS gpp_obs, a.gpp_dt AS gpp_obs_alt FROM fx_daily o LEFT JOIN
        (SELECT sitename, date, gpp_dt FROM fx_daily WHERE temp > 0) a USING (sitename, date)""",
        OM,
        "gpp_obs gpp_obs_alt",
    ),
)(
    lambda s, d: J.merge_alt_target(
        fx_daily(s, d).select("sitename", "date", F.col("gpp_nt").alias("gpp_obs")),
        fx_daily(s, d).where(F.col("temp") > 0).select("sitename", "date", F.col("gpp_dt").alias("gpp_obs")),
    )
)


def quantile_values(s, d):
    """Three quantiles of each of two columns, taken from all days."""
    probs = {"low": 0.1, "mid": 0.5, "high": 0.9}
    table = values_of(fx_daily(s, d), ["temp", "soilm"], [], probabilities(probs))  # one row per named column
    return {r.series: [r.low, r.mid, r.high] for r in table.collect()}


query(
    "cartesian_sweep",
    rsql(
        """SELECT temp, soilm FROM (SELECT unnest(quantile_cont(temp, [0.1, 0.5, 0.9])) AS temp FROM fx_daily),
        (SELECT unnest(quantile_cont(soilm, [0.1, 0.5, 0.9])) AS soilm FROM fx_daily)""",
        "",
        "temp soilm",
    ),
)(lambda s, d: J.cartesian_sweep(quantile_values(s, d), s))
query("keep_sites", "SELECT count(*) AS n, sitename FROM fx_daily WHERE sitename IN (SELECT sitename FROM fx_site WHERE elv IS NOT NULL) GROUP BY sitename")(
    lambda s, d: J.keep_sites(fx_daily(s, d), fx_site(s, d).where("elv IS NOT NULL")).groupBy("sitename").agg(F.count(F.lit(1)).alias("n"))
)
query("drop_sites", "SELECT count(*) AS n, sitename FROM fx_daily WHERE sitename NOT IN (SELECT sitename FROM fx_site WHERE c4) GROUP BY sitename")(
    lambda s, d: J.drop_sites(fx_daily(s, d), fx_site(s, d).where("c4")).groupBy("sitename").agg(F.count(F.lit(1)).alias("n"))
)
query("selected_sites", 'SELECT sitename FROM fx_site WHERE classid % 3 = 1')(
    lambda s, d: J.selected_sites(
        fx_site(s, d).select(F.col("sitename").alias("Site"), F.when(F.col("classid") % 3 == 1, 1).alias("use"))
    )
)
query(
    "missing_periods",
    """SELECT sitename, year, moy FROM (SELECT DISTINCT sitename FROM fx_daily), (SELECT CAST(unnest(range(1995, 2003)) AS INTEGER) AS year),
    (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS moy) EXCEPT SELECT sitename, CAST(year(date) AS INTEGER), CAST(month(date) AS INTEGER) FROM fx_daily""",
)(
    lambda s, d: J.missing_periods(
        fx_daily(s, d).select("sitename", F.year("date").alias("year"), F.month("date").alias("moy")), 1995, 2002, ["sitename"]
    )
)
query(
    "union_sites",
    rsql(
        """SELECT sitename, date, v, NULL AS et FROM fx_sensor UNION ALL SELECT sitename, date, NULL AS v, et FROM fx_daily""",
        OM,
        "v et",
    ),
)(lambda s, d: union_sites(fx_sensor(s, d).drop("n"), fx_daily(s, d).select("sitename", "date", "et")))
query("set_difference", "SELECT DISTINCT user_id AS sitename FROM events EXCEPT SELECT s_suppkey FROM supplier")(
    lambda s, d: J.drop_sites(table(s, d, "events").select(F.col("user_id").alias("sitename")).distinct(), fx_site(s, d))
)
query("distinct_keys", "SELECT DISTINCT sitename, CAST(year(date) AS INTEGER) AS year FROM fx_daily")(
    lambda s, d: fx_daily(s, d).select("sitename", F.year("date").alias("year")).distinct()
)
query(
    "values_by_frequency",
    "SELECT sitename, et, count(*) AS freq FROM fx_daily GROUP BY ALL HAVING count(*) > 2",
)(
    lambda s, d: fx_daily(s, d)
    .groupBy("sitename", "et")
    .agg(F.count(F.lit(1)).alias("freq"))
    .where("freq > 2")
    .orderBy(F.desc("freq"), "sitename", "et")
)

SPEC50 = G.GridSpec(lon0=0.0, lat0=0.0, dlon=1.0, dlat=1.0, nlon=50, nlat=1_000_000)


def grid_sites(s, d):
    """Sites placed on the part grid."""
    return fx_site(s, d).select(
        "sitename",
        (F.col("sitename") * 7 % 50 + 0.3).alias("lon"),
        (F.col("sitename") * 3 % 41 + 0.4).alias("lat"),
    )


GRID_SITES = "SELECT sitename, sitename * 7 % 50 + 0.3 AS lon, sitename * 3 % 41 + 0.4 AS lat, CAST(sitename * 7 % 50 AS INTEGER) AS lon_idx, CAST(sitename * 3 % 41 AS INTEGER) AS lat_idx FROM fx_site"
query(
    "sample_grid_at_sites",
    rsql(f"SELECT s.*, g.value FROM ({GRID_SITES}) s LEFT JOIN fx_grid g USING (lon_idx, lat_idx)", "sitename, lon_idx, lat_idx", "lon lat value"),
)(lambda s, d: G.sample_grid_at_sites(grid_sites(s, d), fx_grid(s, d), SPEC50))
query(
    "nearest_valid_cell_same_latitude",
    f"""SELECT sitename, lon_idx, lat_idx, lon_idx_found, value FROM (SELECT s.sitename, s.lon_idx, s.lat_idx, g.lon_idx AS lon_idx_found, g.value,
    row_number() OVER (PARTITION BY s.sitename ORDER BY least((g.lon_idx - s.lon_idx + 50) % 50, (s.lon_idx - g.lon_idx + 50) % 50),
    (g.lon_idx - s.lon_idx + 50) % 50) AS rn FROM ({GRID_SITES}) s LEFT JOIN (SELECT * FROM fx_grid WHERE value IS NOT NULL) g USING (lat_idx)) WHERE rn = 1""",
)(
    lambda s, d: G.nearest_valid_cell_same_latitude(
        G.locate(grid_sites(s, d), SPEC50).select("sitename", "lon_idx", "lat_idx"), fx_grid(s, d), 50
    )
)
# a regional grid: sites outside have no cell
REGION = G.GridSpec(lon0=-19.75, lat0=-29.75, nlon=80, nlat=120)
query(
    "locate_in_region",
    """SELECT sitename, CASE WHEN i BETWEEN 0 AND 79 THEN i END AS lon_idx, CASE WHEN j BETWEEN 0 AND 119 THEN j END AS lat_idx FROM (
    SELECT sitename, CAST(sitename * 37 % 720 AS INTEGER) - 320 AS i, CAST(sitename * 53 % 360 AS INTEGER) - 120 AS j FROM fx_site)""",
)(lambda s, d: G.locate(fx_site(s, d), REGION).select("sitename", "lon_idx", "lat_idx"))
query(
    "locate_half_degree",
    """SELECT sitename, CAST(sitename * 37 % 720 AS INTEGER) AS lon_idx, CAST(sitename * 53 % 360 AS INTEGER) AS lat_idx FROM fx_site""",
)(lambda s, d: G.locate(fx_site(s, d), G.GridSpec()).select("sitename", "lon_idx", "lat_idx"))


def eav(s, d):
    """Customer metadata in the long layout, with market segments standing for rule variables."""
    names = {
        "AUTOMOBILE": "REFERENCE_PAPER",
        "BUILDING": "LOCATION_COMMENT",
        "FURNITURE": "FLUX_MEASUREMENTS_VARIABLE",
        "MACHINERY": "NETWORK",
    }
    variable = F.coalesce(*[F.when(F.col("variable") == k, v) for k, v in names.items()], F.lit("ELEVATION"))
    value = (
        F.when(F.col("variable") == "FURNITURE", F.when(F.col("group_id") % 2 == 0, "CO2").otherwise("CH4"))
        .when(
            F.col("variable") == "BUILDING",
            F.when(F.col("group_id") % 3 == 0, E.REINSTALLED).otherwise(F.concat(F.lit("at "), F.col("group_id").cast("string"))),
        )
        .otherwise(F.col("datavalue"))
    )
    # customers share group numbers, so that a group supplies several variables
    return fx_eav(s, d).select(
        F.col("site_id").alias("SITE_ID"),
        F.floor(F.col("group_id") / 100).alias("GROUP_ID"),
        F.concat(F.lit("GRP_"), F.col("variable")).alias("VARIABLE_GROUP"),
        variable.alias("VARIABLE"),
        value.alias("DATAVALUE"),
        F.col("group_id").alias("line"),
    )


EAV = """SELECT site_id AS "SITE_ID", CAST(floor(group_id / 100) AS BIGINT) AS "GROUP_ID", 'GRP_' || variable AS "VARIABLE_GROUP",
  CASE variable WHEN 'AUTOMOBILE' THEN 'REFERENCE_PAPER' WHEN 'BUILDING' THEN 'LOCATION_COMMENT' WHEN 'FURNITURE' THEN
  'FLUX_MEASUREMENTS_VARIABLE' WHEN 'MACHINERY' THEN 'NETWORK' ELSE 'ELEVATION' END AS "VARIABLE",
  CASE WHEN variable = 'FURNITURE' THEN CASE WHEN group_id % 2 = 0 THEN 'CO2' ELSE 'CH4' END
  WHEN variable = 'BUILDING' THEN CASE WHEN group_id % 3 = 0 THEN 'Reinstallation after management activities' ELSE 'at ' || group_id END
  ELSE datavalue END AS "DATAVALUE", group_id AS line FROM fx_eav"""
_SCOPE = """{out} AS (SELECT s.* FROM {src} s LEFT JOIN (SELECT DISTINCT x."SITE_ID", x."VARIABLE", p.g FROM {src} x JOIN
  (SELECT "SITE_ID", first("GROUP_ID" ORDER BY line) AS g FROM {src} WHERE {cond} AND "SITE_ID" IN (SELECT "SITE_ID" FROM {src}
  WHERE "VARIABLE" = '{var}' GROUP BY "SITE_ID" HAVING count(*) > 1) GROUP BY "SITE_ID") p ON p."SITE_ID" = x."SITE_ID" AND p.g = x."GROUP_ID") q
  ON q."SITE_ID" = s."SITE_ID" AND q."VARIABLE" = s."VARIABLE" WHERE q.g IS NULL OR q.g = s."GROUP_ID")"""
EAV_STEPS = f"""WITH e0 AS (SELECT * FROM ({EAV}) WHERE "VARIABLE" <> 'NETWORK'),
  e1 AS (SELECT e0.* FROM e0 LEFT JOIN (SELECT "SITE_ID", "VARIABLE", first("GROUP_ID" ORDER BY line) AS g FROM e0
    WHERE "VARIABLE" = 'REFERENCE_PAPER' GROUP BY ALL) f USING ("SITE_ID", "VARIABLE") WHERE g IS NULL OR g = "GROUP_ID"),
  {_SCOPE.format(out="e2", src="e1", var="LOCATION_COMMENT", cond='''"VARIABLE" = 'LOCATION_COMMENT' AND "DATAVALUE" <> 'Reinstallation after management activities' ''')},
  {_SCOPE.format(out="e3", src="e2", var="FLUX_MEASUREMENTS_VARIABLE", cond='''"VARIABLE" = 'FLUX_MEASUREMENTS_VARIABLE' AND "DATAVALUE" = 'CO2' ''')},
  e4 AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY "SITE_ID", "VARIABLE" ORDER BY
    try_cast("DATAVALUE" AS DOUBLE) DESC NULLS LAST, line) AS rn FROM e3) WHERE rn = 1)"""
query("dedupe_eav", EAV_STEPS + " SELECT * FROM e4")(lambda s, d: E.dedupe_eav(eav(s, d)))
query("group_scope_prefer", EAV_STEPS + " SELECT * FROM e2")(
    lambda s, d: E.prefer_location(E.keep_first_group(E.drop_noisy(eav(s, d))))
)
query(
    "eav_to_wide",
    EAV_STEPS
    + """ SELECT "SITE_ID", max(CASE WHEN "VARIABLE" = 'ELEVATION' THEN "DATAVALUE" END) AS "ELEVATION",
    max(CASE WHEN "VARIABLE" = 'REFERENCE_PAPER' THEN "DATAVALUE" END) AS "REFERENCE_PAPER" FROM e4 GROUP BY "SITE_ID" """,
)(lambda s, d: E.eav_to_wide(E.dedupe_eav(eav(s, d)), ["ELEVATION", "REFERENCE_PAPER"]))


def tower_code():
    """A tower code of two letters and three digits, unlike for 676,000 keys."""
    key = F.col("s_suppkey")
    letters = [F.char((F.floor(key / n) % 26 + 65).cast("long")) for n in (26_000, 1000)]
    return F.concat(*letters, F.lit("-"), F.lpad((key % 1000).cast("string"), 3, "0"))


TOWER = """chr(CAST(65 + (s_suppkey // 26000) % 26 AS INTEGER)) || chr(CAST(65 + (s_suppkey // 1000) % 26 AS INTEGER)) || '-'
  || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0')"""


def file_names(s, d):
    """Tower file names of every supplier, two versions for even keys."""
    key, site = F.col("s_suppkey"), tower_code()
    versions = F.when(key % 2 == 0, F.array(F.lit("1-2"), F.lit("1-3"))).otherwise(F.array(F.lit("1-1")))
    return table(s, d, "supplier").select(
        F.explode(versions).alias("v"), site.alias("site"), (F.lit(1990) + key % 20).alias("y")
    ).select(
        F.concat(
            F.lit("FLX_"), "site", F.lit("_FLUXNET2015_FULLSET_DD_"), F.col("y").cast("string"), F.lit("-2014_"), "v", F.lit(".csv")
        ).alias("file_name")
    )


FILES = f"""SELECT 'FLX_' || {TOWER} || '_FLUXNET2015_FULLSET_DD_' || (1990 + s_suppkey % 20) || '-2014_' || v || '.csv'
  AS file_name FROM (SELECT s_suppkey, unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['1-2', '1-3'] ELSE ['1-1'] END) AS v FROM supplier)"""
query(
    "pick_site_files",
    f"""SELECT substr(file_name, 5, 6) AS sitename, min(file_name) AS file_name FROM (SELECT *, count(*) OVER (PARTITION BY substr(file_name, 5, 6)) AS n
    FROM ({FILES})) WHERE n = 1 OR file_name LIKE '%3.csv' GROUP BY ALL""",
)(lambda s, d: _pick(file_names(s, d)))
query(
    "years_from_filenames",
    f"""SELECT substr(file_name, 5, 6) AS mysitename, CAST(substr(file_name, 35, 4) AS INTEGER) AS year_start,
    CAST(substr(file_name, 40, 4) AS INTEGER) AS year_end FROM ({FILES})""",
)(lambda s, d: E.years_from_filenames(file_names(s, d), "file_name"))
query(
    "override_years",
    f"""SELECT {TOWER} AS mysitename, coalesce(y, 1980 + s_nationkey) AS year_start, 2014 AS year_end
    FROM supplier LEFT JOIN (SELECT substr(file_name, 5, 6) AS f, CAST(substr(file_name, 35, 4) AS INTEGER) AS y
    FROM ({FILES}) WHERE file_name LIKE '%3.csv') ON f = {TOWER}""",
)(
    lambda s, d: E.override_years(
        table(s, d, "supplier")
        .select(
            tower_code().alias("mysitename"),
            F.concat((F.lit(1980) + F.col("s_nationkey")).cast("string"), F.lit("07")).alias("year_start"),
            F.lit("20141231").alias("year_end"),
        ),
        E.years_from_filenames(file_names(s, d).where(F.col("file_name").endswith("3.csv")), "file_name"),
    )
)


def _pick(files):
    from siteflux.sources.readers import pick_site_files

    return pick_site_files(files, "d")

