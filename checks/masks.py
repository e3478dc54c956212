"""Masks, filters and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggs import ANNUAL_OBS, MIN_DAYS
from checks.base import fx_daily, fx_site, obs_mod, query, rsql, table
from siteflux.functions import rows as R
from siteflux.operators import cleaning as C
from siteflux.operators import masks as K
from siteflux.operators.quantiles import hinges

OM = "sitename, date"


def flags(s, d):
    """Flagged days from orders: a day is covered if any order falls on it."""
    o = table(s, d, "orders").select(
        F.col("o_custkey").alias("sitename"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("o_orderstatus") == "F").alias("is_flue_drought"),
        F.when(F.col("o_orderkey") % 9 > 0, F.lit("c")).alias("cluster"),
    )
    return o.groupBy("sitename", "date").agg(
        F.max("is_flue_drought").alias("is_flue_drought"), F.max("cluster").alias("cluster")
    )


FLAGS = """SELECT o_custkey AS sitename, CAST(o_orderdate AS DATE) AS date, max(o_orderstatus = 'F') AS flag,
  max(CASE WHEN o_orderkey % 9 > 0 THEN 'c' END) AS cluster FROM orders GROUP BY ALL"""

query(
    "select_family",
    rsql("SELECT sitename, date, gpp_nt, gpp_dt FROM fx_daily", OM, "gpp_nt gpp_dt"),
)(
    lambda s, d: fx_daily(s, d).select(
        "sitename", "date", *K.select_family(fx_daily(s, d), "gpp_", not_ends="mod")
    )
)
query(
    "mask_where",
    rsql("SELECT sitename, date, CASE WHEN NOT (temp < 5) THEN gpp_obs END AS gpp_obs FROM obs_mod", OM, "gpp_obs"),
)(lambda s, d: K.mask_where(obs_mod(s, d), "gpp_obs", F.col("temp") < 5).select("sitename", "date", "gpp_obs"))
CALIB = """SELECT sitename, date, temp, soilm_obs_mean, gpp_mod, CASE WHEN NOT (date < DATE '2000-02-18') AND NOT (temp < 5)
  AND NOT (temp > 35) AND NOT (soilm_obs_mean < 0.5) THEN gpp_obs END AS gpp_obs FROM obs_mod"""
query("calibration_filter", rsql(CALIB, OM, "gpp_obs"))(
    lambda s, d: K.calibration_filter(obs_mod(s, d), "gpp_obs", 5.0, 35.0, 0.5).select("sitename", "date", "gpp_obs")
)
query(
    "mask_flagged_days",
    rsql(
        f"""SELECT o.sitename, o.date, CASE WHEN NOT f.flag THEN gpp_obs END AS gpp_obs FROM obs_mod o
        LEFT JOIN (SELECT * FROM ({FLAGS}) WHERE cluster IS NOT NULL) f USING (sitename, date)""",
        OM,
        "gpp_obs",
    ),
)(lambda s, d: K.mask_flagged_days(obs_mod(s, d), flags(s, d)).select("sitename", "date", "gpp_obs"))
query(
    "mask_low_quality",
    rsql("SELECT sitename, date, CASE WHEN qc_nt < 0.5 THEN NULL ELSE gpp_nt END AS gpp_nt FROM fx_daily", OM, "gpp_nt"),
)(lambda s, d: K.mask_low_quality(fx_daily(s, d), "gpp_nt", "qc_nt", 0.5).select("sitename", "date", "gpp_nt"))
query(
    "mask_low_quality_unknown_flag",
    rsql("SELECT sitename, date, CASE WHEN soilm < 0.5 THEN NULL ELSE gpp_nt END AS gpp_nt FROM fx_daily", OM, "gpp_nt"),
)(lambda s, d: K.mask_low_quality(fx_daily(s, d), "gpp_nt", "soilm", 0.5).select("sitename", "date", "gpp_nt"))
# flags are wholly absent for every third site
query(
    "mask_if_no_qc_in_scope",
    rsql(
        """SELECT sitename, date, CASE WHEN qc IS NULL AND max(qc IS NOT NULL) OVER (PARTITION BY sitename) THEN NULL
        ELSE et END AS et FROM (SELECT *, CASE WHEN sitename % 3 > 0 THEN soilm END AS qc FROM fx_daily)""",
        OM,
        "et",
    ),
)(
    lambda s, d: K.mask_if_no_qc_in_scope(
        fx_daily(s, d).withColumn("qc", F.when(F.col("sitename") % 3 > 0, F.col("soilm"))), "et", "qc"
    ).select("sitename", "date", "et")
)
query(
    "mask_negative",
    rsql("SELECT sitename, date, CASE WHEN temp < 0 THEN NULL ELSE temp END AS temp FROM fx_daily", OM, "temp"),
)(lambda s, d: K.mask_negative(fx_daily(s, d), "temp").select("sitename", "date", "temp"))
query(
    "complete_cases",
    rsql(
        """SELECT * FROM obs_mod WHERE gpp_obs IS NOT NULL AND temp IS NOT NULL AND soilm_obs_mean IS NOT NULL AND temp > 0""",
        OM,
        "gpp_obs gpp_mod temp soilm_obs_mean",
    ),
)(lambda s, d: K.complete_cases(obs_mod(s, d), ["gpp_obs", "temp", "soilm_obs_mean"], "temp"))
query(
    "coalesce_sources",
    rsql("SELECT sitename, date, coalesce(soilm, gpp_nt, et) AS best FROM fx_daily", OM, "best"),
)(
    lambda s, d: K.coalesce_sources(fx_daily(s, d), "best", ["soilm", "absent", "gpp_nt", "et"]).select(
        "sitename", "date", "best"
    )
)
query(
    "threshold_filter",
    rsql("SELECT * FROM obs_mod WHERE temp > 5 AND soilm_obs_mean > 0.4", OM, "gpp_obs gpp_mod temp soilm_obs_mean"),
)(lambda s, d: K.threshold_filter(obs_mod(s, d), 5.0, 0.4, soilm="soilm_obs_mean"))
query("with_bias", rsql("SELECT sitename, date, gpp_mod - gpp_obs AS bias FROM obs_mod", OM, "bias"))(
    lambda s, d: K.with_bias(obs_mod(s, d)).select("sitename", "date", "bias")
)
query(
    "derive_c4",
    """SELECT sitename, kind, kind IN ('C4', 'C3C4') AS c4 FROM (SELECT sitename, CASE classid % 4 WHEN 0 THEN 'C4'
    WHEN 1 THEN 'C3' WHEN 2 THEN 'C3C4' END AS kind FROM fx_site)""",
)(
    lambda s, d: fx_site(s, d)
    .select(
        "sitename",
        F.when(F.col("classid") % 4 == 0, "C4")
        .when(F.col("classid") % 4 == 1, "C3")
        .when(F.col("classid") % 4 == 2, "C3C4")
        .alias("kind"),
    )
    .withColumn("c4", R.is_c4(F.col("kind")))
)
query("keep_not_c4", "SELECT sitename, c4 FROM fx_site WHERE coalesce(NOT c4, TRUE)")(
    lambda s, d: fx_site(s, d).where(R.keep_not_c4(F.col("c4"))).select("sitename", "c4")
)
query(
    "zone_label",
    "SELECT sitename, 'Z' || classid || CASE WHEN lat > 0 THEN ' north' ELSE ' south' END AS climatezone FROM fx_site",
)(
    lambda s, d: fx_site(s, d).select(
        "sitename", R.zone_label(F.concat(F.lit("Z"), F.col("classid").cast("string")), F.col("lat")).alias("climatezone")
    )
)
query(
    "split_class",
    """SELECT p_partkey, p_brand AS code, CASE WHEN p_size % 3 > 0 THEN p_type END AS word FROM part""",
)(
    lambda s, d: table(s, d, "part")
    .withColumn("text", F.concat("p_brand", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit(" - "), "p_type")).otherwise(F.lit(""))))
    .select("p_partkey", R.class_code(F.col("text")).alias("code"), R.class_word(F.col("text")).alias("word"))
)
query(
    "cap_and_sunshine",
    rsql(
        """SELECT sitename, date, CASE WHEN temp IS NULL THEN NULL ELSE least(temp * 4, 100) END AS ccov,
        (100 - CASE WHEN temp IS NULL THEN NULL ELSE least(temp * 4, 100) END) / 100 AS fsun FROM fx_daily""",
        OM,
        "ccov fsun",
    ),
)(
    lambda s, d: fx_daily(s, d)
    .select("sitename", "date", R.cap(F.col("temp") * 4, 100.0).alias("ccov"))
    .withColumn("fsun", R.sunshine_fraction(F.col("ccov")))
)
query(
    "year_clean",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders",
)(
    lambda s, d: table(s, d, "orders").select(
        "o_orderkey", R.year_clean(F.date_format("o_orderdate", "yyyyMMdd")).alias("year")
    )
)

PAIRED_IN = """SELECT sitename, date, CASE WHEN qc_nt < 0.5 THEN NULL ELSE gpp_nt END AS a,
  CASE WHEN qc_dt < 0.5 THEN NULL ELSE gpp_dt END AS b FROM fx_daily"""
PAIRED = f"""SELECT p.sitename, p.date,
  CASE WHEN coalesce(a - b > hi OR a - b < lo, FALSE) OR a < 0 THEN NULL ELSE a END AS gpp_nt,
  CASE WHEN coalesce(a - b > hi OR a - b < lo, FALSE) OR b < 0 THEN NULL ELSE b END AS gpp_dt
  FROM ({PAIRED_IN}) p LEFT JOIN (SELECT sitename, quantile_cont(a - b, 0.025) AS lo, quantile_cont(a - b, 0.975) AS hi
  FROM ({PAIRED_IN}) GROUP BY sitename) USING (sitename)"""
query("clean_paired_fluxes", rsql(PAIRED, OM, "gpp_nt gpp_dt"))(
    lambda s, d: C.clean_paired_fluxes(fx_daily(s, d), "gpp_nt", "gpp_dt", "qc_nt", "qc_dt", 0.5).select(
        "sitename", "date", "gpp_nt", "gpp_dt"
    )
)


def repeated_sql(src: str, col: str) -> str:
    return f"""SELECT r.sitename, r.date, CASE WHEN EXISTS (SELECT 1 FROM (SELECT sitename, {col} AS s FROM ({src})
      WHERE {col} IS NOT NULL GROUP BY sitename, {col} HAVING count(*) > 2) q WHERE q.sitename = r.sitename
      AND abs(q.s - r.{col}) < 1e-4) THEN NULL ELSE r.{col} END AS {col} FROM ({src}) r"""


query("mask_repeated_values", rsql(repeated_sql("SELECT sitename, date, et FROM fx_daily", "et"), OM, "et"))(
    lambda s, d: C.mask_repeated_values(fx_daily(s, d).select("sitename", "date", "et"), "et")
)
# values nearer to each other than the tolerance
NEAR = "SELECT sitename, date, floor(gpp_mod * 3) / 3e4 + (dayofyear(date) % 5) * 3.7e-5 AS v FROM fx_daily"
query("mask_repeated_values_near", rsql(repeated_sql(NEAR, "v"), OM, "v", 9), digits=9)(
    lambda s, d: C.mask_repeated_values(
        fx_daily(s, d).select(
            "sitename", "date", (F.floor(F.col("gpp_mod") * 3) / 3e4 + (F.dayofyear("date") % 5) * 3.7e-5).alias("v")
        ),
        "v",
    )
)
ET_CLEAN = repeated_sql(
    """SELECT sitename, date, CASE WHEN soilm < 0.2 THEN NULL WHEN soilm IS NULL AND max(soilm IS NOT NULL)
    OVER (PARTITION BY sitename) THEN NULL ELSE et END AS et FROM fx_daily""",
    "et",
)
query("clean_et", rsql(ET_CLEAN, OM, "et"))(
    lambda s, d: C.clean_et(fx_daily(s, d), "et", "soilm", 0.2).select("sitename", "date", "et")
)
query(
    "clean_swc",
    rsql(
        "SELECT sitename, date, CASE WHEN qc_nt < 0.9 THEN NULL ELSE soilm END AS swc_1 FROM fx_daily", OM, "swc_1"
    ),
)(
    lambda s, d: C.clean_swc(
        fx_daily(s, d).select("sitename", "date", F.col("soilm").alias("swc_1"), F.col("qc_nt").alias("swc_1_QC")),
        [("swc_1", "swc_1_QC")],
        0.9,
    ).drop("swc_1_QC")
)

HINGES = """SELECT sitename,
  (max(CASE WHEN rn = floor(n4) THEN v END) + max(CASE WHEN rn = ceil(n4) THEN v END)) / 2 AS h1,
  (max(CASE WHEN rn = floor(n + 1 - n4) THEN v END) + max(CASE WHEN rn = ceil(n + 1 - n4) THEN v END)) / 2 AS h2
  FROM (SELECT sitename, v, row_number() OVER (PARTITION BY sitename ORDER BY v) AS rn, count(*) OVER (PARTITION BY sitename) AS n,
    floor((count(*) OVER (PARTITION BY sitename) + 3) / 2) / 2 AS n4 FROM ({src}) WHERE v IS NOT NULL) GROUP BY sitename"""
# the days of every seventh site belong to no known site
UNKNOWN = "SELECT CASE WHEN sitename % 7 > 0 THEN sitename END AS sitename, date, et, gpp_nt, gpp_dt, qc_nt, qc_dt FROM fx_daily"


def unknown_site(s, d):
    site = F.when(F.col("sitename") % 7 > 0, F.col("sitename")).alias("sitename")
    return fx_daily(s, d).select(site, "date", "et", "gpp_nt", "gpp_dt", "qc_nt", "qc_dt")


query(
    "mask_outliers_unknown_site",
    rsql(
        f"""SELECT a.sitename, a.date, CASE WHEN et < h1 - 0.2 * (h2 - h1) OR et > h2 + 0.2 * (h2 - h1) THEN NULL ELSE et END AS et
        FROM ({UNKNOWN}) a JOIN ({HINGES.format(src=f"SELECT sitename, et AS v FROM ({UNKNOWN})")}) h
        ON a.sitename IS NOT DISTINCT FROM h.sitename""",
        OM,
        "et",
    ),
)(lambda s, d: C.mask_outliers(unknown_site(s, d).select("sitename", "date", "et"), "et", 0.2))
query("hinges", rsql(HINGES.format(src="SELECT sitename, et AS v FROM fx_daily"), "sitename", "h1 h2"))(
    lambda s, d: hinges(fx_daily(s, d), "et", ["sitename"], "h1", "h2")
)
query(
    "mask_outliers",
    rsql(
        f"""SELECT a.sitename, a.year, CASE WHEN gpp_obs < h1 - 1.5 * (h2 - h1) OR gpp_obs > h2 + 1.5 * (h2 - h1) THEN NULL
        ELSE gpp_obs END AS gpp_obs FROM ({ANNUAL_OBS}) a LEFT JOIN
        ({HINGES.format(src=f"SELECT sitename, gpp_obs AS v FROM ({ANNUAL_OBS})")}) USING (sitename)""",
        "sitename, year",
        "gpp_obs",
    ),
)(
    lambda s, d: C.mask_outliers(
        obs_mod(s, d)
        .groupBy("sitename", F.year("date").alias("year"))
        .agg(F.when(F.count(F.lit(1)) >= MIN_DAYS, F.sum("gpp_obs")).alias("gpp_obs")),
        "gpp_obs",
    )
)
