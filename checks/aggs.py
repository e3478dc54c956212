"""Aggregations and skill."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import fx_daily, fx_eav, fx_sensor, fx_site, obs_mod, query, rsql
from siteflux.functions.rows import row_mean, row_weighted_mean
from siteflux.operators import aggregate as A
from siteflux.operators import skill as S
from siteflux.operators.groups import find_duplicates, first_per_key
from siteflux.operators.joins import attach_model
from siteflux.operators.quantiles import quantiles
from siteflux.operators.series import anomalies

Y, M, D = "CAST(year(date) AS INTEGER)", "CAST(month(date) AS INTEGER)", "CAST(dayofyear(date) AS INTEGER)"
MIN_DAYS = 60  # the given series are sparse


def strict(fn: str, c: str) -> str:
    return f"CASE WHEN count({c}) = count(*) THEN {fn}({c}) END"


def skill_sql(obs: str = "gpp_obs", mod: str = "gpp_mod") -> str:
    pair = f"CASE WHEN {mod} IS NOT NULL THEN {obs} END"
    return f"""
      CASE WHEN regr_count({obs}, {mod}) >= 3 AND max({pair}) > min({pair}) THEN
        1 - (1 - regr_r2({obs}, {mod})) * (regr_count({obs}, {mod}) - 1) / (regr_count({obs}, {mod}) - 2) END AS rsq,
      sqrt(avg(({mod} - {obs}) * ({mod} - {obs}))) AS rmse,
      CASE WHEN regr_count({obs}, {mod}) >= 2 THEN regr_slope({obs}, {mod}) END AS slope,
      avg({mod} - {obs}) AS bias, CAST(regr_count({obs}, {mod}) AS BIGINT) AS nvals"""


SKILL = "rsq rmse slope bias"
ANNUAL = f"""SELECT sitename, {Y} AS year,
  CASE WHEN count(*) >= {MIN_DAYS} THEN {strict('sum', 'gpp_mod')} END AS gpp_mod, count(*) AS n
  FROM obs_mod GROUP BY ALL"""
ANNUAL_OBS = f"""SELECT sitename, {Y} AS year,
  CASE WHEN count(*) >= {MIN_DAYS} THEN sum(gpp_obs) END AS gpp_obs FROM obs_mod GROUP BY ALL"""
MONTHLY = f"""SELECT sitename, {Y} AS year, {M} AS moy, {strict('avg', 'gpp_mod')} AS gpp_mod, count(*) AS n
  FROM obs_mod GROUP BY ALL"""


def xbin_sql(k: int = 5) -> str:
    last = -(-365 // k) - 1
    return f"""CASE WHEN date >= DATE '1990-01-01' AND date < DATE '2018-01-01' + {last * k} THEN
      CAST(date_trunc('year', date) AS DATE) + CAST(least(floor((dayofyear(date) - 1) / {k}), {last}) AS INTEGER) * {k} END"""


def xday_sql(c: str, n: str, k: int = 5, src: str = "obs_mod") -> str:
    return f"""SELECT sitename, {xbin_sql(k)} AS inbin, avg({c}) AS {c}, min({c}) AS {c}_min, max({c}) AS {c}_max,
      count({c}) AS {n} FROM {src} GROUP BY ALL"""


query("annual_sum", rsql(ANNUAL, "sitename, year, n", "gpp_mod"))(
    lambda s, d: A.annual_sum(obs_mod(s, d), "gpp_mod", MIN_DAYS)
)
query(
    "annual_sum_strict_nulls",
    rsql(
        f"SELECT sitename, {Y} AS year, CASE WHEN count(*) >= 1 THEN {strict('sum', 'gpp_obs')} END AS gpp_obs, count(*) AS n FROM obs_mod GROUP BY ALL",
        "sitename, year, n",
        "gpp_obs",
    ),
)(lambda s, d: A.annual_sum(obs_mod(s, d), "gpp_obs", 1))
query("monthly_mean", rsql(MONTHLY, "sitename, year, moy, n", "gpp_mod"))(
    lambda s, d: A.monthly_mean(obs_mod(s, d), "gpp_mod")
)
for _k in (5, 8):
    query(f"xday_aggregate_{_k}", rsql(xday_sql("gpp_obs", "n_obs", _k), "sitename, inbin, n_obs", "gpp_obs gpp_obs_min gpp_obs_max"))(
        lambda s, d, k=_k: A.xday_aggregate(obs_mod(s, d), "gpp_obs", k)
    )
# the same days twenty years later, past any fixed range
LATE = "SELECT sitename, CAST(date + INTERVAL 20 YEAR AS DATE) AS date, gpp_obs FROM obs_mod"
query(
    "xday_aggregate_late_years",
    rsql(
        f"""SELECT sitename, inbin, avg(gpp_obs) AS gpp_obs, min(gpp_obs) AS gpp_obs_min, max(gpp_obs) AS gpp_obs_max, count(gpp_obs) AS n_obs FROM (
        SELECT *, CAST(date_trunc('year', date) AS DATE) + CAST(least(floor((dayofyear(date) - 1) / 5), 72) AS INTEGER) * 5 AS inbin FROM ({LATE}))
        GROUP BY sitename, inbin""",
        "sitename, inbin, n_obs",
        "gpp_obs gpp_obs_min gpp_obs_max",
    ),
)(
    lambda s, d: A.xday_aggregate(
        obs_mod(s, d).select("sitename", F.add_months("date", 240).alias("date"), "gpp_obs"),
        "gpp_obs",
        5,
    )
)
query("valid_count", "SELECT sitename, count(gpp_obs) AS ndailygpp FROM obs_mod GROUP BY sitename")(
    lambda s, d: A.valid_count(obs_mod(s, d))
)


def annual_pair(s, d):
    daily = obs_mod(s, d)
    obs = daily.groupBy("sitename", F.year("date").alias("year")).agg(
        F.when(F.count(F.lit(1)) >= MIN_DAYS, F.sum("gpp_obs")).alias("gpp_obs")
    )
    return attach_model(obs, A.annual_sum(daily, "gpp_mod", MIN_DAYS), ["sitename", "year"])


PAIR = f"SELECT o.sitename, o.year, o.gpp_obs, m.gpp_mod, m.n FROM ({ANNUAL_OBS}) o LEFT JOIN ({ANNUAL}) m USING (sitename, year)"
SPATIAL = f"SELECT sitename, avg(gpp_obs) AS gpp_obs, avg(gpp_mod) AS gpp_mod FROM ({PAIR}) GROUP BY sitename"
query("multiyear_mean", rsql(SPATIAL, "sitename", "gpp_obs gpp_mod"))(lambda s, d: A.multiyear_mean(annual_pair(s, d)))


def interpolate_sql(src: str, cols: list[str], by: str, order: str) -> str:
    """Linear interpolation by row number within ``by``."""
    marks = ", ".join(
        f"""last_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER up AS p_{c},
        last_value({c} IGNORE NULLS) OVER up AS pv_{c},
        first_value(CASE WHEN {c} IS NOT NULL THEN rn END IGNORE NULLS) OVER down AS n_{c},
        first_value({c} IGNORE NULLS) OVER down AS nv_{c}"""
        for c in cols
    )
    out = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} ELSE pv_{c} + (nv_{c} - pv_{c}) * ((rn - p_{c}) / (n_{c} - p_{c})) END AS {c}"
        for c in cols
    )
    return f"""SELECT * REPLACE ({out}) FROM (
      SELECT *, {marks} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM ({src}))
      WINDOW up AS (PARTITION BY {by} ORDER BY rn ROWS UNBOUNDED PRECEDING),
             down AS (PARTITION BY {by} ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def cycle_sql(src: str, key: str) -> str:
    agg = f"""SELECT sitename, {key}, avg(gpp_obs) AS obs_mean, min(gpp_obs) AS obs_min, max(gpp_obs) AS obs_max,
      avg(gpp_mod) AS mod_mean, min(gpp_mod) AS mod_min, max(gpp_mod) AS mod_max FROM ({src}) GROUP BY ALL"""
    return interpolate_sql(agg, ["obs_mean", "obs_min", "obs_max"], "sitename", key)


CYCLE = "obs_mean obs_min obs_max mod_mean mod_min mod_max"
DOY = cycle_sql(f"SELECT *, {D} AS doy FROM obs_mod WHERE dayofyear(date) <> 366", "doy")
XDF = f"""SELECT o.*, m.gpp_mod FROM ({xday_sql('gpp_obs', 'n_obs')}) o
  LEFT JOIN ({xday_sql('gpp_mod', 'n_mod')}) m USING (sitename, inbin)"""
XOY = cycle_sql(f"SELECT *, CAST(dayofyear(inbin) AS INTEGER) AS xoy FROM ({XDF})", "xoy")

query("mean_seasonal_cycle_doy", rsql(DOY, "sitename, doy", CYCLE))(
    lambda s, d: A.mean_seasonal_cycle_doy(obs_mod(s, d))
)


def xdf(s, d):
    daily = obs_mod(s, d)
    return attach_model(
        A.xday_aggregate(daily, "gpp_obs", 5), A.xday_aggregate(daily, "gpp_mod", 5, "n_mod"), ["sitename", "inbin"]
    )


query("mean_seasonal_cycle_xoy", rsql(XOY, "sitename, xoy", CYCLE))(lambda s, d: A.mean_seasonal_cycle_xoy(xdf(s, d)))

ZONE_SITES = """SELECT sitename, lat, CASE WHEN classid % 7 > 0 THEN 'Z' || (classid % 7) END AS koeppen_code FROM fx_site"""
ZONE_LABELS = f"""SELECT sitename, coalesce(koeppen_code, '-') AS koeppen_code,
  CASE WHEN lat > 0 THEN 'north' ELSE 'south' END AS hemisphere FROM ({ZONE_SITES})"""
ZONES = interpolate_sql(
    f"""SELECT koeppen_code, hemisphere, {D} AS doy,
    quantile_cont(gpp_obs, 0.5) AS obs_mean, quantile_cont(gpp_obs, 0.33) AS obs_min, quantile_cont(gpp_obs, 0.66) AS obs_max,
    quantile_cont(gpp_mod, 0.5) AS mod_mean, quantile_cont(gpp_mod, 0.33) AS mod_min, quantile_cont(gpp_mod, 0.66) AS mod_max
    FROM obs_mod JOIN ({ZONE_LABELS}) USING (sitename) WHERE dayofyear(date) <> 366 GROUP BY ALL""",
    ["obs_mean", "obs_min", "obs_max"],
    "koeppen_code, hemisphere",
    "doy",
)


def zone_sites(s, d):
    code = F.when(F.col("classid") % 7 > 0, F.concat(F.lit("Z"), (F.col("classid") % 7).cast("string")))
    return fx_site(s, d).select("sitename", "lat", code.alias("koeppen_code"))


query(
    "zone_seasonal_cycle",
    rsql(
        f"""SELECT *, koeppen_code || ' ' || hemisphere AS climatezone FROM ({ZONES})
        JOIN (SELECT koeppen_code, hemisphere, count(*) AS nsites FROM ({ZONE_LABELS}) GROUP BY ALL) USING (koeppen_code, hemisphere)""",
        "koeppen_code, hemisphere, doy, nsites, climatezone",
        CYCLE,
    ),
)(lambda s, d: A.zone_seasonal_cycle(obs_mod(s, d), zone_sites(s, d)))

query("skill_pooled_daily", rsql(f"SELECT {skill_sql()} FROM obs_mod", "nvals", SKILL))(
    lambda s, d: S.skill(obs_mod(s, d))
)
query("skill_by_site", rsql(f"SELECT sitename, {skill_sql()} FROM obs_mod GROUP BY sitename", "sitename, nvals", SKILL))(
    lambda s, d: S.skill(obs_mod(s, d), ["sitename"])
)
query(
    "skill_by_site_annual",
    rsql(f"SELECT sitename, {skill_sql()} FROM ({PAIR}) GROUP BY sitename HAVING count(gpp_obs) > 2", "sitename, nvals", SKILL),
)(lambda s, d: S.skill_by_site(annual_pair(s, d), 2))
query(
    "skill_extended",
    rsql(
        f"""SELECT sitename, {skill_sql()},
        100 * sqrt(avg((gpp_mod - gpp_obs) * (gpp_mod - gpp_obs))) / avg(gpp_obs) AS prmse,
        1 - sum((gpp_mod - gpp_obs) * (gpp_mod - gpp_obs)) / regr_syy(gpp_obs, gpp_mod) AS nse,
        1 - sum((gpp_mod - gpp_obs) * (gpp_mod - gpp_obs)) / regr_sxx(gpp_obs, gpp_mod) AS nse_ref,
        avg((gpp_mod - gpp_obs) / gpp_obs) AS rel_bias, count(gpp_obs) AS n_obs FROM obs_mod GROUP BY sitename""",
        "sitename, nvals, n_obs",
        SKILL + " prmse nse nse_ref rel_bias",
    ),
)(lambda s, d: S.skill_extended(obs_mod(s, d), ["sitename"]))

_COSTS = {
    "rmse": "sqrt(avg((gpp_mod - gpp_obs) ** 2))",
    "mae": "avg(abs(gpp_mod - gpp_obs))",
    "inverse_rmse": "1 / sqrt(avg((gpp_mod - gpp_obs) ** 2))",
    "scaled_rmse": "sqrt(avg((0.8 * gpp_mod - gpp_obs) ** 2))",
}
for _kind, _expr in _COSTS.items():
    query(f"cost_{_kind}", rsql(f"SELECT sitename, {_expr} AS cost FROM obs_mod GROUP BY sitename", "sitename", "cost"))(
        lambda s, d, kind=_kind: S.cost(obs_mod(s, d), kind, ["sitename"], scale=0.8)
    )

_WEEK = "CAST(floor((dayofyear(date) - 1) / 7) AS INTEGER) + 1"
for _freq, _keys in (("week", f", {_WEEK} AS week"), ("month", f", {M} AS month"), ("year", "")):
    query(
        f"roll_up_{_freq}",
        rsql(
            f"""SELECT sitename, {Y} AS year{_keys}, min(date) AS date, {strict('sum', 'gpp_mod')} AS gpp,
            {strict('sum', 'et')} AS aet, {strict('avg', 'qc_nt')} AS wcont FROM fx_daily GROUP BY ALL""",
            "sitename, year, date" + (f", {_freq}" if _keys else ""),
            "gpp aet wcont",
        ),
    )(
        lambda s, d, freq=_freq: A.roll_up(
            fx_daily(s, d).select(
                "sitename", "date", F.col("gpp_mod").alias("gpp"), F.col("et").alias("aet"), F.col("qc_nt").alias("wcont")
            ),
            freq,
        )
    )
query(
    "roll_up_sensor_week",
    rsql(
        f"SELECT sitename, {Y} AS year, {_WEEK} AS week, min(date) AS date, sum(v) AS gpp FROM fx_sensor GROUP BY ALL",
        "sitename, year, week, date",
        "gpp",
    ),
)(lambda s, d: A.roll_up(fx_sensor(s, d).select("sitename", "date", F.col("v").alias("gpp")), "week"))

_ALL = ["gpp_nt", "gpp_dt", "qc_nt", "qc_dt", "temp", "soilm", "et", "gpp_mod"]
query(
    "monthly_mean_all",
    rsql(
        f"SELECT sitename, {Y} AS year, {M} AS month, {', '.join(f'avg({c}) AS {c}' for c in _ALL)} FROM fx_daily GROUP BY ALL",
        "sitename, year, month",
        " ".join(_ALL),
    ),
)(lambda s, d: A.monthly_mean_all(fx_daily(s, d)))
query(
    "find_duplicates",
    "SELECT site_id, variable, count(*) AS n FROM fx_eav GROUP BY ALL HAVING count(*) > 1",
)(lambda s, d: find_duplicates(fx_eav(s, d), ["site_id", "variable"]))
query(
    "distinct_legend",
    """SELECT variable AS code, min(word) AS word FROM (SELECT variable, 'word ' || site_id AS word FROM fx_eav
    WHERE variable <> 'BUILDING') GROUP BY variable""",
)(
    lambda s, d: A.distinct_legend(
        fx_eav(s, d).select(
            F.when(F.col("variable") == "BUILDING", "-").otherwise(F.col("variable")).alias("code"),
            F.concat(F.lit("word "), F.col("site_id").cast("string")).alias("word"),
        ),
        "code",
        "word",
    )
)
query(
    "mean_by_doy_fill",
    rsql(
        "SELECT sitename, date, coalesce(soilm, avg(soilm) OVER (PARTITION BY sitename, dayofyear(date))) AS fapar FROM fx_daily",
        "sitename, date",
        "fapar",
    ),
)(lambda s, d: A.mean_by_doy_fill(fx_daily(s, d).select("sitename", "date", F.col("soilm").alias("fapar"))))

_NORM = {
    "max": "et / max(et) OVER w",
    "p97": "et / quantile_cont(et, 0.97) OVER w",
    "minmax": "(et - min(et) OVER w) / (max(et) OVER w - min(et) OVER w)",
}
for _kind, _expr in _NORM.items():
    query(
        f"normalise_{_kind}",
        rsql(f"SELECT sitename, date, {_expr} AS et FROM fx_daily WINDOW w AS (PARTITION BY sitename)", "sitename, date", "et"),
    )(lambda s, d, kind=_kind: A.normalise(fx_daily(s, d).select("sitename", "date", "et"), ["et"], kind))

query(
    "row_mean",
    rsql(
        """SELECT sitename, date, CASE WHEN gpp_nt IS NULL AND temp IS NULL THEN NULL ELSE
        (coalesce(gpp_nt, 0) + coalesce(temp, 0)) / ((gpp_nt IS NOT NULL)::INT + (temp IS NOT NULL)::INT) END AS known_mean,
        (gpp_nt + temp) / 2 AS strict_mean,
        CASE WHEN gpp_nt IS NULL AND temp IS NULL THEN NULL ELSE (coalesce(2 * gpp_nt, 0) + coalesce(temp, 0))
        / (2 * (gpp_nt IS NOT NULL)::INT + (temp IS NOT NULL)::INT) END AS weighted FROM fx_daily""",
        "sitename, date",
        "known_mean strict_mean weighted",
    ),
)(
    lambda s, d: fx_daily(s, d).select(
        "sitename",
        "date",
        row_mean(F.col("gpp_nt"), F.col("temp")).alias("known_mean"),
        row_mean(F.col("gpp_nt"), F.col("temp"), strict=True).alias("strict_mean"),
        row_weighted_mean([F.col("gpp_nt"), F.col("temp")], [2, 1]).alias("weighted"),
    )
)


def run_sites(s, d):
    return fx_site(s, d).select("sitename", (F.lit(1990) + F.col("classid")).alias("year_start"), F.lit(2014).alias("year_end"))


query("run_years", "SELECT sitename, 1990 + classid AS year_start, 2014 AS year_end, 2014 - (1990 + classid) + 1 AS nyears FROM fx_site")(
    lambda s, d: A.run_years(run_sites(s, d))
)
query("total_run_years", "SELECT CAST(sum(2014 - (1990 + classid) + 1) AS BIGINT) AS total_years FROM fx_site")(
    lambda s, d: A.total_run_years(run_sites(s, d))
)

MEANS = f"SELECT sitename, avg(gpp_obs) AS mo, avg(gpp_mod) AS mm FROM ({PAIR}) GROUP BY sitename"
IAV = f"SELECT p.sitename, p.year, p.gpp_obs - mo AS gpp_obs, p.gpp_mod - mm AS gpp_mod FROM ({PAIR}) p JOIN ({MEANS}) USING (sitename)"
IDV = f"""SELECT o.sitename, o.date, o.gpp_obs - c.obs_mean AS gpp_obs, o.gpp_mod - c.mod_mean AS gpp_mod
  FROM obs_mod o LEFT JOIN ({DOY}) c ON o.sitename = c.sitename AND dayofyear(o.date) = c.doy"""
IXV = f"""SELECT o.sitename, o.inbin, o.gpp_obs - c.obs_mean AS gpp_obs, o.gpp_mod - c.mod_mean AS gpp_mod
  FROM ({XDF}) o LEFT JOIN ({XOY}) c ON o.sitename = c.sitename AND dayofyear(o.inbin) = c.xoy"""


def iavdf(s, d):
    pair = annual_pair(s, d).select("sitename", "year", "gpp_obs", "gpp_mod")
    means = A.multiyear_mean(pair).withColumnsRenamed({"gpp_obs": "obs_mean", "gpp_mod": "mod_mean"})
    return anomalies(pair, means, ["sitename"])


def idvdf(s, d):
    daily = obs_mod(s, d).select("sitename", "date", "gpp_obs", "gpp_mod")
    return anomalies(
        daily.withColumn("doy", F.dayofyear("date")), A.mean_seasonal_cycle_doy(daily), ["sitename", "doy"]
    ).drop("doy")


def ixvdf(s, d):
    x = xdf(s, d).select("sitename", "inbin", "gpp_obs", "gpp_mod")
    return anomalies(x.withColumn("xoy", F.dayofyear("inbin")), A.mean_seasonal_cycle_xoy(x), ["sitename", "xoy"]).drop("xoy")


query("anomalies_annual", rsql(IAV, "sitename, year", "gpp_obs gpp_mod"))(iavdf)
query("anomalies_daily", rsql(IDV, "sitename, date", "gpp_obs gpp_mod"))(idvdf)
query("anomalies_xdaily", rsql(IXV, "sitename, inbin", "gpp_obs gpp_mod"))(ixvdf)


def _hist_sql(bins: int) -> str:
    long = f"SELECT unnest(['gpp_obs', 'gpp_mod']) AS series, unnest([gpp_obs, gpp_mod]) AS v FROM ({IDV})"
    return f"""SELECT series, bin, any_value(lo) + any_value(hi - lo) / {bins} * bin AS bin_start, count(*) AS n,
      count(*) / (any_value(total) * (any_value(hi - lo) / {bins})) AS density, any_value(sd) AS sd FROM (
      SELECT l.series, CAST(least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS INTEGER) AS bin, lo, hi, total, sd
      FROM ({long}) l JOIN (SELECT series, min(v) AS lo, max(v) AS hi, count(v) AS total, stddev_samp(v) AS sd
        FROM ({long}) GROUP BY series) USING (series) WHERE v IS NOT NULL) GROUP BY series, bin"""


query("anomaly_histogram", rsql(_hist_sql(20), "series, bin, n", "bin_start density sd"))(
    lambda s, d: S.anomaly_histogram(idvdf(s, d), ["gpp_obs", "gpp_mod"], 20)
)
query(
    "site_quantiles",
    rsql(
        """SELECT sitename, quantile_cont(et, 0.025) AS q025, quantile_cont(et, 0.5) AS q500, quantile_cont(et, 0.975) AS q975
        FROM fx_daily GROUP BY sitename""",
        "sitename",
        "q025 q500 q975",
    ),
)(lambda s, d: quantiles(fx_daily(s, d), "et", ["sitename"], {"q025": 0.025, "q500": 0.5, "q975": 0.975}))
# most values in a small part of the range
HEAVY = "SELECT sitename, CASE WHEN et > 900 THEN et * 1e4 WHEN et < 10 THEN -et * 1e4 ELSE et END AS et FROM fx_daily"
query(
    "site_quantiles_heavy_tail",
    rsql(
        f"""SELECT sitename, quantile_cont(et, 0.01) AS q010, quantile_cont(et, 0.25) AS q250, quantile_cont(et, 0.5) AS q500,
        quantile_cont(et, 0.99) AS q990 FROM ({HEAVY}) GROUP BY sitename
        UNION ALL SELECT -1, quantile_cont(et, 0.01), quantile_cont(et, 0.25), quantile_cont(et, 0.5), quantile_cont(et, 0.99) FROM ({HEAVY})""",
        "sitename",
        "q010 q250 q500 q990",
    ),
)(lambda s, d: heavy_tail(s, d))


def heavy_tail(s, d):
    """Quantiles of each site and, as site -1, of the whole table."""
    et = F.col("et")
    days = fx_daily(s, d).select(
        "sitename", F.when(et > 900, et * 1e4).when(et < 10, -et * 1e4).otherwise(et).alias("et")
    )
    probs = {"q010": 0.01, "q250": 0.25, "q500": 0.5, "q990": 0.99}
    whole = quantiles(days, "et", [], probs).select(F.lit(-1).cast("long").alias("sitename"), *probs)
    return quantiles(days, "et", ["sitename"], probs, empty=True).union(whole)


query(
    "normalise_p97_unknown_site",
    rsql(
        """SELECT sitename, date, et / quantile_cont(et, 0.97) OVER w AS et, gpp_mod / quantile_cont(gpp_mod, 0.97) OVER w AS gpp_mod
        FROM (SELECT * REPLACE (CASE WHEN sitename % 7 > 0 THEN sitename END AS sitename) FROM fx_daily) WINDOW w AS (PARTITION BY sitename)""",
        "sitename, date",
        "et gpp_mod",
    ),
)(
    lambda s, d: A.normalise(
        fx_daily(s, d).select(F.when(F.col("sitename") % 7 > 0, F.col("sitename")).alias("sitename"), "date", "et", "gpp_mod"),
        ["et", "gpp_mod"],
        "p97",
    )
)
query(
    "response_quantiles",
    rsql(
        """SELECT CAST(floor(temp / 5) AS BIGINT) AS step, """
        + ", ".join(
            f"quantile_cont({c}, {p}) AS {n}{x}"
            for c, x in (("gpp_obs", ""), ("gpp_mod", "_mod"))
            for n, p in (("median", 0.5), ("q33", 0.33), ("q66", 0.66), ("q25", 0.25), ("q75", 0.75))
        )
        + " FROM obs_mod GROUP BY ALL",
        "step",
        " ".join(f"{n}{x}" for x in ("", "_mod") for n in ("median", "q33", "q66", "q25", "q75")),
    ),
)(
    lambda s, d: A.response_quantiles(
        obs_mod(s, d).withColumn("step", F.floor(F.col("temp") / 5)), "step", {"gpp_obs": "", "gpp_mod": "_mod"}
    )
)
query(
    "first_per_key",
    """SELECT site_id, variable, group_id, datavalue FROM (SELECT *, row_number() OVER (PARTITION BY site_id, variable
    ORDER BY group_id) AS rn FROM fx_eav) WHERE rn = 1""",
)(
    lambda s, d: first_per_key(
        fx_eav(s, d).select("site_id", "variable", "group_id", "datavalue"), ["site_id", "variable"], ["group_id"]
    )
)
