"""Ordered series, running balance, calendars and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.aggs import interpolate_sql, xbin_sql
from checks.base import fx_daily, fx_site, obs_mod, query, rsql, table
from checks.joins import SENSOR, sensor_series
from siteflux.functions import atmosphere as P
from siteflux.functions import calendar as T
from siteflux.functions import units as U
from siteflux.operators import downscale as X
from siteflux.operators import series as W
from siteflux.operators.balance import bounded_running_balance

OM = "sitename, date"

query(
    "interpolate_linear",
    rsql(interpolate_sql("SELECT sitename, date, soilm, temp FROM fx_daily", ["soilm", "temp"], "sitename", "date"), OM, "soilm temp"),
)(
    lambda s, d: W.interpolate_linear(
        fx_daily(s, d).select("sitename", "date", "soilm", "temp"), ["soilm", "temp"], ["sitename"], block=F.year("date")
    )
)
query(
    "interpolate_linear_bounded",
    rsql(interpolate_sql(SENSOR, ["v"], "sitename", "date"), OM, "v"),
)(lambda s, d: W.interpolate_linear(sensor_series(s, d), ["v"], ["sitename"], bounded=True))
# the whole table is one long site
ONE_SITE = """SELECT 1 AS sitename, l_orderkey * 10 + l_linenumber AS t,
  avg(CASE WHEN l_tax > 0.02 THEN l_quantity END) AS v FROM lineitem GROUP BY ALL"""


def one_site(s, d):
    return (
        table(s, d, "lineitem")
        .groupBy(F.lit(1).alias("sitename"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("t"))
        .agg(F.avg(F.when(F.col("l_tax") > 0.02, F.col("l_quantity"))).alias("v"))
    )


query("interpolate_linear_one_long_site", rsql(interpolate_sql(ONE_SITE, ["v"], "sitename", "t"), "sitename, t", "v"))(
    lambda s, d: W.interpolate_linear(one_site(s, d), ["v"], ["sitename"], "t", ranges=32)
)


def _null_first_site(df):
    first = df.agg(F.min("sitename").alias("_first"))
    out = df.join(first, F.col("sitename") == F.col("_first"), "left")
    return out.withColumn("sitename", F.when(F.col("_first").isNull(), F.col("sitename"))).drop("_first")


def fill_sql(src: str, cols: list[str], extra: str = "") -> str:
    inner = interpolate_sql(src, cols, "sitename", "date")
    out = ", ".join(f"coalesce({c}, nv_{c}, pv_{c}) AS {c}" for c in cols)
    return f"SELECT sitename, date, {out}{extra} FROM ({inner})"


query(
    "fill_gaps",
    rsql(
        fill_sql("SELECT sitename, date, soilm, temp, gpp_nt FROM fx_daily", ["soilm", "temp"], ", coalesce(gpp_nt, 0) AS gpp_nt"),
        OM,
        "soilm temp gpp_nt",
    ),
)(
    lambda s, d: W.fill_gaps(
        fx_daily(s, d).select("sitename", "date", "soilm", "temp", "gpp_nt"), ["soilm", "temp"], zero=["gpp_nt"]
    )
)
# one site's key unknown: its rows are a series too
query(
    "fill_gaps_null_site",
    rsql(
        fill_sql("SELECT nullif(sitename, (SELECT min(sitename) FROM fx_daily)) AS sitename, date, soilm FROM fx_daily", ["soilm"]),
        OM,
        "soilm",
    ),
)(lambda s, d: W.fill_gaps(_null_first_site(fx_daily(s, d).select("sitename", "date", "soilm")), ["soilm"]))
# sensor calendars put the leading and trailing gaps inside one short block
query("fill_gaps_sensor", rsql(fill_sql(SENSOR.replace("f.v FROM", "CASE WHEN f.v > 20 THEN f.v END AS v FROM"), ["v"]), OM, "v"))(
    lambda s, d: W.fill_gaps(
        sensor_series(s, d).withColumn("v", F.when(F.col("v") > 20, F.col("v"))), ["v"], block=F.floor(F.dayofmonth("date") / 7)
    )
)
_YD = """year(date) + (dayofyear(date) - 1) / CASE WHEN (year(date) % 4 = 0 AND year(date) % 100 <> 0) OR year(date) % 400 = 0 THEN 366 ELSE 365 END"""
_X = f"""SELECT sitename, date, x, CASE WHEN soilm IS NULL AND i = 1 THEN lead_v WHEN soilm IS NULL AND i = n THEN lag_v ELSE soilm END AS soilm
  FROM (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY sitename) AS n, lead(soilm) OVER w AS lead_v, lag(soilm) OVER w AS lag_v
  FROM (SELECT sitename, date, {_YD} AS x, soilm FROM fx_daily) WINDOW w AS (PARTITION BY sitename ORDER BY x))"""
query(
    "interpolate_at_x",
    rsql(
        f"""SELECT sitename, date, CASE WHEN soilm IS NOT NULL THEN soilm ELSE pv + (nv - pv) * ((x - p) / (n - p)) END AS soilm FROM (
        SELECT *, last_value(CASE WHEN soilm IS NOT NULL THEN x END IGNORE NULLS) OVER up AS p, last_value(soilm IGNORE NULLS) OVER up AS pv,
        first_value(CASE WHEN soilm IS NOT NULL THEN x END IGNORE NULLS) OVER down AS n, first_value(soilm IGNORE NULLS) OVER down AS nv FROM ({_X})
        WINDOW up AS (PARTITION BY sitename ORDER BY x ROWS UNBOUNDED PRECEDING),
        down AS (PARTITION BY sitename ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
        OM,
        "soilm",
    ),
)(
    lambda s, d: W.interpolate_at_x(
        fx_daily(s, d).select("sitename", "date", T.decimal_year(F.col("date")).alias("year_dec"), "soilm"), ["soilm"]
    ).drop("year_dec")
)
query(
    "add_fitted",
    rsql(
        """SELECT sitename, date, CASE WHEN gpp_obs IS NOT NULL THEN regr_intercept(gpp_obs, gpp_mod) OVER w
        + regr_slope(gpp_obs, gpp_mod) OVER w * gpp_mod END AS fitted FROM obs_mod WINDOW w AS (PARTITION BY sitename)""",
        OM,
        "fitted",
    ),
)(lambda s, d: W.add_fitted(obs_mod(s, d).select("sitename", "date", "gpp_obs", "gpp_mod")).select("sitename", "date", "fitted"))


def monthly_et(s, d):
    """A monthly table per site."""
    return (
        fx_daily(s, d)
        .groupBy("sitename", F.year("date").alias("year"), F.month("date").alias("moy"))
        .agg((F.avg("et") / 10.3).alias("et"))
    )


MONTHLY_ET = """SELECT sitename, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS moy, avg(et) / 10.3 AS et
  FROM fx_daily GROUP BY ALL"""


def neighbours_sql(src: str, c: str) -> str:
    return f"""SELECT m.sitename, m.year, m.moy, m.{c}, CASE WHEN m.moy = 1 AND b.year IS NULL THEN d.{c} ELSE p.{c} END AS {c}_prev,
  CASE WHEN m.moy = 12 AND a.year IS NULL THEN j.{c} ELSE x.{c} END AS {c}_next FROM ({src}) m
  LEFT JOIN ({src}) p ON p.sitename = m.sitename AND p.year * 12 + p.moy = m.year * 12 + m.moy - 1
  LEFT JOIN ({src}) x ON x.sitename = m.sitename AND x.year * 12 + x.moy = m.year * 12 + m.moy + 1
  LEFT JOIN ({src}) d ON d.sitename = m.sitename AND d.year = m.year AND d.moy = 12
  LEFT JOIN ({src}) j ON j.sitename = m.sitename AND j.year = m.year AND j.moy = 1
  LEFT JOIN (SELECT DISTINCT sitename, year FROM ({src})) b ON b.sitename = m.sitename AND b.year = m.year - 1
  LEFT JOIN (SELECT DISTINCT sitename, year FROM ({src})) a ON a.sitename = m.sitename AND a.year = m.year + 1"""


query("neighbour_months", rsql(neighbours_sql(MONTHLY_ET, "et"), "sitename, year, moy", "et et_prev et_next"))(
    lambda s, d: W.neighbour_months(monthly_et(s, d), ["et"])
)

query(
    "neighbour_months_missing_year",
    rsql(neighbours_sql(f"SELECT * FROM ({MONTHLY_ET}) WHERE year <> 1998", "et"), "sitename, year, moy", "et et_prev et_next"),
)(lambda s, d: W.neighbour_months(monthly_et(s, d).where("year <> 1998"), ["et"]))


def _dim(y: str, m: str) -> str:
    return f"day(last_day(make_date({y}, {m}, 1)))"


def months_to_days_sql(src: str, c: str, noleap: bool = False) -> str:
    """A parabola fixed by its two edge values and its integral, in days from half a day before the first."""
    last = "CASE WHEN moy = 2 THEN 28 ELSE dt END" if noleap else "dt"
    return f"""SELECT sitename, date, a * t * t + (dl / dt - a * dt) * t + l AS {c} FROM (
  SELECT *, day(date) - 0.5 AS t FROM (
  SELECT *, ({c} * dt - dl * dt / 2 - l * dt) / (dt ** 3 / 3 - dt ** 3 / 2) AS a,
  CAST(unnest(generate_series(make_date(year, moy, 1), make_date(year, moy, CAST({last} AS INTEGER)), INTERVAL 1 DAY)) AS DATE) AS date FROM (
  SELECT *, ({c} * dt + {c}_prev * n0) / (dt + n0) AS l, ({c}_next * n2 + {c} * dt) / (n2 + dt) - ({c} * dt + {c}_prev * n0) / (dt + n0) AS dl FROM (
  SELECT *, {_dim('year', 'moy')}::DOUBLE AS dt, {_dim('year', 'CASE WHEN moy = 1 THEN 12 ELSE moy - 1 END')} AS n0,
  {_dim('year', 'CASE WHEN moy = 12 THEN 1 ELSE moy + 1 END')} AS n2 FROM ({neighbours_sql(src, c)})))))"""


query("monthly_to_daily_polynom", rsql(months_to_days_sql(MONTHLY_ET, "et"), OM, "et"))(
    lambda s, d: X.monthly_to_daily(monthly_et(s, d), "et")
)
query(
    "monthly_to_daily_step",
    rsql(
        f"""SELECT sitename, CAST(unnest(generate_series(make_date(year, moy, 1), make_date(year, moy, CAST(CASE WHEN moy = 2 THEN 28 ELSE
        {_dim('year', 'moy')} END AS INTEGER)), INTERVAL 1 DAY)) AS DATE) AS date, et FROM ({MONTHLY_ET})""",
        OM,
        "et",
    ),
)(lambda s, d: X.monthly_to_daily(monthly_et(s, d), "et", "step", noleap=True))
for _t, _w in ((0.1, 1.0), (0.0, 0.0)):
    query(
        "allocate_period_total" if _t else "allocate_period_total_exact",
        rsql(
            f"""SELECT sitename, date, CASE WHEN share < {_t} THEN 0 ELSE share END AS prec FROM (SELECT d.sitename, d.date,
            d.soilm * m.et / nullif(CASE WHEN w < {_w} THEN {_w} ELSE w END, 0) AS share FROM (SELECT *, sum(soilm) OVER
            (PARTITION BY sitename, year(date), month(date)) AS w FROM fx_daily) d JOIN ({MONTHLY_ET}) m ON m.sitename = d.sitename
            AND m.year = year(d.date) AND m.moy = month(d.date))""",
            OM,
            "prec",
        ),
    )(
        lambda s, d, t=_t, w=_w: X.allocate_period_total(
            fx_daily(s, d).select("sitename", "date", "soilm"), "soilm", monthly_et(s, d), "et", "prec", t, w
        ).drop("soilm")
    )

_STEP = {
    "bucket": "least(greatest(0.0, s + inflow - outflow - greatest(0.0, s + inflow - 60.0)), 60.0)",
    "keenan": "least(greatest(0.0, s + inflow - outflow - (6e-5 * inflow + 0.01 * s)), 60.0)",
}


def balance_sql(step: str, source: str = fill_sql(SENSOR, ["v"])) -> str:
    """Spin-up over the first ten rows, then all rows, one at a time."""
    rows = f"""SELECT sitename, date, v / 3 AS inflow, CASE WHEN v IS NULL THEN NULL ELSE 20 - v / 7 END AS outflow,
      row_number() OVER (PARTITION BY sitename ORDER BY date) AS i FROM ({source})"""
    return f"""WITH RECURSIVE steps AS ({rows}),
      queue AS (SELECT sitename, NULL::DATE AS date, inflow, outflow, i FROM steps WHERE i <= 10 UNION ALL
        SELECT s.sitename, s.date, inflow, outflow, i + n FROM steps s JOIN (SELECT sitename, least(count(*), 10) AS n FROM steps GROUP BY sitename) c USING (sitename)),
      run AS (SELECT sitename, 0::BIGINT AS i, NULL::DATE AS date, 60.0::DOUBLE AS s FROM (SELECT DISTINCT sitename FROM steps)
        UNION ALL SELECT q.sitename, q.i, q.date, CAST({step} AS DOUBLE) FROM run r JOIN queue q ON q.sitename = r.sitename AND q.i = r.i + 1)
      {rsql('SELECT sitename, date, s AS soilm FROM run WHERE date IS NOT NULL', OM, 'soilm')}"""


for _kind, _expr in _STEP.items():
    query(f"bounded_running_balance_{_kind}", balance_sql(_expr))(
        lambda s, d, kind=_kind: bounded_running_balance(
            W.fill_gaps(sensor_series(s, d), ["v"]).select(
                "sitename", "date", (F.col("v") / 3).alias("inflow"), (20 - F.col("v") / 7).alias("outflow")
            ),
            "inflow",
            "outflow",
            kind=kind,
            cap=60.0,
            spinup=10,
        ).select("sitename", "date", "soilm")
    )

# all sites' days as one series, in more ranges than it has years
ONE_BALANCE = "SELECT 1 AS sitename, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) + 10 * avg(l_linenumber) AS v FROM lineitem GROUP BY CAST(l_shipdate AS DATE)"
query("bounded_running_balance_one_long_site", balance_sql(_STEP["keenan"], ONE_BALANCE))(
    lambda s, d: bounded_running_balance(
        table(s, d, "lineitem")
        .groupBy(F.col("l_shipdate").cast("date").alias("date"))
        .agg((F.avg("l_quantity") + 10 * F.avg("l_linenumber")).alias("v"))
        .select(F.lit(1).alias("sitename"), "date", (F.col("v") / 3).alias("inflow"), (20 - F.col("v") / 7).alias("outflow")),
        "inflow",
        "outflow",
        kind="keenan",
        cap=60.0,
        spinup=10,
        ranges=24,
    ).select("sitename", "date", "soilm")
)

query(
    "calendar_parts",
    rsql(
        f"""SELECT o_orderkey, CAST(floor((dayofyear(date) - 1) / 7) AS INTEGER) + 1 AS week, CAST(dayofyear(date) AS INTEGER) AS doy,
        {_YD} AS year_dec FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)""",
        "o_orderkey, week, doy",
        "year_dec",
    ),
)(
    lambda s, d: table(s, d, "orders")
    .select("o_orderkey", F.col("o_orderdate").cast("date").alias("date"))
    .select(
        "o_orderkey",
        T.week_of_year(F.col("date")).alias("week"),
        F.dayofyear("date").alias("doy"),
        T.decimal_year(F.col("date")).alias("year_dec"),
    )
)
for _k in (5, 7, 8):
    query(
        f"xday_bin_{_k}",
        f"SELECT o_orderkey, {xbin_sql(_k)} AS inbin FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders)",
    )(
        lambda s, d, k=_k: table(s, d, "orders").select(
            "o_orderkey", T.xday_bin(F.col("o_orderdate").cast("date"), k).alias("inbin")
        )
    )

_LEAP = "((y % 4 = 0 AND y % 100 <> 0) OR y % 400 = 0)"
query(
    "noleap_to_date_365",
    f"""SELECT p_partkey, make_date(y, 1, 1) + CAST(t % 365 + CASE WHEN {_LEAP} AND t % 365 >= 59 THEN 1 ELSE 0 END AS INTEGER) AS date
    FROM (SELECT p_partkey, p_partkey AS t, 2001 + CAST(floor(p_partkey / 365) AS INTEGER) AS y FROM part)""",
)(lambda s, d: table(s, d, "part").select("p_partkey", T.noleap_to_date(F.col("p_partkey")).alias("date")))
_J360 = " + ".join(f"(d >= {at})::INT" for at in (150, 210, 240, 300))
query(
    "noleap_to_date_360",
    f"""SELECT p_partkey, make_date(y, 1, 1) + CAST(d + {_J360} + CASE WHEN {_LEAP} AND d >= 90 THEN 1 ELSE 0 END AS INTEGER) AS date
    FROM (SELECT p_partkey, p_partkey % 360 AS d, 2001 + CAST(floor(p_partkey / 360) AS INTEGER) AS y FROM part)""",
)(
    lambda s, d: table(s, d, "part").select(
        "p_partkey", T.noleap_to_date(F.col("p_partkey"), year_length=360).alias("date")
    )
)
query(
    "drop_leap_days",
    "SELECT o_orderkey FROM orders WHERE NOT (month(o_orderdate) = 2 AND day(o_orderdate) = 29)",
)(lambda s, d: table(s, d, "orders").where(~T.is_leap_day(F.col("o_orderdate"))).select("o_orderkey"))
query(
    "unit_conversions",
    rsql(
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity * 0.0864 AS mj_per_day, l_quantity * 86400 * 2.04e-6 AS photons,
        l_quantity * 100 AS pa, l_quantity + 250 - 273.15 AS celsius, (l_quantity + l_discount) * 1e-6 * 86400 AS rain,
        l_quantity * 12.0107 AS carbon, l_quantity * 1e-6 * 86400 * 12.0107 AS carbon_flux, l_extendedprice * 1e3 / 2.26476e6 AS mm FROM lineitem""",
        "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate",
        "mj_per_day photons pa celsius rain carbon carbon_flux mm",
    ),
)(
    lambda s, d: table(s, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_shipdate",
        (U.watt_to_joule_per_day(F.col("l_quantity")) / 1e6).alias("mj_per_day"),
        U.watt_to_photons(F.col("l_quantity")).alias("photons"),
        U.hpa_to_pa(F.col("l_quantity")).alias("pa"),
        U.kelvin_to_celsius(F.col("l_quantity") + 250).alias("celsius"),
        U.precipitation(F.col("l_quantity") * 1e-6, F.col("l_discount") * 1e-6).alias("rain"),
        U.mol_to_gram_carbon(F.col("l_quantity")).alias("carbon"),
        U.micromol_flux_to_gram_carbon_per_day(F.col("l_quantity")).alias("carbon_flux"),
        U.joule_to_mm(F.col("l_extendedprice") * 1e3).alias("mm"),
    )
)
PRESSURE = "101325 * (1 - 0.0065 * elv / {t0}) ** (9.80665 * 0.028963 / (8.3143 * 0.0065))"
query(
    "air_pressure",
    rsql(
        f"SELECT sitename, {PRESSURE.format(t0=288.15)} / 100 AS p_input, {PRESSURE.format(t0=298.15)} / 100 AS p_score FROM fx_site",
        "sitename",
        "p_input p_score",
    ),
)(
    lambda s, d: fx_site(s, d).select(
        "sitename",
        (P.air_pressure(F.col("elv")) / 100).alias("p_input"),
        (P.air_pressure(F.col("elv"), P.BASE_TEMPERATURE_SCORING) / 100).alias("p_score"),
    )
)
_ESAT = "611 * exp(17.27 * {t} / ({t} + 237.3))"
_Q = "soilm / 50"
_EACT = f"""({PRESSURE.format(t0=288.15)}) * ({_Q} / (1 - {_Q})) * (8.3143 / 18.02) / (8.3143 / 28.963 + ({_Q} / (1 - {_Q})) * (8.3143 / 18.02))"""
query(
    "vpd",
    rsql(
        f"""SELECT sitename, date, CASE WHEN e IS NULL OR temp IS NULL THEN NULL ELSE greatest(0, {_ESAT.format(t='temp')} - e) END / 1000 AS vpd,
        CASE WHEN temp IS NULL THEN NULL ELSE greatest(0, {_ESAT.format(t='(0.5 * (temp - 3 + temp + 4))')} - 900) END / 1000 AS vpd_range,
        ({_ESAT.format(t='temp')} - gpp_mod * 100) / 1000 AS vpd_month FROM (SELECT *, {_EACT} AS e FROM fx_daily LEFT JOIN fx_site USING (sitename))""",
        OM,
        "vpd vpd_range vpd_month",
    ),
)(
    lambda s, d: fx_daily(s, d)
    .join(fx_site(s, d), "sitename", "left")
    .select(
        "sitename",
        "date",
        (P.vpd(F.col("temp"), qair=F.col("soilm") / 50, elv=F.col("elv")) / 1000).alias("vpd"),
        (P.vpd(F.col("temp"), eact=F.lit(900.0), tmin=F.col("temp") - 3, tmax=F.col("temp") + 4) / 1000).alias("vpd_range"),
        (P.vpd_monthly(F.col("temp"), F.col("gpp_mod")) / 1000).alias("vpd_month"),
    )
)
query(
    "text_pieces",
    """SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS two_digits, substr(n_name, 1, 4) AS head,
    n_name LIKE '%A%' AS has_a, n_name || '_' || n_regionkey AS joined FROM nation""",
)(
    lambda s, d: table(s, d, "nation").select(
        "n_nationkey",
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("two_digits"),
        F.substring("n_name", 1, 4).alias("head"),
        F.col("n_name").rlike("A").alias("has_a"),
        F.concat_ws("_", "n_name", F.col("n_regionkey").cast("string")).alias("joined"),
    )
)
