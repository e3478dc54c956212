"""Query registry and the site-series views over the given tables, in Spark and in SQL.

The views' scale factors are chosen so that no value lies on a rounding boundary.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "fx_daily": """
SELECT l_suppkey AS sitename, CAST(l_shipdate AS DATE) AS date,
  AVG(CASE WHEN l_tax > 0 THEN l_extendedprice END) / 4993 AS gpp_nt,
  AVG(CASE WHEN l_tax > 0 THEN l_extendedprice * (1 - l_discount) END) / 4993 AS gpp_dt,
  AVG(l_discount) / 0.1003 AS qc_nt, AVG(l_tax) / 0.0803 AS qc_dt,
  AVG(CASE WHEN l_discount > 0 THEN l_quantity END) / 1.03 - 10 AS temp,
  AVG(CASE WHEN l_linenumber > 2 THEN l_discount END) / 0.1003 AS soilm,
  MAX(ROUND(l_extendedprice / 100)) AS et, AVG(l_quantity) / 2.53 AS gpp_mod
FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "fx_sensor": """
SELECT user_id AS sitename, CAST(ts AS DATE) AS date, AVG(value) AS v, COUNT(*) AS n
FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "fx_grid": """
SELECT p_partkey % 50 AS lon_idx, CAST(FLOOR(p_partkey / 50) AS BIGINT) AS lat_idx,
  CASE WHEN p_size >= 25 THEN p_retailprice END AS value FROM part""",
    "fx_eav": """
SELECT c_nationkey AS site_id, c_custkey AS group_id, c_mktsegment AS variable,
  CAST(c_acctbal AS VARCHAR(30)) AS datavalue, c_acctbal AS num FROM customer""",
    "fx_site": """
SELECT s_suppkey AS sitename, s_nationkey AS classid,
  (s_suppkey * 37 % 720) * 0.5 - 179.75 AS lon, (s_suppkey * 53 % 360) * 0.5 - 89.75 AS lat,
  CASE WHEN s_acctbal > 0 THEN s_acctbal / 3 END AS elv,
  CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey % 5 = 1 END AS c4 FROM supplier""",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fx_daily(spark: SparkSession, sf: str) -> DataFrame:
    price, disc, qty = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_quantity")
    taxed = F.col("l_tax") > 0
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_suppkey").alias("sitename"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            (F.avg(F.when(taxed, price)) / 4993).alias("gpp_nt"),
            (F.avg(F.when(taxed, price * (1 - disc))) / 4993).alias("gpp_dt"),
            (F.avg(disc) / 0.1003).alias("qc_nt"),
            (F.avg("l_tax") / 0.0803).alias("qc_dt"),
            (F.avg(F.when(disc > 0, qty)) / 1.03 - 10).alias("temp"),
            (F.avg(F.when(F.col("l_linenumber") > 2, disc)) / 0.1003).alias("soilm"),
            F.max(F.round(price / 100)).alias("et"),
            (F.avg(qty) / 2.53).alias("gpp_mod"),
        )
    )


def fx_sensor(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("sitename"), F.col("ts").cast("date").alias("date"))
        .agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n"))
    )


def fx_grid(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (key % 50).alias("lon_idx"),
        F.floor(key / 50).alias("lat_idx"),
        F.when(F.col("p_size") >= 25, F.col("p_retailprice")).alias("value"),
    )


def fx_eav(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("site_id"),
        F.col("c_custkey").alias("group_id"),
        F.col("c_mktsegment").alias("variable"),
        F.col("c_acctbal").cast("string").alias("datavalue"),
        F.col("c_acctbal").alias("num"),
    )


def fx_site(spark: SparkSession, sf: str) -> DataFrame:
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf, "supplier").select(
        key.alias("sitename"),
        nation.alias("classid"),
        ((key * 37 % 720) * 0.5 - 179.75).alias("lon"),
        ((key * 53 % 360) * 0.5 - 89.75).alias("lat"),
        F.when(F.col("s_acctbal") > 0, F.col("s_acctbal") / 3).alias("elv"),
        F.when(nation % 5 != 0, nation % 5 == 1).alias("c4"),
    )


def obs_mod(spark: SparkSession, sf: str) -> DataFrame:
    """Observed (nullable) and modelled daily values with temperature and soil moisture."""
    return fx_daily(spark, sf).select(
        "sitename", "date", F.col("gpp_nt").alias("gpp_obs"), "gpp_mod", "temp", F.col("soilm").alias("soilm_obs_mean")
    )


VIEWS["obs_mod"] = (
    "SELECT sitename, date, gpp_nt AS gpp_obs, gpp_mod, temp, soilm AS soilm_obs_mean FROM fx_daily"
)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column, half up, to the values that ``F.round`` gives.

    ``F.round`` goes through the decimal text of every value, most of the time of a wide query. Away from a tie the nearest
    whole number of units, divided by their number, is the same double; ties, large values and NaN are left to ``F.round``.
    The columns are rounded in one array, so that the generated method keeps a size that the JVM compiles.
    """
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    if not doubles:
        return df
    units = float(10**digits)

    def nearest(x: Column) -> Column:
        whole = F.rint(x * units)
        plain = (F.abs(x * units) < 1e12) & (F.abs(x * units - whole) < 0.499)
        return F.when(plain, whole / units + 0.0).otherwise(F.round(x, digits))  # adding 0 turns -0 into 0

    out = df.withColumn("_rounded", F.transform(F.array(*[F.col(f"`{c}`") for c in doubles]), lambda x: nearest(x)))
    place = {c: i for i, c in enumerate(doubles)}
    return out.select(*[F.col("_rounded")[place[c]].alias(c) if c in place else F.col(f"`{c}`") for c in df.columns])


def rsql(inner: str, keys: str, doubles: str, digits: int = 6) -> str:
    """Select the keys and the rounded doubles of a query (adding 0 turns -0 into 0)."""
    cols = [k.strip() for k in keys.split(",") if k.strip()]
    cols += [f"round(CAST({d} AS DOUBLE), {digits}) + 0.0 AS {d}" for d in re.split(r"[,\s]+", doubles.strip()) if d]
    return f"SELECT {', '.join(cols)} FROM ({inner}) AS rounded_rows"


def with_views(sql: str) -> str:
    """Prefix the views a query names, in order of dependence."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                visit(body)
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    views = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    body = sql.lstrip()
    recursive = "RECURSIVE " if re.match(r"WITH\s+RECURSIVE\b", body, re.I) else ""
    body_with = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", body, flags=re.I)
    if body_with != body:
        return f"WITH {recursive}{views}, {body_with}"
    return f"WITH {views} {body}"


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register a query and its SQL; ``digits`` rounds the result's doubles."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = fn(spark, sf)
            return out if digits is None else rounded(out, digits)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def col(name: str) -> Column:
    return F.col(name)
