"""Readers and writers: tables are written in the source's layout and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import fx_daily, fx_eav, obs_mod, query, rsql
from siteflux.operators.aggregate import annual_sum, monthly_mean
from siteflux.sources import readers as R
from siteflux.sources import sinks as S

OM = "sitename, date"
PATH_SITE = r"sitename=(?:FLX_)?([^/]+)/"


def _site_int(df):
    return df.withColumn("sitename", F.col("sitename").cast("bigint"))


def csv_files(df, folders, path):
    """A folder of CSV with a header for each value of ``folders``."""
    cells = [c for c in df.columns if c not in folders]
    lines = df.select(*folders, F.to_csv(F.struct(*[F.col(f"`{c}`") for c in cells])).alias("value"))
    S.write_folders(lines, folders, path, ",".join(cells), ".csv")


def text_of_folders(s, path, folders):
    """Lines with the values of their folders, cut from the path: Spark's own way compares all folders on the driver, in a time
    that grows with the square of their number."""
    cut = {f: F.regexp_extract("file", f"/{f}=([^/]+)/", 1).try_cast(kind) for f, kind in folders.items()}
    return R.text_lines(s, path).select("value", *[c.alias(f) for f, c in cut.items()])


def _tower_files(s, d, stamp, name, columns=("gpp_nt", "et")):
    """One directory of CSV files per site; odd sites report their columns in another order."""
    base = S.scratch_dir(s)
    daily = fx_daily(s, d).withColumn("TIMESTAMP", stamp)
    rows = daily.groupBy("sitename", "TIMESTAMP").agg(*[F.max(c).alias(c) for c in columns])
    for odd, order in ((0, columns), (1, tuple(reversed(columns)))):
        part = rows.where(F.col("sitename") % 2 == odd).select("sitename", F.col("TIMESTAMP").alias(name), *order)
        part = part.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("-9999")) for c in columns})
        csv_files(part, ["sitename"], f"{base}/{odd}")
    return base


_FREQ = {
    "d": ("TIMESTAMP", "yyyyMMdd", "date"),
    "w": ("TIMESTAMP_START", "yyyyMMdd", "date"),
    "m": ("TIMESTAMP", "yyyyMM", "CAST(date_trunc('month', date) AS DATE)"),
    "y": ("TIMESTAMP", "yyyy", "CAST(date_trunc('year', date) AS DATE)"),
}
for _f, (_name, _fmt, _date) in _FREQ.items():
    query(
        f"read_site_csv_{_f}",
        rsql(
            f"SELECT sitename, {_date} AS date, max(gpp_nt) AS gpp_nt, max(et) AS et FROM fx_daily GROUP BY ALL", OM, "gpp_nt et"
        ),
    )(
        lambda s, d, f=_f, name=_name, fmt=_fmt: _site_int(
            R.read_site_csv(
                s, _tower_files(s, d, F.date_format("date", fmt), name), f, ["gpp_nt", "et"], site_pattern=PATH_SITE
            )
        )
    )


def _csv(df, s, parts=("sitename",)):
    path = S.scratch_dir(s)
    csv_files(df, list(parts), path)
    return path


def _meta(s, d):
    path = S.scratch_dir(s)
    long = fx_eav(s, d).select(
        F.col("site_id").alias("SITE_ID"),
        F.col("group_id").alias("GROUP_ID"),
        F.lit("GRP").alias("VARIABLE_GROUP"),
        F.col("variable").alias("VARIABLE"),
        F.col("datavalue").alias("DATAVALUE"),
    )
    long.write.option("header", True).option("sep", ";").csv(path)
    return R.read_site_meta_long(s, path).drop("line")


query(
    "read_site_meta_long",
    """SELECT CAST(site_id AS VARCHAR) AS "SITE_ID", CAST(group_id AS VARCHAR) AS "GROUP_ID", 'GRP' AS "VARIABLE_GROUP",
    variable AS "VARIABLE", datavalue AS "DATAVALUE" FROM fx_eav""",
)(_meta)


def _alt(s, d):
    path = _csv(
        fx_daily(s, d).select(
            "sitename",
            F.col("date").alias("Timestamp"),
            F.when(F.dayofyear("date") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("gpp_nt")).alias("GPP_mol.m2"),
            F.col("gpp_mod").alias("GPP_err_mol.m2"),
        ),
        s,
    )
    site = F.regexp_extract("_metadata.file_path", PATH_SITE, 1)
    return _site_int(R.read_alt_gpp(s, path, site=site))


query(
    "read_alt_gpp",
    rsql(
        """SELECT sitename, date, CASE WHEN dayofyear(date) % 7 > 0 THEN gpp_nt * 12.0107 END AS gpp_obs, gpp_mod * 12.0107 AS gpp_err_obs
        FROM fx_daily""",
        OM,
        "gpp_obs gpp_err_obs",
    ),
)(_alt)


def _vegetation(s, d, splined, layout="gapfilled"):
    path = _csv(
        fx_daily(s, d).select(
            "sitename", "date", F.col("soilm").alias("spline"), F.col("qc_nt").alias("interpl"), F.col("qc_dt").alias("modisvar_interpol")
        ),
        s,
    )
    site = F.regexp_extract("_metadata.file_path", PATH_SITE, 1)
    return _site_int(R.read_vegetation_index(s, path, splined, layout, site))


for _n, _c, _args in (
    ("splined", "soilm", (True,)),
    ("interpolated", "qc_nt", (False,)),
    ("second_layout", "qc_dt", (False, "interpolated")),
):
    query(f"read_vegetation_{_n}", rsql(f"SELECT sitename, date, {_c} AS fapar FROM fx_daily", OM, "fapar"))(
        lambda s, d, a=_args: _vegetation(s, d, *a)
    )


def _text(s, d):
    path = S.scratch_dir(s)
    S.write_site_year_text(obs_mod(s, d).select("sitename", "date", "gpp_mod"), "gpp_mod", path)
    return path


def _fixed_width(s, d):
    keys = {"sitename": r"sitename=([^/]+)/", "year": r"year=([^/]+)/"}
    back = R.read_fixed_width(s, _text(s, d), 1, 16, "gpp_mod", keys)
    # line order within a file carries the date order
    return back.groupBy(F.col("sitename").cast("bigint").alias("sitename"), F.col("year").cast("int").alias("year")).agg(
        F.count("gpp_mod").alias("n"), F.sum("gpp_mod").alias("total"), F.min_by("gpp_mod", "line").alias("first"),
        F.max_by("gpp_mod", "line").alias("last"),
    )


query(
    "read_fixed_width",
    rsql(
        """SELECT sitename, CAST(year(date) AS INTEGER) AS year, count(*) AS n, sum(round(gpp_mod, 6)) AS total,
        arg_min(round(gpp_mod, 6), date) AS first, arg_max(round(gpp_mod, 6), date) AS last FROM obs_mod GROUP BY ALL""",
        "sitename, year, n",
        "total first last",
    ),
)(_fixed_width)


def _text_lines(s, d):
    path = S.scratch_dir(s)
    S.write_site_year_text(fx_daily(s, d).select("sitename", "date", "gpp_mod", "et"), "gpp_mod", path, "et")
    lines = text_of_folders(s, path, {"sitename": "bigint", "year": "int"})
    return lines.groupBy("sitename", "year", "value").agg(F.count(F.lit(1)).alias("n"))


query(
    "write_site_year_text",
    """SELECT sitename, CAST(year(date) AS INTEGER) AS year, format('{:16.6f}    {:.6f}', gpp_mod, et) AS value, count(*) AS n
    FROM fx_daily GROUP BY ALL""",
)(_text_lines)


def _yearly(s, d):
    path = S.scratch_dir(s)
    long = (
        fx_daily(s, d)
        .select("sitename", "date", F.year("date").alias("year"), "temp", "soilm", "et")
        .unpivot(["sitename", "date", "year"], ["temp", "soilm", "et"], "variable", "value")
    )
    long.hint("rebalance", "variable", "year").write.partitionBy("variable", "year").parquet(path)
    return R.read_yearly_outputs(s, path, ["temp", "soilm", "et"])


query("merge_yearly_outputs", rsql("SELECT sitename, date, temp, soilm, et FROM fx_daily", OM, "temp soilm et"))(_yearly)


def _flat(s, d, fmt):
    path = S.scratch_dir(s)
    S.write_flat(monthly_mean(obs_mod(s, d)), path, fmt)
    schema = "sitename BIGINT, year INT, moy INT, gpp_mod DOUBLE, n BIGINT"
    return s.read.parquet(path) if fmt == "parquet" else s.read.option("header", True).schema(schema).csv(path)


for _fmt in ("parquet", "csv"):
    query(
        f"write_flat_{_fmt}",
        rsql(
            """SELECT sitename, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS moy, avg(gpp_mod) AS gpp_mod,
            count(*) AS n FROM obs_mod GROUP BY ALL""",
            "sitename, year, moy, n",
            "gpp_mod",
        ),
    )(lambda s, d, f=_fmt: _flat(s, d, f))


def _stored(s, d):
    path = S.scratch_dir(s)
    first = S.materialise_or_load(s, path, lambda: annual_sum(obs_mod(s, d), "gpp_mod", 1))
    # a second call must reuse what is there
    again = S.materialise_or_load(s, path, lambda: first.where("false"))
    return again


query(
    "materialise_or_load",
    rsql(
        "SELECT sitename, CAST(year(date) AS INTEGER) AS year, sum(gpp_mod) AS gpp_mod, count(*) AS n FROM obs_mod GROUP BY ALL",
        "sitename, year, n",
        "gpp_mod",
    ),
)(_stored)
