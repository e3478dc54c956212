"""Yearly outputs: a variable's year is written by as many tasks as its rows fill."""

from checks import files
from siteflux.sources import readers


def test_a_year_is_no_single_task(spark, monkeypatch, tmp_path):
    # 200 days of 1,000 sites: one variable and year outgrow the advised size of a partition
    days = spark.range(0, 200_000, 1, 4).selectExpr(
        "id % 1000 AS sitename", "date_add(DATE '2001-01-01', CAST(id / 1000 AS INT)) AS date",
        "rand(1) AS temp", "rand(2) AS soilm", "rand(3) AS et",
    )
    monkeypatch.setattr(files, "fx_daily", lambda s, d: days)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "256k")
    monkeypatch.setattr(files.S, "scratch_dir", lambda s: str(tmp_path / "yearly"))
    try:
        out = files._yearly(spark, "")
    finally:
        spark.conf.set(size, before)
    parts = list((tmp_path / "yearly" / "variable=temp" / "year=2001").glob("*.parquet"))
    assert len(parts) > 1
    assert out.count() == 200_000 and out.where("temp IS NULL OR soilm IS NULL OR et IS NULL").isEmpty()


def test_merging_is_one_aggregate(spark):
    rows = [("a", 1, "x", 1.0), ("a", 1, "x", 2.0), ("a", 1, "y", None), ("a", 2, "z", 5.0), (None, 1, "y", 3.0), ("b", 1, None, 4.0)]
    df = spark.createDataFrame(rows, "sitename STRING, day INT, variable STRING, value DOUBLE")
    df = df.selectExpr("sitename", "date_add(DATE '2001-01-01', day) AS date", "variable", "value")
    out = readers.merge_yearly_outputs(df, ["x", "y"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    got = {(r.sitename, r.date.day): (r.x, r.y) for r in out.collect()}
    assert got == {("a", 2): (2.0, None), ("a", 3): (None, None), (None, 2): (None, 3.0), ("b", 2): (None, None)}
