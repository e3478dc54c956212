"""Files by folder: named, ordered and read back as Spark's own, without its process for each file."""

import pytest
from pyspark.sql import functions as F

from checks import files as checks_files
from siteflux.sources import sinks

NAMES = ["a b", "x/y=%", None, "", "ü:[1]^", "tab\t\"'\\{}", "c"]


@pytest.fixture
def rows(spark):
    data = [(name, 2000 + i % 3, i, f"{name}-{i:05d} ü") for i in range(3000) for name in NAMES]
    return spark.createDataFrame(data, "sitename STRING, year INT, _order INT, value STRING").repartition(7)


def _read(spark, path):
    lines = spark.read.schema("value STRING, sitename STRING, year INT").text(path)
    return {(r.sitename, r.year, r.value) for r in lines.select("sitename", "year", "value").collect()}


def test_files_equal_those_of_partition_by(spark, rows, tmp_path):
    mine, spark_own = tmp_path / "mine", tmp_path / "own"
    (mine / "sitename=old").mkdir(parents=True)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")  # a folder of 1,000 or more lines spans batches
    try:
        sinks.write_folders(rows, ["sitename", "year"], str(mine))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows.repartition("sitename", "year").drop("_order").write.partitionBy("sitename", "year").text(str(spark_own))
    folders = {str(p.parent.relative_to(spark_own)) for p in spark_own.rglob("part-*")}
    found = [p for p in mine.rglob("*") if p.is_file() and p.name != "_SUCCESS"]
    # no checksum files and nothing of an attempt is left: a process for each of Hadoop's files made the write slow
    assert sorted(str(p.parent.relative_to(mine)) for p in found) == sorted(folders)
    assert all(p.name == "part-00000.txt" for p in found) and (mine / "_SUCCESS").exists()
    assert _read(spark, str(mine)) == _read(spark, str(spark_own)) and len(_read(spark, str(mine))) == 3000 * len(NAMES)
    for path in found:
        numbers = [int(line[:-2].rsplit("-", 1)[1]) for line in path.read_text(encoding="utf-8").splitlines()]
        assert numbers == sorted(numbers)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["mine", "own"]


def test_a_failed_write_leaves_what_was_there(spark, rows, tmp_path):
    path = tmp_path / "kept"
    sinks.write_folders(rows.where("sitename = 'c'"), ["sitename"], str(path))
    bad = rows.withColumn("value", F.when(F.col("_order") < 2999, F.col("value")).otherwise(F.raise_error(F.lit("stop")).cast("string")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_folders(bad, ["sitename", "year"], str(path))
    assert [p.name for p in tmp_path.iterdir()] == ["kept"]
    assert len((path / "sitename=c" / "part-00000.txt").read_text(encoding="utf-8").splitlines()) == 3000


@pytest.mark.parametrize("machines", [True, False])
def test_csv_files_by_either_way(spark, tmp_path, monkeypatch, machines):
    if not machines:
        monkeypatch.setattr(sinks, "_path_on_machines", lambda s, path: None)
    df = spark.createDataFrame([("a", 1.5, 'x,"y'), ("a", None, "z"), ("b", float("nan"), None)], "site STRING, `v.1` DOUBLE, w STRING")
    checks_files.csv_files(df, ["site"], str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("escape", "\\").csv(str(tmp_path / "csv"))
    assert back.columns == ["v.1", "w", "site"]
    assert {tuple(r) for r in back.collect()} == {("1.5", 'x,"y', "a"), (None, "z", "a"), ("NaN", None, "b")}
    sinks.write_folders(df.where("false").select("site", F.lit("x").alias("value")), ["site"], str(tmp_path / "csv"))
    assert not list((tmp_path / "csv").rglob("part-*"))


def test_no_reader_compares_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, "2001-01-01", 0.5) for i in range(5)], "sitename INT, date STRING, spline DOUBLE")
    checks_files.csv_files(df, ["sitename"], str(tmp_path / "veg"))
    of_path = F.regexp_extract("_metadata.file_path", "sitename=([^/]+)/", 1)
    for site, compared in ((of_path, False), (F.col("sitename"), True)):
        out = checks_files.R.read_vegetation_index(spark, str(tmp_path / "veg"), site=site)
        assert {(int(r.sitename), r.fapar) for r in out.collect()} == {(i, 0.5) for i in range(5)}
        # columns of folders need a comparison of all folders on the driver
        plan = out._jdf.queryExecution().analyzed().toString()
        assert any("Relation" in line and "sitename#" in line for line in plan.splitlines()) == compared
