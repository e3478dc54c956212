"""Lines of text files below a folder, read by tasks: as Spark's reader gives them, without a list of files on the driver."""

import pytest
from pyspark.sql import functions as F

from siteflux.sources import readers as R
from siteflux.sources import sinks

NAMES = ["a b", "x/y=%", "ü:[1]^", "tab\t\"'\\{}", "c"]


def _spark_own(spark, path):
    raw = spark.read.option("recursiveFileLookup", True).text(path)
    return sorted((r.file, r.value) for r in raw.select(F.col("_metadata.file_path").alias("file"), "value").collect())


def _mine(spark, path):
    rows = R.text_lines(spark, path).collect()
    assert len({(r.file, r.block, r.row) for r in rows}) == len(rows)
    return sorted((r.file, r.value) for r in rows), rows


def test_paths_and_lines_are_those_of_the_reader(spark, tmp_path):
    data = [(name, 2000 + i % 2, i, f"{i:05d} ü") for i in range(40) for name in NAMES]
    df = spark.createDataFrame(data, "sitename STRING, year INT, _order INT, value STRING")
    sinks.write_folders(df, ["sitename", "year"], str(tmp_path / "t"))
    (tmp_path / "t" / "_hidden").mkdir()
    (tmp_path / "t" / "_hidden" / "x.txt").write_text("no")
    (tmp_path / "t" / "empty.txt").write_text("")
    assert _mine(spark, f"file://{tmp_path}/t")[0] == _spark_own(spark, f"file://{tmp_path}/t")
    got, rows = _mine(spark, str(tmp_path / "t"))
    assert got == _spark_own(spark, str(tmp_path / "t")) and len(got) == 200
    plan = R.text_lines(spark, str(tmp_path / "t"))._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan
    one = sorted((r.row, r.value) for r in rows if "/sitename=c/year=2000/" in r.file)
    assert [v for _, v in one] == [f"{i:05d} ü" for i in range(0, 40, 2)]


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 7, 1 << 20])
def test_pieces_of_long_files(spark, tmp_path, monkeypatch, piece):
    monkeypatch.setattr(R, "PIECE", piece)
    monkeypatch.setattr(R, "BATCH_LINES", 2)
    texts = {"a": b"\xef\xbb\xbfx,y\r\n1,2\r\n\r\nend", "b": b"x", "c": b"", "d": b"z\rw\n\nq\r", "e e": b"\n\n\n", "f": b"ab\ncd\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text)
    got, rows = _mine(spark, str(tmp_path))
    assert got == _spark_own(spark, str(tmp_path))
    of_d = sorted((r.block, r.row, r.value) for r in rows if r.file.endswith("/d.txt"))
    assert [v for *_, v in of_d] == ["z", "w", "", "q"]


def test_packed_files_and_patterns_are_left_to_the_reader(spark, tmp_path):
    spark.createDataFrame([("x",), ("y",)], "value STRING").coalesce(1).write.option("compression", "gzip").text(str(tmp_path / "z"))
    (tmp_path / "z" / "plain.txt").write_text("w\n")
    assert _mine(spark, str(tmp_path / "z"))[0] == _spark_own(spark, str(tmp_path / "z"))
    assert [v for _, v in _mine(spark, str(tmp_path / "z" / "pl*.txt"))[0]] == ["w"]
    (tmp_path / "none").mkdir()
    assert _mine(spark, str(tmp_path / "none"))[0] == []
