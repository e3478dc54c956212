"""Tower files: one header a file, one scan a header, one file a site, and the job from files to targets."""

import datetime as dt

import pytest

from siteflux.plans.observations import build_observations, observations_from_files, soil_water_observations
from siteflux.sources import readers as R

HEAD = "TIMESTAMP,GPP_NT_VUT_REF,GPP_DT_VUT_REF,LE_F_MDS,LE_F_MDS_QC,NEE_VUT_REF_NIGHT_QC,NEE_VUT_REF_DAY_QC,TA_F,SWC_F_MDS_1,SWC_F_MDS_1_QC"


def rows(values, shift=0.0):
    out = []
    for i, v in enumerate(values):
        out.append(f"200101{i + 1:02d},{v + shift},{v + 0.5},{v * 10},1,1,1,{10 + i},{20 + i},1")
    return out


@pytest.fixture
def towers(tmp_path):
    def put(folder, name, lines):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text("\n".join(lines) + ("\n" if lines else ""), encoding="utf-8")

    values = [1.0, 2.5, 3.25, 4.75, 5.0, 6.5]
    put("a b", "FLX_AA-One_FLUXNET2015_FULLSET_DD_1996-2014_1-3.csv", [HEAD, *rows(values)])
    put("two", "FLX_BB-Two_FLUXNET2015_FULLSET_DD_1996-2014_2-3.csv", [HEAD, *rows(values), HEAD])
    # an older version that no reader could parse, and other resolutions
    put("two", "FLX_BB-Two_FLUXNET2015_FULLSET_DD_1996-2014_1-1.csv", ["no header", "\x00,\"broken"])
    put("two", "FLX_BB-Two_FLUXNET2015_FULLSET_YY_1996-2014_2-3.csv", ["TIMESTAMP,TA_F", "2001,9.5"])
    # fewer columns in another order, quoted cells, a byte order mark
    put("three", "FLX_CC-Thr_FLUXNET2015_FULLSET_DD_1996-2014_1-1.csv", ["\ufeffTA_F,NOTE,TIMESTAMP,TA_F", '3.5,"a, ""b""",20010101,9', '"-9999","x",20010102,9', "cold,,20010103,9"])
    put("four", "FLX_DD-Emp_FLUXNET2015_FULLSET_DD_1996-2014_1-1.csv", [])
    return str(tmp_path)


def test_every_file_is_read_by_its_own_header(spark, towers):
    out = R.read_site_csv(spark, towers, "d", ["TA_F", "SWC_F_MDS_1", "NOWHERE"], "*_DD_*-3.csv")
    assert out.count() == 12 and {r.NOWHERE for r in out.collect()} == {None}
    assert {(r.sitename, r.TA_F) for r in out.where("date = '2001-01-02'").collect()} == {("AA-One", 11.0), ("BB-Two", 11.0)}
    quoted = R.read_site_csv(spark, f"{towers}/three", "d").orderBy("date")
    assert quoted.columns == ["sitename", "date", "NOTE", "TA_F"]
    assert [(r.date.day, r.TA_F) for r in quoted.collect()] == [(1, 3.5), (2, None), (3, None)]
    year = R.read_site_csv(spark, towers, "y", glob="*_YY_*.csv").collect()
    assert [tuple(r) for r in year] == [("BB-Two", dt.date(2001, 1, 1), 9.5)]


def test_no_files_and_empty_files(spark, towers):
    assert R.read_site_csv(spark, f"{towers}/four", "d").columns == ["sitename", "date"]
    none = R.read_site_csv(spark, [], "d", ["TA_F"])
    assert none.columns == ["sitename", "date", "TA_F"] and none.isEmpty()


def test_headers_are_grouped_and_only_first_lines_count(spark, towers):
    paths = R.chosen_files(spark, towers, "d")
    assert sorted(p.rsplit("/", 1)[1][4:10] for p in paths) == ["AA-One", "BB-Two", "CC-Thr"]  # an empty file is not listed
    assert not any("1996-2014_1-1" in p and "BB-Two" in p for p in paths)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    headers = R.file_headers(spark, paths)
    assert {k: len(v) for k, v in headers.items()} == {HEAD: 2, "TA_F,NOTE,TIMESTAMP,TA_F": 1}
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_only_wanted_columns_are_scanned(spark, towers):
    out = R.read_site_csv(spark, towers, "d", lambda c: c.startswith("SWC_F_MDS_1") and not c.endswith("QC"), "*AA-One*")
    assert out.columns == ["sitename", "date", "SWC_F_MDS_1"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<_c0:string,_c8:string>" in plan and plan.count("FileScan csv") == 1


def test_targets_from_files_equal_targets_from_the_parsed_table(spark, towers):
    got = observations_from_files(spark, towers).orderBy("sitename", "date").collect()
    raw = R.read_site_csv(spark, R.chosen_files(spark, towers, "d"), "d")
    want = build_observations(raw).orderBy("sitename", "date").collect()
    assert got == want and len(got) == 15
    first = got[0]
    assert first.sitename == "AA-One" and first.gpp_obs == pytest.approx(1.25) and first.soilm_obs_mean == 0.0
    assert got[-1].sitename == "CC-Thr" and got[-1].gpp_obs is None
    water = soil_water_observations(raw).where("sitename = 'AA-One'")
    assert water.columns == ["sitename", "date", "SWC_F_MDS_1"] and water.where("SWC_F_MDS_1 IS NULL").isEmpty()


def test_first_lines_of_many_small_files_take_few_tasks(spark, tmp_path):
    for i in range(120):
        (tmp_path / f"FLX_AA-{i:03d}_a.csv").write_text(f"TIMESTAMP,{'ab'[i % 2]}\n20010101,{i}\n")
    paths = [r.path for r in R.list_files(spark, str(tmp_path)).collect()]
    spark.sparkContext.setJobGroup("first-lines", "")
    headers = R.file_headers(spark, paths)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("first-lines") for s in tracker.getJobInfo(j).stageIds}
    assert sum(tracker.getStageInfo(s).numTasks for s in stages) < len(paths)
    assert {line: len(files) for line, files in headers.items()} == {"TIMESTAMP,a": 60, "TIMESTAMP,b": 60}


def test_first_lines_do_not_depend_on_the_length_of_files(spark, tmp_path):
    texts = {"a": b"\xef\xbb\xbfx,y\r\n1,2\r\n", "b": b"x,y", "c": b"", "d": b"z\rw\n", "e e": b"z\n" * 5, "f": b"\n1\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text)
    paths = [r.path for r in R.list_files(spark, str(tmp_path)).collect()]
    found = [R.file_headers(spark, paths, small) for small in (0, 6, 1 << 20)]
    assert found[0] == found[1] == found[2]
    assert {line: len(files) for line, files in found[0].items()} == {"x,y": 2, "z": 2, "": 1}
