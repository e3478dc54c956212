"""Readers of tower, product, metadata and model files. Files of one layout are read in one scan."""

from __future__ import annotations

import csv
import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteflux import DATE, SITE
from siteflux.functions.nulls import finite
from siteflux.functions.units import mol_to_gram_carbon
from siteflux.sources.sinks import UNKNOWN, _path_on_machines, stored

MISSING = "-9999"
# Resolution code in tower file names.
RESOLUTION = {"d": "DD", "w": "WW", "m": "MM", "y": "YY"}
TIME_COLUMNS = ("TIMESTAMP", "TIMESTAMP_START", "TIMESTAMP_END")
#: Bytes up to which a file is read whole for its first line.
SMALL_FILE = 32 << 20
#: Bytes of a text file that one task reads at once, and lines it passes on at once.
PIECE, BATCH_LINES = 32 << 20, 1 << 16
#: Endings by which Spark's readers know compressed files.
PACKED = (".gz", ".gzip", ".bz2", ".zst", ".zstd", ".lz4", ".snappy", ".deflate")
SITE_PATTERN = r"FLX_([A-Za-z]{2}-[A-Za-z0-9]{3})"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def line_order() -> Column:
    """A sortable place of a line. Spark packs files into tasks in an order of its own, so the path and block lead."""
    path, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    return F.struct(path.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("row"))


def site_of_file(pattern: str = SITE_PATTERN) -> Column:
    return F.regexp_extract(file_name(), pattern, 1)


def _list_folders(deep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function from folders to what lies in them, or (``deep``) to all files below them; files pass."""

    def seen(folder: str) -> list[tuple[str, int]]:
        out = []
        with os.scandir(folder) as found:
            for entry in found:
                name = entry.name  # names that Spark's readers leave out
                if name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_"):
                    continue
                out.append((entry.path, -1 if entry.is_dir() else entry.stat().st_size))
        return out

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo, out = list(zip(*[c.to_pylist() for c in batch.columns])), []
            while todo:
                path, size = todo.pop()
                if size >= 0:
                    out.append((path, size))
                else:
                    (todo if deep else out).extend(seen(path))
                if len(out) >= 10_000 or (out and not todo):
                    yield pa.record_batch([pa.array([p for p, _ in out], pa.string()), pa.array([n for _, n in out], pa.int64())], ["path", "size"])
                    out = []

    return list_


def _piece_lines(lines: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function from ``path, start, stop`` to the lines that begin there. Lines end as Spark's do, with LF, CR or both."""
    plain = frozenset("/:@&=+$,;-_.!~*'()")

    def as_uri(path: str) -> str:
        kept = (c if c.isalnum() or c in plain or ord(c) > 160 else "".join(f"%{b:02X}" for b in c.encode()) for c in path)
        return "file:" + "".join(kept)

    def ends(data: bytes, at: int) -> int:
        """The place after the first line end from ``at``; -1 where more bytes are needed to tell."""
        found = [i for i in (data.find(b"\n", at), data.find(b"\r", at)) if i >= 0]
        if not found:
            return -1
        first = min(found)
        if data[first : first + 1] == b"\n":
            return first + 1
        return -1 if first + 1 == len(data) else first + 1 + (data[first + 1 : first + 2] == b"\n")

    def piece(path: str, start: int, stop: int) -> list[bytes]:
        with open(path, "rb") as file:
            before = 1 if start else 0
            file.seek(start - before)
            data = file.read(stop - start + before)
            last = stop - start + before - 1
            while (end := ends(data, last)) < 0 and (more := file.read(1 << 16)):
                data += more
            data = data[: end if end >= 0 else len(data)]
        if start:  # the line that began before this piece is another's
            end = ends(data, 0)
            data = data[end if end >= 0 else len(data) :]
        elif data.startswith(b"\xef\xbb\xbf"):
            data = data[3:]
        return data.splitlines()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int, int, list[bytes]]] = []

        def passed() -> pa.RecordBatch:
            sizes = [len(h[3]) for h in held]
            files = pa.DictionaryArray.from_arrays(pa.array([i for i, n in enumerate(sizes) for _ in range(n)], pa.int32()), pa.array([h[0] for h in held], pa.string()))
            blocks = pa.array([h[1] for h, n in zip(held, sizes) for _ in range(n)], pa.int64())
            rows = pa.array([i for h, n in zip(held, sizes) for i in range(h[2], h[2] + n)], pa.int64())
            value = pa.array([x for h in held for x in h[3]], pa.binary()).view(pa.string())
            return pa.record_batch([files.cast(pa.string()), blocks, rows, value], ["file", "block", "row", "value"])

        count = 0
        for batch in batches:
            for path, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
                all_, uri = piece(path, start, stop), as_uri(path)
                for at in range(0, len(all_), lines):
                    held.append((uri, start, at, all_[at : at + lines]))
                    count += len(held[-1][3])
                    if count >= lines:
                        yield passed()
                        held, count = [], 0
        if held:
            yield passed()

    return read


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row, value``: the lines of all text files below a folder, with the path and block of their file.

    Spark's driver holds some kilobytes of every file of a scan. On the machines' own file system (local or mounted) tasks list
    the folders and open the files instead, and neither names nor files reach the driver. Other file systems, single files,
    patterns of names and compressed files are read by Spark's reader.
    """
    local = _path_on_machines(spark, path)
    if local is not None and os.path.isdir(local) and not set("*?[{") & set(local):
        tasks = 4 * spark.sparkContext.defaultParallelism
        found = spark.createDataFrame([(local, -1)], "path STRING, size LONG")
        for deep in (False, False, True):  # two levels are dealt out anew, since the first may have few folders
            found = found.mapInArrow(_list_folders(deep), found.schema).repartition(tasks)
        found = stored(found, "files")
        packed = F.max(F.lower("path").rlike("(" + "|".join(PACKED).replace(".", "[.]") + ")$"))
        n = found.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), packed.alias("packed")).first()
        if not n.packed:
            starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(PIECE).cast("long")))
            pieces = found.where("size > 0").select("path", "size", starts.alias("start"))
            pieces = pieces.select("path", "start", F.least(F.col("start") + PIECE, "size").alias("stop"))
            tasks = max(1, min(n.files, max(tasks, (n.bytes or 0) // PIECE)))
            lines = pieces.repartition(tasks, "path", "start").mapInArrow(
                _piece_lines(BATCH_LINES), "file STRING, block LONG, row LONG, value STRING"
            )
            return lines
    with few_listing_tasks(spark):
        raw = spark.read.option("recursiveFileLookup", True).text(path)
    place = line_order()
    return raw.select(place["file"].alias("file"), place["block"].alias("block"), place["row"].alias("row"), "value")


def pick_site_files(files: DataFrame, freq: str, name: str = "file_name") -> DataFrame:
    """One file per site for a resolution; of several, those ending in ``3.csv``."""
    site = F.regexp_extract(name, SITE_PATTERN, 1)
    wanted = files.where(F.col(name).rlike(rf"FLX_.*_FLUXNET2015_FULLSET_{RESOLUTION[freq]}.*\.csv$")).withColumn(
        SITE, site
    )
    key = F.struct((~F.col(name).endswith("3.csv")).alias("_rank"), F.col(name).alias("_name"))
    # a site with several files and none ending in 3.csv keeps none
    counted = wanted.groupBy(SITE).agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_k"))
    return counted.where((F.col("_n") == 1) | ~F.col("_k._rank")).select(SITE, F.col("_k._name").alias(name))


def _date_column(cell, freq: str) -> Column:
    """Date from the time stamp: the day, the week's start, the month's or the year's first day."""
    if freq == "d":
        text = cell("TIMESTAMP")
    elif freq == "w":
        text = cell("TIMESTAMP_START")
    elif freq == "m":
        text = F.concat(F.substring(cell("TIMESTAMP"), 1, 6), F.lit("01"))
    elif freq == "y":
        text = F.concat(F.substring(cell("TIMESTAMP"), 1, 4), F.lit("0101"))
    else:
        raise ValueError("freq must be 'd', 'w', 'm' or 'y'")
    return F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")


def list_files(spark: SparkSession, path: str | list[str], glob: str = "*.csv") -> DataFrame:
    """``path, file_name`` of the files below ``path``, from the listing alone: no file is opened."""
    with few_listing_tasks(spark):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"))


def chosen_files(spark: SparkSession, path: str, freq: str) -> list[str]:
    """The paths of the one file per site that ``pick_site_files`` chooses, in order."""
    files = list_files(spark, path)
    names = files.groupBy("file_name").agg(F.min("path").alias("path"))  # one version of a name kept in two folders
    picked = pick_site_files(names, freq).join(names, "file_name")
    return [r.path for r in picked.orderBy("path").select("path").collect()]


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of a task's input, if it begins a file; the rest is not asked for."""
    for batch in batches:
        if batch.num_rows:
            if batch.column(2)[0].as_py() == 0:
                yield batch.slice(0, 1)
            return


@contextmanager
def _setting(spark: SparkSession, option: str, value: str) -> Iterator[None]:
    before = spark.conf.get(option)
    spark.conf.set(option, value)
    try:
        yield
    finally:
        spark.conf.set(option, before)


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders and files that a reader is given inside are listed by a few tasks a core, not by a task each."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    with _setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(tasks)):
        yield


def _headers_of_small(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``file, value``: the first line of files that are read whole, many of them by one task."""
    with few_listing_tasks(spark):
        whole = spark.read.text(paths, wholetext=True)
    line = F.substring_index(F.substring_index("value", "\n", 1), "\r", 1)
    return whole.where(F.length("value") > 0).select(F.col("_metadata.file_path").alias("file"), line.alias("value"))


def _headers_of_large(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same of files too long for that: a task gets one file (or one split of it) and stops after a line."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("start")
    )
    return lines.mapInArrow(_first_lines, "file string, value string, start long").drop("start")


def file_headers(spark: SparkSession, paths: list[str], small: int = SMALL_FILE) -> dict[str, list[str]]:
    """Each different first line of the files, with the files that begin with it.

    Files of at most ``small`` bytes are packed into tasks, so that the number of tasks follows the bytes and not the
    number of sites; of a longer one a task of its own reads a line. Only names and different lines reach the driver.
    """
    # the listing, the caller and the scan write one path in different forms
    known = {unquote(urlparse(p).path): p for p in paths}

    def given(path: str) -> str:
        return known.get(unquote(urlparse(path).path), path)

    with few_listing_tasks(spark):
        listed = spark.read.format("binaryFile").load(paths)
    long = {given(r.path) for r in listed.where(F.col("length") > small).select("path").collect()}
    # a file that counts as a whole partition shares its task with no other
    cost, least = "spark.sql.files.openCostInBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    headers: dict[str, list[str]] = {}
    for lines, files, setting in (
        (_headers_of_small, [p for p in paths if p not in long], spark.conf.get(cost)),
        (_headers_of_large, [p for p in paths if p in long], least),
    ):
        if files:
            with _setting(spark, cost, setting):
                rows = lines(spark, files).groupBy("value").agg(F.collect_list("file").alias("files")).collect()
            for r in rows:
                headers.setdefault(r.value.strip("\ufeff\r\n"), []).extend(given(file) for file in r.files)
    return {line: sorted(files) for line, files in sorted(headers.items(), key=lambda item: min(item[1]))}


def read_site_csv(
    spark: SparkSession,
    path: str | list[str],
    freq: str,
    columns: list[str] | Callable[[str], bool] | None = None,
    glob: str = "*.csv",
    site_pattern: str = SITE_PATTERN,
) -> DataFrame:
    """Tower CSV files under ``path``, or a list of files: ``-9999`` is missing, the date follows the resolution, numbers
    are double.

    Towers differ in the columns they report. The first line of every file is read before the rest; the files of one header
    are then one CSV scan with that header's columns, which reads the columns asked for alone and understands quoted
    cells, and the scans are united by name. ``columns`` are names, a condition on names, or all. Columns that a
    file lacks are null, as are cells that are no number. A header line that a file repeats is no row; a file without
    a line gives none. The first of two columns of one name counts.
    """
    paths = path if isinstance(path, list) else [r.path for r in list_files(spark, path, glob).orderBy("path").collect()]
    headers = file_headers(spark, paths) if paths else {}
    named = {line: next(csv.reader([line]), []) for line in headers}
    known = sorted({n for names in named.values() for n in names if n not in TIME_COLUMNS})
    wanted = columns if isinstance(columns, list) else [n for n in known if columns is None or columns(n)]

    def scan(line: str, files: list[str]) -> DataFrame:
        names = named[line]
        places = {n: f"_c{i}" for i, n in reversed(list(enumerate(names)))}
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        with few_listing_tasks(spark):
            raw = spark.read.schema(schema).option("header", True).option("nullValue", MISSING).csv(files)

        def cell(name: str) -> Column:
            return F.col(places[name]) if name in places else F.lit(None).cast("string")

        stamp = next((n for n in TIME_COLUMNS if n in places), None)
        data = raw if stamp is None else raw.where(~F.col(places[stamp]).eqNullSafe(stamp))
        site = F.regexp_extract("_metadata.file_path", site_pattern, 1)
        numbers = [cell(c).try_cast("double").alias(c) for c in wanted]
        return data.select(site.alias(SITE), _date_column(cell, freq).alias(DATE), *numbers)

    if not headers:
        fields = [T.StructField(SITE, T.StringType()), T.StructField(DATE, T.DateType())]
        return spark.createDataFrame([], T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in wanted]))
    return reduce(DataFrame.unionByName, [scan(line, files) for line, files in headers.items()])


def read_site_meta_long(spark: SparkSession, path: str) -> DataFrame:
    """Semicolon-separated long metadata with ``line``, an order of rows by file path, block of the file and row."""
    fields = ["SITE_ID", "GROUP_ID", "VARIABLE_GROUP", "VARIABLE", "DATAVALUE"]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in fields])
    df = spark.read.option("header", True).option("sep", ";").schema(schema).csv(path)
    return df.withColumn("line", line_order())


def _by_file(spark: SparkSession, site: Column | None) -> DataFrameReader:
    """A reader that makes no columns of folders where ``site`` comes from the file's path or name.

    To make columns of them, Spark's driver compares all folders, in a time that grows with the square of their number.
    """
    named = site is None or "_metadata" in str(site)
    return spark.read.option("recursiveFileLookup", named)


def read_alt_gpp(spark: SparkSession, path: str, freq: str = "d", site: Column | None = None) -> DataFrame:
    """Second carbon flux product, daily only: mol CO2 to gC, NaN to null, common names."""
    if freq != "d":
        raise ValueError("the second product is available for daily time steps only")
    # columns are found by the header's names; values are cast here, since a schema would go by position
    with few_listing_tasks(spark):
        raw = _by_file(spark, site).option("header", True).option("nullValue", MISSING).csv(path)
    where = F.regexp_extract(file_name(), r"^(.*)_daily_GPP", 1) if site is None else site
    return raw.select(
        where.alias(SITE),
        F.col("Timestamp").try_cast("date").alias(DATE),
        *[
            finite(mol_to_gram_carbon(F.col(f"`{name}`").try_cast("double"))).alias(out)
            for name, out in (("GPP_mol.m2", "gpp_obs"), ("GPP_err_mol.m2", "gpp_err_obs"))
        ],
    )


def read_vegetation_index(
    spark: SparkSession, path: str, splined: bool = True, layout: str = "gapfilled", site: Column | None = None
) -> DataFrame:
    """Vegetation index files as ``fapar``; ``layout="interpolated"`` has the value in ``modisvar_interpol``."""
    column = "modisvar_interpol" if layout == "interpolated" else ("spline" if splined else "interpl")
    with few_listing_tasks(spark):
        raw = _by_file(spark, site).option("header", True).csv(path)
    where = F.regexp_extract(file_name(), r"_([A-Za-z]{2}-[A-Za-z0-9]{3})_", 1) if site is None else site
    return raw.select(
        where.alias(SITE),
        F.expr("try_cast(date AS DATE)").alias(DATE),
        F.expr(f"try_cast({column} AS DOUBLE)").alias("fapar"),
    )


def read_fixed_width(
    spark: SparkSession, path: str, begin: int = 5, end: int = 15, name: str = "gpp_mod", keys: dict[str, str] | None = None
) -> DataFrame:
    """One number at character positions ``begin`` to ``end``, 1-based; -9999 is missing.

    ``keys`` adds columns cut from the file path by regular expression, and ``line`` orders the lines of a
    file, so that the table can be joined by key.
    """
    raw = text_lines(spark, path)
    number = F.nullif(F.expr(f"try_cast(trim(substring(value, {begin}, {end - begin + 1})) AS DOUBLE)"), F.lit(UNKNOWN))
    cut = [F.regexp_extract("file", pattern, 1).alias(k) for k, pattern in (keys or {}).items()]
    return raw.select(*cut, number.alias(name), F.struct("file", "block", "row").alias("line"))


def union_sites(*frames: DataFrame) -> DataFrame:
    """Rows of all frames; a column missing from one is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def merge_yearly_outputs(df: DataFrame, variables: list[str]) -> DataFrame:
    """Yearly long outputs (site, date, variable, value) as one row per site and day, a column per variable.

    Where yearly outputs overlap, a day takes the largest value, whatever the order of the files.
    """
    # one aggregate over the listed names; a pivot would first hold a row for each day and variable
    picked = {v: F.max(F.when(F.col("variable") == v, F.col("value"))) for v in variables}
    return df.groupBy(SITE, DATE).agg(*[value.alias(v) for v, value in picked.items()])


def read_yearly_outputs(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """A directory of yearly Parquet outputs partitioned by ``variable`` (and year)."""
    return merge_yearly_outputs(spark.read.parquet(path).where(F.col("variable").isin(variables)), variables)
