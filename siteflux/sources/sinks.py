"""Writers, and stored results that are built once."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux import DATE, SITE


#: How text files write an unknown value.
UNKNOWN = -9999.0
#: Spark's setting by which the shuffle files of a finished query are deleted.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fixed_format(value: Column, second: Column | None = None) -> Column:
    """The text form ``%16.6f``, or ``%16.6f    %f`` for two columns; an unknown value is the number -9999."""
    known = [F.coalesce(c.cast("double"), F.lit(UNKNOWN)) for c in (value, second) if c is not None]
    return F.format_string("%16.6f" if second is None else "%16.6f    %f", *known)


def write_site_year_text(df: DataFrame, col: str, path: str, second: str | None = None) -> None:
    """One directory per site and year, lines in date order.

    Rows are hashed by (site, year), so a large site spreads over its years and each file is written by
    one task in order.
    """
    line = fixed_format(F.col(col), F.col(second) if second else None)
    _write_lines(df.select(F.col(SITE), F.year(DATE).alias("year"), F.col(DATE), line.alias("value")), [SITE, "year"], path)


def write_variables_text(long: DataFrame, path: str) -> None:
    """The same for many variables at once: rows ``sitename, date, variable, value``, a directory per variable, site and year."""
    lines = long.select("variable", SITE, F.year(DATE).alias("year"), DATE, fixed_format(F.col("value")).alias("value"))
    _write_lines(lines, ["variable", SITE, "year"], path)


def _write_lines(lines: DataFrame, folders: list[str], path: str) -> None:
    write_folders(lines.select(*folders, F.col(DATE).alias("_order"), "value"), folders, path)


def write_folders(lines: DataFrame, folders: list[str], path: str, header: str | None = None, suffix: str = ".txt") -> None:
    """One file for each value of ``folders``, in folders named as ``partitionBy`` names them; what ``path`` held is replaced.

    ``lines`` has the text of a line in ``value`` and, where lines have an order, ``_order``. The rows are hashed by folder and
    sorted, so that one task writes a file from its first line to its last. On the machines' own file system (local or
    mounted) tasks open the files themselves: there Hadoop starts a process for each folder and file it makes, and the
    driver moves every file once more. Other file systems get Spark's own files. ``path`` is replaced when all is written.
    """
    spark = lines.sparkSession
    order = ["_order"] if "_order" in lines.columns else []
    # a folder's name is the text of its value; unknown and empty ones share a folder
    named = lines.withColumns({f: F.nullif(F.col(f).cast("string"), F.lit("")) for f in folders})
    out = named.repartition(*folders).sortWithinPartitions(*folders, *order).select(*folders, "value")
    local = _path_on_machines(spark, path)
    if local is None:
        writer = out.withColumnRenamed("value", header or "value").write.mode("overwrite").partitionBy(*folders)
        if header is None:
            writer.text(path)
        else:  # one column of whole lines: no character of a line is its separator or quote
            writer.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
        return
    fresh = os.path.join(os.path.dirname(local), f".{os.path.basename(local)}-{uuid.uuid4().hex}")
    try:
        os.makedirs(fresh)
        with configured(spark, CLEANUP, "true"):
            out.mapInArrow(_folder_writer(fresh, folders, header, suffix), "files LONG").agg(F.sum("files")).collect()
        open(f"{fresh}/_SUCCESS", "w").close()
        remove(spark, path)
        os.rename(fresh, local)
    except BaseException:
        remove(spark, f"file:{fresh}")
        raise


def _path_on_machines(spark: SparkSession, path: str) -> str | None:
    """The path as the machines' own file system knows it, if it lies there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    where = files.makeQualified(target).toUri()
    return where.getPath().rstrip("/") if where.getScheme() == "file" else None


def _folder_writer(
    root: str, folders: list[str], header: str | None, suffix: str
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function that writes a task's sorted rows. It uses nothing of this package, so that workers need not import it.

    A file is written beside its place and moved there when it is whole, so that a task may run again.
    """
    unsafe = {*map(chr, range(1, 32)), *"\x7f\"#%'*/:=?\\{[]^"}

    def folder(values: list[str | None]) -> str:
        names = ("__HIVE_DEFAULT_PARTITION__" if v is None else "".join(f"%{ord(c):02X}" if c in unsafe else c for c in v) for v in values)
        return "/".join([root, *(f"{key}={name}" for key, name in zip(folders, names))])

    def changes(batch: pa.RecordBatch) -> np.ndarray:
        """Rows that begin another folder than the row before them; the first row of a batch does."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for i in range(len(folders)):
            codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.append(np.flatnonzero(new), batch.num_rows)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, here, out, count = uuid.uuid4().hex, None, None, 0

        def finish() -> None:
            if out is not None:
                out.close()
                os.replace(out.name, f"{here}/part-00000{suffix}")

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                bounds = changes(batch).tolist()
                for start, end in zip(bounds, bounds[1:]):
                    there = folder([batch.column(i)[start].as_py() for i in range(len(folders))])
                    if there != here:
                        finish()
                        os.makedirs(there, exist_ok=True)
                        here, out, count = there, open(f"{there}/.{token}", "wb"), count + 1
                        if header is not None:
                            out.write(f"{header}\n".encode())
                    lines = batch.column(len(folders)).slice(start, end - start).to_pylist()
                    out.write("".join(f"{line or ''}\n" for line in lines).encode())
            finish()
            out = None
        finally:
            if out is not None:
                out.close()
                if os.path.exists(out.name):
                    os.remove(out.name)
        yield pa.RecordBatch.from_pydict({"files": [count]})

    return write


def write_flat(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "csv":
        df.write.mode(mode).option("header", True).csv(path)
    else:
        raise ValueError("fmt must be 'parquet' or 'csv'")


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def materialise_or_load(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], overwrite: bool = False
) -> DataFrame:
    """The stored result at ``path`` if it was written completely, else build, write and read it."""
    if overwrite or not _exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_dir(spark: SparkSession, folder: str | None = None) -> str:
    """The name of a new folder for intermediate tables, below a folder that all executors share.

    That is ``folder``, else the one in ``spark.checkpoint.dir``, else the warehouse. Where neither of the
    first two is given and the warehouse lies on the local disk of a cluster's machines, executors could
    not read each other's files, so this is an error.
    """
    base = folder or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        warehouse = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        files = warehouse.getFileSystem(spark._jsc.hadoopConfiguration())
        base = files.makeQualified(warehouse).toString()
        master = spark.sparkContext.master
        if files.getUri().getScheme() == "file" and not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder: {base} is local and the master is {master}")
    return f"{base.rstrip('/')}/siteflux-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables once their results have been consumed."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def configured(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with another value of a setting."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def workspace(spark: SparkSession, folder: str | None = None) -> Iterator[str]:
    """A new scratch folder that is deleted at the end, also after an error. Only what is consumed inside may live there."""
    path = scratch_dir(spark, folder)
    try:
        yield path
    finally:
        remove(spark, path)


def stored(df: DataFrame, name: str = "table", directory: str | None = None) -> DataFrame:
    """Write the table once to the shared folder and read it back.

    Later uses scan the written columns instead of recomputing the plan, survive lost executors, and let
    Spark see the table's true size when it chooses a join. What was shuffled to make it is of no use any more, so Spark is
    asked to delete those files when the write ends.
    """
    spark = df.sparkSession
    path = f"{directory or scratch_dir(spark)}/{name}"
    with configured(spark, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
