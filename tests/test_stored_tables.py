"""Stored tables leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from siteflux.sources import sinks


def _shuffled(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = disk.getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_what_was_shuffled_for_a_stored_table_or_files_goes(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 9).alias("site"), F.col("id").cast("string").alias("value"))
    before, setting = _shuffled(spark), spark.conf.get(sinks.CLEANUP, None)
    out = sinks.stored(rows.groupBy("site").agg(F.count("value").alias("n")))
    sinks.write_folders(rows, ["site"], str(tmp_path / "t"))
    for _ in range(50):
        if not _shuffled(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffled(spark) - before and spark.conf.get(sinks.CLEANUP, None) == setting
    assert out.agg(F.sum("n")).first()[0] == 1000 and len(list((tmp_path / "t").rglob("part-*"))) == 9
