"""Ordered series cut into ranges that follow the data, for scans that carry something from one range to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered_ranges(df: DataFrame, by: list[str], order: str, name: str, partitions: int | None = None) -> DataFrame:
    """The rows dealt by ranges of (group, order), sorted in each range, with the range's number as ``name``.

    Spark draws the ranges from a sample, so they hold about equally many rows however long a group is; a group may
    spread over any number of ranges, whose numbers rise along its order. Rows of one group and place meet in one range.
    Another evaluation may draw other ranges: store what is used more than once.
    """
    keys = [*by, order]
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.withColumn(name, F.spark_partition_id()).sortWithinPartitions(*keys)
