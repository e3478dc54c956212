"""Exact order statistics per group, with no group held in one task.

Values are first counted per (group, value), so that a value repeated without end is one row. These rows are dealt by
ranges of (group, value) that Spark draws from a sample of them, so the ranges follow the data however it is
distributed, and stored with the number of their range. One row per (group, range) is enough to tell which range holds
a rank; only those ranges are read again and ranked inside. The sample decides how even the work is, never a result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflux.operators.groups import join_keys
from siteflux.sources.sinks import stored, workspace

#: Output name to a function of the group's number of known values: a 1-based, possibly fractional, position.
Positions = dict[str, Callable[[Column], Column]]


def ranged_counts(df: DataFrame, by: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """``by, _v, _c, _part``: how often each value of ``value`` occurs per group, and the number of its range.

    Unknown values are a row of count 0, so that every group has a row. The number of ranges is that of shuffle
    partitions unless ``partitions`` says otherwise; all rows of one range fit one task. Store the result before it is
    used more than once: another evaluation may draw other ranges.
    """
    values = df.select(*by, F.col(value).cast("double").alias("_v"))
    counts = values.groupBy(*by, "_v").agg(F.count("_v").alias("_c"))
    ranges = [*by, "_v"]
    dealt = counts.repartitionByRange(partitions, *ranges) if partitions else counts.repartitionByRange(*ranges)
    return dealt.withColumn("_part", F.spark_partition_id())


def values_at(
    df: DataFrame, col: str, by: list[str], positions: Positions, empty: bool = False, partitions: int | None = None
) -> DataFrame:
    """One row per group with the value at each position; between two ranks it is interpolated linearly.

    Rows whose group key is unknown are a group. Groups without a known value appear with nulls if ``empty``, else not
    at all. What is stored in between is deleted; the result, one row per group, stays stored.
    """
    with workspace(df.sparkSession) as folder:
        ranges = stored(ranged_counts(df, by, col, partitions), "ranges", folder)
        group = Window.partitionBy(*by)
        # at most one row per range and group: a window over them is bounded by the number of ranges
        pieces = ranges.groupBy(*by, "_part").agg(F.sum("_c").alias("_in"))
        lower = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        pieces = pieces.withColumns(
            {"_n": F.sum("_in").over(group), "_before": F.coalesce(F.sum("_in").over(lower), F.lit(0))}
        )

        def holds(rank: Column, before: Column, upto: Column) -> Column:
            return (rank > before) & (rank <= upto)

        ranks = [rank(position(F.col("_n"))) for position in positions.values() for rank in (F.floor, F.ceil)]
        wanted = [holds(rank, F.col("_before"), F.col("_before") + F.col("_in")) for rank in ranks]
        if empty:
            wanted.append((F.col("_n") == 0) & (F.col("_before") == 0))
        pieces = pieces.where(reduce(or_, wanted)).drop("_in")

        inside = Window.partitionBy(*by, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = join_keys(ranges, pieces, [*by, "_part"], "inner")
        ranked = ranked.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
        below_own = F.col("_upto") - F.col("_c")
        out, hits = [], [F.col("_n") == 0]
        for name, position in positions.items():
            at = position(F.col("_n"))
            low, high = [holds(rank, below_own, F.col("_upto")) for rank in (F.floor(at), F.ceil(at))]
            hits += [low, high]
            below, above = F.max(F.when(low, F.col("_v"))), F.max(F.when(high, F.col("_v")))
            rest = F.max(at - F.floor(at))
            out.append((below * (1.0 - rest) + above * rest).alias(name))
        return stored(ranked.where(reduce(or_, hits)).groupBy(*by).agg(*out), "quantiles")


def values_of(df: DataFrame, cols: list[str], by: list[str], positions: Positions, empty: bool = False) -> DataFrame:
    """``values_at`` of several columns from one table of counts: one row per group and ``series``, the column's name."""
    sides = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("_value")) for c in cols])
    long = df.select(*by, F.explode(sides).alias("_s")).select(*by, "_s.series", "_s._value")
    return values_at(long, "_value", [*by, "series"], positions, empty)


def beside(table: DataFrame, by: list[str], cols: dict[str, str], values: list[str]) -> DataFrame:
    """One row per group from one per group and series: the values of series ``c`` named ``<value><cols[c]>``."""
    picked = [
        F.max(F.when(F.col("series") == c, F.col(v))).alias(f"{v}{suffix}") for c, suffix in cols.items() for v in values
    ]
    return table.groupBy(*by).agg(*picked)


def probabilities(probs: dict[str, float]) -> Positions:
    """Positions 1 + p * (n - 1): quantiles by linear interpolation between closest ranks."""

    def at(p: float) -> Callable[[Column], Column]:
        return lambda n: F.lit(1.0) + (n - 1) * float(p)

    return {name: at(p) for name, p in probs.items()}


def quantiles(df: DataFrame, col: str, by: list[str], probs: dict[str, float], empty: bool = False) -> DataFrame:
    """Quantiles of one column per group, interpolated between closest ranks."""
    return values_at(df, col, by, probabilities(probs), empty)


def hinges(df: DataFrame, col: str, by: list[str], low: str = "hinge_low", high: str = "hinge_high") -> DataFrame:
    """Tukey's hinges: the values at depth floor((n + 3) / 2) / 2 from either end."""

    def depth(n: Column) -> Column:
        return F.floor((n + 3) / 2) / 2

    return values_at(df, col, by, {low: depth, high: lambda n: n + 1 - depth(n)})
