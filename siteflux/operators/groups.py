"""Group statistics attached to rows.

Statistics are aggregated (partial sums before the shuffle) and joined back, rather than computed as a
window: a window would send every row of one key to one task, while the join leaves Spark free to
broadcast the small side or to split an oversized key at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi join on ``keys`` in which an unknown key matches an unknown key, as grouping treats it."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_stats(df: DataFrame, by: list[str], **stats: Column) -> DataFrame:
    """Add per-group aggregates as columns; rows with an unknown key are a group too."""
    table = df.groupBy(*by).agg(*[agg.alias(name) for name, agg in stats.items()])
    return join_keys(df, table, list(by))


def first_per_key(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``, taken with a combinable minimum rather than a sort."""
    rest = [c for c in df.columns if c not in by and c not in order]
    picked = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_row"))
    return picked.select(*by, *[F.col("_row")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


def find_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
