"""The missing-value rules every operator states by name.

Two masks look alike and differ only where the condition is unknown:
``null_if`` drops a value whose condition is true *or unknown*; ``null_where`` drops it only where
the condition is true.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def null_if(cond: Column, value: Column) -> Column:
    """Rule N1: an unknown condition masks the value too."""
    return F.when(~cond, value)


def null_where(cond: Column, value: Column) -> Column:
    """Rules N2 and N3: an unknown condition keeps the value."""
    return F.when(cond, F.lit(None)).otherwise(value)


def strict_sum(value: Column) -> Column:
    """Rule N4: one missing value makes the sum missing."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def strict_mean(value: Column) -> Column:
    """Rule N4 for the mean."""
    return F.when(F.count(value) == F.count(F.lit(1)), F.avg(value))


def finite(value: Column) -> Column:
    """NaN and both infinities become null; the library never carries them on."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)


def not_true(flag: Column) -> Column:
    """Rule N7: membership in {false, unknown}."""
    return F.coalesce(~flag, F.lit(True))


def all_known(*values: Column) -> Column:
    cond = F.lit(True)
    for value in values:
        cond = cond & value.isNotNull()
    return cond


def strict_least(a: Column, b: Column) -> Column:
    """Minimum of two, null if either is (``least`` alone would skip the null)."""
    return F.when(all_known(a, b), F.least(a, b))


def strict_greatest(a: Column, b: Column) -> Column:
    return F.when(all_known(a, b), F.greatest(a, b))
