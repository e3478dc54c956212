"""Row-wise means, caps, labels and text pieces."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteflux.functions.nulls import not_true, strict_least


def _total(columns) -> Column:
    return reduce(add, columns)


def row_mean(*cols: Column, strict: bool = False) -> Column:
    """Mean across columns: of the known ones (null if none), or with ``strict`` null if any is unknown."""
    if strict:
        return _total(cols) / len(cols)
    known = _total([c.isNotNull().cast("int") for c in cols])
    return F.try_divide(_total([F.coalesce(c, F.lit(0.0)) for c in cols]), known)


def row_weighted_mean(cols: list[Column], weights: list[float]) -> Column:
    """Weighted mean over the known columns, null if none."""
    pairs = list(zip(cols, weights, strict=True))
    total = _total([F.coalesce(c * float(w), F.lit(0.0)) for c, w in pairs])
    weight = _total([F.when(c.isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in pairs])
    return F.try_divide(total, weight)


def cap(col: Column, upper: float) -> Column:
    return strict_least(col, F.lit(float(upper)))


def sunshine_fraction(ccov: Column) -> Column:
    """Fraction of sunshine from cloud cover in percent."""
    return (100.0 - ccov) / 100.0


def hemisphere(lat: Column) -> Column:
    return F.when(lat > 0, F.lit("north")).when(lat <= 0, F.lit("south"))


def zone_label(code: Column, lat: Column) -> Column:
    return F.concat_ws(" ", code, hemisphere(lat))


def class_code(text: Column) -> Column:
    """``"Cfb - some words"`` gives ``"Cfb"``."""
    return F.try_element_at(F.split(text, " - "), F.lit(1))


def class_word(text: Column) -> Column:
    return F.try_element_at(F.split(text, " - "), F.lit(2))


def year_clean(text: Column) -> Column:
    """Year from a date-like string: its first four characters."""
    return F.substring(text.cast("string"), 1, 4).try_cast("int")


def is_c4(kind: Column) -> Column:
    """Photosynthesis type as a flag; an unknown type stays unknown."""
    return kind.isin("C4", "C3C4")


def keep_not_c4(flag: Column) -> Column:
    return not_true(flag)


def period_label(year_start: Column, year_end: Column) -> Column:
    return F.concat_ws("-", year_start.cast("string"), year_end.cast("string"))
