"""Ordered series per site: interpolation, gap filling, fitted values, anomalies, neighbouring months.

Interpolation works in two levels. Rows are dealt by ranges of (group, order) that follow the data and pass an Arrow function
batch by batch, a batch being a block. Groups that may go on in another block are summed up in one small row per block,
these rows are scanned per group, and what a block needs from its neighbours comes back by an equi join. A long series
is thus split by block and no task has to hold a whole group. Where a group fits one task, as a site's calendar does, its
gaps are filled in one pass over sorted rows instead (``bounded``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.functions.calendar import is_leap_year
from siteflux.operators.groups import join_keys, with_stats
from siteflux.operators.scan import ordered_ranges
from siteflux.sources.sinks import stored


def _neighbours(
    df: DataFrame, cols: list[str], by: list[str], order: str, x: Column | None,
    bounded: bool = False, ranges: int | None = None,
) -> DataFrame:
    """Add the known neighbours of each column ``c`` as ``_p_c`` and ``_n_c`` (position, row, value).

    Also adds the own position ``_at``, the row number ``_rn`` and, by group, the number of rows ``_total``. Where ``c``
    is known its neighbours may be left out, unless ``bounded``.
    """
    if bounded:
        up = Window.partitionBy(*by).orderBy(order)
        # a second, descending scan is linear; a frame ending at "unbounded following" is not
        back = Window.partitionBy(*by).orderBy(F.col(order).desc())
        frame = df.withColumn("_rn", F.row_number().over(up))
        frame = frame.withColumn("_at", (F.col("_rn") if x is None else x).cast("double"))
        up = up.rowsBetween(Window.unboundedPreceding, 0)
        back = back.rowsBetween(Window.unboundedPreceding, 0)
        points = {
            c: F.when(F.col(c).isNotNull(), _point(F.col("_at"), F.col("_rn"), F.col(c).cast("double"))) for c in cols
        }
        frame = frame.withColumns({f"_p_{c}": F.last(p, ignorenulls=True).over(up) for c, p in points.items()})
        frame = frame.withColumns({f"_n_{c}": F.last(p, ignorenulls=True).over(back) for c, p in points.items()})
        return frame.withColumn("_total", F.count(F.lit(1)).over(Window.partitionBy(*by)))

    dealt = ordered_ranges(df, by, order, "_block", ranges)
    given = [f"_v{i}" for i in range(len(cols))]
    dealt = dealt.withColumns({g: F.col(c).cast("double") for g, c in zip(given, cols)})
    dealt = dealt.withColumn("_at", (F.lit(None) if x is None else x).cast("double"))
    point = "STRUCT<at: DOUBLE, rn: LONG, v: DOUBLE>"
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    fields += ["_block LONG", "_at DOUBLE", "_rn LONG", "_total LONG", "_end BOOLEAN"]
    fields += [f"`_{side}_{c}` {point}" for c in cols for side in "pn"]
    scan = _neighbour_scan(by, order, cols, numbered=x is None)
    rows = stored(dealt.mapInArrow(scan, ", ".join(fields)), "series_rows")

    # one row per group and block, of the groups that may go on in another block
    keys = [*by, "_block"]
    ends = rows.where("_end").groupBy(*keys).agg(
        F.max("_total").alias("_rows"),
        *[F.max(f"_p_{c}").alias(f"_last_{c}") for c in cols],
        *[F.min(f"_n_{c}").alias(f"_first_{c}") for c in cols],
    )
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_shift", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))

    def moved(point: Column) -> Column:
        at = point["at"] + F.col("_shift") if x is None else point["at"]
        return F.when(point.isNotNull(), _point(at, point["rn"] + F.col("_shift"), point["v"]))

    carry = ends.select(
        *keys,
        "_shift",
        F.sum("_rows").over(whole).alias("_of_all"),
        *[F.last(moved(F.col(f"_last_{c}")), ignorenulls=True).over(earlier).alias(f"_cp_{c}") for c in cols],
        *[F.last(moved(F.col(f"_first_{c}")), ignorenulls=True).over(later).alias(f"_cn_{c}") for c in cols],
    )
    # stored, so that its true size is known: two rows a batch at most, which Spark broadcasts while that is little
    joined = join_keys(rows, stored(carry, "series_carry"), keys)
    joined = joined.withColumn("_shift", F.coalesce("_shift", F.lit(0)))
    joined = joined.withColumns(
        {
            **{f"_p_{c}": F.coalesce(moved(F.col(f"_p_{c}")), F.col(f"_cp_{c}")) for c in cols},
            **{f"_n_{c}": F.coalesce(moved(F.col(f"_n_{c}")), F.col(f"_cn_{c}")) for c in cols},
            "_rn": F.col("_rn") + F.col("_shift"),
            "_total": F.coalesce("_of_all", "_total"),
        }
    )
    return joined if x is not None else joined.withColumn("_at", F.col("_rn").cast("double"))


def _neighbour_scan(
    by: list[str], order: str, cols: list[str], numbered: bool
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function of ``_neighbours``. It uses nothing of this package, so that workers need not import it.

    Rows come sorted by group and order; their range, values and position are last. Every batch is a block of its range
    and nothing is held from one to the next. Only the first and the last group of a batch may go on outside it: their
    first and last rows are marked as ``_end``. Rows of one place are taken as two windows over a group would take
    them: looking back, they keep their order.
    """

    def begins(batch, names):
        """Rows whose ``names`` are not those of the row before them; unknown ones are alike."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in names:
            codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0
        for batch in batches:
            n, own = batch.num_rows, batch.num_columns - len(cols) - 2
            if not n:
                continue
            place = np.arange(n)
            of_group = begins(batch, by)
            of_place = of_group | begins(batch, [order])
            firsts = np.flatnonzero(of_group)
            sizes = np.diff(np.append(firsts, n))
            start, size = np.repeat(firsts, sizes), np.repeat(sizes, sizes)
            end, rn = start + size, place - start + 1
            marked = np.zeros(n, bool)
            marked[[0, sizes[0] - 1, firsts[-1], n - 1]] = True
            back = place[::-1] if of_place.all() else np.argsort(-np.cumsum(of_place), kind="stable")
            at = pa.array(rn.astype(float)) if numbered else batch.column(batch.num_columns - 1)
            block = batch.column(own).cast(pa.int64()).to_numpy() * 2**32 + number
            columns = [*batch.columns[:own], pa.array(block), at, pa.array(rn), pa.array(size), pa.array(marked)]
            names = [*batch.schema.names[:own], "_block", "_at", "_rn", "_total", "_end"]
            for i, c in enumerate(cols):
                value = batch.column(own + 1 + i)
                known = value.is_valid().to_numpy(zero_copy_only=False)
                before = np.maximum.accumulate(np.where(known, place, -1))
                seen = np.maximum.accumulate(np.where(known[back], place, -1))
                after = np.empty(n, np.int64)
                after[back] = np.where(seen < 0, n, back[np.maximum(seen, 0)])
                asked = ~known | marked
                for side, to, there in (("p", before, before >= start), ("n", after, after < end)):
                    there &= asked
                    to = pa.array(to, mask=~there)
                    fields = [at.take(to), pa.array(rn).take(to), value.take(to)]
                    columns.append(pa.StructArray.from_arrays(fields, ["at", "rn", "v"], mask=pa.array(~there)))
                    names.append(f"_{side}_{c}")
            number += 1
            yield pa.record_batch(columns, names)

    return scan


def _point(at: Column, rn: Column, v: Column) -> Column:
    return F.struct(at.alias("at"), rn.alias("rn"), v.alias("v"))


def _interpolated(c: str) -> Column:
    prev, nxt, at = F.col(f"_p_{c}"), F.col(f"_n_{c}"), F.col("_at")
    share = F.try_divide(at - prev["at"], nxt["at"] - prev["at"])
    return F.coalesce(F.col(c).cast("double"), prev["v"] + (nxt["v"] - prev["v"]) * share)


def interpolate_linear(
    df: DataFrame,
    cols: list[str],
    by: list[str],
    order: str = DATE,
    x: Column | None = None,
    block: Column | None = None,
    bounded: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Linear between known values by row number (or by ``x``); the edges stay null.

    The rows are dealt by ranges of (group, order) and stored once, in ``ranges`` ranges or as many as there are shuffle
    partitions. ``block`` is taken for callers that named blocks of their own; blocks follow the data now and results do
    not depend on them. Say ``bounded`` only where a group fits one task, such as the days of one mean year.
    """
    near = _neighbours(df, cols, by, order, x, bounded, ranges)
    return near.withColumns({c: _interpolated(c) for c in cols}).select(*df.columns)


def fill_gaps(
    df: DataFrame,
    cols: list[str],
    zero: list[str] | None = None,
    by: list[str] | None = None,
    order: str = DATE,
    block: Column | None = None,
    bounded: bool = False,
) -> DataFrame:
    """Interpolate, then carry the first and last known value to the edges; ``zero`` columns get 0 instead.

    Say ``bounded`` only where a group fits one task, such as the calendar of a site: the rows are then dealt by group once,
    and each task fills its sorted groups by an Arrow function.
    """
    by = by or [SITE]
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero or []})
    if not cols:
        return out
    if bounded:
        ready = out.withColumns({c: F.col(c).cast("double") for c in cols})
        block = F.year(order) if block is None else block
        dealt = ready.repartition(*by).withColumn("_block", block).sortWithinPartitions(*by, order)
        return dealt.mapInArrow(_gap_filler(by, order, cols), ready.schema)
    near = _neighbours(out, cols, by, order, None)
    filled = {
        c: F.coalesce(_interpolated(c), F.col(f"_n_{c}")["v"], F.col(f"_p_{c}")["v"]) for c in cols
    }
    return near.withColumns(filled).select(*df.columns)


def _gap_filler(by: list[str], order: str, cols: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function of ``fill_gaps``. It uses nothing of this package, so that workers need not import it.

    Rows come sorted by group and order, their block last. Whole groups are filled at once; the last group of a batch waits
    for the next one. Rows of one place are taken as the windows of ``_neighbours`` take them: looking back inside a block
    they keep their order, and of a later block the first known row counts.
    """

    def key(batch, row):
        return [batch.column(batch.schema.get_field_index(k))[row].as_py() for k in by]

    def begins(batch, names, last=None):
        """Rows whose ``names`` are not those of the row before them; unknown ones are alike."""
        new = np.zeros(batch.num_rows, bool)
        new[0] = last is None or last != key(batch, 0)
        for k in names:
            codes = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def ends(new):
        """The end of the run that each row belongs to."""
        return np.repeat(np.append(np.flatnonzero(new)[1:], len(new)), np.diff(np.append(np.flatnonzero(new), len(new))))

    def filled(batches):
        batch = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        n, place = batch.num_rows, np.arange(batch.num_rows)
        of_group = begins(batch, by)
        of_block = of_group | begins(batch, ["_block"])
        of_place = of_block | begins(batch, [order])
        start, end, block = np.maximum.accumulate(np.where(of_group, place, 0)), ends(of_group), ends(of_block)
        back = place[::-1] if of_place.all() else np.argsort(-np.cumsum(of_place), kind="stable")
        arrays = list(batch.columns[:-1])
        for c in cols:
            i = batch.schema.get_field_index(c)
            known = arrays[i].is_valid().to_numpy(zero_copy_only=False)
            v = arrays[i].fill_null(0.0).to_numpy(zero_copy_only=False)
            before = np.maximum.accumulate(np.where(known, place, -1))
            from_here = np.append(np.minimum.accumulate(np.where(known, place, n)[::-1])[::-1], n)
            after = from_here[block]
            seen = np.maximum.accumulate(np.where(known[back], place, -1))
            inside = back[np.maximum(seen, 0)]
            own = (seen >= 0) & (block[inside] == block[back])
            after[back[own]] = inside[own]
            has_before, has_after = before >= start, after < end
            low, high = v[np.maximum(before, 0)], v[np.minimum(after, n - 1)]
            apart = has_before & has_after & (after != before)
            with np.errstate(all="ignore"):
                between = low + (high - low) * ((place - before) / np.where(apart, after - before, 1))
            out = np.where(known, v, np.where(apart, between, np.where(has_after, high, low)))
            arrays[i] = pa.array(out, mask=~(has_before | has_after))
        return pa.record_batch(arrays, batch.schema.names[:-1])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.flatnonzero(begins(batch, by, last))
            last = key(batch, batch.num_rows - 1)
            if len(new):  # all before the last group that begins here is whole
                whole = [part for part in (*waiting, batch.slice(0, int(new[-1]))) if part.num_rows]
                if whole:
                    yield filled(whole)
                waiting, batch = [], batch.slice(int(new[-1]))
            waiting.append(batch)
        if waiting:
            yield filled(waiting)

    return fill


def interpolate_at_x(
    df: DataFrame, cols: list[str], x: str = "year_dec", by: list[str] | None = None, block: Column | None = None
) -> DataFrame:
    """Fill the first value from the second and the last from the second-last, the rest linearly in ``x``.

    ``x`` must be unique within the group. ``block`` is taken as in ``interpolate_linear``.
    """
    by = by or [SITE]
    near = _neighbours(df, cols, by, x, F.col(x))
    rn, total = F.col("_rn"), F.col("_total")

    def edge(c: str) -> Column:
        nxt, prev = F.col(f"_n_{c}"), F.col(f"_p_{c}")
        return F.when((rn == 1) & (nxt["rn"] == 2), nxt["v"]).when((rn == total) & (prev["rn"] == total - 1), prev["v"])

    return near.withColumns({c: F.coalesce(_interpolated(c), edge(c)) for c in cols}).select(*df.columns)


def add_fitted(
    df: DataFrame, by: list[str] | None = None, obs: str = "gpp_obs", mod: str = "gpp_mod", name: str = "fitted"
) -> DataFrame:
    """Value of the group's regression of ``obs`` on ``mod``, null where either is unknown."""
    fit = with_stats(
        df, by or [SITE], _slope=F.regr_slope(obs, mod), _intercept=F.regr_intercept(obs, mod)
    )
    line = F.col("_intercept") + F.col("_slope") * F.col(mod)
    return fit.withColumn(name, F.when(F.col(obs).isNotNull(), line)).drop("_slope", "_intercept")


def anomalies(
    df: DataFrame, means: DataFrame, by: list[str], mod: str = "gpp_mod", obs: str = "gpp_obs",
    mod_mean: str = "mod_mean", obs_mean: str = "obs_mean",
) -> DataFrame:
    """Values minus the mean of their group; a group absent from ``means`` gives null."""
    table = means.select(*by, F.col(mod_mean).alias("_mod_mean"), F.col(obs_mean).alias("_obs_mean"))
    joined = join_keys(df, table, list(by))
    return joined.withColumns(
        {mod: F.col(mod) - F.col("_mod_mean"), obs: F.col(obs) - F.col("_obs_mean")}
    ).select(*df.columns)


def neighbour_months(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Previous and next month's value as ``<col>_prev`` and ``<col>_next`` on a (site, year, moy) table.

    A neighbour in a year that the site has must be present. Where the site lacks the year before, January takes
    its own year's December; where it lacks the year after, December takes its own year's January.
    """
    by = by or [SITE]
    # a month occurs once per group, so that a group is bounded by its years: plain windows, one shuffle
    whole = Window.partitionBy(*by)
    line = whole.orderBy("year", "moy")
    year = Window.partitionBy(*by, "year")
    index = F.col("year") * 12 + F.col("moy")
    # years as a window of months: the last row of an earlier year and the first of a later one
    near = whole.orderBy("year")
    year_before = F.max("year").over(near.rangeBetween(Window.unboundedPreceding, -1))
    year_after = -F.max(-F.col("year")).over(whole.orderBy(-F.col("year")).rangeBetween(Window.unboundedPreceding, -1))
    first = (F.col("moy") == 1) & ~F.coalesce(year_before == F.col("year") - 1, F.lit(False))
    last = (F.col("moy") == 12) & ~F.coalesce(year_after == F.col("year") + 1, F.lit(False))

    def month(c: str, moy: int) -> Column:
        return F.max(F.when(F.col("moy") == moy, F.col(c))).over(year)

    sides = {}
    for c in cols:
        before = F.when(F.lag(index).over(line) == index - 1, F.lag(c).over(line))
        after = F.when(F.lead(index).over(line) == index + 1, F.lead(c).over(line))
        sides[f"{c}_prev"] = F.when(first, month(c, 12)).otherwise(before)
        sides[f"{c}_next"] = F.when(last, month(c, 1)).otherwise(after)
    return df.withColumns(sides)


def days_in_month(year: Column, moy: Column) -> Column:
    """Length of a month, true leap years."""
    short = F.when(is_leap_year(year), F.lit(29)).otherwise(F.lit(28))
    return F.when(moy == 2, short).when(moy.isin(4, 6, 9, 11), F.lit(30)).otherwise(F.lit(31))
