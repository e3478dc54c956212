"""Bounded running balance per site.

Each row maps the store ``s`` to ``clip(a * s + b, lo, hi)``. Such maps compose into maps of the same form. The rows are
dealt by ranges of (site, order); one pass over each sorted range gives every row the composed map from the start of
its site in that range. One small row per (site, range) is chained over the ranges, which gives the store each range
starts from, and a row's store is its map of that. A long site is worked on in as many ranges as its rows need.

A running composition is not a window aggregate, so the pass is an Arrow function. It composes all rows of a batch at once,
in a number of steps that grows with the logarithm of the batch, and carries one map from batch to batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteflux import DATE, SITE
from siteflux.operators.groups import join_keys
from siteflux.operators.scan import ordered_ranges
from siteflux.sources.sinks import stored

# Fixed values.
CAPACITY = 220.0  # mm
SPINUP_ROWS = 365
DRAINAGE = 0.01
RUNOFF_SHARE = 6e-5

KINDS = ("bucket", "keenan")
MAP = ("_m_a", "_m_b", "_m_lo", "_m_hi")


def _running_maps(cap: float, kind: str, keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The Arrow function of the pass. It uses nothing of this package, so that workers need not import it."""
    slope = 1.0 if kind == "bucket" else 1.0 - DRAINAGE
    kept = 1.0 if kind == "bucket" else 1.0 - RUNOFF_SHARE
    bucket = kind == "bucket"

    def after(first, then):
        """The maps ``then`` of the maps ``first``."""
        (a1, b1, lo1, hi1), (a2, b2, lo2, hi2) = first, then
        return a2 * a1, a2 * b1 + b2, np.clip(a2 * lo1 + b2, lo2, hi2), np.clip(a2 * hi1 + b2, lo2, hi2)

    def starts_group(batch, last):
        """Which rows do not continue the group of the row before them; unknown keys are a group."""
        new = np.zeros(batch.num_rows, bool)
        for key in keys:
            column = batch.column(batch.schema.get_field_index(key))
            here, before = column.slice(1), column.slice(0, batch.num_rows - 1)
            unknown = np.asarray(column.is_null())
            differ = pc.fill_null(pc.not_equal(here, before), False).to_numpy(zero_copy_only=False)
            new[1:] |= differ | (unknown[1:] != unknown[:-1])
        new[0] = last is None or last != first_key(batch, 0)
        return new

    def first_key(batch, row):
        return [batch.column(batch.schema.get_field_index(key))[row].as_py() for key in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, gap_carried, rows_carried = None, None, False, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            inflow, outflow = [batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (-2, -1)]
            shift = inflow * kept - outflow
            top = np.clip(cap - outflow, 0.0, cap) if bucket else np.full(n, cap)
            known = ~np.isnan(shift)
            maps = tuple(np.where(known, v, same) for v, same in ((slope, 1.0), (shift, 0.0), (0.0, 0.0), (top, cap)))
            new, place = starts_group(batch, last), np.arange(n)
            start = np.maximum.accumulate(np.where(new, place, 0))
            step, longest = 1, int((place - start).max()) + 1
            while step < longest:  # after it, a row's map spans the 2 * step rows up to it
                to = np.flatnonzero(place - step >= start)
                joined = after(tuple(m[to - step] for m in maps), tuple(m[to] for m in maps))
                for m, value in zip(maps, joined):
                    m[to] = value
                step *= 2
            gap = np.maximum.accumulate(np.where(known, -1, place)) >= start
            row = place - start + 1
            if not new[0]:
                open_rows = start == 0
                for m, value in zip(maps, after(carried, tuple(m[open_rows] for m in maps))):
                    m[open_rows] = value
                gap[open_rows] |= gap_carried
                row[open_rows] += rows_carried
            last, carried = first_key(batch, n - 1), tuple(m[-1] for m in maps)
            gap_carried, rows_carried = bool(gap[-1]), int(row[-1])
            arrays = [*batch.columns[:-2], *[pa.array(m) for m in maps], pa.array(gap), pa.array(row)]
            yield pa.record_batch(arrays, [*batch.schema.names[:-2], "_m_a", "_m_b", "_m_lo", "_m_hi", "_m_gap", "_m_row"])

    return scan


def _map() -> Column:
    return F.struct(*[F.col(c).alias(c) for c in (*MAP, "_m_gap")])


def _apply(m: Column, s: Column) -> Column:
    return F.least(F.greatest(m["_m_a"] * s + m["_m_b"], m["_m_lo"]), m["_m_hi"])


def bounded_running_balance(
    df: DataFrame,
    inflow: str,
    outflow: str,
    name: str = "soilm",
    kind: str = "bucket",
    cap: float = CAPACITY,
    spinup: int = SPINUP_ROWS,
    by: list[str] | None = None,
    order: str = DATE,
    ranges: int | None = None,
) -> DataFrame:
    """Store after each row: in minus out minus runoff, kept between 0 and ``cap``.

    The first ``spinup`` rows of a site are run once from a full store to find its start state. An unknown
    input makes the store unknown from there on, and everywhere if it lies in the spin-up. Rows of an unknown site are
    a site. The rows pass one shuffle, in ``ranges`` ranges or as many as there are shuffle partitions, and are written
    once with their maps.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    by = by or [SITE]
    keys = [*by, "_m_part"]
    dealt = ordered_ranges(df, by, order, "_m_part", ranges)
    dealt = dealt.withColumns({"_m_in": F.col(inflow).cast("double"), "_m_out": F.col(outflow).cast("double")})
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:-2]]
    schema = ", ".join([*fields, *[f"{c} DOUBLE" for c in MAP], "_m_gap BOOLEAN", "_m_row LONG"])
    rows = stored(dealt.mapInArrow(_running_maps(float(cap), kind, by), schema), "balance_rows")

    # one row per site and range: its rows, its whole map, the rows before it and its share of the spin-up
    pieces = rows.groupBy(*keys).agg(F.max("_m_row").alias("_n"), F.max_by(_map(), "_m_row").alias("full"))
    earlier = Window.partitionBy(*by).orderBy("_m_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    pieces = pieces.withColumn("_m_row", F.least(F.col("_n"), F.greatest(F.lit(0), F.lit(spinup) - before)))
    spun = rows.where(F.col("_m_row") <= spinup).select(*keys, "_m_row", _map().alias("spin"))
    parts = join_keys(pieces, spun, [*keys, "_m_row"])
    # the chain of a site is as long as it has ranges
    chain = parts.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_m_part", "spin", "full"))).alias("_chain"),
        F.coalesce(F.max("spin._m_gap"), F.lit(False)).alias("_spin_gap"),
    )
    start = F.aggregate("_chain", F.lit(float(cap)), lambda s, p: F.when(p["spin"].isNull(), s).otherwise(_apply(p["spin"], s)))
    opened = F.aggregate(
        "_chain",
        F.struct(
            F.col("_start").alias("s"),
            F.col("_spin_gap").alias("gap"),
            F.array().cast("array<struct<_m_part:int,_m_from:double,_m_lost:boolean>>").alias("out"),
        ),
        lambda acc, p: F.struct(
            _apply(p["full"], acc["s"]).alias("s"),
            (acc["gap"] | p["full"]["_m_gap"]).alias("gap"),
            F.concat(
                acc["out"],
                F.array(F.struct(p["_m_part"].alias("_m_part"), acc["s"].alias("_m_from"), acc["gap"].alias("_m_lost"))),
            ).alias("out"),
        ),
    )
    starts = chain.withColumn("_start", start).select(*by, F.inline(opened["out"]))
    out = join_keys(rows, starts, keys, "inner")
    lost = F.col("_m_gap") | F.col("_m_lost")
    own = F.struct(*[F.col(c).alias(c) for c in MAP])
    return out.withColumn(name, F.when(~lost, _apply(own, F.col("_m_from")))).select(*df.columns, name)
