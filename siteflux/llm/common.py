"""Shared pieces: stored intermediates, words, checked joins with small tables, connected groups."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.sources.sinks import configured, remove, scratch_dir, stored

#: White space that separates words: the space and the controls tab to carriage return.
SPACE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROW_GROUP = "parquet.block.size"
#: Rows of a small table that may be broadcast; beyond this a join is dealt by salted keys.
BROADCAST_ROWS = 100_000

#: Folders of the tables stored inside the open blocks of ``temporary_tables``, the innermost block last.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that ``keep`` stores inside are deleted at the end, also after an error.

    What a later step reads must be stored with ``leaves=True``: it belongs to the block around this one, if there is one.
    """
    folders: list[str] = []
    token = _OPEN.set((*_OPEN.get(), folders))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for folder in folders:
            remove(spark, folder)


def keep(df: DataFrame, name: str, leaves: bool = False) -> DataFrame:
    """Store a table in the shared folder and read it back: no later step recomputes it or loses it with an executor."""
    spark = df.sparkSession
    folder = scratch_dir(spark)
    blocks = _OPEN.get()[:-1] if leaves else _OPEN.get()
    if blocks:
        blocks[-1].append(folder)
    out = stored(df, name, folder)
    _FOLDERS[out] = folder
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned, whose last reader has been written."""
    for table in tables:
        remove(table.sparkSession, _FOLDERS.pop(table))


def text_of(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone, whatever the locale or alphabet."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def wrapped(docs: DataFrame) -> DataFrame:
    """``doc_id, text, source`` beside the whole row in ``given``, so that no column of the input can clash."""
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text")]
    own += [F.col("source")] if "source" in docs.columns else []
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), *own)


def unwrapped(out: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The given columns; where ``changed``, with the new text and, if there, ``n_chars`` that follows it."""
    columns = []
    for c in docs.columns:
        old = F.col("given").getField(c)
        if c == "text":
            columns.append(F.when(changed, text).otherwise(old).alias(c))
        elif c == "n_chars":
            columns.append(F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(old).alias(c))
        else:
            columns.append(old.alias(c))
    return out.select(*columns)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_small(big: DataFrame, small: DataFrame, on: str, how: str = "left", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a stored table of at most one row per key, null keys included.

    It is counted first. Up to ``limit`` rows it is broadcast; a larger one is repeated over salts, so that
    the rows of a frequent key are dealt to many tasks.
    """
    small = small.withColumnRenamed(on, "_on")
    same = F.col(on).eqNullSafe(F.col("_on"))
    if small.count() <= limit:
        return big.join(F.broadcast(small), same, how).drop("_on")
    salts = 16
    small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    big = big.withColumn("_deal", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    return big.join(small, same & (F.col("_deal") == F.col("_salt")), how).drop("_on", "_salt", "_deal")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected groups of an undirected graph: ``node`` and ``component``, its smallest reachable node.

    ``edges`` has the columns ``a`` and ``b``. Every round each node hooks to its smallest neighbour and the
    edges are drawn between the hooks; loops and repeats go. The number of rounds grows with the logarithm of
    the number of nodes, all steps are combinable minima and joins, and only an emptiness test reaches the
    driver. Nodes without an edge to another node have no row.
    """
    with temporary_tables(edges.sparkSession):
        return _components(edges, name)


def _components(edges: DataFrame, name: str) -> DataFrame:
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = keep(edges.where("a <> b").select(*pair).distinct(), f"{name}_edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), "b").union(edges.select(F.col("b").alias("node"), "a"))
        hook = ends.groupBy("node").agg(F.min("b").alias("_min"))
        hook = keep(hook.select("node", F.least("node", "_min").alias("to")), f"{name}_hooks")
        hooks.append(hook)
        before = edges
        for end in ("a", "b"):
            edges = edges.join(hook, edges[end] == hook["node"]).drop(end, "node").withColumnRenamed("to", end)
        edges = keep(edges.where("a <> b").select(*pair).distinct(), f"{name}_edges")
        drop(before)
    if not hooks:
        return keep(edges.select(F.col("a").alias("node"), F.col("b").alias("component")), name, leaves=True)

    def follow(found: DataFrame, hook: DataFrame) -> DataFrame:
        hook = hook.select(F.col("node").alias("_from"), F.col("to").alias("_to"))
        out = found.join(hook, found["component"] == hook["_from"], "left")
        return out.select("node", F.coalesce("_to", "component").alias("component"))

    first = hooks[0].withColumnRenamed("to", "component")
    return keep(reduce(follow, hooks[1:], first), name, leaves=True)
