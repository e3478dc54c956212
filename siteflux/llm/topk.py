"""Exact top-k search by inner product: score histograms are refined until each query's kth score is known."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteflux.llm.common import keep

#: Candidates of a block and queries of a group: with the dimension they bound the memory of a task.
BLOCK_ROWS, GROUP_QUERIES = 8192, 2048
#: Bins of one histogram. A range of R scores takes log(R) / log(BINS) rounds.
BINS = 4096
#: Queries that are scored at once against a block.
CHUNK = 256
#: Scores and the distances between two of them are 64-bit: beyond this a pair's score might not fit.
MOST_SCORE = 2**62 - 1


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 1024) -> DataFrame:
    """``row, id, vec``: components as floor(scale * x); null vectors and null or non-finite components take no part.

    ``row`` tells rows with one id apart. The table must be stored before ``row`` is used twice.
    """
    x = F.transform(vector_col, lambda v: v.cast("double"))
    fits = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    vec = F.transform(x, lambda v: F.floor(v * scale))
    square = F.aggregate("vec", F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    out = df.where(F.col(vector_col).isNotNull() & fits)
    out = out.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return out.withColumn("square", square).where("id IS NOT NULL")


def _matrix(vecs: pa.ChunkedArray, width: int, dtype) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros."""
    vecs = vecs.combine_chunks() if isinstance(vecs, pa.ChunkedArray) else vecs
    lengths = np.diff(vecs.offsets.to_numpy())
    flat = vecs.flatten().to_numpy()
    out = np.zeros((len(vecs), width), dtype)
    out[np.repeat(np.arange(len(vecs)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(block: pa.Table, queries: pa.Table, exact_in_double: bool) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Chunks of queries with their scores against a block, and which pairs are a query and its own row."""
    lengths = [int(np.diff(t["vec"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (block, queries)]
    # whole numbers below 2**53 are exact in doubles, whose product is much faster
    dtype = np.float64 if exact_in_double else np.int64
    left, rows = _matrix(block["vec"], max(lengths), dtype), block["row"].to_numpy()
    for at in range(0, queries.num_rows, CHUNK):
        part = queries.slice(at, CHUNK)
        scores = (_matrix(part["vec"], max(lengths), dtype) @ left.T).astype(np.int64)
        yield part, scores, part["row"].to_numpy()[:, None] == rows[None, :]


def _paired(blocks: DataFrame, queries: DataFrame, fn, schema: str) -> DataFrame:
    """Apply ``fn(block, group of queries)`` to every block of candidates and every group of queries."""
    left = blocks.groupBy("block", "group")
    return left.cogroup(queries.groupBy("block", "group")).applyInArrow(fn, schema)


def _histogram(width: int, exact: bool):
    """Counts per query and bin of one block's scores, of the bins that may hold the kth score of all."""

    def count(block: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64),) * 3]
        for part, scores, own in _scores(block, queries, exact):
            low, high, missing = (part[c].to_numpy() for c in ("low", "high", "missing"))
            inside = (scores >= low[:, None]) & (scores < high[:, None]) & ~own
            for i, row in enumerate(part["row"].to_pylist()):
                bins, n = np.unique((scores[i, inside[i]] - low[i]) // width, return_counts=True)
                # a bin below the block's own best ones cannot hold the kth of all
                near = n[::-1].cumsum()[::-1] - n < missing[i]
                found.append((np.full(near.sum(), row), bins[near], n[near]))
        return pa.table(dict(zip(("row", "bin", "n"), map(np.concatenate, zip(*found)))))

    return count


def top_k(
    df: DataFrame,
    is_query,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
) -> DataFrame:
    """The ``k`` highest integer inner products of each query row with all other rows: ``query_id, rank, vec_id, score``.

    ``is_query`` is a condition on the id column. Every query is scored against every other row, in blocks. Round by
    round each block sends, for the bins of the query's current range that can hold its own k best, how many scores
    fall into them; the sums say in which bin the kth score lies, and that bin is the next range, until it is one
    score wide. Then scores above the kth are kept, and of those equal to it as many of the smallest ids as are
    missing; a block sends at most k rows for a query however many tie.

    Vectors of unequal length are compared as if the shorter ended in zeros. Rows that repeat an id are candidates and
    queries of their own: a repeated query id has its ranks once per row. Null ids, null vectors, null or non-finite
    components take no part. A query without candidates has no rows. Other columns of ``df`` are not read. Every finite
    vector takes part; if the two longest ones are so long that a score might not fit 64 bits, an error is raised.
    """
    vectors = keep(quantised(df.select(id_col, vector_col), id_col, vector_col, scale), "topk_vectors")
    seen = vectors.agg(F.count("*").alias("n"), F.count(F.when(is_query(F.col("id")), 1)).alias("q")).first()
    longest = [r["square"] for r in vectors.select("square").orderBy(F.desc("square")).limit(2).collect()]
    n_blocks, n_groups = max(1, -(-seen["n"] // BLOCK_ROWS)), max(1, -(-seen["q"] // GROUP_QUERIES))
    # no score of two rows is beyond the product of the two greatest lengths
    bound = int(math.prod(map(math.sqrt, longest)) * (1 + 1e-9)) + 1 if len(longest) == 2 else 1
    if bound > MOST_SCORE:
        raise ValueError(f"scores of the two longest vectors may reach {bound}, which may not fit 64 bits: use a smaller scale")
    exact = bound < 2**52 and max(longest, default=0) < 2**52
    blocks = vectors.select(F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block"), "row", "id", "vec")
    blocks = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    asked = vectors.where(is_query(F.col("id"))).select("row", "id", "vec")
    asked = asked.withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_groups)).cast("int"))
    asked = keep(asked, "topk_queries")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long")))

    # the range of scores that holds the kth, its bins' width, and how many are missing below its upper end
    state = asked.select("row", F.lit(-bound).alias("low"), F.lit(bound + 1).cast("long").alias("high"), F.lit(k).cast("long").alias("missing"))
    state = keep(state.withColumn("low", F.col("low").cast("long")), "topk_state")
    span = 2 * bound + 1
    while span > 1:
        width = -(-span // BINS)

        ready = asked.join(state, "row").withColumn("block", every_block)
        bins = _paired(blocks, ready, _histogram(width, exact), "row long, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("row").orderBy(F.desc("bin"))) - F.col("n")
        bins = bins.withColumn("above", above).join(state, "row")
        # the last bin that starts with scores missing: it holds the kth, or the lowest score if there are fewer than k
        at = bins.where("above < missing").groupBy("row").agg(
            F.min(F.struct("bin", "low", "high", (F.col("missing") - F.col("above")).alias("missing"))).alias("s")
        )
        low = F.col("s.low") + F.col("s.bin") * width
        state = at.select("row", low.alias("low"), F.least(low + width, F.col("s.high")).alias("high"), F.col("s.missing").alias("missing"))
        state = keep(state, "topk_state")
        span = width

    def best(block: pa.Table, queries: pa.Table) -> pa.Table:
        ids, out = block["id"].to_numpy(), []
        for part, scores, own in _scores(block, queries, exact):
            scores = np.where(own, np.iinfo(np.int64).min, scores)
            for i in range(part.num_rows):
                kth, missing = part["low"][i].as_py(), part["missing"][i].as_py()
                over, tied = np.flatnonzero(scores[i] > kth), np.flatnonzero(scores[i] == kth)
                tied = tied[np.argsort(ids[tied], kind="stable")[:missing]]
                got = np.concatenate([over, tied])
                out.append((np.full(len(got), part["row"][i].as_py()), np.full(len(got), part["id"][i].as_py()), ids[got], scores[i, got]))
        cols = [np.concatenate(c).astype(np.int64) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 4
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), cols)))

    ready = asked.join(state, "row").withColumn("block", every_block)
    found = _paired(blocks, ready, best, "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, lambda vec_id: vec_id % 100 == 0, k=10)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
