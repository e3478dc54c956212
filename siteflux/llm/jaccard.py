"""Join documents by the Jaccard similarity of their word n-grams, exactly, and group the linked ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import BATCH_ROWS, ROW_GROUP, components, configured, drop, keep, temporary_tables, wrapped

WORDS, PERCENT = 4, 85
#: Slots of the table of hashed n-gram counts that fixes which n-grams count as rare. Its size does not grow with the
#: data; slots shared by several n-grams cost time, never links.
SLOTS = 1 << 18
#: Bits of a document's signature.
SIGNATURE_BITS = 2048
#: Longs of the coarse signature that rows of tiles carry.
COARSE = 8
#: Bytes of words that are hashed at once, of sets that one batch of rows holds, and of a stored group of rows.
CHUNK_BYTES, BATCH_BYTES, GROUP_BYTES = 1 << 17, 1 << 21, 1 << 23
#: Rows that a Python worker is handed at once: each carries a whole text or set.
ROWS_AT_ONCE = 512
#: Documents of one block of a tile.
BLOCK = 256
#: Documents of a key that all its others are compared with, one after the other, before the tiles.
PIVOTS = 3
#: Ids of documents to read again that may be broadcast (8 bytes each); beyond that they are joined.
WANTED_ROWS = 1_000_000

_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_STEP = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in _MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Per word the sum of its mixed (place, byte) pairs, mixed again with its length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(words), np.uint8)
    places = (np.arange(len(data)) - np.repeat(starts, lengths)).astype(np.uint64)
    marks = _mixed((places << np.uint64(8)) | data)
    return _mixed(np.add.reduceat(marks, starts) + lengths.astype(np.uint64) * np.uint64(_STEP))


class Shingler:
    """Sets of n-gram hashes of texts.

    Words are maximal runs without white space (space, tab to carriage return), A-Z lower-cased. Every byte is mixed with
    its place in the word before it is summed up, every word's hash with its place in the n-gram: no pattern of letters
    or words makes two n-grams equal, as it can in a polynomial modulo a power of two. Equal n-grams have equal hashes;
    different ones share a 64-bit hash only by chance.
    """

    def __init__(self, words: int):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        """Distinct hashes in rising order; empty for a text without words."""
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1
        cuts = [0, *cuts.tolist(), len(parts)]
        hashes = np.concatenate([_word_hashes(parts[i:j]) for i, j in zip(cuts, cuts[1:])])
        n = min(self.words, len(parts))
        count = len(parts) - n + 1
        # the number of words keeps short texts apart from n-grams of long ones
        grams = np.full(count, n, np.uint64)
        for place in range(n):
            grams += _mixed(hashes[place : place + count] + np.uint64((place + 1) * _STEP % 2**64))
        return np.unique(_mixed(grams))


def _name(hashes: np.ndarray) -> bytes:
    """The name of a set: documents with equal sets are one node of the join."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _prefix_length(n: int, percent: int) -> int:
    """Two sets that link share one of their first so many n-grams in any common order."""
    return n - (n * percent + 99) // 100 + 1


def _text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """One row per document: ``doc_id, text_hash, node`` (null where the set is empty), ``n``, the set's size, and
    ``hashes``, the set itself in rising order."""

    def rows(docs: list[tuple]) -> pa.RecordBatch:
        ids, text_hashes, sets = zip(*docs)
        node = pa.array([_name(h) if len(h) else None for h in sets], pa.binary())
        columns = [pa.array(ids, pa.int64()), pa.array(text_hashes, pa.int64()), node, pa.array([len(h) for h in sets], pa.int64())]
        return pa.record_batch([*columns, pa.array([h.tobytes() for h in sets], pa.binary())], ["doc_id", "text_hash", "node", "n", "hashes"])

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(words)
        for batch in batches:
            held, size = [], 0
            for doc_id, text, text_hash in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((doc_id, text_hash, shingle(text)))
                size += held[-1][2].nbytes
                if size > BATCH_BYTES:
                    yield rows(held)
                    held, size = [], 0
            if held:
                yield rows(held)

    own = docs.select("doc_id", "text", _text_hash().alias("text_hash"))
    return own.mapInArrow(name, "doc_id long, text_hash long, node binary, n long, hashes binary")


def _set(cell: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64)


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many of all documents' n-grams fall into each slot. ``SLOTS`` numbers reach the driver at any input size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            hashes = np.concatenate([np.zeros(0, np.uint64), *map(_set, batch.column(0))])
            total += np.bincount((hashes % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(total)
        for at in range(0, len(slots), 1 << 14):
            part = slots[at : at + (1 << 14)]
            yield pa.record_batch([pa.array(part), pa.array(total[part])], ["slot", "n"])

    sums = sets.where("node IS NOT NULL").select("hashes").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    got = sums.toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def _features(sets: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """``doc_id, node``, ``keys``: the rarest n-grams of each set, as many as its prefix has, and ``signature``: a bitmap
    of all its hashes."""
    # SLOTS numbers, whatever the input
    order = sets.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for batch in batches:
            keys, bitmaps = [np.zeros(0, np.int64)], np.zeros((batch.num_rows, SIGNATURE_BITS), np.uint8)
            for i, h in enumerate(map(_set, batch.column(2))):
                rare = np.lexsort((h, counts[(h % np.uint64(SLOTS)).astype(np.int64)]))[: _prefix_length(len(h), percent)]
                keys.append(h[rare].view(np.int64))
                bitmaps[i, (h >> np.uint64(40)).astype(np.int64) % SIGNATURE_BITS] = 1
            words_of_bits = np.packbits(bitmaps, axis=1).view(np.int64)
            lists = [_lists(list(map(len, keys[1:])), np.concatenate(keys))]
            lists.append(_lists([SIGNATURE_BITS // 64] * batch.num_rows, words_of_bits.ravel()))
            yield pa.record_batch([batch.column(0), batch.column(1), *lists], ["doc_id", "node", "keys", "signature"])

    own = sets.where("node IS NOT NULL").select("doc_id", "node", "hashes")
    return own.mapInArrow(pick, "doc_id long, node binary, keys array<long>, signature array<long>")


def _lists(lengths: list[int], flat: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat))


def _only(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose ``on`` is among the stored ids, null included: these are broadcast up to ``WANTED_ROWS`` of them."""
    ids = ids.select(F.col(on).alias("_wanted"))
    ids = F.broadcast(ids) if ids.count() <= WANTED_ROWS else ids
    return rows.join(ids, rows[on].eqNullSafe(F.col("_wanted")), "left_semi")


def _hashes(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, hashes`` of the sets in ``wanted`` (``node, doc_id, rows``: the one document that speaks for each)."""
    wanted = keep(wanted, "jaccard_wanted")
    own = _only(sets, keep(wanted.select("doc_id").distinct(), "jaccard_ids"), "doc_id").where("node IS NOT NULL")
    own = _only(own.select("node", "hashes"), wanted, "node")  # other texts under a wanted id go
    return own if wanted.where("rows > 1").isEmpty() else own.dropDuplicates(["node"])


def _links_at(overlap, n, m, percent: int):
    return 100 * overlap >= percent * (n + m - overlap)


def _bits_alone(x: str, y: str):
    """Bits of signature ``x`` that ``y`` lacks: each is at least one n-gram of its own."""
    alone = F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
    return F.aggregate(alone, F.lit(0), lambda acc, n: acc + n)


def _may_link(x: str, y: str, percent: int):
    """Whether the bit counts of both signatures leave room for a link."""
    most = F.least(F.col(f"n_{x}") - _bits_alone(f"signature_{x}", f"signature_{y}"), F.col(f"n_{y}") - _bits_alone(f"signature_{y}", f"signature_{x}"))
    return _links_at(most, F.col(f"n_{x}"), F.col(f"n_{y}"), percent)


def _similar(x: str, y: str, percent: int):
    return 100 * F.least(f"n_{x}", f"n_{y}") >= percent * F.greatest(f"n_{x}", f"n_{y}")


def _named(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs of short names ``x, y`` as distinct pairs of nodes ``a, b`` whose sizes and bit counts allow a link.

    Two nodes with one short name are both meant.
    """
    pairs = pairs.where("x <> y").distinct()
    for short, end in (("x", "a"), ("y", "b")):
        own = nodes.select(F.col("short").alias(short), F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("signature").alias(f"signature_{end}"))
        pairs = pairs.join(own, short)
        pairs = pairs.where(_similar("a", "b", percent)) if end == "b" else pairs
    return pairs.where(_may_link("a", "b", percent)).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The stored pairs ``a, b`` that link, by intersecting their sorted sets."""
    with temporary_tables(pairs.sparkSession):
        return _intersected(pairs, sets, nodes, percent)


def _intersected(pairs: DataFrame, sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(map(_set, batch.column(2)), map(_set, batch.column(3))):
                overlap = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                good.append(_links_at(overlap, len(x), len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    ends = {end: keep(pairs.select(F.col(end).alias("node")).distinct(), f"jaccard_{end}") for end in ("a", "b")}
    both = ends["a"].union(ends["b"]).distinct()
    hashes = _hashes(sets, both.join(nodes, "node").select("node", "doc_id", "rows"))
    for end in ("b", "a"):
        own = _only(hashes, ends[end], "node")
        pairs = pairs.join(own.withColumnsRenamed({"node": end, "hashes": f"hashes_{end}"}), end)
    pairs = pairs.select("a", "b", "hashes_a", "hashes_b")
    return keep(pairs.mapInArrow(exact, "a binary, b binary"), "jaccard_links", leaves=True)


def _tile_pairs(rest: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of different groups that share a key and whose sizes and bit counts allow a link, each once.

    ``rest`` has ``key, short, component``. A tile is a key and a band of sizes; a document meets its own band and the
    next. Large tiles are cut in blocks, each of which is visited by the tile's documents. Rows of tiles carry sizes and
    coarse signatures only: a bit of it stands for several of the whole one, so its counts bound the overlap as well. Of
    the pairs that these leave, each once, the whole signatures are asked.
    """
    parts = SIGNATURE_BITS // 64 // COARSE
    folded = [reduce(Column.bitwiseOR, [F.get("signature", F.lit(i + COARSE * j)) for j in range(parts)]) for i in range(COARSE)]
    coarse = [f"bits{i}" for i in range(COARSE)]
    tiles = rest.join(nodes.select("short", "node", "n", *[c.alias(name) for c, name in zip(folded, coarse)]), "short")
    # bands a little wider than the ratio, so that rounding never puts two allowed sizes further apart than neighbours
    band = lambda n: F.floor(F.log(n) / float(np.log(100 / percent) * (1 + 1e-9)))
    tiles = keep(tiles.drop("short").withColumn("band", band("n")), "jaccard_tiles")
    sizes = keep(tiles.groupBy("key", "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "jaccard_blocks")
    fields = ["node", "n", "component", *coarse]
    stay = tiles.join(sizes, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    stay = stay.select("key", "band", "block", *[F.col(c).alias(f"{c}_x") for c in fields])
    visit = tiles.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1))).join(sizes, ["key", "band"])
    visit = visit.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    visit = visit.select("key", "band", "block", *[F.col(c).alias(f"{c}_y") for c in fields])
    # of two documents in one band each visits the other: one of the visits counts
    once = (band("n_x") != band("n_y")) | (F.col("node_x") < F.col("node_y"))
    wanted = (F.col("component_x") != F.col("component_y")) & _similar("x", "y", percent) & once

    def alone(x: str, y: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(F.col(f"{c}_{y}")))) for c in coarse])

    most = F.least(F.col("n_x") - alone("x", "y"), F.col("n_y") - alone("y", "x"))
    pairs = stay.join(visit, ["key", "band", "block"]).where(wanted & _links_at(most, F.col("n_x"), F.col("n_y"), percent))
    pairs = pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(*[F.col(c).alias(f"{c}_{end}") for c in ("n", "signature")], F.col("node").alias(end)), end)
    pairs = keep(pairs.where(_may_link("a", "b", percent)).select("a", "b"), "jaccard_tile_pairs")
    drop(tiles, sizes)
    return pairs


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.union(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.join(both, ["a", "b"], "left_anti")


def _unsettled(rest: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """``key, short, component`` of the keys whose documents are not all in one group."""
    known = nodes.join(groups, "node", "left").select("short", F.coalesce("component", "node").alias("component"))
    found = rest.select("key", "short").join(known, "short")
    several = found.groupBy("key").agg(F.min("component").alias("_low"), F.max("component").alias("_high")).where("_low <> _high")
    return found.join(several.select("key"), "key")


def near_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Link documents whose n-gram sets have 100 * |intersection| >= ``percent`` * |union|, and group them.

    Returns one row per input row: ``doc_id, text_hash, n_shingles, node, component, component_id``. ``node`` names
    the set, ``component`` the group of sets, ``component_id`` is the smallest doc_id of the group.

    Every text is read whole. Documents with one set are one node, so exact copies are never compared. Of each set its
    rarest n-grams, in one order for all, are keys: sets that link share a key. Each key's documents are first compared
    with one of them only, then what is unsettled with another, which connects groups of near copies in linear work;
    then what is still in different groups under one key is compared in tiles of key and size band, whose blocks bound
    a task. Sizes and bit counts of signatures bound the overlap from above; pairs that pass are intersected. No pair
    inside a group that is already connected is looked at again, so the groups, not all links, are the result.

    A null or empty text, or one without words, has an empty set: it links with nothing and is its own group. A text of
    fewer words than ``words`` is one n-gram. Null doc_ids are nodes like others and do not count for the smallest id;
    such a row alone has a null component_id. Rows that repeat an id with other texts are nodes of their own. Other
    columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    with temporary_tables(spark), configured(spark, BATCH_ROWS, str(ROWS_AT_ONCE)), configured(spark, ROW_GROUP, str(GROUP_BYTES)):
        return keep(_grouped(keep(_sets(docs, words), "jaccard_sets"), percent), "jaccard_documents", leaves=True)


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    nodes = sets.where("node IS NOT NULL").groupBy("node", "doc_id").agg(F.min("n").alias("n"), F.count("*").alias("rows"))
    first_id = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    speaks = nodes.withColumnsRenamed({"node": "_node", "doc_id": "_doc"})
    speaks = first_id.join(speaks, (F.col("node") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    speaks = keep(speaks.select("node", "doc_id", "n", "rows", F.xxhash64("node").alias("short")), "jaccard_speakers")
    # one document speaks for all copies of its set
    features = _features(sets, percent, _slot_counts(sets))
    features = features.withColumnsRenamed({"doc_id": "_doc", "node": "_node"})
    own = (F.col("_node") == F.col("node")) & F.col("_doc").eqNullSafe(F.col("doc_id"))
    nodes = features.join(speaks, own).select("node", "doc_id", "n", "rows", "short", "keys", "signature")
    repeated = not speaks.where("rows > 1").isEmpty()
    nodes = keep(nodes.dropDuplicates(["node"]) if repeated else nodes, "jaccard_nodes")
    drop(speaks)
    keys = nodes.select("short", F.explode("keys").alias("key"))
    ends = keys.groupBy("key").agg(F.min("short").alias("x"), F.max("short").alias("y"), F.count("*").alias("docs"))
    ends = keep(ends.where("x <> y"), "jaccard_keys")
    shared = keys.join(ends.where("docs > 2").select("key", F.col("x").alias("pivot")), "key")
    shared = keep(shared, "jaccard_shared")
    # every document of a key with one of them, which connects most of a group of near copies
    pairs = ends.where("docs = 2").select("x", "y").union(shared.select(F.col("pivot").alias("x"), F.col("short").alias("y")))
    pairs = keep(_named(pairs, nodes, percent), "jaccard_pairs")
    drop(ends)
    tried, links = pairs, _verified(pairs, sets, nodes, percent)
    rest = shared
    for turn in range(PIVOTS):
        groups = components(links, "jaccard_groups")
        before, rest = rest, keep(_unsettled(rest, nodes, groups), "jaccard_rest")
        drop(before)
        if rest.isEmpty() or turn == PIVOTS - 1:
            break
        # what a key still holds in different groups, with another one of its documents
        pivots = rest.groupBy("key").agg(F.min(F.struct(F.xxhash64("short", F.lit(turn)), "short", "component")).alias("p"))
        pairs = rest.join(pivots, "key").where(F.col("component") != F.col("p.component"))
        pairs = _named(pairs.select(F.col("p.short").alias("x"), F.col("short").alias("y")), nodes, percent)
        pairs = keep(_untried(pairs, tried), "jaccard_pairs")
        tried, links = tried.union(pairs), links.union(_verified(pairs, sets, nodes, percent))
    pairs = links.limit(0) if rest.isEmpty() else keep(_untried(_tile_pairs(rest, nodes, percent), tried), "jaccard_pairs")
    if not pairs.isEmpty():
        groups = components(links.union(_verified(pairs, sets, nodes, percent)), "jaccard_groups")
    nodes = nodes.drop("keys", "signature")
    named = keep(nodes.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "jaccard_named")
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.select("node", "component").join(smallest, "component")
    out = sets.drop("hashes").join(named, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node", "component", own)


def one_per_group(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of :func:`near_groups`: the one of the smallest doc_id, null last.

    Of a group's documents that share the smallest id, the one whose set has the smallest name stays. Rows that repeat
    both id and text are one document, of which one row stays. Documents with an empty set stay.
    """
    with temporary_tables(docs.sparkSession):
        marked = keep(_marked(docs, words, percent), "jaccard_marked", leaves=True)
    own = wrapped(docs)
    same = own["doc_id"].eqNullSafe(marked["_doc"]) & (_text_hash() == marked["_hash"])
    if marked.where("NOT gone").isEmpty():
        return own.join(marked, same, "left_anti").select("given.*")
    out = own.join(marked, same, "left").where("gone IS NULL OR NOT gone")
    once = out.where("repeated").dropDuplicates(["_doc", "_hash"])
    return out.where("repeated IS NULL").unionByName(once).select("given.*")


def _marked(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``_doc, _hash`` of the documents that go (``gone``) or have several equal rows (``repeated``)."""
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "node", "text_hash")
    found = near_groups(docs, words, percent).select("component", place.alias("place"))
    found = keep(found.groupBy("component", "place").agg(F.count("*").alias("rows")), "jaccard_places")
    best = found.where("component IS NOT NULL").groupBy("component").agg(F.min("place").alias("best"))
    marked = found.join(best, "component", "left").withColumn("gone", F.coalesce(F.col("place") != F.col("best"), F.lit(False)))
    return marked.where("gone OR rows > 1").select(
        F.col("place.doc_id").alias("_doc"), F.col("place.text_hash").alias("_hash"), "gone", (F.col("rows") > 1).alias("repeated")
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
