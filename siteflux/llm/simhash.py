"""Near duplicates by SimHash: fingerprints of two bits' distance or less, found through one-wildcard segments."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import components, join_small, keep

WORDS, SEED = 3, 42
#: Bits in which two linked fingerprints differ at most. The keys below hold for two.
DISTANCE = 2
#: Bits of a segment; a fingerprint has two, so one of them differs by at most one bit.
SEGMENT = 32
#: Different fingerprints with one segment value beyond which its keys are drawn finer. It changes costs, no results.
OFTEN = 1_000
#: Members of one key that are compared place by place; more are looked up by the bits that may differ.
DIRECT = 256
#: Shingle hashes whose bits are counted at once.
CHUNK = 1 << 15

MASK = (1 << SEGMENT) - 1


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    import xxhash

    cut = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not cut:
        return 0
    whole = b" ".join(cut)
    ends = np.cumsum([len(w) + 1 for w in cut]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(cut) - words + 1)
    spans = zip(starts[:n].tolist(), ends[min(words, len(cut)) - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(whole[a:b], seed) for a, b in spans], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (a long whose 64 bits are the SimHash) of every whole text."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), words, seed) for text in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(hashed, "doc_id long, fingerprint long")


def as_hex(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _bits(value: Column, at: int, n: int) -> Column:
    return F.shiftrightunsigned(value, at).bitwiseAND(F.lit((1 << n) - 1))


def _without(value: Column, bit: Column) -> Column:
    """The value with one bit left out of account."""
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))


def _packed(kind: int, segment: Column, *fields: tuple[Column, int]) -> Column:
    """One long that names a key: its kind, the segment and fields of so many bits."""
    key, used = F.lit(kind).cast("long") * 2 + segment, 3
    for value, bits in fields:
        key, used = F.shiftleft(key, bits).bitwiseOR(value.cast("long")), used + bits
    assert used <= 64
    return key


def segment_keys(nodes: DataFrame, often: int = OFTEN) -> DataFrame:
    """``key, fingerprint``: two fingerprints that differ by one or two bits share a key.

    The index holds every segment under each of its 32 forms with one bit left out (kind 0). A key covers two segment
    values. Where either of them is a segment of more than ``often`` fingerprints, the key is made finer by the rest of
    the fingerprint, which the same pigeonhole splits again:

    * equal segments leave two bits for the other one: of its halves one differs by at most one bit and is held under
      16 forms with a bit left out (kind 1);
    * segments one bit apart leave one bit for the other one: one of its halves is equal (kind 2);
    * fingerprints of a value that is not frequent itself keep one key for that value (kind 3).

    Both fingerprints of a pair see the same two counts, so they take the same keys. A key of kind 0 or 3 has at most
    twice ``often`` members, and one of kind 1 or 2 fixes 47 bits or more, however many near copies there are.
    """
    both = F.array(*[F.struct(F.lit(s).alias("s"), _bits(F.col("fingerprint"), SEGMENT * s, SEGMENT).alias("v")) for s in (0, 1)])
    cut = nodes.select("fingerprint", F.explode(both).alias("_c")).select("fingerprint", "_c.s", "_c.v")
    frequent = cut.groupBy("s", "v").agg(F.count("*").alias("_n")).where(F.col("_n") > often)
    flip = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    # a frequent value makes its own keys finer (-1) and, for each bit, the key it shares with its neighbour
    near = frequent.select("s", "v", F.explode(F.sequence(F.lit(-1), F.lit(SEGMENT - 1))).alias("bit"))
    near = near.select("s", F.when(F.col("bit") < 0, F.col("v")).otherwise(F.col("v").bitwiseXOR(flip)).alias("v"), "bit")
    near = keep(near.groupBy("s", "v").agg(F.collect_set("bit").alias("_finer")), "simhash_frequent")
    near = near.withColumnsRenamed({"s": "_s", "v": "_v"})
    cut = cut.join(near, (F.col("s") == F.col("_s")) & (F.col("v") == F.col("_v")), "left")

    s, v, finer = F.col("s"), F.col("v"), F.coalesce("_finer", F.array().cast("array<int>"))
    other = _bits(F.when(s == 0, F.shiftrightunsigned("fingerprint", SEGMENT)).otherwise(F.col("fingerprint")), 0, SEGMENT)
    own, half = F.array_contains(finer, -1), SEGMENT // 2
    halves = [(h, _bits(other, half * h, half)) for h in (0, 1)]
    every = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
    coarse = F.transform(
        F.when(own, F.array().cast("array<int>")).otherwise(F.array_except(every, finer)),
        lambda bit: _packed(0, s, (bit, 5), (_without(v, bit), SEGMENT)),
    )

    def one_apart(bit: Column) -> Column:
        return F.array(*[_packed(2, s, (bit, 5), (_without(v, bit), SEGMENT), (F.lit(h), 1), (x, half)) for h, x in halves])

    def equal(bit: Column) -> Column:
        return F.array(*[_packed(1, s, (v, SEGMENT), (F.lit(h), 1), (bit, 4), (_without(x, bit), half)) for h, x in halves])

    fine = F.flatten(F.transform(F.when(own, every).otherwise(finer), one_apart))
    within = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(half - 1)), equal))
    within = F.when(own, within).otherwise(F.array(_packed(3, s, (v, SEGMENT))))
    keys = F.when(F.col("_finer").isNull(), coarse).otherwise(F.concat(coarse, fine, within))
    return cut.select("fingerprint", F.explode(keys).alias("key")).select("key", "fingerprint")


def _looked_up(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of different, sorted fingerprints that differ by one or two bits: looked up by flipping bits."""
    free = [i for i in range(64) if np.any((members ^ members[0]) >> np.uint64(i) & np.uint64(1))]
    one = [np.uint64(1) << np.uint64(i) for i in free]
    lefts, rights = [], []
    for i, a in enumerate(one):
        for flip in [a, *[a | b for b in one[:i]]]:
            other = members ^ flip
            at = np.searchsorted(members, other)
            hit = (at < len(members)) & (members[np.minimum(at, len(members) - 1)] == other) & (other > members)
            lefts.append(np.flatnonzero(hit))
            rights.append(at[hit])
    return np.concatenate(lefts), np.concatenate(rights)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the least place it is linked with over any number of links."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[left], least[right])
        new = least.copy()
        for side in (left, right):
            np.minimum.at(new, side, low)
            np.minimum.at(new, least[side], low)
        new = new[new]
        if np.array_equal(new, least):
            return least
        least = new


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to links: each fingerprint of a key with the least one it is linked with inside the key."""
    rest_key, rest = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        lefts, rights = [], []
        # small keys all at once: each member with the one so many places on
        few = np.repeat(np.where(sizes <= DIRECT, sizes, 1), sizes)
        upto = np.repeat(starts + sizes, sizes)
        for step in range(1, int(few.max(initial=1))):
            at = np.flatnonzero(few > step)
            at = at[at + step < upto[at]]
            near = np.bitwise_count(prints[at] ^ prints[at + step]) <= DISTANCE
            lefts.append(at[near])
            rights.append(at[near] + step)
        for start, size in zip(starts[sizes > DIRECT], sizes[sizes > DIRECT]):
            order = start + np.argsort(prints[start : start + size])
            left, right = _looked_up(prints[order])
            lefts.append(order[left])
            rights.append(order[right])
        left, right = [np.concatenate([np.zeros(0, np.int64), *x]) for x in (lefts, rights)]
        place = np.unique(np.concatenate([left, right]))
        least = place[_forest(len(place), np.searchsorted(place, left), np.searchsorted(place, right))]
        moved = least != place
        pairs = np.stack([prints[least[moved]], prints[place[moved]]], axis=1).view(np.int64)
        pairs = np.unique(pairs, axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        keys = np.concatenate([rest_key, batch.column(0).to_numpy()])
        prints = np.concatenate([rest, batch.column(1).to_numpy().view(np.uint64)])
        last = np.searchsorted(keys, keys[-1]) if len(keys) else 0
        rest_key, rest = keys[last:], prints[last:]
        yield links(keys[:last], prints[:last])
    yield links(rest_key, rest)


def linked_fingerprints(nodes: DataFrame, often: int = OFTEN) -> DataFrame:
    """Links ``a, b`` that connect the same groups of different fingerprints as all pairs within the distance.

    Fingerprints meet by equal keys: rows are dealt by key, sorted, and compared where keys are equal. Inside a key
    each fingerprint gets one link, to the least one it reaches there, so that links stay in proportion to keys.
    """
    dealt = segment_keys(nodes, often).repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_compare, "a long, b long").distinct()


def near_groups(docs: DataFrame, words: int = WORDS, seed: int = SEED, often: int = OFTEN) -> DataFrame:
    """``doc_id, fingerprint, component_id``: documents connected by fingerprints that differ by at most two bits.

    Every row of the input gives one row. A-Z are lower-cased; words are what stands between white space; shingles count
    as often as they occur. A text of fewer words is one shingle; null and empty texts have fingerprint 0, which links
    like any other. ``component_id`` is the smallest doc_id of the group, null ids aside; it is null where a group has no
    other. Repeated rows and copies share a fingerprint and are one node, whatever their number. An empty table gives
    none; other columns are not read.
    """
    prints = keep(fingerprints(docs, words, seed), "simhash_prints")
    nodes = keep(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash_nodes")
    groups = components(linked_fingerprints(nodes.select("fingerprint"), often), "simhash")
    members = nodes.join(groups, nodes["fingerprint"] == groups["node"], "left")
    least = members.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("component_id"))
    least = least.withColumnRenamed("component", "_group")
    named = members.where("component IS NOT NULL").join(least, F.col("component") == F.col("_group"))
    alone = members.where("component IS NULL AND n > 1").select("fingerprint", F.col("first").alias("component_id"))
    named = keep(named.select("fingerprint", "component_id").union(alone), "simhash_named")
    out = join_small(prints, named.withColumn("_named", F.lit(True)), "fingerprint")
    group = F.when(F.col("_named"), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "fingerprint", group.alias("component_id"))


def op13_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")
