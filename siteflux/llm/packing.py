"""Pack tokenised documents into sequences of a fixed length by hierarchical best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import keep

SEQUENCE, END_ID = 1024, 2
VOCABULARY = "byte_bpe_50k"
#: Distinct words whose ids a task remembers at most.
REMEMBERED = 400_000
#: A bin with at most this many free tokens is nearly full and leaves the rounds.
NEARLY_FULL = 1
#: Items one task is dealt in the first round, tasks that meet in one of the next, and the share of items that, if left
#: after a round, shows that they no longer fit together.
MERGE_ROWS, FAN_IN, MERGED_ENOUGH = 50_000, 4, 0.9

PIECE = "doc_id long, piece int, start long, length int, ids_crc32 long"


class _Words(dict):
    """Ids of a space-led word as little-endian 32-bit bytes, remembered."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) < REMEMBERED:
            self[word] = ids
        return ids


def encoder(vocabulary: str = VOCABULARY):
    """A function from a text to its ids as bytes, equal to the whole text's tokenisation by the public vocabulary.

    The vocabulary's pattern never lets a token cross from a character into a single following space, so a text is
    cut before its spaces and words are remembered. Runs of white space can form one token; texts that hold any are
    encoded whole.
    """
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    plain = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words, run = _Words(plain.encode_ordinary), re.compile(r"\s \s|\s \Z").search

    def encode(text: str) -> bytes:
        if run(text):
            return np.array(plain.encode_ordinary(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(plain.encode_ordinary(first), "<u4").tobytes() + b"".join([words[w] for w in rest])

    return encode


def pieces(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``sequence`` ids: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``).

    A document's ids are those of its text (null: empty) and ``end_id``. Only a longer one is cut, so that all its
    pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = encode(text or "") + end
                total = len(raw) // 4
                first = (total - 1) % sequence + 1
                cuts = [0, *range(first, total + 1, sequence)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = raw[4 * a : 4 * b]
                    rows.append((doc, i, a, b - a, zlib.crc32(part), *([np.frombuffer(part, "<u4")] if ids else ())))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECE + (", ids array<int>" if ids else ""))


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit of the sizes in falling order: each goes to the fullest bin it fits in. Returns positions per bin.

    Open bins are held by free space, with the spaces that occur in a sorted list of at most ``capacity`` entries.
    """
    bins: list[list[int]] = []
    open_bins: dict[int, list[int]] = {}
    spaces: list[int] = []
    for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[i]
        at = bisect_left(spaces, size)
        if at < len(spaces):
            free = spaces[at]
            b = open_bins[free].pop()
            if not open_bins[free]:
                del open_bins[free], spaces[at]
            bins[b].append(i)
        else:
            free, b = capacity, len(bins)
            bins.append([i])
        if left := free - size:
            if left not in open_bins:
                open_bins[left] = []
                insort(spaces, left)
            open_bins[left].append(b)
    return bins


def _merge_round(items: DataFrame, tasks: int, capacity: int) -> DataFrame:
    """Deal the items to ``tasks`` tasks and best-fit them there: ``bin`` (its parts' ids, in order) and ``size``.

    An item is a row ``id, size``; a bin is named after its first item, so that names stay unique over rounds.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        ids = np.concatenate([b.column(0).to_numpy() for b in batches]) if batches else np.zeros(0, np.int64)
        sizes = [s for b in batches for s in b.column(1).to_pylist()]
        for at in range(0, len(sizes), 8 * MERGE_ROWS):  # bounds a share whatever it is dealt
            part = sizes[at : at + 8 * MERGE_ROWS]
            rows = best_fit(part, capacity)
            flat = [i for r in rows for i in r]
            offsets = [o for r in rows for o in np.cumsum([0, *(part[i] for i in r[:-1])]).tolist()]
            first = [r[0] for r in rows for _ in r]
            total = [t for r in rows for t in [sum(part[i] for i in r)] * len(r)]
            arrays = [ids[at + np.array(x, np.int64)] for x in (flat, first)] + [np.array(x, np.int32) for x in (offsets, total)]
            yield pa.record_batch([pa.array(a) for a in arrays], ["id", "bin", "offset", "bin_size"])

    dealt = items.select("id", "size").repartition(tasks, F.xxhash64("id"))
    return dealt.mapInArrow(fit, "id long, bin long, offset int, bin_size int")


def pack(parts: DataFrame, capacity: int = SEQUENCE, nearly_full: int = NEARLY_FULL, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a stored table of pieces with ``id`` (unique) and ``length``.

    Tasks best-fit their share; bins with more than ``nearly_full`` free tokens become items of the next round, which
    has fewer tasks, down to one task or to a round after which nearly as many bins are underfull as went in. Only
    counts reach the driver.
    """
    items, count = parts.select("id", F.col("length").alias("size")), parts.count()
    tasks, where = max(1, -(-count // merge_rows)), None
    while True:
        placed = keep(_merge_round(items, tasks, capacity), "packing_round")
        if where is None:
            where = placed.select("id", "bin", "offset")
        else:
            # a piece moves with the bin it lies in
            moved = placed.select(F.col("id").alias("_bin"), F.col("bin").alias("_to"), F.col("offset").alias("_by"))
            by = F.col("offset") + F.coalesce("_by", F.lit(0))
            where = where.join(moved, where["bin"] == moved["_bin"], "left")
            where = where.select("id", F.coalesce("_to", "bin").alias("bin"), by.alias("offset"))
        underfull = (F.col("offset") == 0) & (F.col("bin_size") < capacity - nearly_full)
        items = placed.where(underfull).select(F.col("bin").alias("id"), F.col("bin_size").alias("size"))
        left = items.count()
        if tasks == 1 or left > MERGED_ENOUGH * count:
            break
        count, tasks = left, max(1, min(tasks // FAN_IN, -(-left // merge_rows)))
    return parts.join(where, "id").select(*[c for c in parts.columns if c != "id"], F.col("bin").alias("sequence_id"), F.col("offset").cast("long"))


def pack_documents(docs: DataFrame, sequence: int = SEQUENCE, end_id: int = END_ID, vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """Documents cut into pieces and packed: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    One row per piece; a sequence's pieces lie gapless from offset 0. Null and empty texts are their end id alone. A
    repeated row is packed once more. Null doc_ids are kept. An empty table packs to none. Texts are read once; what
    is dealt out is two numbers per piece.
    """
    parts = pieces(docs, sequence, end_id, vocabulary, ids).withColumn("id", F.monotonically_increasing_id())
    out = pack(keep(parts, "packing_pieces"), sequence)
    return out.withColumn("length", F.col("length").cast("long"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
