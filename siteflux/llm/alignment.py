"""Align the tokens that two tokenizers make of one text, and count which of their ids go together."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import keep

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters whose class (letter, digit, space, other) all editions of Unicode agree on: Latin, Greek and Cyrillic
#: letters, general punctuation, kana, ideographs, Hangul.
SETTLED = "\\x00-\u0220\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u2010-\u2027\u2030-\u203e\u3000-\u3020\u3041-\u3094\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Characters of texts that are aligned at once.
CHUNK = 1 << 19
#: Id pairs that every task may hold (16 bytes each); links of other pairs are joined.
FREQUENT = 500_000


class Tokenizer:
    """Ids of texts, each with a space before it, and the bytes of each id."""

    def __init__(self, ids_of: Callable[[list[str]], Iterable[list[int]]], table: list[bytes]):
        self.ids_of, self.table = ids_of, table
        self.sizes = np.array([len(x) for x in table], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text; None for an empty one or where the tokens' bytes differ from the space and the text."""
        out = []
        for text, ids in zip(texts, self.ids_of(texts)):
            same = text and b"".join(map(self.table.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass")
            out.append(np.array(ids, np.int32) if same else None)
        return out


def byte_level(name: str = VOCABULARY_A) -> Tokenizer:
    """A byte-level vocabulary file, whose ids are in the order of its merges. Special strings are ordinary text.

    The merges are made by the ranks' encoder, several times as fast as the file's own, which serves for texts with
    characters whose class may depend on the libraries' edition of Unicode.
    """
    import json

    import public_tokenizers
    import tiktoken
    import tokenizers

    # byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    path = public_tokenizers.path(name)
    loaded = tokenizers.Tokenizer.from_file(path)
    loaded.encode_special_tokens = True
    with open(path, encoding="utf-8") as file:
        special = {x["id"]: x["content"] for x in json.load(file)["added_tokens"]}
    names = [loaded.id_to_token(i) or "" for i in range(loaded.get_vocab_size())]
    table = [n.encode() if i in special else bytes(byte_of[c] for c in n) for i, n in enumerate(names)]
    ranks = {token: i for i, token in enumerate(table) if i not in special}
    plain = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    unsure = re.compile(f"[^{SETTLED}]").search

    def ids_of(texts: list[str]) -> Iterator[list[int]]:
        for text in texts:
            if unsure(text):
                yield loaded.encode(" " + text, add_special_tokens=False).ids
            else:
                yield plain.encode_ordinary(" " + text)

    return Tokenizer(ids_of, table)


def pieces(name: str = VOCABULARY_B) -> Tokenizer:
    """A piece model file, which itself puts a space before a text and writes spaces as U+2581."""
    import public_tokenizers
    import sentencepiece

    loaded = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    names = [loaded.id_to_piece(i) for i in range(loaded.get_piece_size())]
    table = [bytes([int(n[3:5], 16)]) if loaded.is_byte(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
    return Tokenizer(lambda texts: (loaded.encode(text) for text in texts), table)


def group_tokens(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of its group, from the byte offsets at which the tokens end.

    Both rows cover the same bytes. Every token points to the token that reaches farthest right among those that overlap
    it: a token of A to the one of B that holds its last byte, a token of B to the one of A that holds its last byte if that
    reaches farther, else to itself. All pointers are doubled at once until none moves; tokens with one end point
    are a connected group, and groups are numbered from left to right.
    """
    n = len(ends_a)
    over = np.searchsorted(ends_a, ends_b)
    own = n + np.arange(len(ends_b))
    to = np.concatenate([n + np.searchsorted(ends_b, ends_a), np.where(ends_a[over] > ends_b, over, own)])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    last = np.flatnonzero(to[n:] == own)
    group = np.searchsorted(last, to - n)
    return group[:n], group[n:]


def _written(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, closing: np.ndarray, names: list[bytes]
) -> tuple[bytes, np.ndarray]:
    """All groups as text, ``a1,a2|b1;a3|b2``, and for each group the place after its text; ``closing`` ends a
    document and ``names`` are the ids in digits and a comma."""
    per_a, per_b = np.bincount(group_a), np.bincount(group_b)
    before_a, before_b = np.cumsum(per_a), np.cumsum(per_b)
    place_a = np.arange(len(a)) + (before_b - per_b)[group_a]
    place_b = np.arange(len(b)) + before_a[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    ids[place_a], ids[place_b] = a, b
    text = np.frombuffer(bytearray(b"".join(map(names.__getitem__, ids.tolist()))), np.uint8)
    digits = np.searchsorted(10 ** np.arange(1, 12), ids, "right") + 1
    after = np.cumsum(digits + 1)
    text[after[before_a + before_b - per_b - 1] - 1] = ord("|")
    text[after[before_a + before_b - 1] - 1] = ord(";")
    return text.tobytes(), after[(before_a + before_b - 1)[closing]]


def align_texts(texts: list[str], one: Tokenizer, two: Tokenizer, names: list[bytes]) -> pa.RecordBatch:
    """Counts, groups and id pairs of each text; see ``align``."""
    ids_a, ids_b = one.encode(texts), two.encode(texts)
    good = [i for i in range(len(texts)) if ids_a[i] is not None and ids_b[i] is not None]
    n_a, n_b, n_groups, n_links = np.zeros((4, len(texts)), np.int64)
    written, sizes = [""] * len(texts), np.zeros(len(texts), np.int64)
    pairs = links = np.zeros(0, np.int64)
    if good:
        n_a[good], n_b[good] = [len(ids_a[i]) for i in good], [len(ids_b[i]) for i in good]
        a, b = [np.concatenate([ids[i] for i in good]) for ids in (ids_a, ids_b)]
        # the documents' bytes follow one another: every document's end is an end in both rows
        ends_a, ends_b = [np.cumsum(tokens.sizes[ids]) for tokens, ids in ((one, a), (two, b))]
        group_a, group_b = group_tokens(ends_a, ends_b)
        closing = group_b[np.cumsum(n_b[good]) - 1]
        n_groups[good] = np.diff(closing, prepend=-1)
        text, upto = _written(a, b, group_a, group_b, closing, names)
        for i, start, end in zip(good, [0, *upto[:-1].tolist()], upto.tolist()):
            written[i] = text[start : end - 1].decode()
        # a token of B is linked with the tokens of A from the one that holds its first byte to the one of its last
        first = np.searchsorted(ends_a, np.append(0, ends_b[:-1]), "right")
        many = np.searchsorted(ends_a, ends_b) - first + 1
        n_links[good] = np.add.reduceat(many, np.cumsum(n_b[good]) - n_b[good])
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        pair = np.repeat(b.astype(np.int64), many) * len(one.table) + a[place]
        doc = np.repeat(np.arange(len(good)), n_links[good])
        every = len(one.table) * len(two.table)
        both, links = np.unique(doc * every + pair, return_counts=True)
        pairs = both % every
        sizes[good] = np.bincount(both // every, minlength=len(good))
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    columns = [pa.array(x) for x in (n_a, n_b, n_groups, n_links)] + [pa.array(written, pa.string())]
    columns += [pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(links, pa.int64()))]
    return pa.record_batch(columns, ["n_a", "n_b", "n_groups", "n_links", "groups", "pairs", "pair_links"])


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """Tokens of a byte-level vocabulary (A) and of a piece model (B), aligned by the bytes they cover.

    One row per row of the input: ``doc_id, n_a, n_b, n_groups, n_links``; ``groups``, the whole alignment as text
    (``a1,a2|b1;a3|b2,b3``: the ids of A and of B in each group); ``pairs``, the distinct id pairs linked in the
    document (``id of B * size of A + id of A``), and ``pair_links``, how often each is. A link is an occurrence of a token
    of A and one of B whose bytes overlap. Groups end at bytes at which tokens of both end.

    A gets a space and the text; B adds that space itself. A text that is null or empty, or whose tokens do not join to
    exactly these bytes, has no tokens: zeros, no groups, no pairs. Repeated rows give equal rows; null doc_ids are
    kept; an empty table gives none; other columns are not read. Texts are aligned whole, many short ones at once.
    """

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = byte_level(vocabulary_a), pieces(vocabulary_b)
        names = [b"%d," % i for i in range(max(len(one.table), len(two.table)))]
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                texts: list[str] = []
                chars = 0
                while at + len(texts) < batch.num_rows and (not texts or chars < CHUNK):
                    texts.append(batch.column(1)[at + len(texts)].as_py() or "")
                    chars += len(texts[-1])
                done = align_texts(texts, one, two, names)
                yield pa.record_batch([batch.column(0).slice(at, len(texts)), *done.columns], ["doc_id", *done.schema.names])
                at += len(texts)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, pair_links array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(aligned, schema)


def pair_counts(aligned: DataFrame, size_a: int) -> DataFrame:
    """``pair, links, best``: how many links of the corpus hold an id pair, and whether no other pair of its id of B has more."""
    pairs = aligned.select(F.inline(F.arrays_zip("pairs", "pair_links"))).groupBy(F.col("pairs").alias("pair"))
    counts = keep(pairs.agg(F.sum("pair_links").alias("links")), "alignment_counts")
    id_b = F.expr(f"pair div {size_a}")
    most = counts.groupBy(id_b.alias("_b")).agg(F.max("links").alias("_most"))
    best = counts.join(most, id_b == F.col("_b")).select("pair", "links", (F.col("links") == F.col("_most")).alias("best"))
    return keep(best, "alignment_pairs")


def link_scores(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``row, n_best, count_sum`` of a stored table with ``row`` (unique), ``pairs`` and ``pair_links``.

    ``n_best`` counts a row's links of best pairs, ``count_sum`` adds the corpus counts of all its links. The counts of the
    ``frequent`` most frequent pairs are held by every task. Links of other pairs, each of which is rare, are joined by pair.
    """
    links = aligned.select("row", F.inline(F.arrays_zip("pairs", "pair_links"))).withColumnRenamed("pairs", "_pair")
    step = F.floor(F.log2("links") * 8)
    many = counts.count()
    if many > frequent:  # at most 512 steps: the least whose pairs and all above fit
        rows = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect(), reverse=True)
        upto = np.cumsum([r.n for r in rows])
        held = [r.step for r, n in zip(rows, upto) if n <= frequent]
        least = held[-1] if held else rows[0].step + 1
    else:
        least = 0
    known = links.join(F.broadcast(counts.where(step >= least)), F.col("_pair") == F.col("pair"), "left")

    def added(part: DataFrame) -> DataFrame:
        best = F.sum(F.when(F.col("best"), F.col("pair_links")).otherwise(0)).alias("n_best")
        return part.groupBy("row").agg(best, F.sum(F.col("pair_links") * F.col("links")).alias("count_sum"))

    if least == 0:
        return added(known)
    rare = known.where("pair IS NULL").select("row", "_pair", "pair_links").join(counts.where(step < least), F.col("_pair") == F.col("pair"))
    parts = added(known.where("pair IS NOT NULL")).union(added(rare))
    return parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def aligned_counts(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum`` of every row; see ``align`` and ``link_scores``.

    Documents without tokens have zeros and an empty ``groups_sha256``. Texts are tokenised once; what is stored of them is
    their distinct id pairs.
    """
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    rows = align(docs, vocabulary_a, vocabulary_b).withColumn("row", F.monotonically_increasing_id())
    rows = keep(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "pair_links"), "alignment")
    scores = link_scores(rows, pair_counts(rows, vocabulary_size(vocabulary_a)), frequent).withColumnRenamed("row", "_row")
    out = rows.join(scores, rows["row"] == scores["_row"], "left")
    scored = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *scored)


def vocabulary_size(name: str) -> int:
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path(name)).get_vocab_size()


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
