"""Score texts by a language model: the marginal probability of all their segmentations into subword pieces."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import keep

VOCABULARY = "piece_bpe_32k.model"
#: Documents whose crc32(doc_id as text) has this remainder are held out of all counts.
FOLDS, HELD_OUT = 7, 2
#: The most frequent words, whose figures every task holds; all others are joined. A fixed bound.
HEAD_WORDS = 1 << 17
#: Distinct words a task counts before it passes their sums on.
COUNTED_AT_ONCE = 300_000
#: The token that ends a text. No word holds white space.
END = b"\n"
SPACE_MARK = "▁"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: maximal runs without space, tab to carriage return."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, trained, seen``: how often each word stands in the training documents and in all, ends included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(trained: Counter, seen: Counter) -> Iterator[pa.RecordBatch]:
            names = list(seen)
            for at in range(0, len(names), 1 << 15):
                part = names[at : at + (1 << 15)]
                columns = [pa.array(part, pa.binary()), pa.array([trained[w] for w in part], pa.int64()), pa.array([seen[w] for w in part], pa.int64())]
                yield pa.record_batch(columns, ["word", "trained", "seen"])

        trained, seen = Counter(), Counter()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                words.append(END)
                seen.update(words)
                if not held_out(doc):
                    trained.update(words)
                if len(seen) > COUNTED_AT_ONCE:
                    yield from flush(trained, seen)
                    trained, seen = Counter(), Counter()
        yield from flush(trained, seen)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word binary, trained long, seen long")
    return rows.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen"))


def _pieces(vocabulary: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))


def piece_counts(counts: DataFrame, vocabulary: str = VOCABULARY) -> np.ndarray:
    """How often each piece of the vocabulary is used to write the training words. One number per piece is collected."""

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _pieces(vocabulary)
        total = np.zeros(model.vocab_size(), np.int64)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column(0).to_pylist()]
            ids = model.encode(words, num_threads=1)
            times = np.repeat(batch.column(1).to_numpy(), list(map(len, ids)))
            np.add.at(total, np.fromiter((i for x in ids for i in x), np.int64, len(times)), times)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["piece", "n"])

    rows = counts.where(F.col("trained") > 0).where(F.col("word") != F.lit(END)).select("word", "trained").mapInArrow(segment, "piece long, n long")
    got = rows.groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(_pieces(vocabulary).vocab_size(), np.int64)
    out[got["piece"].to_numpy()] = got["n"].to_numpy()
    return out


class Lattice:
    """Natural-log probabilities of pieces and the forward recursion over all ways to write a word with them.

    A word starts with the space mark. Characters no piece holds are written by their bytes. The end of a text is one
    more symbol, and each count is raised by one, so that the symbols' probabilities sum to one.
    """

    def __init__(self, counts: np.ndarray, ends: int, vocabulary: str = VOCABULARY):
        model = _pieces(vocabulary)
        total = math.log(int(counts.sum()) + ends + len(counts) + 1)
        self.end = math.log(ends + 1) - total
        self.logs: dict[str, float] = {}
        self.bytes: dict[int, float] = {}
        for i, n in enumerate(counts.tolist()):
            value = math.log(n + 1) - total
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:-1], 16)] = value
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.logs[model.id_to_piece(i)] = value
        self.longest = max(map(len, self.logs))

    def word(self, word: bytes) -> float:
        """Log of the summed probabilities of all segmentations."""
        text = SPACE_MARK + word.decode("utf-8", "surrogateescape")
        n, logs, longest = len(text), self.logs, self.longest
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        for i in range(n):
            here = forward[i]
            if text[i] not in logs:
                parts = [self.bytes.get(b, self.end) for b in text[i].encode("utf-8", "surrogateescape")]
                forward[i + 1] = _add(forward[i + 1], here + sum(parts))
            for j in range(i + 1, min(i + longest, n) + 1):
                value = logs.get(text[i:j])
                if value is not None:
                    forward[j] = _add(forward[j], here + value)
        return forward[n]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def word_scores(counts: DataFrame, lattice: Lattice) -> DataFrame:
    """``word, trained, seen, marginal``: log10 of each distinct word's marginal probability, found once per word."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [lattice.end if w == END else lattice.word(w) for w in batch.column(0).to_pylist()]
            columns = [*batch.columns, pa.array(np.array(logs, np.float64) / math.log(10))]
            yield pa.record_batch(columns, ["word", "trained", "seen", "marginal"])

    return counts.select("word", "trained", "seen").mapInArrow(score, "word binary, trained long, seen long, marginal double")


def _frequent(words: DataFrame, most: int) -> DataFrame:
    """The words seen oftenest, at most ``most`` of them: those above a count that a histogram of few steps gives.

    Eight steps per doubling: no more than some hundred rows are collected, and nothing is sorted in one task.
    """
    step = F.floor(F.log2("seen") * 8)
    sizes = {r["step"]: r["n"] for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()}
    least, room = float("inf"), most
    for at in sorted(sizes, reverse=True):
        room -= sizes[at]
        if room < 0:
            break
        least = at
    return words.where(step >= F.lit(float(least)))


def score_texts(docs: DataFrame, vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """Log10 probabilities of all texts, one row per row.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. ``base_score`` is a word model with
    each count raised by one. ``score`` is the marginal probability of the text under a unigram model of subword
    pieces: the vocabulary's segmentation of the training words gives the pieces' weights, and the probabilities of
    all segmentations are summed. Words start pieces of their own, so a text's probability is the product of its
    words' and its end.

    Words are counted over all training documents and each distinct word is scored once. The most
    frequent, at most ``head_words``, are held by every task; the others are joined by word, none of which is frequent.
    A null text is empty and has its end alone; a null id counts as the empty string for the fold. Repeats count as
    often as they stand. Without training documents all counts are zero. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counts = keep(word_counts(docs), "lm_counts")
    total = counts.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    n, v = total["n"] or 0, total["v"]
    ends = counts.where(F.col("word") == F.lit(END)).first()
    lattice = Lattice(piece_counts(counts, vocabulary), ends["trained"] if ends else 0, vocabulary)
    words = keep(word_scores(counts, lattice), "lm_words")
    head = _frequent(words, head_words).toArrow()
    names = head["word"].to_pylist()
    known = dict(zip(map(bytes, names), zip(head["trained"].to_pylist(), head["marginal"].to_pylist())))
    known = docs.sparkSession.sparkContext.broadcast(known)  # head_words entries
    unit = math.log10(n + v + 1)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {w: (math.log10(c + 1), c > 0, m) for w, (c, m) in known.value.items()}
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = words_of(text)
                words.append(END)
                base = marginal = 0.0
                hits, rest = 0, {}
                for word, times in Counter(words).items():
                    entry = table.get(word)
                    if entry is None:
                        rest[word] = times
                    else:
                        base += times * entry[0]
                        hits += times * entry[1]
                        marginal += times * entry[2]
                rows.append((row, doc, held_out(doc), len(words), hits, base, marginal, list(rest), list(rest.values())))
            columns = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], names)

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<binary>, times array<long>"
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(local, schema)
    rows = keep(rows, "lm_rows")
    rest = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    rest = rest.join(words.select("word", "trained", "marginal"), "word")
    times = F.col("times")
    rest = rest.groupBy("row").agg(
        F.sum(times * F.log10(F.col("trained") + 1)).alias("_base"),
        F.sum(F.when(F.col("trained") > 0, times).otherwise(0)).alias("_known"),
        F.sum(times * F.col("marginal")).alias("_score"),
    )
    zero = F.lit(0.0)
    out = rows.drop("words", "times").join(rest, "row", "left")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", zero) - F.col("n_tokens") * F.lit(unit)).alias("base_score"),
        (F.col("score") + F.coalesce("_score", zero)).alias("score"),
    )


def op9_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
