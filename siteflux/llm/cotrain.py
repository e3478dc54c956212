"""Quality classifier by co-training: a content view and a metadata view teach each other, then score together."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteflux.llm.common import keep

#: Labelled and unlabelled documents the classifiers are fitted on, at most: those of the smallest hashed ids.
FIT_ROWS, UNLABELLED_ROWS = 16_000, 6_000
#: Hash buckets of words; the last ones are shape features.
BUCKETS = 1 << 16
#: Rounds of exchanging pseudo-labels, and the calibrated certainty that a pseudo-label takes.
ROUNDS, CERTAIN = 3, 0.97
#: Pseudo-labels one view gives the other in a round, at most.
TAUGHT_ROWS = 1_000
#: Fifth part of the labelled sample that calibrates.
CALIBRATE = 5
META_BUCKETS = 1 << 10
PUNCTUATION = b".,;:!?\"'()"


def content_features(text: str | None) -> np.ndarray:
    """Buckets of a text's distinct words, and of its shape: steps of upper-case, symbol, repeated-word and length shares."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    distinct = set(words)
    found = {zlib.crc32(w) % (BUCKETS - 64) for w in {w.strip(PUNCTUATION) for w in distinct}}
    n = max(len(words), 1)
    upper = sum(raw.count(bytes([c])) for c in range(65, 91)) / max(len(raw), 1)
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">", b"!"))) / n
    lines = raw.split(b"\n")
    shares = (upper * 2, symbols, 1 - len(distinct) / n, 1 - len(set(lines)) / len(lines))
    steps = [16 * i + min(int(10 * s), 10) for i, s in enumerate(shares)]
    return np.array(sorted(found) + [BUCKETS - 64 + s for s in steps], np.int32)


def metadata_features(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """Buckets of language, source and length, alone and the first two together."""
    size = "none" if n_chars is None else str(int(n_chars).bit_length())
    marks = (f"lang={lang}", f"source={source}", f"size={size}", f"both={lang}/{source}")
    return np.array(sorted({zlib.crc32(m.encode("utf-8", "surrogatepass")) % META_BUCKETS for m in marks}), np.int32)


def featurised(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns``, ``content`` and ``meta``: bucket numbers of the two views."""

    def view(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.int32())
        for batch in batches:
            text, lang, source, size = (batch.column(len(columns) + i).to_pylist() for i in range(4))
            content = pa.array([content_features(t) for t in text], kind)
            meta = pa.array([metadata_features(*m) for m in zip(lang, source, size)], kind)
            yield pa.record_batch([*batch.columns[: len(columns)], content, meta], [*columns, "content", "meta"])

    own = docs.select(*columns, "text", F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in own.select(*columns).schema.fields]
    return own.mapInArrow(view, ", ".join([*kinds, "content array<int>", "meta array<int>"]))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Rows:
    """Sparse binary rows: all buckets in a line, and where each row starts."""

    flat: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        flat = np.concatenate(lists) if lists else np.zeros(0, np.int32)
        return cls(flat, np.array([len(x) for x in lists], np.int64))

    def take(self, at: np.ndarray) -> Rows:
        ends = self.lengths.cumsum()
        return Rows.of([self.flat[ends[i] - self.lengths[i] : ends[i]] for i in at])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths), weights[self.flat], len(self.lengths))


def fit(rows: Rows, y: np.ndarray, size: int, steps: int = 80, rate: float = 0.1, decay: float = 1e-3) -> np.ndarray:
    """Logistic regression with a bias (last weight), by Adam over all rows; both classes weigh alike in sum."""
    weights, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    owner = np.repeat(np.arange(len(y)), rows.lengths)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6) if len(y) else 0.5
    cost = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / max(len(y), 1)
    for step in range(1, steps + 1):
        slope = (sigmoid(rows.dot(weights) + weights[-1]) - y) * cost
        grad = np.bincount(rows.flat, slope[owner], size + 1)
        grad[-1] += slope.sum()
        grad += decay * weights
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def calibrate(scores: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression on few dense scores (a column each), bias last: Newton steps with a ridge."""
    x = np.column_stack([scores, np.ones(len(scores))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 1e-2 * w)
    return w


@dataclass
class Model:
    """Weights of both views and of their combination; the same few numbers at any input size."""

    content: np.ndarray
    meta: np.ndarray
    content_scale: np.ndarray
    meta_scale: np.ndarray
    combined: np.ndarray

    def score(self, content: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the content view, the metadata view and both together."""
        z = np.column_stack([content.dot(self.content) + self.content[-1], meta.dot(self.meta) + self.meta[-1]])
        c, m = (_logit(z[:, [i]], s) for i, s in enumerate((self.content_scale, self.meta_scale)))
        return sigmoid(c), sigmoid(m), sigmoid(_logit(np.column_stack([c, m]), self.combined))


def _logit(z: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return z @ scale[:-1] + scale[-1]


def co_train(content: Rows, meta: Rows, y: np.ndarray, rounds: int = ROUNDS, certain: float = CERTAIN, taught: int = TAUGHT_ROWS) -> Model:
    """Fit both views on rows labelled 0 or 1 (NaN: unlabelled).

    A fifth of the labelled rows is kept for calibration. In every round each view's calibrated model labels the
    unlabelled rows it is most certain of, and the other view learns from them in the next.
    """
    labelled = np.flatnonzero(~np.isnan(y))
    hold = labelled[np.arange(len(labelled)) % CALIBRATE == 0]
    train = labelled[np.arange(len(labelled)) % CALIBRATE != 0]
    free = np.flatnonzero(np.isnan(y))
    views = {"content": (content, BUCKETS), "meta": (meta, META_BUCKETS)}
    lessons = {name: (np.zeros(0, np.int64), np.zeros(0)) for name in views}
    weights, scales = {}, {}
    for step in range(rounds + 1):
        for name, (rows, size) in views.items():
            at, said = lessons[name]
            weights[name] = fit(rows.take(np.concatenate([train, at])), np.concatenate([y[train], said]), size)
            held = rows.take(hold)
            scales[name] = calibrate((held.dot(weights[name]) + weights[name][-1])[:, None], y[hold])
        if step == rounds:
            break
        for name, other in (("content", "meta"), ("meta", "content")):
            rows = views[name][0].take(free)
            p = sigmoid(_logit((rows.dot(weights[name]) + weights[name][-1])[:, None], scales[name]))
            sure = np.flatnonzero((p >= certain) | (p <= 1 - certain))
            sure = sure[np.argsort(-np.abs(p[sure] - 0.5), kind="stable")[:taught]]
            lessons[other] = (free[sure], (p[sure] > 0.5).astype(float))
    model = Model(weights["content"], weights["meta"], scales["content"], scales["meta"], np.array([1.0, 0.0, 0.0]))
    z = [_logit((rows.take(hold).dot(weights[n]) + weights[n][-1])[:, None], scales[n]) for n, (rows, _) in views.items()]
    model.combined = calibrate(np.column_stack(z), y[hold])
    return model


def fitting_sample(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, unlabelled_rows: int = UNLABELLED_ROWS) -> pa.Table:
    """``y, content, meta`` of at most ``fit_rows`` labelled and ``unlabelled_rows`` other documents, in hash order of id.

    A document is good if its quality is 1 and it is not toxic. Labels that are null or contradict each other count as
    none. Only this sample, whose size the two numbers bound, reaches the driver.
    """
    good = F.when(F.col("quality").isNull(), None).otherwise((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0))
    marked = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marked = marked.agg(F.min(good.cast("double")).alias("y"), F.max(good.cast("double")).alias("_y")).where("y = _y").drop("_y")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    order = F.xxhash64("doc_id", F.lit(1))
    ids = keep(ids.join(marked, "doc_id", "left").withColumn("_order", order), "classifier_ids")
    parts = [ids.where("y IS NOT NULL").orderBy("_order").limit(fit_rows), ids.where("y IS NULL").orderBy("_order").limit(unlabelled_rows)]
    chosen = keep(parts[0].union(parts[1]), "classifier_chosen").withColumnRenamed("doc_id", "_id")
    own = docs.join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("_id"))
    return featurised(own, ["_order", "y"]).orderBy("_order").toArrow()


def _rows(column: pa.ChunkedArray | pa.Array) -> Rows:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return Rows(column.flatten().to_numpy(), np.diff(column.offsets.to_numpy()))


def classify(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Score every document: ``doc_id, content_score, meta_score, score, kept``, one row per row.

    Scores are calibrated probabilities that a document is good; ``kept`` is score >= 0.5. Every whole text is scored
    where it lies; the weights are a fixed number of floats. Null texts and fields are values like others. With fewer
    than two classes of labels the scores are null and everything is kept. ``bounds`` are those of
    :func:`fitting_sample`. Repeated rows get equal scores; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    sample = fitting_sample(docs, labels, **bounds)
    y = sample["y"].to_numpy()
    if len(set(y[~np.isnan(y)])) < 2:
        empty = F.lit(None).cast("double")
        return docs.select("doc_id", empty.alias("content_score"), empty.alias("meta_score"), empty.alias("score"), F.lit(True).alias("kept"))
    model = co_train(_rows(sample["content"]), _rows(sample["meta"]), y)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, m, both = model.score(_rows(batch.column(1)), _rows(batch.column(2)))
            yield pa.record_batch([batch.column(0), *map(pa.array, (c, m, both, both >= 0.5))], ["doc_id", "content_score", "meta_score", "score", "kept"])

    rows = featurised(docs.withColumn("doc_id", F.col("doc_id").cast("long")), ["doc_id"])
    return rows.mapInArrow(score, "doc_id long, content_score double, meta_score double, score double, kept boolean")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
