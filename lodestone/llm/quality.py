"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents whose label is 1; unlabelled web text, good and bad, is every row of the same sample with its label
hidden. With the class prior p (the share of good text) and the logistic loss, the risk is p * loss of positives as good + max(0, loss
of the unlabelled as bad - p * loss of positives as bad): the bracket estimates what true negatives cost and can't be negative, so
where it falls below 0 the step goes back up instead (the non-negative estimator). No label 0 is read anywhere. The prior is estimated
from positives and unlabelled rows alone: a model of positives against unlabelled ones, fitted on half of the rows, scores the other;
where its scores are so high that no bad text is left, the ratio of the two tails is the share of good text among the unlabelled.

The scorer is a small network over writing statistics of the whole text. It is fitted on the driver on a bounded sample of labelled
rows (`max_labelled`), as feature rows; every document is scored in the executors. Defined results: null, empty and blank texts have all
features 0 and are scored as such; very long texts are counted whole; repeated rows are scored one by one; null ids are scored too; extra
columns pass through; without positive labels every score is 1 (nothing is rejected on no evidence).
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, encode_words, fresh, held_out, sliced, text_batches, whole_array

REJECT_BELOW = 0.3
_CLASSES = ["lower", "upper", "digit", "blank", "line", "stop", "comma", "bang", "bar", "symbol", "wide"]


def _byte_classes() -> np.ndarray:
    of = np.full(256, _CLASSES.index("symbol"), np.int64)
    for name, chars in {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t\r\v\f", "line": "\n", "stop": ".;:", "comma": ",", "bang": "!?", "bar": "|"}.items():
        of[list(chars.encode())] = _CLASSES.index(name)
    of[128:] = _CLASSES.index("wide")
    return of


BYTE_CLASS = _byte_classes()


def features(texts: pa.Array) -> np.ndarray:
    """A row of writing statistics for each whole text."""
    texts = whole_array(texts)
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    k = len(_CLASSES)
    counts = np.zeros((n, k))
    for a in range(0, n, 256):  # by blocks: a number for each byte is wide
        b = min(n, a + 256)
        piece = raw[offsets[a] - offsets[0] : offsets[b] - offsets[0]]
        counts[a:b] = np.bincount(np.repeat(np.arange(b - a) * k, lengths[a:b]) + BYTE_CLASS[piece], minlength=(b - a) * k).reshape(b - a, k)
    size = np.maximum(lengths, 1)[:, None]

    codes, dictionary, starts = encode_words(texts, lower=False)
    words = np.diff(starts)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), words)
    inner = doc[1:] == doc[:-1]
    repeated = np.bincount(doc[1:], inner & (codes[1:] == codes[:-1]), n) if len(doc) > 1 else np.zeros(n)
    every = np.sort(doc * max(len(dictionary), 1) + codes)
    fresh = np.concatenate([[True], every[1:] != every[:-1]]) if len(every) else np.zeros(0, bool)
    owner = every // max(len(dictionary), 1)
    distinct = np.bincount(owner[fresh], minlength=n)
    at = np.flatnonzero(fresh)
    runs = np.diff(np.concatenate([at, [len(every)]]))
    top = np.zeros(n)
    np.maximum.at(top, owner[at], runs)
    length = np.asarray(pc.utf8_length(dictionary), np.int64)[codes] if len(codes) else np.zeros(0)
    mean = np.bincount(doc, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / some - mean**2, 0))
    short = np.bincount(doc, length <= 3, n) / some
    shape = [np.log1p(words), mean, spread, short, repeated / some, distinct / np.maximum(some, 1) ** 0.8, top / some, counts[:, 4] / some]
    return np.column_stack([np.sqrt(counts / size), *shape, words == 0]).astype(np.float32)


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.clip((x - self.centre) / self.scale, -6, 6)
        (w1, b1), (w2, b2) = self.layers
        return (np.tanh(h @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features(texts)), -30, 30)))


def fit_features(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, hidden: int = 24, batch: int = 2048, rate: float = 0.01, decay: float = 1e-4) -> QualityModel:
    """Minimises the non-negative risk by Adam on mini-batches of both samples."""
    rng = np.random.default_rng(7)
    everything = np.vstack([positive, unlabelled]).astype(np.float64)
    centre, scale = everything.mean(0), everything.std(0) + 1e-6
    d = positive.shape[1]
    params = [rng.normal(0, d**-0.5, (d, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, (hidden, 1)), np.zeros(1)]
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    p, u = (np.clip((x - centre) / scale, -6, 6) for x in (positive, unlabelled))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        a, b = p[rng.integers(0, len(p), min(batch, len(p)))], u[rng.integers(0, len(u), min(batch, len(u)))]
        x = np.vstack([a, b])
        h = np.tanh(x @ params[0] + params[1])
        z = (h @ params[2] + params[3])[:, 0]
        za, zb = z[: len(a)], z[len(a) :]
        negative = np.logaddexp(0, zb).mean() - prior * np.logaddexp(0, za).mean()
        as_good, as_bad = -(1 - sigmoid(za)) / len(a), sigmoid(za) / len(a)
        if negative >= 0:
            by_z = np.concatenate([prior * as_good - prior * as_bad, sigmoid(zb) / len(b)])
        else:
            by_z = np.concatenate([prior * as_bad, -sigmoid(zb) / len(b)])
        by_z = by_z[:, None]
        by_h = (by_z @ params[2].T) * (1 - h**2)
        grads = [x.T @ by_h, by_h.sum(0), h.T @ by_z, by_z.sum(0)]
        now = rate * (1 - t / (steps + 1))
        for i, g in enumerate(grads):
            g = g + decay * params[i]
            moment[i], square[i] = 0.9 * moment[i] + 0.1 * g, 0.999 * square[i] + 0.001 * g**2
            params[i] = params[i] - now * (moment[i] / (1 - 0.9**t)) / (np.sqrt(square[i] / (1 - 0.999**t)) + 1e-8)
    return QualityModel(centre.astype(np.float32), scale.astype(np.float32), [(params[0], params[1]), (params[2], params[3])], prior)


def _sample(docs: DataFrame, chosen: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of the documents of (doc_id, good), and which are good."""

    def run(batches):
        for batch in sliced(batches, 0):
            x = features(batch.column(0))
            yield pa.RecordBatch.from_pydict({"x": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32())), "good": batch.column(1)})

    rows = docs.join(F.broadcast(chosen), "doc_id").select("text", "good").mapInArrow(run, "x array<float>, good boolean").toArrow()
    flat = np.asarray(pc.list_flatten(rows["x"]), np.float32)
    return flat.reshape(rows.num_rows, len(flat) // max(rows.num_rows, 1)), np.asarray(rows["good"].cast(pa.uint8()), bool)


def share_at_top(positive: np.ndarray, unlabelled: np.ndarray, certainty: float = 0.9, slack: float = 0.01) -> float:
    """The share of positives among the unlabelled, from scores of rows that the scorer hasn't seen.

    Above any threshold, unlabelled rows are at least as frequent as share * positives, so every threshold bounds the share from above:
    the ratio of the two tails. It is tight where no negatives lie above. The threshold is where the ratio and its error bound (of both
    empirical tails, at the given certainty) are least together; the ratio there is the estimate."""
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    tail = lambda x: 1 - np.searchsorted(np.sort(x), cuts) / len(x)
    p, u = tail(positive), tail(unlabelled)
    some = p > 0
    p, u = p[some], u[some]
    error = sum(np.sqrt(np.log(4 / (1 - certainty)) / (2 * len(x))) for x in (positive, unlabelled))
    return float((u / p)[np.argmin((u + (1 + slack) * error) / p)])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled: a model of positives against as many unlabelled rows in weight is fitted on either
    half of the rows and scores the other; equal rows are in one half, so no row is scored by a model that has seen it."""
    half = lambda x: np.fromiter((crc32(np.ascontiguousarray(r).tobytes()) & 1 for r in x), np.int64, len(x))
    in_p, in_u = half(positive), half(unlabelled)
    found = []
    for h in (0, 1):
        p, u, rest_p, rest_u = positive[in_p == h], unlabelled[in_u == h], positive[in_p != h], unlabelled[in_u != h]
        if min(len(p), len(u), len(rest_p), len(rest_u)) == 0:
            continue
        plain = fit_features(p, np.vstack([np.resize(p, u.shape), u]), 0.5, steps=300)
        found.append((share_at_top(plain.logits(rest_p), plain.logits(rest_u)), len(rest_u)))
    if not found:
        return 0.5  # too few rows to hold any out
    shares, rows = np.array(found).T
    return float(np.clip(np.average(shares, weights=rows), 0.01, 0.99))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> QualityModel | None:
    """None without positive labels."""
    text_batches(docs.sparkSession)
    known = labels.where(~held_out()).groupBy("doc_id").agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    unlabelled, good = _sample(docs, chosen)
    if not good.any():
        return None
    return fit_features(unlabelled[good], unlabelled, estimated_prior(unlabelled[good], unlabelled))


def score(docs: DataFrame, model: QualityModel | None, name: str = "quality_score") -> DataFrame:
    """All columns of documents and the score under a name that they don't have."""
    if name in docs.columns:
        raise ValueError(f"{name} is there already")
    if model is None:
        return docs.withColumn(name, F.lit(1.0))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in sliced(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)).astype(np.float64))], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects (score under 0.3) go; the rest stay as they were."""
    model, name = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), fresh(docs, "score")
    return score(docs, model, name).where(F.col(name) >= REJECT_BELOW).select(docs.columns)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= REJECT_BELOW).cast("int").alias("predicted"))
