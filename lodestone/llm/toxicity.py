"""Toxicity by multiple-instance learning: labels mark documents, the model scores sentences.

A sentence's chance to be toxic is a logistic function of its words. A document is toxic if any sentence is: a noisy-or over its
sentences, with a leak for documents that are labelled toxic without a sentence that tells why. Training maximises the likelihood
of the document labels alone; the sentence scores that explain a document then locate the offending sentences.

The model is fitted on the driver from a bounded sample of labelled rows (`max_labelled`); every row is
scored in the executors. Defined results: null, empty and blank texts have no sentence and score the leak; repeated rows are
scored one by one; null ids are scored too; very long texts are bags of more sentences; extra columns are ignored; without labels the
scores are all 0.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents, encode_words, gathered, held_out, text_batches, whole_array

BITS = 18
LINE = "\x02"
_EDGES = re.compile(r"^\W+|\W+$")
_END = re.compile(r"[.!?]\W*$")
_TOKEN = re.compile(rf"\n|{WORD}")


#: A word counts as itself and by its beginnings of these lengths, so inflected forms share what is learnt.
PREFIXES = (4, 5, 6, 7)


def word_features(word: str) -> list[int]:
    core = _EDGES.sub("", word)
    parts = [core] + [core[:k] + "-" for k in PREFIXES if len(core) >= k] if core else []
    return [xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for p in parts]


def sentence_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different words, the number of each word in order, the sentence number of each, and the first sentence of each text."""
    texts = pc.replace_substring(whole_array(texts), "\n", f" {LINE} ")
    codes, dictionary, starts = encode_words(texts)
    words = dictionary.to_pylist()
    ends = np.fromiter((w == LINE or bool(_END.search(w)) for w in words), bool, len(words))
    closes = ends[codes] if len(codes) else np.zeros(0, bool)
    opens = np.concatenate([[False], closes[:-1]]) if len(codes) else closes
    lengths = np.diff(starts)
    opens[starts[:-1][lengths > 0]] = True
    number = np.cumsum(opens) - 1
    total = int(number[-1]) + 1 if len(number) else 0
    return words, codes, number, np.concatenate([number, [total]])[starts]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Where the sentences of sentence_words lie in a text: code points, end exclusive."""
    spans, closed = [], True
    for m in _TOKEN.finditer(text):
        token = m.group()
        if closed:
            spans.append(m.span())
        else:
            spans[-1] = (spans[-1][0], m.end())
        closed = token in ("\n", LINE) or bool(_END.search(token.lower()))
    return spans


@dataclass
class ToxicityModel:
    weights: np.ndarray  # a weight for each word feature
    bias: float
    leak: float  # of the noisy-or: -log(1 - chance without any sentence)
    known: dict[str, float] = field(default_factory=dict, repr=False)  # weights of words met lately, up to `remembered`
    remembered: int = 400_000

    def word_weights(self, words: list[str]) -> np.ndarray:
        known, new = self.known, [w for w in words if w not in self.known]
        if len(known) + len(new) > self.remembered:
            known.clear()
            new = words
        filled = {i: float(self.weights[i]) for i in np.flatnonzero(self.weights).tolist()} if new else {}
        for w in new:
            known[w] = sum(filled.get(x, 0.0) for x in word_features(w))
        return np.fromiter((known[w] for w in words), np.float64, len(words))

    def evidence(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """-log(1 - chance) of each sentence, and the first sentence of each text."""
        words, codes, number, first = sentence_words(texts)
        of = self.word_weights(words)
        return np.logaddexp(0, self.bias + np.bincount(number, of[codes] if len(codes) else None, int(first[-1]))), first

    def document_scores(self, each: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(each)])
        return -np.expm1(-(total[first[1:]] - total[first[:-1]] + self.leak))

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.document_scores(*self.evidence(texts))


def _descend(label, n, sentence, feature, width, steps, decay, rate) -> tuple[np.ndarray, float, float]:
    """Adam on the mean loss of documents plus an L1 pull of `decay` on the weights."""
    owner = np.repeat(np.arange(len(label)), n)
    w, bias, leak = np.zeros(width), -7.0, float(np.log(20 / 19))
    moment, square = np.zeros(width + 2), np.zeros(width + 2)
    for t in range(1, steps + 1):
        z = bias + np.bincount(sentence, w[feature], len(owner))
        rest = np.exp(-(np.bincount(owner, np.logaddexp(0, z), len(label)) + leak))
        by_total = (1 - label) - label * rest / np.maximum(1 - rest, 1e-9)
        by_z = by_total[owner] / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.concatenate([np.bincount(feature, by_z[sentence], width), [by_z.sum(), by_total.sum() * leak]]) / len(label)
        moment, square = 0.9 * moment + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        scale = np.sqrt(square / (1 - 0.99**t)) + 1e-6
        step = rate * (moment / (1 - 0.9**t)) / scale
        w -= step[:-2]
        w = np.sign(w) * np.maximum(np.abs(w) - rate * decay / scale[:-2], 0)
        bias = float(np.clip(bias - step[-2], -14, -7))  # a sentence without known words stays harmless, however many there are
        leak = float(np.clip(leak * np.exp(-step[-1]), 1e-4, 0.5))
    return w, bias, leak


def fit(sampled: pa.Table, steps: int = 250, decay: float = 3e-5, least_documents: int = 4, rate: float = 0.1) -> ToxicityModel:
    """Fits the noisy-or to a table (text, label). Features of fewer documents than least_documents get no weight."""
    label = np.asarray(sampled["label"], dtype=np.float64)
    if not len(label) or label.min() == label.max():
        return ToxicityModel(np.zeros(1 << BITS), -20.0, 0.0)
    words, codes, number, first = sentence_words(sampled["text"])
    owned = [word_features(w) for w in words]
    flat = np.fromiter((x for f in owned for x in f), np.int32)
    sizes = np.array([len(f) for f in owned], np.int64)
    del words, owned
    n = np.diff(first)
    doc = np.repeat(np.arange(len(label)), n)[number]

    def parts(flat: np.ndarray, sizes: np.ndarray):
        """(rows, features) of the words, block by block: a feature for each word's part is long."""
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for low in range(0, len(codes), 200_000):
            own = codes[low : low + 200_000]
            times = sizes[own]
            at = np.repeat(starts[own] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
            yield np.repeat(np.arange(low, low + len(own)), times), flat[at]

    documents_with = np.zeros(1 << BITS, np.int64)
    last = np.full(1 << BITS, -1, np.int64)  # a block may end within a document
    for row, feature in parts(flat, sizes):
        seen = np.unique(doc[row] << BITS | feature)
        owner, feature = seen >> BITS, seen & ((1 << BITS) - 1)
        fresh = last[feature] != owner
        documents_with += np.bincount(feature[fresh], minlength=1 << BITS)
        last[feature] = owner
    kept = documents_with >= least_documents
    vocabulary = np.flatnonzero(kept)
    place = np.cumsum(kept) - 1
    word_of = np.repeat(np.arange(len(sizes)), sizes)[kept[flat]]
    flat, sizes = place[flat[kept[flat]]].astype(np.int32), np.bincount(word_of, minlength=len(sizes))
    blocks = [(number[row].astype(np.int32), feature) for row, feature in parts(flat, sizes)]
    sentence, feature = (np.concatenate([b[i] for b in blocks] or [np.zeros(0, np.int32)]) for i in (0, 1))
    del blocks
    w, bias, leak = _descend(label, n, sentence, feature, len(vocabulary), steps, decay, rate)
    weights = np.zeros(1 << BITS)
    weights[vocabulary] = w
    return ToxicityModel(weights, bias, leak)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_labelled: int) -> DataFrame:
    """(text, label) of at most max_labelled labelled rows outside the held-out fold, those least by a hash of the id."""
    chosen = labels.where(~held_out() & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labelled)
    return docs.join(F.broadcast(chosen), "doc_id").select("text", "label")


OFFENDING = "array<struct<sentence:int,start:int,end:int,text:string,score:double>>"


def score(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, score, offending) of documents (doc_id, text): the sentences that score at least `least` by themselves, without the
    leak; code points, end exclusive."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    enough = -np.log1p(-min(least, 1 - 1e-12))

    def run(batches):
        for batch in gathered(batches, 1):
            each, first = shared.value.evidence(batch.column(1))
            found = [[] for _ in range(batch.num_rows)]
            high = np.flatnonzero(each >= enough)  # few, so their texts alone are cut in Python
            owner = np.searchsorted(first, high, side="right") - 1
            for i in np.unique(owner).tolist():
                text = batch.column(1)[i].as_py()
                spans = sentence_spans(text)
                for j in (high[owner == i] - first[i]).tolist():
                    a, b = spans[j]
                    found[i].append({"sentence": j, "start": a, "end": b, "text": text[a:b], "score": float(-np.expm1(-each[first[i] + j]))})
            kind = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(shared.value.document_scores(each, first)), "offending": pa.array(found, kind)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, score double, offending {OFFENDING}")


def offending_sentences(docs: DataFrame, model: ToxicityModel, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, start, end, text, score): a row for each sentence that scores at least `least`."""
    return score(docs, model, least).select("doc_id", F.explode("offending").alias("o")).select("doc_id", "o.*")


def op2_toxicity(spark: SparkSession, sf_dir: str, max_labelled: int = 4_000) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = fit(training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", max_labelled).toArrow())
    places = F.concat_ws(",", F.transform("offending", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"), places.alias("offending"))
