"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in the sum of its words'
weights; a word's weight is the sum of the hashed weights of its beginnings, so that unseen
words are scored too. The sentences' probabilities are combined by
noisy-or, and only documents' labels train the weights. The sentences that are toxic on their own
are then located.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fold_of, text_of

BITS = 18
#: Bounds of the training sample: labelled documents of either class, and their length in code points.
SAMPLE = 2500
SAMPLE_CHARS = 20_000
SENTENCE = re.compile(r"[^.!?\n]+")
#: Words whose weights a task remembers.
REMEMBERED = 300_000
SEED = 11


def word_features(word: str) -> list[int]:
    """Hashed features of a word: its beginnings of 3 to 6 characters; shorter words have none."""
    mask = (1 << BITS) - 1
    return [zlib.crc32(word[:k].encode("utf-8", "surrogatepass")) & mask for k in range(3, min(6, len(word)) + 1)]


def words_of(sentence: str) -> list[str]:
    return [w for x in sentence.split() if (w := x.strip(",;:()\"'|#*$%&<>"))]


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Weights of hashed word features and the sentences' bias."""

    weights: np.ndarray
    bias: float

    def word(self, word: str) -> float:
        return float(self.weights[word_features(word)].sum())


class Scorer:
    """Scores texts with a model, remembering words' weights."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            got = self.known[word] = self.model.word(word)
        return got

    def text(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability and the sentences of at least 1/2, as (start, end, probability)."""
        weight, bias = self.weight, self.model.bias
        spans, logits = [], []
        for m in SENTENCE.finditer(text):
            words = words_of(m.group().lower())
            if words:
                logits.append(bias + sum(map(weight, words)))
                spans.append(m.span())
        if not logits:
            return 0.0, []
        z = np.clip(np.array(logits), -30, 30)
        calm = -np.logaddexp(0.0, z).sum()  # log of the chance that no sentence is toxic
        return float(-np.expm1(calm)), [(*spans[i], float(sigmoid(z[i]))) for i in np.flatnonzero(z >= 0)]


def train(texts: list[str], labels: list[int], epochs: int = 200, rate: float = 0.3, decay: float = 1e-5, least: int = 5, weight: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Full-batch gradient descent on the noisy-or likelihood of the documents' labels.

    Features of fewer than `least` documents aren't used; the others are scaled by their inverse
    document frequency, so that the words all sentences share don't drown the rest. Steps are
    averaged with momentum and scaled by the largest recent gradient.
    """
    weights, bias = np.zeros(1 << BITS), -4.0
    ids: dict[str, int] = {}
    word_at, word_sentence, sentence_doc = [], [], []
    for d, text in enumerate(texts):
        for m in SENTENCE.finditer(text):
            words = words_of(m.group().lower())
            if words:
                word_at.extend(ids.setdefault(w, len(ids)) for w in words)
                word_sentence.extend([len(sentence_doc)] * len(words))
                sentence_doc.append(d)
    if not sentence_doc or len(set(labels)) < 2:
        return Model(weights, -12.0 if not any(labels) else 0.0)
    lists = [word_features(w) for w in ids]
    feature = np.concatenate([np.array(x, np.int64) for x in lists])
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    at, sentence, doc = np.array(word_at), np.array(word_sentence), np.array(sentence_doc)
    y, n_docs, n_sentences = np.array(labels, float), len(texts), len(sentence_doc)
    each = np.where(y > 0, weight[1], weight[0])  # of the clean and the toxic: what one document of the sample stands for
    # document frequencies of features, by way of the distinct words of each document
    pairs = np.unique(doc[sentence] * len(ids) + at)
    begins = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    frequency = np.zeros(len(weights))
    for _, words in zip(*np.unique(pairs // len(ids), return_counts=True), strict=True):
        mine, pairs = pairs[:words] % len(ids), pairs[words:]
        held = [feature[begins[w] : begins[w + 1]] for w in mine]
        frequency[np.unique(np.concatenate(held))] += 1
    scale = np.where(frequency >= least, np.log((1.0 + n_docs) / (1.0 + frequency)), 0.0)
    used = scale[feature] > 0
    feature, owner = feature[used], owner[used]
    value = scale[feature]
    mean, largest = np.zeros(len(weights) + 1), 0.0
    for step in range(1, epochs + 1):
        word_weight = np.bincount(owner, weights[feature] * value, len(ids))
        z = np.clip(bias + np.bincount(sentence, word_weight[at], n_sentences), -30, 30)
        calm = np.bincount(doc, -np.logaddexp(0.0, z), n_docs)
        p = np.clip(-np.expm1(calm), 1e-9, 1.0)
        # d(-log likelihood)/d z: the sentence's own probability times what the label asks of its document
        pull = np.where(y > 0, -(1.0 - p) / p, 1.0)
        dz = sigmoid(z) * pull[doc] * each[doc] / each.sum()
        dword = np.bincount(at, dz[sentence], len(ids))
        gradient = np.append(np.bincount(feature, dword[owner] * value, len(weights)) + decay * weights, dz.sum())
        mean = 0.9 * mean + 0.1 * gradient
        largest = 0.99 * largest + 0.01 * float((gradient**2).max())
        move = rate * mean / np.sqrt(largest / (1 - 0.99**step) + 1e-30)
        weights, bias = weights - move[:-1], bias - float(move[-1])
    return Model(weights * scale, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Trains on labelled documents of folds 1 to 4: the first `sample` of either class by a hash, of at most `chars` code points.

    Rows whose id or label is null, or that are labelled both ways, aren't used.
    """
    known = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
    known = known.filter((F.col("toxic") == F.col("_most")) & (fold(F.col("doc_id")) != 0)).drop("_most")
    # the hash thins the larger class before its texts are read; what is kept is bounded by `sample`
    wanted = []
    every = {int(r[0]): r[1] for r in known.groupBy("toxic").count().collect()}
    for label in (1, 0):
        wanted += known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample).collect()
    truth = {r[0]: int(r[1]) for r in wanted}
    if not truth:
        return Model(np.zeros(1 << BITS), -12.0)
    spark = docs.sparkSession
    chosen = F.broadcast(spark.createDataFrame([(k,) for k in truth], "doc_id long"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.length("text") <= chars).join(chosen, "doc_id")
    texts = sorted(rows.dropDuplicates(["doc_id"]).limit(2 * sample).collect())
    taken = list(truth.values())
    weight = tuple(every.get(c, 0) / max(1, taken.count(c)) for c in (0, 1))
    return train([r[1] for r in texts], [truth[r[0]] for r in texts], weight=weight)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, offending): offending has (start, end, score) of the toxic sentences.

    A text without words, empty or null has the score 0. Very long texts are scored whole, repeated
    rows each; an empty table gives no rows, and other columns, whatever their names, aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    schema = "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            got = [scorer.text(t.as_py()) for t in batch.column(1)]
            scores = [s for s, _ in got]
            spans = [[{"start": a, "end": b, "score": p} for a, b, p in x] for _, x in got]
            columns = [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted", "offending"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def keep_calm(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns; scored in place, nothing is joined. Null and empty texts stay, repeated rows are judged alike."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for batch in batches:
            yield batch.filter(pa.array([scorer.text(t.as_py() or "")[0] < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


__all__ = ["Model", "Scorer", "fit", "fold_of", "keep_calm", "score", "train"]
