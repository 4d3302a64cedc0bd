"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages; only the document has a label. Each passage (its hashed words and some measures of its characters) is
encoded by one layer; gated attention, softmax(w . (tanh(V h) * sigmoid(U h))) over the document's passages, weighs the encodings, and
a logistic layer scores the weighted sum. All weights are learned together, by gradients through the attention, in one task from a bounded
sample of labelled rows, the first by a hash of their ids; scoring reads every passage of every text.

Defined cases: a null or empty text is one passage without words and is scored like any other; texts are scored whole; rows that repeat
a doc_id are scored row by row; labels other than 0 and 1, null ones and rows without a document don't take part; without both labels in the sample every
score is the share of label 1 (0.5 if there are none); an empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import release, small_batches

#: Most labelled rows that training reads, and the longest text among them: together they bound the training task's memory.
TRAINING_ROWS, TRAINING_CHARS = 4000, 1 << 16
PASSAGE_WORDS = 48
BUCKETS = 512
HIDDEN, GATE = 32, 16
#: Passages encoded at once.
CHUNK = 2048
_CLASSES = [b"#*$%&<>", b"|", b"!", b"?", b".", b",", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"\n", b"@:/\\_=~^", b"\"'()[]{}", bytes(range(128, 256))]
MEASURES = len(_CLASSES) + 5
_CLASS_OF = np.full(256, len(_CLASSES), "u1")
for _k, _x in enumerate(_CLASSES):
    _CLASS_OF[list(_x)] = _k


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None
    prior: float
    middle: np.ndarray
    spread: np.ndarray


def passages(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[np.ndarray], np.ndarray]]:
    """Runs of texts: (first row, first passage of each text, chunks of passage features (word counts and measures)). Every text has a passage."""
    for row, data, offsets in hashing.groups(texts):
        starts, ends, before = hashing.words(data, offsets)
        h = hashing.word_hashes(data, starts, ends)
        n_words = np.diff(before)
        count = np.maximum(1, -(-n_words // PASSAGE_WORDS))
        first = np.r_[0, np.cumsum(count)]
        text_of = np.repeat(np.arange(len(count)), count)
        word_from = before[text_of] + (np.arange(first[-1]) - first[text_of]) * PASSAGE_WORDS
        word_to = np.minimum(word_from + PASSAGE_WORDS, before[text_of + 1])
        byte_to = np.where(word_to < before[text_of + 1], np.r_[starts, 0][np.minimum(word_to, len(starts))], offsets[text_of + 1])
        byte_from = np.r_[0, byte_to[:-1]]
        yield row, first, [(data, h, starts, ends, word_from[k : k + CHUNK], word_to[k : k + CHUNK], byte_from[k : k + CHUNK], byte_to[k : k + CHUNK]) for k in range(0, first[-1], CHUNK)]


def features(chunk: tuple) -> np.ndarray:
    """(passages, BUCKETS + MEASURES) of one chunk of consecutive passages."""
    data, h, starts, ends, word_from, word_to, byte_from, byte_to = chunk
    n, a, b = len(word_from), int(word_from[0]), int(word_to[-1])
    size = word_to - word_from
    owner = np.repeat(np.arange(n), size)
    words = h[a:b]
    bucket = (words >> np.uint64(40)).astype("i8") % BUCKETS
    counts = np.bincount(owner * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype("f4")
    distinct = (counts > 0).sum(axis=1)
    lo, hi = int(byte_from[0]), int(byte_to[-1])
    kinds = len(_CLASSES) + 1
    by = np.repeat(np.arange(n), byte_to - byte_from)
    chars = np.bincount(by * kinds + _CLASS_OF[data[lo:hi]], minlength=n * kinds).reshape(n, kinds).astype("f4")
    length = np.maximum(1, byte_to - byte_from)[:, None]
    letters = np.bincount(owner, weights=(ends - starts)[a:b], minlength=n)
    one = np.maximum(1, size)
    same = np.bincount(owner[1:], weights=(words[1:] == words[:-1]) & (owner[1:] == owner[:-1]), minlength=n) if b > a else np.zeros(n)
    extra = np.stack([np.log1p(size), letters / one, distinct / one, same / one, (size == 0)], axis=1)
    counts /= np.maximum(1e-6, np.sqrt((counts * counts).sum(axis=1, keepdims=True)))
    return np.concatenate([counts, np.sqrt(chars[:, : len(_CLASSES)] / length), extra], axis=1).astype("f4")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def attention(e: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Softmax of e within each bag."""
    count = np.diff(first)
    x = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), count))
    return x / np.repeat(np.add.reduceat(x, first[:-1]), count)


def gradients(w: dict[str, np.ndarray], x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and gradients of one batch of bags."""
    count = np.diff(first)
    bag = np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
    a = attention((t * g) @ w["w"], first)
    z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
    p = sigmoid(z @ w["c"] + w["d"])
    loss = -(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).mean()
    ds = weight * (p - y) / len(y)
    dz = ds[:, None] * w["c"]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first[:-1])[bag])
    gate = de[:, None] * w["w"]
    dt, dg = gate * g * (1 - t * t), gate * t * g * (1 - g)
    dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
    return float(loss), {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}


class Bags:
    """Passage features of texts: word counts as (place, value) of what isn't zero, since most are."""

    def __init__(self, texts: pa.Array):
        sizes, counts, at, value, measures = [], [], [], [], []
        for _, first, chunks in passages(texts):
            sizes.append(np.diff(first))
            for c in chunks:
                x = features(c)
                row, column = np.nonzero(x[:, :BUCKETS])
                counts.append(np.bincount(row, minlength=len(x)))
                at.append(column.astype("u2")), value.append(x[row, column]), measures.append(x[:, BUCKETS:].copy())
        self.first = np.r_[0, np.cumsum(np.concatenate(sizes))]
        self.start = np.r_[0, np.cumsum(np.concatenate(counts))]
        self.at, self.value, self.measures = np.concatenate(at), np.concatenate(value), np.concatenate(measures)

    def dense(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passages, BUCKETS + MEASURES) of these texts, and where each begins."""
        first = np.r_[0, np.cumsum(self.first[texts + 1] - self.first[texts])]
        x = np.zeros((first[-1], BUCKETS + MEASURES), "f4")
        for row, a, b in zip(first[:-1], self.first[texts], self.first[texts + 1], strict=True):
            lo, hi = self.start[a], self.start[b]
            x[row + np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1])), self.at[lo:hi]] = self.value[lo:hi]
            x[row : row + b - a, BUCKETS:] = self.measures[a:b]
        return x, first


def train(texts: list[str | None], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 5) -> Model:
    """Adam over shuffled batches of documents."""
    y = np.asarray(labels, "f4")
    width = BUCKETS + MEASURES
    if not len(y) or y.min() == y.max():
        return Model(None, float(y.mean()) if len(y) else 0.5, np.zeros(width, "f4"), np.ones(width, "f4"))
    bags = Bags(pa.array(texts, pa.string()))
    middle, spread = np.zeros(width, "f4"), np.ones(width, "f4")
    middle[BUCKETS:], spread[BUCKETS:] = bags.measures.mean(axis=0), bags.measures.std(axis=0) + 1e-3
    bags.measures = (bags.measures - middle[BUCKETS:]) / spread[BUCKETS:]
    r = np.random.default_rng(seed)
    normal = lambda *s: (r.normal(size=s) / np.sqrt(s[0])).astype("f4")
    w = {"W": normal(width, HIDDEN), "b": np.zeros(HIDDEN, "f4"), "V": normal(HIDDEN, GATE), "U": normal(HIDDEN, GATE), "w": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1, "f4")}
    m, v, step = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2)), None, 0
    m, v = m
    for epoch in range(epochs):
        order = r.permutation(len(y))
        for k in range(0, len(order), batch):
            at = order[k : k + batch]
            _, g = gradients(w, *bags.dense(at), y[at], np.ones(len(at), "f4"))
            step += 1
            lr = rate * (1 - epoch / epochs) + 1e-4
            for n in w:
                grad = g[n] + decay * w[n]
                m[n] = 0.9 * m[n] + 0.1 * grad
                v[n] = 0.999 * v[n] + 0.001 * grad * grad
                w[n] = (w[n] - lr * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)).astype("f4")
    return Model(w, float(y.mean()), middle, spread)


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """A score for each text; of a text's passages only encodings and attention are held at once."""
    w = model.weights
    if w is None:
        return np.full(len(texts), model.prior)
    out = np.empty(len(texts))
    for row, first, chunks in passages(texts):
        h = [np.tanh(((features(c) - model.middle) / model.spread) @ w["W"] + w["b"]) for c in chunks]
        e = np.concatenate([(np.tanh(x @ w["V"]) * sigmoid(x @ w["U"])) @ w["w"] for x in h])
        a = attention(e, first)
        z = np.add.reduceat(a[:, None] * np.concatenate(h), first[:-1], axis=0)
        out[row : row + len(first) - 1] = sigmoid(z @ w["c"] + w["d"])
    return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Rows that learning leaves out: crc32 of the id as text, modulo folds, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    texts, labels = [], []
    for b in batches:
        texts += b["text"].to_pylist()
        labels += b["label"].to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(labels)))], pa.binary())], ["model"])
    del texts
    release()


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAINING_ROWS, chars: int = TRAINING_CHARS) -> Model:
    """A model from at most `rows` labelled documents that aren't held out, the first by a hash of doc_id. One task reads them and only the weights come to the driver."""
    known = labels.where(F.col(f"`{label}`").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("__id")).agg(F.max(f"`{label}`").alias("label"))
    share = min(1.0, 1.2 * rows / max(1, known.count()))
    order = F.pmod(F.xxhash64("__id"), F.lit(1 << 30))
    picked = known.where(order < int(share * (1 << 30))).withColumn("order", order)  # a bounded table, as rows is a bound
    d = small_batches(docs).select(F.col("doc_id"), F.col("text")).where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    found = d.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("order", "doc_id", "text", "label").orderBy("order", "doc_id", "text").limit(rows)
    made = found.select("text", "label").coalesce(1).mapInArrow(_trained, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else train([], np.empty(0))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with the column out: the probability of label 1."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(scores(shared.value, texts))

    return docs.withColumn(out, scored(F.col(f"`{text}`")))


def _reported(shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores(shared.value, b["text"]))], ["doc_id", "score"])


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(fit(docs, labels))
    found = docs.select("doc_id", "text").mapInArrow(partial(_reported, shared), "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def _kept(shared, text: str, threshold: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        yield b.filter(pa.array(scores(shared.value, b[text]) >= threshold))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of docs that score threshold or more; batches are filtered where they are scored."""
    shared = small_batches(docs).sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_kept, shared, text, threshold), docs.schema)
