"""Toxicity: bags of subwords, embedded and averaged into a linear softmax, all trained jointly in numpy.

A word's features are itself and its character n-grams, hashed into buckets, so a misspelt word still shares most
of its vectors with the word that it comes from. A text's vector is the mean over all features of all its words,
and a few without evidence.
As the softmax is linear, each feature's vector adds one number to the difference of the two classes' scores;
scoring therefore needs one number a word, which tasks keep for words seen before.
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

WORDS = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    """buckets: hashed features. dim: length of the vectors. per_class: the bound on labelled rows of each class that are fitted."""

    buckets: int = 1 << 17
    dim: int = 8
    per_class: int = 2000
    epochs: int = 12
    batch: int = 64
    rate: float = 0.02
    decay: float = 1e-6
    ngrams: tuple[int, int] = (3, 5)
    #: Features without any evidence that every text gets besides its own, so that a few words don't decide by themselves.
    prior: float = 200.0
    #: The toxic rows' share of the loss.
    toxic_share: float = 0.4
    #: By how much the mean of the vectors is stretched before the softmax.
    scale: float = 30.0
    seed: int = 7


def features(word: str, s: Settings) -> list[int]:
    """The buckets of a word: itself and its n-grams, with < and > at its ends."""
    marked = f"<{word}>"
    n = len(marked)
    grams = {marked[i : i + k] for k in range(s.ngrams[0], s.ngrams[1] + 1) for i in range(n - k + 1)} | {marked}
    return sorted(zlib.crc32(g.encode()) * 0x9E3779B1 % 0xFFFFFFFB % s.buckets for g in grams)


def counted(text: str | None) -> tuple[list[str], np.ndarray]:
    found: dict[str, int] = {}
    for w in WORDS.findall((text or "").lower()):
        found[w] = found.get(w, 0) + 1
    return list(found), np.array(list(found.values()), np.float64)


@dataclass
class Model:
    """weight: what each bucket adds to the difference of the class scores; bias: the rest of it."""

    weight: np.ndarray
    bias: float
    settings: Settings

    def word(self, word: str) -> tuple[float, int]:
        f = features(word, self.settings)
        return float(self.weight[f].sum()), len(f)


def train(texts: list[str | None], toxic: list[int], s: Settings) -> Model:
    """Embeddings and softmax by Adam on the cross entropy, each class with its share of the weight. Without rows of both classes: a constant score."""
    y = np.asarray(toxic, np.float64)
    rng = np.random.default_rng(s.seed)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(s.buckets, np.float32), 0.0 if not len(y) else (4.0 if y[0] else -4.0), s)
    known: dict[str, np.ndarray] = {}
    docs = []
    for t in texts:
        words, count = counted(t)
        for w in words:
            if w not in known:
                known[w] = np.array(features(w, s), np.int32)
        if words:
            sizes = np.array([len(known[w]) for w in words])
            ids, place = np.unique(np.concatenate([known[w] for w in words]), return_inverse=True)
            weight = np.bincount(place, np.repeat(count, sizes))
            docs.append((ids.astype(np.int32), (weight / (weight.sum() + s.prior)).astype(np.float32)))
        else:
            docs.append((np.zeros(1, np.int32), np.zeros(1, np.float32)))
    table = np.zeros((s.buckets, s.dim), np.float32)  # features that no text had stay without evidence
    out = rng.normal(0, 0.3, (s.dim, 2)).astype(np.float32)
    # Fixed at the classes' shares of the loss, so that no evidence is never taken for toxic.
    bias = np.array([0.0, np.log(s.toxic_share / (1 - s.toxic_share))], np.float32)
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, out)]
    share = np.where(y > 0, s.toxic_share / y.mean(), (1 - s.toxic_share) / (1 - y.mean()))
    scale, step, total = s.scale, 0, s.epochs * -(-len(docs) // s.batch)

    def adam(param, grad, k, rows=None):
        m, v = state[k]
        if rows is None:
            m *= 0.9
            v *= 0.99
            m += 0.1 * grad
            v += 0.01 * grad * grad
            param -= lr * m / (np.sqrt(v) + 1e-8)
            return
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        param[rows] -= lr * (m[rows] / (np.sqrt(v[rows]) + 1e-8) + s.decay * param[rows])

    for _ in range(s.epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), s.batch):
            lr = s.rate * (1 - step / total) + 1e-5
            step += 1
            rows = order[at : at + s.batch]
            starts = np.cumsum([0, *(len(docs[i][0]) for i in rows[:-1])])
            ids, weight = np.concatenate([docs[i][0] for i in rows]), np.concatenate([docs[i][1] for i in rows])
            hidden = scale * np.add.reduceat(table[ids] * weight[:, None], starts, axis=0)
            logits = hidden @ out + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows].astype(int)] -= 1
            p *= (share[rows] / len(rows))[:, None]
            p = p.astype(np.float32)
            back = scale * p @ out.T
            sizes = np.diff([*starts, len(ids)])
            used, place = np.unique(ids, return_inverse=True)
            per = np.repeat(back, sizes, axis=0) * weight[:, None]
            grad = np.stack([np.bincount(place, per[:, d], len(used)) for d in range(s.dim)], 1).astype(np.float32)
            adam(out, hidden.T @ p, 1)
            adam(table, grad, 0, used)
    side = out[:, 1] - out[:, 0]
    return Model((scale * table @ side).astype(np.float32), float(bias[1] - bias[0]), s)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on at most settings.per_class rows of each label: those with the least hash of their id, so that reruns agree.

    Rows with equal ids count as one, with the least of their texts, so that per_class bounds what comes to the driver.
    labels: (id, label), labels other than 0 and 1, nulls and ids without a document are left out; of an id's labels the greatest counts.
    Only ids are sorted, of about twice as many rows as are wanted; the texts of those picked come to the driver by a broadcast of their ids.
    """
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    key = F.xxhash64(F.col("id").cast("string"), F.lit(settings.seed))
    counts = dict(one.groupBy("y").count().collect())
    picked = []
    for y, n in counts.items():
        share = min(1.0, 2.0 * settings.per_class / n + 1e-4)
        near = one.where((F.col("y") == y) & (F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30))))
        picked += near.orderBy(F.pmod(key, F.lit(1 << 30)), "id").limit(settings.per_class).collect()
    spark = docs.sparkSession
    ids = spark.createDataFrame(picked, one.schema) if picked else one.limit(0)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted(found, key=lambda r: (r.y, str(r.id)))
    return train([r.text for r in rows], [r.y for r in rows], settings)


class Scored(dict):
    """Word to the place of its numbers."""

    LIMIT = 500_000

    def __init__(self, model: Model):
        self.model = model
        self.renew()

    def renew(self) -> None:
        self.clear()
        self.total, self.n = np.zeros(1 << 12), np.zeros(1 << 12)

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i == len(self.n):
            self.total, self.n = (np.concatenate([x, np.zeros(len(x))]) for x in (self.total, self.n))
        self.total[i], self.n[i] = self.model.word(word)
        self[word] = i
        return i

    def score(self, text: str | None) -> float:
        if len(self) > self.LIMIT:
            self.renew()
        words = WORDS.findall((text or "").lower())
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        z = self.model.bias + self.total[at].sum() / (self.n[at].sum() + self.model.settings.prior)
        return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each row, from its text alone: score from 0 to 1, predicted 1 from 0.5 on.

    Null texts and texts without a word get the score of no evidence. Rows are independent, so repeated ids give repeated
    rows; other columns are not read. The model travels as one number a bucket: 0.5 MB, whatever the corpus.
    """
    weight, bias, settings = model.weight, model.bias, model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(Model(weight, bias, settings))
        for batch in batches:
            out = np.array([scored.score(t) for t in batch.column(1).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not predicted toxic. One pass without a shuffle."""
    weight, bias, settings = model.weight, model.bias, model.settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = Scored(Model(weight, bias, settings))
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([scored.score(t) < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
