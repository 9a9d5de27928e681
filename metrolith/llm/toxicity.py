"""Toxicity by subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word is its own bucket and those of its character n-grams (3 to 5, with
boundary marks); a text is the average of the embeddings of all its subwords; a
two-class linear softmax reads the average.  Embeddings and softmax are trained
together by Adam on the driver, so an unseen misspelling gets the vectors of the
n-grams that it shares with seen words.

Training sees at most ``SAMPLE`` labelled documents of each class (a documented
bound), chosen by a hash of the id, with class weights that restore the class
shares of all labelled rows; their whole texts are read.  A quarter of the sample
is kept for fitting the slope and offset of the final logistic scale.

Because the softmax is linear in an average, a word's part of a score is one
number; scoring looks it up for each word of the whole text.

Defined cases: null and empty texts score the model's offset; labels other than
0 and 1, null ids and rows without a document are not learned from; a document
labelled more than once counts once (the largest label), and so does one whose
id repeats (the least text); with no labelled row of
some class every score is the share of class 1 (0 without labels); repeated rows
each get a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, per_document

BUCKETS = 1 << 14
DIMENSIONS = 16
NGRAMS = (3, 4, 5)
SAMPLE = 1200
EPOCHS = 60
THRESHOLD = 0.3
REMEMBERED = 400_000
#: Tokens whose subwords the driver remembers while it reads the sample.
REMEMBERED_IN_FIT = 50_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def subwords(token: str) -> list[int]:
    """The buckets of a token: of the word and of its character n-grams."""
    word = f"<{token.lower().strip(PUNCTUATION)}>"
    if len(word) == 2:
        return []
    pieces = [word] + [word[i : i + n] for n in NGRAMS for i in range(len(word) - n + 1) if n < len(word)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in pieces]


class _Parts(dict):
    """token -> (sum of its subwords' values, their number)."""

    def __init__(self, values: np.ndarray):
        super().__init__()
        self.values = values.tolist()

    def __missing__(self, token):
        found = subwords(token)
        v = self.values
        part = (sum([v[i] for i in found]), len(found))
        if len(self) >= REMEMBERED:
            self.clear()
        self[token] = part
        return part


class ToxicityModel:
    """Values of the buckets, and a logistic scale."""

    def __init__(self, values: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.values, self.bias, self.slope, self.offset = values, bias, slope, offset
        self._parts = None

    def __getstate__(self):
        return {**self.__dict__, "_parts": None}

    def raw(self, text: str) -> float:
        if self._parts is None:
            self._parts = _Parts(self.values)
        parts = list(map(self._parts.__getitem__, text.split()))
        n = sum([p[1] for p in parts])
        return self.bias + (sum([p[0] for p in parts]) / n if n else 0.0)

    def score(self, text: str) -> float:
        z = self.slope * self.raw(text) + self.offset
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -50, 50))))


def bag(text: str, memory: dict) -> np.ndarray:
    """The average subword bag of a text over all buckets."""
    out = np.zeros(BUCKETS, dtype=np.float32)
    found: list[int] = []
    # A long text's subwords are counted piece by piece.
    total = 0
    for token in text.split():
        if token not in memory:
            memory[token] = subwords(token)
        found += memory[token]
        if len(found) > 100_000:
            out += np.bincount(found, minlength=BUCKETS)
            total += len(found)
            found = []
    out += np.bincount(np.array(found, dtype=np.int64), minlength=BUCKETS)
    return out / max(1, total + len(found))


def train(bags: np.ndarray, labels: np.ndarray, weights: np.ndarray, fit: int, seed: int = 7) -> ToxicityModel:
    """Embeddings and softmax, jointly, by full-batch Adam on the first ``fit`` rows; scales ``bags`` in place."""
    random = np.random.default_rng(seed)
    x, y, w = bags[:fit], labels[:fit], (weights[:fit] / weights[:fit].sum()).astype(np.float32)
    scale = (1.0 / (np.sqrt(np.einsum("ij,ij->j", x, x) / len(x)) + 1e-4)).astype(np.float32)
    bags *= scale
    table = random.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    head = random.normal(0, 0.3, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (table, head, bias)]
    onehot = np.eye(2, dtype=np.float32)[y]
    for step in range(1, EPOCHS + 1):
        hidden = x @ table
        logits = hidden @ head + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) * w[:, None]
        grads = (x.T @ (g @ head.T) + 1e-6 * table, hidden.T @ g, g.sum(axis=0))
        for (m, v), value, grad in zip(state, (table, head, bias), grads, strict=True):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            rate = 0.01 / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            value -= rate * m / (1 - 0.9**step)
    difference = table @ (head[:, 1] - head[:, 0])
    model = ToxicityModel((difference * scale).astype(np.float64), float(bias[1] - bias[0]))
    # Logistic scale on the rows that were kept back, by Newton's method.
    z, t, u = (bags[fit:] @ difference).astype(np.float64) + model.bias, labels[fit:], weights[fit:]
    if len(set(t.tolist())) == 2:
        beta = np.array([0.0, np.log((t * u).sum() / ((1 - t) * u).sum())])
        spread = z.std() + 1e-9
        design = np.stack([(z - z.mean()) / spread, np.ones_like(z)], axis=1)
        for _ in range(25):
            q = 1 / (1 + np.exp(-design @ beta))
            hessian = (design * (u * q * (1 - q))[:, None]).T @ design + 1e-3 * np.eye(2)
            beta += np.linalg.solve(hessian, design.T @ (u * (t - q)) - 1e-3 * beta * [1, 0])
        model.slope, model.offset = float(beta[0] / spread), float(beta[1] - beta[0] * z.mean() / spread)
    return model


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label_column: str = "toxic",
    id_column: str = "doc_id",
    text_column: str = "text",
    sample: int = SAMPLE,
) -> ToxicityModel:
    """Train on a bounded sample of the labelled rows that are not held out."""
    known = (
        labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max(label_column).cast("int").alias("_y"))
    )
    texts = docs.select(F.col(id_column).alias("_d"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"))
    shares = {r[0]: r[1] for r in known.groupBy("_y").count().collect()}
    if len(shares) < 2:
        share = 1.0 if 1 in shares else 0.0
        return ToxicityModel(np.zeros(BUCKETS), 50.0 if share else -50.0)
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample)
        chosen = part if chosen is None else chosen.union(part)
    rows = texts.join(F.broadcast(chosen), F.col("_d") == F.col("_id")).select("_id", "_y", "_text")
    # Rows for fitting are filled from the front, rows kept back from the end.
    size = sum(min(sample, n) for n in shares.values())
    bags, y = np.zeros((size, BUCKETS), dtype=np.float32), np.zeros(size, dtype=int)
    front, back, memory = 0, size, {}
    rows = rows.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).orderBy("_id")
    for r in rows.toLocalIterator():
        if zlib.crc32(f"kept {r[0]}".encode()) % 4 == 3:
            back -= 1
            at = back
        else:
            at = front
            front += 1
        bags[at], y[at] = bag(r[2], memory), r[1]
        if len(memory) > REMEMBERED_IN_FIT:
            memory.clear()
    if front < back:  # labelled rows without a document
        y = np.delete(y, slice(front, back))
        bags = np.delete(bags, slice(front, back), axis=0)
    if len(set(y[:front].tolist())) < 2:
        return ToxicityModel(np.zeros(BUCKETS), 50.0 if y.any() else -50.0)
    counts = np.bincount(y, minlength=2)
    weights = np.array([shares[0] / counts[0], shares[1] / counts[1]])[y]
    return train(bags, y, weights, front)


def toxicity(docs: DataFrame, model: ToxicityModel, id_column="doc_id", text_column="text", threshold=THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every document, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts):
        score = np.array([shared.value.score(t) for t in texts], dtype=np.float64)
        return {"score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))}

    return per_document(docs, rows, "score double, predicted int", id_column, text_column)
