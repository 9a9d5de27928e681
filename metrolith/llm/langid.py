"""Language identification by nearest centroids.

A text's letters are lower-cased, everything else becomes a space, and its
character 1-, 2- and 3-grams are hashed to ``BUCKETS`` features.  Damped counts
times inverse document frequencies, at length one, are compared by cosine with
several centroids of each language; the nearest centroid names the language.  A
text whose nearest centroid is farther than its language's limit is rejected.

Centroids come from spherical k-means on a bounded sample (``SAMPLE`` documents
of each language, a documented bound, chosen by a hash of id and text) of documents
that are not held out; whole texts are read.

Defined cases: null texts and texts without a letter are ``und`` with score 0 and
rejected; ties between centroids go to the language that sorts first; null
languages are not learned from; with nothing to learn from every text is
``und``; rows that repeat an id or have none are told apart by their text and each
get a row; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import checked, held_out, keep_rows, per_document

BUCKETS = 1 << 13
SAMPLE = 300
CENTROIDS = 4
#: A language's limit lies in the gap between the similarity that 95 in a hundred
#: sampled texts of other languages stay below and the one that 99 in a hundred of
#: its own exceed: this share of the gap above the former, at most the second share
#: of the latter (a stray label can close the gap).  A language learned alone has
#: no gap; its limit is the third share of its own similarity.
GAP_SHARE, MOST_SHARE, LONE_SHARE = 0.25, 0.75, 0.5
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a text; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letters = _letters()[points]
    if not letters.any():
        return None
    spaced = np.where(letters, points, 32).astype(np.uint32)
    keep = letters.copy()
    keep[1:] |= letters[:-1]  # of each run of other characters one space stays
    c = np.concatenate([[32], spaced[keep], [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    with np.errstate(over="ignore"):
        h = c * np.uint32(0x9E3779B1)
        for n in (1, 2, 3):
            if n > 1:
                if len(h) < 2:
                    break
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[n - 1 :] * np.uint32(0x9E3779B1)
            out += np.bincount((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1), minlength=BUCKETS)
    return out


def normalised(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (np.sqrt(count) * idf).astype(np.float32)
    return v / max(1e-12, float(np.linalg.norm(v)))


def k_means(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means; starts from the farthest-point choice, so it has no randomness."""
    mean = x.mean(axis=0)
    centres = [mean / max(1e-12, np.linalg.norm(mean))]
    near = x @ centres[0]
    while len(centres) < min(k, len(x)):
        centres.append(x[int(np.argsort(near, kind="stable")[len(near) // 20])])
        near = np.maximum(near, x @ centres[-1])
    c = np.stack(centres)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


class LanguageModel:
    def __init__(self, languages: list[str], of: np.ndarray, centroids: np.ndarray, idf: np.ndarray, limits: np.ndarray):
        self.languages, self.of, self.centroids, self.idf, self.limits = languages, of, centroids, idf, limits

    def predict(self, text: str) -> tuple[str, float, bool]:
        """(language, cosine with the nearest centroid, rejected)."""
        count = counts(text) if text else None
        if count is None or not self.languages:
            return UNKNOWN, 0.0, True
        near = self.centroids @ normalised(count, self.idf)
        best = int(np.argmax(near))
        language = int(self.of[best])
        score = float(np.clip(near[best], 0.0, 1.0))
        return self.languages[language], score, score < self.limits[language]


def train(samples: dict[str, list[np.ndarray]], centroids: int = CENTROIDS) -> LanguageModel:
    """A model from the n-gram counts of each language's sample."""
    languages = sorted(k for k, v in samples.items() if v)
    total = sum(len(samples[k]) for k in languages)
    seen = np.zeros(BUCKETS)
    for k in languages:
        for c in samples[k]:
            seen[c[0]] += 1
    idf = np.log((1 + total) / (1 + seen)) + 0.05
    of, parts, texts = [], [], []
    for i, k in enumerate(languages):
        x = np.zeros((len(samples[k]), BUCKETS), dtype=np.float32)
        for row, (at, value) in zip(x, samples[k], strict=True):
            row[at] = np.sqrt(value) * idf[at]
            row /= max(1e-12, float(np.linalg.norm(row)))
        c = k_means(x, centroids)
        of += [i] * len(c)
        parts.append(c)
        texts.append(x)
    limits = []
    for i, c in enumerate(parts):
        near = [(x @ c.T).max(axis=1) for x in texts]
        own, others = float(np.quantile(near[i], 0.01)), near[:i] + near[i + 1 :]
        if others:
            other = float(np.quantile(np.concatenate(others), 0.95))
            limits.append(min(other + GAP_SHARE * max(0.0, own - other), MOST_SHARE * own))
        else:
            limits.append(LONE_SHARE * own)
    stacked = np.concatenate(parts) if parts else np.zeros((0, BUCKETS), dtype=np.float32)
    return LanguageModel(languages, np.array(of, dtype=int), stacked.astype(np.float32), idf, np.array(limits))


def fit(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str = "lang",
    sample: int = SAMPLE,
    centroids: int = CENTROIDS,
) -> LanguageModel:
    """Learn from a bounded sample of each language, leaving out held-out documents."""
    known = docs.where(F.col(language_column).isNotNull() & ~held_out(id_column)).select(
        F.col(id_column).alias("_id"), F.col(language_column).alias("_l"), F.col(text_column).alias("_t")
    )
    shares = known.groupBy("_l").count().select("_l", (F.lit(2.0 * sample) / F.col("count")).alias("_share"))
    shares = checked(shares, "language-shares")
    hashed = F.shiftrightunsigned(F.xxhash64("_id", "_t", F.lit(11)), 1) / F.lit(2.0**63)
    rows = known.join(shares, "_l").where(hashed < F.col("_share"))
    samples: dict[str, list] = {}
    for r in rows.select(F.xxhash64("_id", "_t").alias("_h"), "_l", "_t").toLocalIterator():
        held = samples.setdefault(r[1], [])
        count = counts(r[2] or "")
        if count is not None:
            at = np.flatnonzero(count)
            held.append((r[0], at, count[at]))
    chosen = {k: [(a, c) for _, a, c in sorted(v, key=lambda x: x[0])[:sample]] for k, v in samples.items()}
    return train(chosen, centroids)


def languages(docs: DataFrame, model: LanguageModel, id_column="doc_id", text_column="text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(texts):
        found = [shared.value.predict(t) for t in texts]
        return {
            "lang_pred": pa.array([f[0] for f in found], pa.string()),
            "score": pa.array([f[1] for f in found], pa.float64()),
            "rejected": pa.array([f[2] for f in found], pa.bool_()),
        }

    return per_document(docs, rows, "lang_pred string, score double, rejected boolean", id_column, text_column)


def accepted(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The documents whose language is accepted, with all their columns; one pass, no join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda texts: [not shared.value.predict(t)[2] for t in texts], text_column)
