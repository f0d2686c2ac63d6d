"""Operator 6: quality classifier by Bradley-Terry pairwise ranking.

A document has features of its whole text (shares of kinds of characters, repetition, compression, word lengths). From
labelled documents, preference pairs (a document of label 1 over one of label 0) teach weights w by logistic loss on
feature differences: P(a over b) = sigmoid(w . (f(a) - f(b))). The verdict's threshold is a quantile of the scores of
the labelled documents: the share of label 0 among them. score = sigmoid(w . f - threshold).

Only fitting looks at a sample: at most `most_labelled` labelled rows, those with the smallest hash of their id (a
documented bound); scores are of all rows. Labels, ids and other columns are never features.

Defined cases: null text counts as empty and is scored like any other; repeated rows get equal scores; equal label rows
count once, conflicting labels of an id by the larger; null labels or ids teach nothing; with only one label, or none,
all scores are 0.5; empty table: empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, pick, small_batches

SIGNS = string.punctuation
_z = None


def features(text: str | None) -> np.ndarray:
    global _z
    _z = _z or zstandard.ZstdCompressor(level=1)
    t = text or ""
    n = max(len(t), 1)
    raw = t.encode()
    words = raw.split()
    nw = max(len(words), 1)
    size = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    distinct = len(set(words)) / nw
    pairs = len(set(zip(words, words[1:], strict=False))) / max(len(words) - 1, 1)
    ascii_hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)[:128] / max(len(raw), 1)
    signs = ascii_hist[[ord(c) for c in SIGNS]]
    lines = t.split("\n")
    upper = sum(map(bytes.isupper, words)) / nw
    ratio = len(raw) / max(len(_z.compress(raw)), 1)
    f = [
        np.log1p(len(words)), size.mean(), size.std(), distinct, pairs, ratio, np.log(ratio + 1e-3) - 0.12 * np.log1p(len(raw)),
        ascii_hist[65:91].sum(), ascii_hist[48:58].sum(), ascii_hist[97:123].sum(), signs.sum(), signs.max(initial=0), upper,
        1 - len(set(lines)) / len(lines), np.log1p(len(lines)) - np.log1p(nw), len(t.strip()) / n,
    ]
    return np.concatenate([f, np.sqrt(signs)])


class BradleyTerry:
    def __init__(self, mean, scale, weight, threshold):
        self.mean, self.scale, self.weight, self.threshold = mean, scale, weight, threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight - self.threshold
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, seed: int = 7) -> BradleyTerry:
    """Newton's method on the logistic loss of sampled preference pairs."""
    mean, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(1), np.ones(1))
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1] if len(x) else 1)
    if not len(good) or not len(bad):
        return BradleyTerry(mean, scale, w, 0.0)
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (p - 1) / pairs + ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    # the quantile of label 0's share; between its two neighbours
    k = min(len(bad), len(s) - 1)
    return BradleyTerry(mean, scale, w, float((s[k - 1] + s[k]) / 2))


def train(docs: DataFrame, labels: DataFrame, label: str, most_labelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> BradleyTerry:
    """labels: id_col and label (0 or 1) of the rows to learn from."""
    small_batches(docs.sparkSession)
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    lab = lab.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(most_labelled)
    # at most most_labelled rows of two numbers
    got = pick(docs, id=id_col, text=text_col).join(F.broadcast(lab), "id").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t).tolist() for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["y", "f"])

    rows = got.mapInArrow(given_back(run), "y int, f array<double>").collect()
    rows.sort(key=lambda r: (r.y, r.f))
    return fit(np.array([r.f for r in rows]), np.array([r.y for r in rows]))


def score(docs: DataFrame, model: BradleyTerry, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(1).to_pylist()]
            s = model.score(np.array(x)) if x and model.weight.any() else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    return d.mapInArrow(given_back(run), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double")


def keep(docs: DataFrame, model: BradleyTerry, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, with a score of 0.5 or more; all of them if nothing could be learned."""
    small_batches(docs.sparkSession)
    if not model.weight.any():
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(model.score(np.array(x)) >= 0.5)) if x else b

    return docs.mapInArrow(given_back(run), docs.schema)
