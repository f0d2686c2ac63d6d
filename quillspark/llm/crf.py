"""Operator 9: toxicity by a linear-chain conditional random field over tokens.

Tags: O and T (toxic). Documents carry the labels, so tokens get theirs from them: a token of a toxic document is T if
its word or one of its prefixes is strongly tied to toxic documents (smoothed log-odds over the training documents).
The field has weights for words, prefixes, word shape and the four transitions; forward-backward gives each token's
marginal of T. A document's score comes from the expected number of toxic tokens, the largest marginal and the length
by logistic regression on the training documents; spans are runs of tokens with a marginal of half or more.
A sequence ends at . ! or ? or after LONGEST tokens; every token of a text is in one.

Only fitting looks at a sample: at most `most_toxic` and `most_clean` labelled rows, those with the smallest hash of
their id. Ties of features to toxicity and the regression of scores are of all of these; the field's weights are of all
sequences of at most FIELD of them of either label, drawn with a fixed seed. Everything else is of all rows, each on its own.

Defined cases: null or empty text has no tokens and is scored like any other; repeated rows get equal scores; equal label
rows count once, conflicting labels of an id by the larger; null labels or ids teach nothing; with only one label, or
none, all scores are 0.5 and there are no spans; empty table: empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, small_batches

#: Texts that the fit tokenizes at a time.
LONGEST, ENDS, PART = 128, (".", "!", "?"), 100
#: Labelled rows of either label whose sequences the field is fitted on.
FIELD = 250
_STRIP = "".join(map(chr, range(33, 127)))
_STRIP = "".join(c for c in _STRIP if not c.isalnum()) + "“”„«»’‘…–—¡¿"


def word_features(token: str) -> list[str]:
    w = token.strip(_STRIP)
    low = w.lower()
    out = ["b", "=" + low] + [f"^{low[:k]}" for k in (4, 5, 6, 7) if len(low) >= k]
    if len(w) > 3 and w.isupper():
        out.append("caps")
    return out


def sequences(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All tokens; the number of the sequence of each; the number of its text."""
    tokens: list[str] = []
    per = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        x = (t or "").split()
        tokens += x
        per[k] = len(x)
    n = len(tokens)
    text = np.repeat(np.arange(len(texts)), per)
    if not n:
        return tokens, np.zeros(0, np.int64), text
    new = np.zeros(n, bool)
    new[0] = True
    new[1:] = np.fromiter((t.endswith(ENDS) for t in tokens), bool, n)[:-1] | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    inside = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    new |= inside % LONGEST == 0
    return tokens, np.cumsum(new) - 1, text


def marginals(x: np.ndarray, seq: np.ndarray, trans: np.ndarray, edges: bool = False):
    """Probability of T of each token; x: score of T over O; trans: log weights [from, to] of O, T.

    With edges, also the expected transitions of all sequences and the log partition sum of each token's sequence share.
    """
    p = np.zeros(len(x))
    tr, total, logz = np.exp(trans), np.zeros((2, 2)), 0.0
    if not len(x):
        return (p, total, logz) if edges else p
    start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
    size = np.diff(np.append(start, len(x)))
    bucket = np.maximum(1, 2 ** np.ceil(np.log2(size)).astype(int))
    for width in np.unique(bucket):
        rows = np.flatnonzero(bucket == width)
        s, n = start[rows], size[rows]
        m = len(rows)
        at = np.minimum(s[:, None] + np.arange(width), len(x) - 1)
        live = np.arange(width) < n[:, None]
        e = np.where(live, np.exp(np.clip(x[at], -20, 20)), 1.0).T
        live = live.T
        fo, ft = np.empty((width, m)), np.empty((width, m))
        a, b = np.ones(m), e[0].copy()
        for k in range(width):
            if k:
                a2 = a * tr[0, 0] + b * tr[1, 0]
                b2 = (a * tr[0, 1] + b * tr[1, 1]) * e[k]
                a, b = np.where(live[k], a2, a), np.where(live[k], b2, b)
            c = a + b
            a, b = a / c, b / c
            if edges:
                logz += np.log(c[live[k]]).sum()
            fo[k], ft[k] = a, b
        bo, bt = np.ones(m), np.ones(m)
        out = np.empty((width, m))
        for k in range(width - 1, -1, -1):
            q = ft[k] * bt / (fo[k] * bo + ft[k] * bt)
            out[k] = q
            if k:
                yo, yt = bo, e[k] * bt
                if edges:
                    w = np.stack([fo[k - 1] * tr[0, 0] * yo, fo[k - 1] * tr[0, 1] * yt, ft[k - 1] * tr[1, 0] * yo, ft[k - 1] * tr[1, 1] * yt])
                    total += (w / w.sum(0))[:, live[k]].sum(1).reshape(2, 2)
                po, pt = tr[0, 0] * yo + tr[0, 1] * yt, tr[1, 0] * yo + tr[1, 1] * yt
                c = po + pt
                bo, bt = np.where(live[k], po / c, bo), np.where(live[k], pt / c, bt)
        p[at.T[live]] = out[live]
    return (p, total, logz) if edges else p


class ToxicCRF:
    """weights: of T over O by feature."""

    #: Distinct tokens whose scores a worker keeps.
    MOST = 500_000

    def __init__(self, weights: dict[str, float], trans: np.ndarray, head: np.ndarray | None):
        self.weights, self.trans, self.head = weights, trans, head
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > self.MOST:
            known.clear()
        out = np.fromiter(map(known.get, tokens, iter(lambda: np.nan, 0)), np.float64, len(tokens))
        miss = np.flatnonzero(np.isnan(out)).tolist()
        get = self.weights.get
        for k in miss:
            t = tokens[k]
            v = known.get(t)
            if v is None:
                v = known[t] = sum(get(f, 0.0) for f in word_features(t))
            out[k] = v
        return out

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        tokens, seq, text = sequences(texts)
        return marginals(self.emissions(tokens), seq, self.trans), text, tokens

    @staticmethod
    def summary(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        expected = np.bincount(text, np.where(p > 0.02, p, 0), n)
        tokens = np.bincount(text, minlength=n)
        top = np.zeros(n)
        np.maximum.at(top, text, p)
        return np.stack([np.ones(n), np.log(expected + 0.02), top, np.log((expected + 0.02) / (tokens + 20.0))], 1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, text, _ = self.tag(texts)
        if self.head is None:
            return np.full(len(texts), 0.5), p, text
        s = self.summary(p, text, len(texts)) @ self.head
        return 1 / (1 + np.exp(-np.clip(s, -30, 30))), p, text


def fit(texts: list[str], y: np.ndarray, rounds: int = 40, field: int = FIELD) -> ToxicCRF:
    """Token labels from document labels, then gradient ascent (AdaGrad) on the field's log-likelihood."""
    trans = np.array([[0.0, -2.0], [0.0, -1.0]])
    if not (y == 1).any() or not (y == 0).any():
        return ToxicCRF({}, trans, None)
    df = [Counter(), Counter()]
    for t, k in zip(texts, y.tolist(), strict=True):
        df[k].update({f for w in set(t.split()) for f in word_features(w)})
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    base = np.log((n1 + 1) / (n0 + 1))
    tied = {f: np.log((c + 0.3) / (df[0][f] + 0.3)) - base for f, c in df[1].items() if c >= 4 and f not in ("b", "caps")}
    strong = {f for f, v in tied.items() if v > 3.2}
    cached: dict[str, bool] = {}

    def golden(tokens: list[str], toxic: np.ndarray) -> np.ndarray:
        gold = np.zeros(len(tokens), bool)
        for k in np.flatnonzero(toxic).tolist():
            t = tokens[k]
            v = cached.get(t)
            if v is None:
                v = cached[t] = any(f in strong for f in word_features(t))
            gold[k] = v
        return gold

    # whole texts, as many of either label
    rng = np.random.default_rng(3)
    use = np.sort(np.concatenate([rng.permutation(np.flatnonzero(y == k))[:field] for k in (1, 0)])).tolist()
    tok, seq, text = sequences([texts[k] for k in use])
    gold = golden(tok, y[use][text] == 1).astype(float)
    weights_of: dict[str, int] = {}
    at, idx = [], []
    for k, t in enumerate(tok):
        for f in word_features(t):
            if f == "b" or f == "caps" or f in tied or df[0][f] + df[1][f] >= 6:
                at.append(k)
                idx.append(weights_of.setdefault(f, len(weights_of)))
    at, idx = np.array(at), np.array(idx)
    w, sq = np.zeros(len(weights_of)), np.full(len(weights_of), 1e-6)
    tsq = np.full((2, 2), 1e-6)
    n = len(tok)
    same = seq[1:] == seq[:-1]
    code = (gold[:-1] * 2 + gold[1:]).astype(int)[same]
    seen = np.bincount(code, minlength=4).reshape(2, 2)
    for _ in range(rounds):
        x = np.bincount(at, w[idx], n)
        p, expected, _ = marginals(x, seq, trans, edges=True)
        g = np.bincount(idx, (gold - p)[at], len(w)) - 0.5 * w
        gt = seen - expected - 0.5 * trans
        sq += g * g
        tsq += gt * gt
        w += 0.5 * g / np.sqrt(sq)
        trans = trans + 0.2 * gt / np.sqrt(tsq)
    model = ToxicCRF({f: float(w[k]) for f, k in weights_of.items()}, trans, None)
    z = np.concatenate([model.summary(*model.tag(texts[k : k + PART])[:2], len(texts[k : k + PART])) for k in range(0, len(texts), PART)])
    model.known.clear()
    head = np.zeros(z.shape[1])
    ridge = np.diag([1e-3, 0.1, 0.1, 0.1])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(z @ head, -30, 30)))
        step = np.linalg.solve((z * (q * (1 - q))[:, None]).T @ z + ridge, z.T @ (q - y) + ridge @ head)
        head -= step
        if np.abs(step).max() < 1e-7:
            break
    model.head = head
    return model


def train(docs: DataFrame, labels: DataFrame, label: str, most_toxic: int = 3000, most_clean: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> ToxicCRF:
    """labels: id_col and label (0 or 1) of the rows to learn from."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    lab = lab.groupBy("id").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("id"), F.col("id")]
    lab = lab.where("y = 1").orderBy(*by_hash).limit(most_toxic).unionByName(lab.where("y = 0").orderBy(*by_hash).limit(most_clean))
    # at most most_toxic + most_clean rows of two numbers
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(lab), "id").select("id", "y", "text").collect()
    rows.sort(key=lambda r: (r.id, r.text or ""))
    return fit([r.text or "" for r in rows], np.array([r.y for r in rows], np.int64))


def score(docs: DataFrame, model: ToxicCRF, spans: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_toxic (tokens with a marginal of half or more) and their runs as spans (start, end in code points)."""
    small_batches(docs.sparkSession)
    d = pick(docs, doc_id=id_col, text=text_col)
    word = re.compile(r"\S+")

    def offsets(t: str, hit: np.ndarray) -> list[dict]:
        # str.split and \S agree on white space
        out: list[dict] = []
        at = [(m.start(), m.end()) for m in word.finditer(t)]
        for k in np.flatnonzero(hit).tolist():
            if out and k and hit[k - 1]:
                out[-1]["end"] = at[k][1]
            else:
                out.append({"start": at[k][0], "end": at[k][1]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            s, p, text = model.score(texts)
            hit = (p >= 0.5) if model.head is not None else np.zeros(len(p), bool)
            n = np.bincount(text, hit, len(texts)).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
            first = np.searchsorted(text, np.arange(len(texts) + 1))
            found = [offsets(t, hit[first[k] : first[k + 1]]) if spans and n[k] else [] for k, t in enumerate(texts)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array(n), pa.array(found, kind)], ["doc_id", "score", "n_toxic", "spans"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, score double, n_toxic long, spans array<struct<start:long,end:long>>")
