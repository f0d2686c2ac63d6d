"""Matching statistics of many texts in large references, by hashes of n-grams that travel packed.

Documents are dealt to units by doc_id. A unit sends each distinct n-gram of a side once, in blobs of sorted hashes, to
the place of that range of hashes; there membership is looked up, and bits come back. Containment passes to suffixes, so
only positions that have a match of FIRST tokens send longer n-grams, and only references that some text has at that
length. No n-gram is a key, so frequent ones make no large group, and no set of n-grams is held whole by a process.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import workers_import

#: Bytes of text in a unit, and the orders sent in the first of the two rounds.
UNIT, FIRST = 4_000_000, 3
BLOB = "p int, unit int, side int, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(v: np.ndarray) -> bytes:
    """Sorted distinct hashes: the first, then gaps of six bytes; all whole where a gap is larger."""
    gaps = np.diff(v)
    if len(gaps) and int(gaps.max()) >> 48:
        return b"\x08" + v.astype("<u8").tobytes()
    return b"\x06" + v[:1].astype("<u8").tobytes() + gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    if b[0] == 8:
        return np.frombuffer(b, "<u8", offset=1)
    six = np.frombuffer(b, np.uint8, offset=9).reshape(-1, 6)
    gaps = np.zeros((len(six), 8), np.uint8)
    gaps[:, :6] = six
    return np.cumsum(np.concatenate([np.frombuffer(b, "<u8", 1, 1), gaps.view("<u8").ravel()]), dtype=np.uint64)


def within(v: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Which of v are in the sorted array `have`."""
    if not len(have):
        return np.zeros(len(v), bool)
    return have[np.minimum(np.searchsorted(have, v), len(have) - 1)] == v


class Unit:
    """Tokens of a unit's documents, and what is known of each position."""

    def __init__(self, docs: pa.Table, refs: int, places: int):
        lists = docs["h"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        n = np.diff(lists.offsets.to_numpy())
        self.doc = np.repeat(np.arange(len(n)), n)
        self.ix = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.token = mixed(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        self.side = docs["side"].to_numpy().astype(np.int8)[self.doc]
        self.refs, self.places = refs, places
        self.best = np.zeros((refs, len(self.doc)), np.int8)
        self.alive = np.ones(len(self.doc), bool)
        self.gram, self.order = np.zeros(len(self.doc), np.uint64), 0

    def asked(self, last: int) -> tuple[list, dict]:
        """(order, positions, hashes) of the orders up to `last` at positions alive, and the sorted distinct hashes by side."""
        at = []
        while self.order < last:
            self.order += 1
            far = np.zeros_like(self.token)
            far[self.order - 1 :] = self.token[: max(len(far) - self.order + 1, 0)]
            self.gram = mixed(self.gram * np.uint64(3) + far + np.uint64(self.order))
            where = np.flatnonzero(self.alive & (self.ix >= self.order - 1))
            at.append((self.order, where, self.gram[where]))
        sides = {s: np.unique(np.concatenate([g[self.side[w] == s] for _, w, g in at])) for s in range(self.refs + 1)}
        return at, sides

    def cuts(self, v: np.ndarray) -> np.ndarray:
        """Where each place's range of hashes begins in v."""
        return np.searchsorted((v >> np.uint64(32)) * np.uint64(self.places) >> np.uint64(32), np.arange(self.places + 1))

    def told(self, last: int, replies: pa.Table) -> None:
        """Takes the bits of a round."""
        at, sides = self.asked(last)
        bits = {(s, p): d for s, p, d in zip(*(replies[c].to_pylist() for c in ("side", "p", "data")), strict=True)}
        shared = np.zeros(len(self.doc), bool)
        for s, v in sides.items():
            kinds = self.refs if s == 0 else 1
            has, cut = np.zeros((kinds, len(v)), bool), self.cuts(v)
            for p in np.flatnonzero(np.diff(cut)):
                n = cut[p + 1] - cut[p]
                has[:, cut[p] : cut[p + 1]] = np.unpackbits(np.frombuffer(bits[s, int(p)], np.uint8))[: kinds * n].reshape(kinds, n)
            for o, where, g in at:
                mine = self.side[where] == s
                where, k = where[mine], np.searchsorted(v, g[mine])
                for r in range(kinds):
                    there = where[has[r, k]]
                    if s == 0:
                        self.best[r, there] = o
                    if o == last:
                        shared[there] = True
        self.alive &= shared


def rows_of(docs: DataFrame, side: int) -> DataFrame:
    return docs.select("doc_id", "text", F.lit(side).alias("side"))


def units_of(docs: DataFrame) -> int:
    """The number of units for these texts, by their bytes."""
    return 4 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // UNIT


def matches(rows: DataFrame, refs: int, cap: int, units: int | None = None, near: tuple[int, int] | None = None) -> DataFrame:
    """rows: doc_id, text, side (0: a text; 1 to refs: a reference) -> doc_id, tok_ix, m1 to m<refs> for each token of the texts.

    m is the length of the longest suffix at the token, up to cap, that a document of the reference has. near, as (start,
    keep), for two references: only tokens with m1 - m2 >= keep, and those that a match ending at m1 - m2 >= start can span.
    """
    workers_import(rows.sparkSession)
    units = units or units_of(rows)
    places = max(4, units // 2)
    rounds = [min(FIRST, cap), *([cap] if cap > FIRST else [])]
    unit = F.pmod(F.hash(F.col("doc_id").cast("string")), F.lit(units)).alias("unit")
    tokens = T.clean_tokens(F.coalesce("text", F.lit("")))
    dealt = rows.select(unit, "doc_id", F.col("side").cast("int").alias("side"), "text").repartition(units, "unit")
    dealt = dealt.select("unit", "doc_id", "side", F.transform(tokens, lambda x: F.xxhash64(x)).alias("h"))
    blob = pa.schema([("p", pa.int32()), ("unit", pa.int32()), ("side", pa.int32()), ("data", pa.binary())])

    def after(docs: pa.Table, replies: pa.Table | None, upto: int) -> Unit:
        """A unit that has taken the replies of the first `upto` rounds."""
        u = Unit(docs, refs, places)
        for k in range(upto):
            u.told(rounds[k], replies.filter(pa.array(replies["round"].to_numpy() == k)))
        return u

    def sent(docs: pa.Table, u: Unit, k: int) -> pa.Table:
        out = []
        for s, v in u.asked(rounds[k])[1].items():
            cut = u.cuts(v)
            out += [(int(p), docs["unit"][0].as_py(), s, packed(v[cut[p] : cut[p + 1]])) for p in np.flatnonzero(np.diff(cut))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, blob.types, strict=True)], schema=blob)

    def first(docs: pa.Table) -> pa.Table:
        return sent(docs, after(docs, None, 0), 0)

    def second(docs: pa.Table, replies: pa.Table) -> pa.Table:
        return sent(docs, after(docs, replies, 1), 1)

    def looked_up(k: int):
        def f(t: pa.Table) -> pa.Table:
            side = t["side"].to_numpy()
            vs = [unpacked(b.as_py()) for b in t["data"]]
            last = k == len(rounds) - 1
            have = [np.unique(np.concatenate([v for v, s in zip(vs, side, strict=True) if s == r] or [np.zeros(0, np.uint64)])) if r or not last else None for r in range(refs + 1)]
            bits = [np.packbits(np.concatenate([within(v, x) for x in have[1:]]) if s == 0 else np.zeros(len(v), bool) if last else within(v, have[0])).tobytes() for v, s in zip(vs, side, strict=True)]
            return pa.table({"unit": t["unit"], "round": pa.array([k] * len(vs), pa.int32()), "side": t["side"], "p": t["p"], "data": pa.array(bits, pa.binary())})

        return f

    def answers(docs: pa.Table, replies: pa.Table) -> pa.Table:
        u = after(docs, replies, len(rounds))
        keep = u.side == 0
        if near:
            d = u.best[0] - u.best[1]
            hot, spanned = d >= near[0], d >= near[1]
            for back in range(cap):
                here = np.flatnonzero(hot & (u.ix >= back))
                spanned[here - back] = True
            keep &= spanned
        at = np.flatnonzero(keep)
        return pa.table({"doc_id": docs["doc_id"].take(pa.array(u.doc[at])), "tok_ix": pa.array(u.ix[at], pa.int64()), **{f"m{r + 1}": pa.array(u.best[r, at].astype(np.int64)) for r in range(refs)}})

    replies = None
    for k in range(len(rounds)):
        by_unit = dealt.groupBy("unit")
        blobs = by_unit.applyInArrow(first, BLOB) if k == 0 else by_unit.cogroup(replies.groupBy("unit")).applyInArrow(second, BLOB)
        got = blobs.groupBy("p").applyInArrow(looked_up(k), "unit int, round int, side int, p int, data binary")
        replies = got if replies is None else replies.unionByName(got)
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, tok_ix long, " + ", ".join(f"m{r + 1} long" for r in range(refs))
    return dealt.groupBy("unit").cogroup(replies.groupBy("unit")).applyInArrow(answers, out)

