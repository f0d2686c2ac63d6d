"""Operator 10: byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaves of a piece's tree are its byte positions; a live position holds the rank of the pair that starts there, a
node the leftmost minimum below it. A merge takes the root's pair, joins it with its right neighbour and updates three
leaves (the pair, the absorbed neighbour, the live neighbour on the left) with logarithmic work each. Short pieces of
the same padded length are merged side by side in numpy; long ones one at a time.

Defined cases: null text is empty; an empty text has no ids and decodes to no bytes; repeated rows give repeated
results; an empty table gives an empty result; other columns are not read. Memory: one Arrow batch and a bounded cache.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ChunkCache, pattern
from .common import KEPT, given_back, pick, small_batches

NONE = np.int64(1 << 62)
#: Chunks of texts whose ids a worker keeps.
MOST = 200_000
#: Signs that are pieces of their own after a word, whatever the contractions of the pattern.
CLOSERS = frozenset(".,!?;:")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class SegmentTreeBPE:
    """Encodes pieces (bytes) by ranks; the id of a token is its rank."""

    #: Pieces of at most so many bytes are merged side by side.
    SIDE = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self._table(pairs)
        n = max(ranks.values()) + 1
        spelled = [b""] * n
        for token, rank in ranks.items():
            spelled[rank] = token
        self.spell_len = np.array([len(x) for x in spelled], np.int64)
        self.spell_at = np.cumsum(self.spell_len) - self.spell_len
        self.spell = np.frombuffer(b"".join(spelled), np.uint8)

    def _table(self, pairs: dict[int, int]) -> None:
        """Two hash tables; each pair is in its slot of the one or of the other."""
        bits = max(8, (2 * len(pairs)).bit_length())
        while True:
            self.shift = np.uint64(64 - bits)
            key, val = (np.fromiter(x, np.int64, len(pairs)) for x in (pairs.keys(), pairs.values()))
            slots = [s.tolist() for s in self._slots(key)]
            left: list[dict[int, int]] = [{}, {}]
            fits = True
            for k in range(len(pairs)):
                side, at = 0, k
                for _ in range(200):
                    s = slots[side][at]
                    out = left[side].get(s)
                    left[side][s] = at
                    if out is None:
                        break
                    at, side = out, 1 - side
                else:
                    fits = False
                    break
            if fits:
                break
            bits += 1
        self.tab_key = [np.full(1 << bits, -1, np.int64) for _ in range(2)]
        self.tab_val = [np.full(1 << bits, NONE, np.int64) for _ in range(2)]
        for side in range(2):
            s = np.fromiter(left[side], np.int64, len(left[side]))
            k = np.fromiter(left[side].values(), np.int64, len(left[side]))
            self.tab_key[side][s], self.tab_val[side][s] = key[k], val[k]

    def _slots(self, key: np.ndarray) -> list[np.ndarray]:
        k = key.view(np.uint64)
        return [((k * np.uint64(c)) >> self.shift).view(np.int64) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        s0, s1 = self._slots(key)
        return np.where(self.tab_key[0][s0] == key, self.tab_val[0][s0], np.where(self.tab_key[1][s1] == key, self.tab_val[1][s1], NONE))

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[list[int]]:
        n, bits = len(pieces), width.bit_length() - 1
        size = np.fromiter(map(len, pieces), np.int64, n)
        inside = np.arange(width) < size[:, None]
        raw = np.zeros((n, width), np.uint8)
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        # flat arrays; a row has one position more than bytes, as the end's neighbour
        w1, w2 = width + 1, 2 * width
        tok = np.zeros((n, w1), np.int64)
        tok[:, :width] = self.byte[raw]
        tree = np.full((n, w2), NONE, np.int64)
        pos = np.arange(width)
        r = self._rank(tok[:, :width], tok[:, 1:])
        tree[:, width:] = np.where((pos + 1 < size[:, None]) & (r < NONE), (r << bits) | pos, NONE)
        for level in range(bits - 1, -1, -1):
            lo = 1 << level
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        live = np.zeros((n, w1), bool)
        live[:, :width] = inside
        tok, tree, live = tok.ravel(), tree.ravel(), live.ravel()
        nxt = np.tile(np.arange(1, width + 2), n)
        prv = np.tile(np.arange(-1, width), n)
        row = np.flatnonzero(tree[1::w2] < NONE)
        while len(row):
            base, root = row * w1, row * w2
            top = tree[root + 1]
            i = top & (width - 1)
            j = nxt[base + i]
            after = nxt[base + j]
            merged = top >> bits
            tok[base + i] = merged
            nxt[base + i] = after
            prv[base + after] = i
            live[base + j] = False
            before = prv[base + i]
            has = before >= 0
            before = np.maximum(before, 0)
            m = len(row)
            r = self._rank(np.concatenate([merged, tok[base + before]]), np.concatenate([tok[base + after], merged]))
            right, left = r[:m], r[m:]
            right = np.where((after < size[row]) & (right < NONE), (right << bits) | i, NONE)
            left = np.where(left < NONE, (left << bits) | before, NONE)
            tree[root + width + j] = NONE
            tree[root + width + i] = right
            tree[(root + width + before)[has]] = left[has]
            node = np.concatenate([j, i, before]) + width
            of = np.concatenate([root, root, root])
            for _ in range(bits):
                node >>= 1
                child = of + 2 * node
                tree[of + node] = np.minimum(tree[child], tree[child + 1])
            row = row[tree[root + 1] < NONE]
        ends = np.cumsum(live.reshape(n, w1).sum(1)).tolist()
        flat = tok[live].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _alone(self, piece: bytes) -> list[int]:
        n = len(piece)
        width = 1 << max(n - 1, 1).bit_length()
        none, get = int(NONE), self.pairs.get
        tok = [self.ranks[piece[k : k + 1]] for k in range(n)]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * width)
        for k in range(n - 1):
            r = get(tok[k] << 32 | tok[k + 1])
            if r is not None:
                tree[width + k] = r * width + k
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = leaf + width
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                tree[k] = a if a < b else b
                k >>= 1

        def rank(a: int, b: int) -> int:
            r = get(tok[a] << 32 | tok[b]) if b < n else None
            return none if r is None else r * width + a

        while tree[1] < none:
            merged, i = divmod(tree[1], width)
            j = nxt[i]
            tok[i] = merged
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            put(j, none)
            put(i, rank(i, nxt[i]))
            if prv[i] >= 0:
                put(prv[i], rank(prv[i], i))
        out, k = [], 0
        while k < n:
            out.append(tok[k])
            k = nxt[k]
        return out

    def pieces(self, pieces: list[bytes]) -> list:
        """The ids of each piece."""
        out: list = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = (whole,)
            elif len(p) > self.SIDE:
                out[k] = self._alone(p)
            else:
                groups.setdefault(1 << max(len(p) - 1, 1).bit_length(), []).append(k)
        for width, ks in groups.items():
            for lo in range(0, len(ks), 8192):
                part = ks[lo : lo + 8192]
                for k, ids in zip(part, self._side_by_side([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids one after another, and how many each id has."""
        size = self.spell_len[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.spell[np.repeat(self.spell_at[ids] - (ends - size), size) + np.arange(total)], size


@lru_cache(maxsize=2)
def _model(path: str) -> SegmentTreeBPE:
    return SegmentTreeBPE(load_ranks(path))


@lru_cache(maxsize=2)
def _cache(path: str, pat: str) -> ChunkCache:
    model, find = _model(path), pattern(pat)

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        split = []
        for x in chunks:
            # most are a space and letters, with one sign after them or none
            word = x[1:] if x[:1] == " " else x
            if word.isalpha():
                split.append((x,))
            elif word[-1:] in CLOSERS and word[:-1].isalpha():
                split.append((x[:-1], x[-1]))
            else:
                split.append(find.findall(x))
        pieces = list(dict.fromkeys(chain.from_iterable(split)))
        ids = dict(zip(pieces, model.pieces([p.encode() for p in pieces]), strict=True))
        out = [ids[x[0]] if len(x) == 1 else [i for p in x for i in ids[p]] for x in split]
        size = np.fromiter(map(len, out), np.int64, len(out))
        return np.fromiter(chain.from_iterable(out), np.int32, int(size.sum())), size

    return ChunkCache(encode, pat, MOST)


KEPT.extend([_model, _cache])


def encode(docs: DataFrame, ranks_path: str, pat: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text, as the ranks' tokenizer has them, no special tokens."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(ranks_path, pat)
        for b in batches:
            flat, per = cache.batch(b.column(1).to_pylist())
            at = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()))], ["doc_id", "ids"])

    d = pick(docs, doc_id=id_col, text=text_col)
    return d.mapInArrow(given_back(run, _cache, _model), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Adds decoded (binary): the bytes of ids. ids null: null bytes."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in encoded.schema.fields)
    at_ids = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(ranks_path)
        for b in batches:
            ids = b.column(at_ids)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            per = np.diff(ids.offsets.to_numpy()) if ids.null_count == 0 else np.array([len(x or ()) for x in ids.to_pylist()])
            raw, size = model.decode(flat)
            upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(per)])].astype(np.int64)
            out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(per), [None, pa.py_buffer(upto), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            if ids.null_count:
                out = pa.compute.if_else(ids.is_valid(), out, None)
            yield pa.RecordBatch.from_arrays([*b.columns, out], [*b.schema.names, "decoded"])

    return encoded.mapInArrow(given_back(run, _cache, _model), f"{fields}, decoded binary")


def digest(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
