"""Operator 1: quality rules by compression bands.

zstandard ratios (bytes over compressed bytes) of the whole text and of fixed chunks must lie in the band of the text's
length: repetitive text compresses too well, noise (keys, encoded data) too little. Short texts have wide bands, as
frames and an empty window weigh more there. A text of a chunk's length or more is covered by chunks from begin to end; a
shorter one is a chunk of its own size with the band of its length. Counts of the base rules come with the verdict.

Defined cases: null text has no words, all counts 0, fails the base rules; empty likewise; repeated rows give repeated
results; empty table: empty result; other columns are not read. Each text is looked at as a whole and on its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import pick, small_batches

#: Up to so many bytes, the ratio of the whole text is to be in [low, high].
BANDS = ((100, 0.0, 4.0), (300, 0.9, 2.8), (700, 1.1, 2.8), (1500, 1.2, 2.9), (3000, 1.3, 3.0), (6000, 1.4, 3.2), (12_000, 1.4, 3.5), (1 << 62, 1.4, 4.5))
#: Chunks of so many bytes have this band; at most this share of a text's chunks may be outside. Base64 chunks are at 1.3,
#: prose chunks at 1.88 or more; hex digits compress like prose (1.88 to 1.93), so that no bound of a ratio tells them apart.
CHUNK, CHUNK_BAND, CHUNK_SHARE = 2048, (1.6, 3.2), 0.1
SYMBOLS = "#*$%&|<>"


@lru_cache(maxsize=1)
def _compressor(level: int = 3) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = text.split("\n")
    dup = 0
    if len(lines) > 1:
        used = [x for x in lines if x.encode().split()]
        dup = len(used) - len(set(used))
    repeat = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        v = len(ids)
        if v < n:
            pairs = np.unique(w[:-1] * v + w[1:], return_inverse=True)[1]
            _, at, times = np.unique(pairs[:-1] * v + w[2:], return_inverse=True, return_counts=True)
            start = np.flatnonzero(times[at] > 1)
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[start + k] = True
            repeat = int(covered.sum())
    return n, word_chars, symbols, dup, repeat


def ratios(raw: bytes) -> tuple[float, list[float]]:
    """Ratio of the whole, 1 for nothing; those of its chunks, of which the last ends with the text and may overlap."""
    z = _compressor()
    whole = len(raw) / len(z.compress(raw)) if raw else 1.0
    starts = [*range(0, len(raw) - CHUNK + 1, CHUNK)]
    if starts and len(raw) % CHUNK:
        starts.append(len(raw) - CHUNK)
    return whole, [CHUNK / len(z.compress(raw[k : k + CHUNK])) for k in starts]


def verdict(n_bytes: int, whole: float, chunks: list[float]) -> bool:
    low, high = next((lo, hi) for most, lo, hi in BANDS if n_bytes <= most)
    if not low <= whole <= high:
        return False
    return sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks) <= CHUNK_SHARE * len(chunks)


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts, ratios, base_failed and kept of each row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                t = t or ""
                n, chars, symbols, dup, repeat = base_counts(t)
                raw = t.encode()
                whole, chunks = ratios(raw)
                failed = n < 50 or 100 * repeat > 50 * n
                bad = sum(not CHUNK_BAND[0] <= r <= CHUNK_BAND[1] for r in chunks)
                rows.append((n, chars, symbols, dup, repeat, failed, not failed and verdict(len(raw), whole, chunks), whole, len(chunks), bad))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.int64(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds, strict=True)]], names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "n_chunks", "n_bad_chunks"]
    d = pick(docs, doc_id=id_col, text=text_col)
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")
