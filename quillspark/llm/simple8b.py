"""Operator 4: token ids in Simple-8b words, written in order of doc_id and read back.

A 64-bit word has a selector in its top four bits and 60 bits of ids: 240 or 120 zeros, or 60 x 1 bit ... 2 x 30 bits.
Selector 15 is the escape: one id of up to 60 bits. Ids are packed in blocks of 256, each begun with a new word; a
segment keeps where each block begins, so blocks are decoded independently and side by side. A segment holds whole
documents of about SEGMENT ids (a longer document has its own) and is one row of the files:

    part, seq      place of the segment: partition of the range sort, number within it
    before         ids of earlier segments of the partition
    n_docs, n_ids  its documents and ids
    payload        magic, counts, doc ids, ids per document, block offsets, words (all little-endian)

The container is Parquet in the shared folder: written by Spark's committer, so lost executors leave no halves, and
readable from any store. Position of a document: ids of earlier partitions (one total per partition, broadcast), of
earlier segments (written with the segment), of earlier documents of the segment; no payload is shuffled to be read.

Added tokens of the tokenizer (such as an end-of-text sign) are recognised in texts, as the library does by default.

Defined cases: null text is empty (only the end id); null doc_id sorts first; repeated doc_ids follow one another,
ordered by text; an empty table gives no file rows; other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import WHITE, ChunkCache
from .common import KEPT, given_back, pick, shared_dir, small_batches

BLOCK, SEGMENT, MAGIC = 256, 16_384, 0x42385351
FILE = "part int, seq long, before long, n_docs long, n_ids long, payload binary"
ALONE = WHITE | {""}
#: Chunks of texts whose ids a worker keeps; chunks encoded in one call.
MOST, TOGETHER = 800_000, 32
#: By selector: ids in a word, bits each.
COUNT = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)


def pack(ids: np.ndarray, block_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks one after another, and how many each block has; the blocks follow one another in ids."""
    n = len(block_size)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    val = np.zeros((n, BLOCK + 240), np.uint64)
    if (block_size[:-1] == BLOCK).all():
        whole = len(ids) // BLOCK
        val[:whole, :BLOCK] = ids[: whole * BLOCK].reshape(whole, BLOCK)
        val[whole:, : len(ids) - whole * BLOCK] = ids[whole * BLOCK :]
    else:
        val[:, :BLOCK][np.arange(BLOCK) < block_size[:, None]] = ids
    # bits of each id, then of the widest of COUNT[s] ids from each position on; past the block's end are zeros
    need = np.frexp(val[:, :BLOCK].astype(np.float64))[1].astype(np.int8)
    best = np.full((n, BLOCK), 15, np.int8)
    rows, seen = np.arange(n), 1
    for s in range(14, -1, -1):
        more = min(int(COUNT[s]) - seen, BLOCK)
        wide = need.copy()
        np.maximum(need[:, : BLOCK - more], need[:, more:], out=wide[:, : BLOCK - more])
        fits = wide <= BITS[s]
        some = fits.any(1)
        if not some.all():
            rows, wide, fits = rows[some], wide[some], fits[some]
        if not len(rows):
            break  # no id is this small, nor smaller
        best[rows] = np.where(fits, np.int8(s), best[rows])
        need, seen = wide, int(COUNT[s])
    best, stride = best.ravel(), BLOCK + 240
    starts = np.zeros((n, BLOCK), bool)
    row, p = np.flatnonzero(block_size > 0), np.zeros(n, np.int64)
    while len(row):
        starts[row, p[row]] = True
        p[row] += COUNT[best[row * BLOCK + p[row]]]
        row = row[p[row] < block_size[row]]
    f = np.flatnonzero(starts.ravel())
    sel = best[f]
    at = f // BLOCK * stride + f % BLOCK
    words = sel.astype(np.uint64) << np.uint64(60)
    flat = val.ravel()
    for s in range(2, 16):
        k = np.flatnonzero(sel == s)
        if len(k):
            take = flat[at[k][:, None] + np.arange(COUNT[s])]
            words[k] |= np.bitwise_or.reduce(take << (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64), axis=1)
    return words, starts.sum(1)


def unpack(words: np.ndarray, block_words: np.ndarray, block_size: np.ndarray) -> np.ndarray:
    """The ids of all blocks one after another."""
    base = np.cumsum(block_size) - block_size
    sel = (words >> np.uint64(60)).astype(np.int64)
    has = COUNT[sel]
    of = np.repeat(np.arange(len(block_words)), block_words)
    first = np.cumsum(block_words) - block_words
    before = np.cumsum(has) - has
    start = before - before[first[of]] if len(of) else before
    out = np.zeros(int(block_size.sum()), np.uint64)
    for s in range(2, 16):
        k = np.flatnonzero(sel == s)
        if len(k):
            v = (words[k, None] >> (np.arange(COUNT[s]) * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
            at = start[k, None] + np.arange(COUNT[s])
            ok = at < block_size[of[k], None]
            out[(at + base[of[k], None])[ok]] = v[ok]
    return out


def _blocks(n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments' numbers of blocks, and the sizes of all blocks."""
    n = (n_ids + BLOCK - 1) // BLOCK
    size = np.full(int(n.sum()), BLOCK, np.int64)
    last = np.cumsum(n)[n > 0] - 1
    size[last] = (n_ids - (n - 1) * BLOCK)[n > 0]
    return n, size


def segments(doc_ids: list, per: np.ndarray, ids: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(n_docs, n_ids, payload) of segments of whole documents."""
    cut, run = [0], 0
    for k, n in enumerate(per.tolist()):
        if run and run + n > SEGMENT:
            cut.append(k)
            run = 0
        run += n
    cut.append(len(per))
    upto = np.concatenate([[0], np.cumsum(per)])
    n_ids = np.diff(upto[cut])
    n_blocks, size = _blocks(n_ids)
    words, block_words = pack(ids, size)
    word_at = np.concatenate([[0], np.cumsum(block_words)])
    block_at = np.concatenate([[0], np.cumsum(n_blocks)])
    out = []
    for k in range(len(cut) - 1):
        a, b = cut[k], cut[k + 1]
        p, q = block_at[k], block_at[k + 1]
        docs = doc_ids[a:b]
        head = np.array([MAGIC, b - a, n_ids[k], q - p], "<i8")
        parts = [head, np.array([d is not None for d in docs], "<u1"), np.array([d or 0 for d in docs], "<i8"), per[a:b].astype("<i8"), (word_at[p:q] - word_at[p]).astype("<i4"), words[word_at[p] : word_at[q]].astype("<u8")]
        out.append((b - a, int(n_ids[k]), b"".join(x.tobytes() for x in parts)))
    return out


def read_segments(payloads: list[bytes]) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, ids per document, all ids one after another, documents per segment."""
    docs, per, words, block_words, n_ids, n_docs = [], [], [], [], [], []
    for raw in payloads:
        magic, nd, ni, nb = np.frombuffer(raw, "<i8", 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a Simple-8b segment")
        at = 32
        valid = np.frombuffer(raw, "<u1", nd, at).tolist()
        at += nd
        docs += [d if v else None for d, v in zip(np.frombuffer(raw, "<i8", nd, at).tolist(), valid, strict=True)]
        at += 8 * nd
        per.append(np.frombuffer(raw, "<i8", nd, at))
        at += 8 * nd
        offset = np.frombuffer(raw, "<i4", nb, at)
        at += 4 * nb
        w = np.frombuffer(raw, "<u8", offset=at)
        words.append(w)
        block_words.append(np.diff(np.append(offset, len(w))))
        n_ids.append(ni)
        n_docs.append(nd)
    cat = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
    _, size = _blocks(np.array(n_ids, np.int64))
    return docs, cat(per, np.int64), unpack(cat(words, np.uint64), cat(block_words, np.int64), size), np.array(n_docs, np.int64)


def _is_piece(chunk: str) -> bool:
    """Latin letters, with one space before them or none: one piece whatever version of Unicode the library has."""
    w = chunk[1:] if chunk[:1] == " " else chunk
    return w.isalpha() and (w.isascii() or max(w) < "\u0220")


@lru_cache(maxsize=2)
def _encoder(path: str, pat: str):
    """texts -> all ids one after another, and how many each text has, as the tokenizers library encodes whole texts.

    Chunks not seen before that are one piece of the pre-tokenizer, letters with a space before them or none, go to the
    library's model, spelled as its byte level does. Others are encoded TOGETHER in one string, cut again where their bytes
    end: ids are byte-level tokens, and a chunk that begins with one space, followed by none, begins a piece of the
    pre-tokenizer. Texts with an added token's string go through the library whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    n_bytes = np.array([len(t.id_to_token(k) or "") for k in range(t.get_vocab_size())], np.int64)
    added = [x.content for x in t.get_added_tokens_decoder().values()]

    tokenize = t.model.tokenize
    spelled = {b: t.pre_tokenizer.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
    # bytes from 128 on: by the signs of two bytes that have them
    for k in range(128, 0x800):
        spelled |= zip(chr(k).encode(), t.pre_tokenizer.pre_tokenize_str(chr(k))[0][0], strict=True)
    line_end = spelled[ord("\n")]

    def encode(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter(map(_is_piece, chunks), bool, len(chunks))
        letters = list(compress(chunks, plain))
        spelling = "\n".join(letters).encode().decode("latin-1").translate(spelled).split(line_end) if letters else []
        found = [[x.id for x in tokenize(w)] for w in spelling]
        odd, odd_size = encode_odd(list(compress(chunks, ~plain)))
        size = np.zeros(len(chunks), np.int64)
        size[plain], size[~plain] = np.fromiter(map(len, found), np.int64, len(found)), odd_size
        flat = np.zeros(int(size.sum()), np.int32)
        of = np.repeat(plain, size)
        flat[of] = np.fromiter(chain.from_iterable(found), np.int32, int(of.sum()))
        flat[~of] = odd
        return flat, size

    def encode_odd(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        apart = [x[:1] != " " or x[1:2] in ALONE or x[-1] in WHITE for x in chunks]
        one = [x for x, a in zip(chunks, apart, strict=True) if not a]
        size = np.zeros(len(chunks), np.int64)
        is_apart = np.array(apart, bool)
        ids = [np.zeros(0, np.int64)]
        for e in t.encode_batch_fast(["".join(one[k : k + TOGETHER]) for k in range(0, len(one), TOGETHER)], add_special_tokens=False):
            ids.append(np.array(e.ids, np.int64))
        joined = np.concatenate(ids)
        raw = np.frombuffer("".join(one).encode(), np.uint8)
        ends = np.append(np.flatnonzero(raw == ord(" "))[1:], len(raw))[: len(one)]
        if len(ends) < len(one) or (raw == ord(" ")).sum() > len(one):  # a chunk has a space that isn't its first sign
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in one), np.int64, len(one)))
        upto = np.searchsorted(np.cumsum(n_bytes[joined]), ends) + 1
        size[~is_apart] = np.diff(np.append(0, upto))
        rest = [e.ids for e in t.encode_batch_fast([x for x, a in zip(chunks, apart, strict=True) if a], add_special_tokens=False)]
        size[is_apart] = [len(x) for x in rest]
        flat = np.zeros(int(size.sum()), np.int32)
        of = np.repeat(is_apart, size)
        flat[~of] = joined
        flat[of] = np.fromiter((i for x in rest for i in x), np.int32)
        return flat, size

    cache = ChunkCache(encode, pat, MOST)

    def texts(batch: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        odd = [k for k, x in enumerate(batch) if x and any(a in x for a in added)]
        if not odd:
            return cache.batch(batch)
        whole = dict(zip(odd, (np.array(e.ids, np.int32) for e in t.encode_batch_fast([batch[k] for k in odd], add_special_tokens=False)), strict=True))
        flat, per = cache.batch([None if k in whole else x for k, x in enumerate(batch)])
        parts = np.split(flat, np.cumsum(per)[:-1])
        parts = [whole.get(k, x) for k, x in enumerate(parts)]
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64)

    return texts


KEPT.append(_encoder)


def write_ids(docs: DataFrame, tokenizer_path: str, pat: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Encodes whole texts, appends end_id to each, and writes the files; returns their path.

    pat: the pre-tokenizer's pattern. Texts are range-partitioned by id once and sorted within partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = path or shared_dir(spark, "token-ids")
    d = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seq, before = _encoder(tokenizer_path, pat), TaskContext.get().partitionId(), 0, 0
        for b in batches:
            if b.num_rows == 0:
                continue
            flat, per = encode(b.column(1).to_pylist())
            out = np.full(len(flat) + len(per), end_id, np.uint32)
            ends = np.cumsum(per + 1) - 1
            body = np.ones(len(out), bool)
            body[ends] = False
            out[body] = flat
            rows = segments(b.column(0).to_pylist(), per + 1, out)
            m, sizes = len(rows), np.array([r[1] for r in rows], np.int64)
            upto = before + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * m, pa.int32()), pa.array(range(seq, seq + m), pa.int64()), pa.array(upto - sizes), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)]],
                ["part", "seq", "before", "n_docs", "n_ids", "payload"],
            )
            seq, before = seq + m, int(upto[-1])

    d.mapInArrow(given_back(run, _encoder), FILE).write.parquet(path)
    return path


def read_ids(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted."""
    small_batches(spark)
    f = spark.read.schema(FILE).parquet(path)
    # one row per partition of the writer, however large the data
    totals = f.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    placed = f.join(F.broadcast(base), "part").select((F.col("base") + F.col("before")).alias("start"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, per, ids, n_docs = read_segments(b.column(1).to_pylist())
            ends = np.cumsum(per)
            first = np.cumsum(n_docs) - n_docs
            before = ends - per
            seg = np.repeat(np.arange(len(n_docs)), n_docs)
            start = b.column(0).to_numpy()[seg] + before - before[first[seg]] if len(per) else before
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[e - n : e]) for e, n in zip(ends.tolist(), per.tolist(), strict=True)]
            cols = [pa.array(docs, pa.int64()), pa.array(start, pa.int64()), pa.array(per, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int64))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
