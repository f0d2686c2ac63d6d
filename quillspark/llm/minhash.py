"""Operator 8: MinHash near-duplicates with tensored banding; every candidate is confirmed on the full sets.

A document's set: distinct shingles of `width` words (lower case for A-Z; words as [^\\x20\\x09-\\x0D]+), the whole
sequence as one with fewer words, as 64-bit hashes. Equal sets are one node, whatever their number, so copies cost
nothing further. Tensored banding: M collections of R minhashes; a table for each pair of collections is keyed by both
together. M * R hashes serve M * (M - 1) / 2 tables of 2 R hashes each. Two sets meet in a table if two collections
agree: with M = 24, R = 4 a pair at similarity 0.85 is missed with probability 6e-7, at 0.8 with 6e-5.

1. A node joins tables only with the collections it shares with another node; most nodes have none and stop here.
2. Over a ring of M tables, each bucket's smallest node is compared with the others; links make components.
3. Over all tables, only buckets that still hold several components are looked at: first against some hubs; the nodes that
   are left then meet by the first rare items that their full sets share, which loses no link, and only nodes of different
   components are paired. Pairs inside a component would change nothing. So a group of copies or near copies is never
   expanded into all its pairs, nor is a family of texts that share a bucket without being similar enough.
A pair is made only if sizes and odd sketches allow the similarity: a sketch has a bit for each of ODD buckets of hashes,
whether an odd number fall there, so two differ in at most as many bits as the sets in members. This loses no link.

Defined cases: null or empty text, or no words: n_shingles 0, linked with nothing, component_id is its doc_id and it is
kept. Repeated rows: each gets a result; equal doc_ids share the verdict. Null doc_id: never a component's id unless it
is alone (then null, kept). Empty table: empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import given_back, pick, saved, small_batches
from .graph import components

M, R, HUBS, ODD, BEFORE = 24, 4, 2, 512, 4
#: Ids of documents that are broadcast (16 bytes each, or as many as a longer id has).
MOST_IDS = 2_000_000
_rng = np.random.default_rng(20240611)
_WORD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_PERM = _rng.integers(0, 1 << 63, (M * R), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _rng.integers(0, 1 << 63, (M * R), dtype=np.uint64)
_words: dict[bytes, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    if len(_words) > 200_000:
        _words.clear()
    out = []
    for t in texts:
        words = (t or "").encode().lower().split()
        if not words:
            out.append(np.zeros(0, np.uint64))
            continue
        try:
            h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in set(words):
                if w not in _words:
                    _words[w] = xxhash.xxh3_64_intdigest(w)
            h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
        k = min(width, len(words))
        n = len(words) - k + 1
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = s + h[i : i + n] * _WORD[i]
            s = s ^ (s >> np.uint64(29))
        out.append(np.unique(mix(s)))
    return out


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """One row of M collection hashes a set; no set may be empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    out = np.zeros((len(sets), M), np.uint64)
    for m in range(M):
        key = np.full(len(sets), m + 1, np.uint64)
        for r in range(R):
            low = np.minimum.reduceat((flat ^ _XOR[m * R + r]) * _PERM[m * R + r], at)
            key = mix(key + low * _WORD[r + 8])
        out[:, m] = key
    return out


def odd_sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ODD // 64 longs a set: for each of ODD buckets, whether an odd number of its hashes fall there.

    Two sketches differ in at most as many bits as their sets' symmetric difference has members.
    """
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    at = own * ODD + (np.concatenate(sets) & np.uint64(ODD - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * ODD) & 1).astype(np.uint8).reshape(len(sets), ODD)
    return np.packbits(odd, axis=1).view(np.int64)


def _node(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def nodes(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), node (null without shingles), halves (M collection hashes), odd (sketch)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1).to_pylist(), width)
            full = [k for k, s in enumerate(sets) if len(s)]
            at = np.zeros(len(sets) + 1, np.int32)
            at[1:] = np.cumsum([M if len(s) else 0 for s in sets])
            some = [sets[k] for k in full]
            sig = signature(some).ravel() if full else np.zeros(0, np.uint64)
            odd = odd_sketch(some).ravel() if full else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(sig.view(np.int64))), pa.ListArray.from_arrays(pa.array(at // M * (ODD // 64)), pa.array(odd))],
                ["doc_id", "n", "node", "halves", "odd"],
            )

    return docs.mapInArrow(given_back(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, node binary, halves array<long>, odd array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """node, items (sorted distinct shingle hashes) of each text that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [s for s in shingle_sets(b.column(1).to_pylist(), width) if len(s)]
            at = np.cumsum([0, *[len(s) for s in sets]]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["node", "items"])

    return docs.mapInArrow(given_back(run), "node binary, items array<long>")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct (a, b), those with 100 * intersection >= percent * union, on the full sets.

    Only sets of nodes in pairs are shuffled; which these are is broadcast if they are few.
    """
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    named = saved(named, "named")
    sets = sets.join(F.broadcast(named) if named.count() <= MOST_IDS else named, "node", "left_semi")
    a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("ia")), sets.select(F.col("node").alias("b"), F.col("items").alias("ib"))
    both = pairs.select("a", "b").join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("ia", "ib")).cast("long")
    return both.select("a", "b", F.size("ia").cast("long").alias("na"), F.size("ib").cast("long").alias("nb"), common.alias("c")).where(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * percent).select("a", "b")


def _near(percent: int):
    """False only for sets that cannot be similar enough, by their sizes and sketches.

    100 * c >= percent * u is (100 - percent) * (n + m) >= (100 + percent) * (members of just one of the sets).
    """
    differ = sum((F.bit_count(F.get("odd", k).bitwiseXOR(F.get("hub_odd", k))) for k in range(ODD // 64)), F.lit(0))
    return (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent) & ((F.col("n") + F.col("hub_n")) * (100 - percent) >= differ * (100 + percent))


def _rare(left: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """left (node, n, odd, comp) with item, at, before: the items of a node's set by which it meets every set similar enough.

    Sets of n items that are similar enough share percent * n / 100 of them at least, so not all they share is among the last
    of either in one order of all items; the first n - ceil(percent * n / 100) + 1 suffice. Rarest come first, those of one
    node alone (which meet nothing) before all: members of a family that differ in items of their own keep few or none.
    at is the item's place in that order; before, the last BEFORE items ahead of it that other nodes have too.
    """
    each = left.select("node").join(sets, "node").select("node", F.explode("items").alias("item"))
    often = saved(each.groupBy("item").agg(F.count("*").alias("f")).where("f > 1"), "often")
    own = each.join(often, "item").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "item"))).alias("x"))
    alone = F.col("n") - F.size("x")
    keep = F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1 - alone
    own = left.join(own, "node").where(keep > 0).select("*", alone.alias("alone"), F.slice("x.item", F.lit(1), F.greatest(keep, F.lit(0)).cast("int")).alias("own"))
    own = own.select("node", "n", "odd", "comp", "alone", "own", F.posexplode("own").alias("k", "item"))
    before = F.slice("own", F.greatest(F.col("k") - BEFORE, F.lit(0)) + 1, F.least("k", F.lit(BEFORE)))
    return saved(own.select("node", "n", "odd", "comp", "item", (F.col("alone") + F.col("k")).alias("at"), before.alias("before")), "rare")


def _meet(rare: DataFrame, percent: int) -> DataFrame:
    """node, a: every pair of nodes of different components that may be similar enough, from rows of _rare.

    Such sets of n and m items share s = ceil(percent * (n + m) / (100 + percent)) at least, all of them from the first they
    share on, so that one is at place n - s and m - s at most; for the smaller set s is least where both have its size. A pair
    is left out at an item that follows one they share too, as it is made at the first of these. No link is lost, and a pair
    comes from one item or few, not from each that its sets share.
    """
    share = lambda both: F.floor((both * percent + (99 + percent)) / (100 + percent))
    small = rare.where(F.col("at") <= F.col("n") - share(F.col("n") * 2))
    small = small.select("item", F.col("node").alias("a"), F.col("n").alias("hub_n"), F.col("odd").alias("hub_odd"), F.col("comp").alias("hub_comp"), F.col("at").alias("hub_at"), F.col("before").alias("hub_before"))
    s = share(F.col("n") + F.col("hub_n"))
    ordered = (F.col("hub_n") < F.col("n")) | ((F.col("hub_n") == F.col("n")) & (F.col("a") < F.col("node")))
    first = (F.col("at") <= F.col("n") - s) & (F.col("hub_at") <= F.col("hub_n") - s)
    return rare.join(small, "item").where((F.col("comp") != F.col("hub_comp")) & ordered & first & _near(percent) & ~F.arrays_overlap("before", "hub_before")).select("node", "a")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, comp) after links (a, b) between nodes."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("comp").alias("x")), labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    step = components(links.join(la, "a").join(lb, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    step = step.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return saved(labels.join(step, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")


def classes(docs: DataFrame, percent: int = 85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row; links are sets with a similarity of percent / 100 or more."""
    d = pick(docs, doc_id=id_col, text=text_col)
    every = saved(nodes(d, width), "nodes")
    reps = saved(every.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("halves").alias("halves"), F.first("odd").alias("odd")), "reps")
    half = reps.select("node", "n", F.explode("halves").alias("u"))
    often = saved(half.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").select("u"), "shared")
    # at most M values a node
    shared = half.join(often, "u", "left_semi").groupBy("node", "n").agg(F.array_sort(F.collect_set("u")).alias("us")).where(F.size("us") > 1)
    shared = saved(shared.join(reps.select("node", "odd"), "node"), "tables")

    def keyed(t: DataFrame) -> DataFrame:
        """All tables of t's nodes: node, n, key."""
        first = t.select("*", F.posexplode("us").alias("i", "u"))
        rest = first.select(*[c for c in t.columns if c != "us"], "u", F.explode(F.slice("us", F.col("i") + 2, M)).alias("v"))
        return rest.select(*[c for c in t.columns if c != "us"], F.xxhash64("u", "v").alias("key"))

    # the ring: neighbouring shared collections by hash, as many tables as collections
    ring = shared.select("node", "n", "odd", F.explode(F.transform(F.sequence(F.lit(1), F.size("us")), lambda i: F.xxhash64(F.element_at("us", i), F.element_at("us", F.when(i == F.size("us"), 1).otherwise(i + 1))))).alias("key"))
    hubs = saved(ring.groupBy("key").agg(F.min(F.struct("node", "n", "odd")).alias("h"), F.count("*").alias("k")).where("k > 1").select("key", F.col("h.node").alias("a"), F.col("h.n").alias("hub_n"), F.col("h.odd").alias("hub_odd")), "hubs")
    pairs = saved(ring.join(hubs, "key").where(F.col("a") != F.col("node")).where(_near(percent)).select("a", F.col("node").alias("b")).distinct(), "pairs")
    # texts are shuffled only if there are too many nodes with a table to broadcast their ids
    wanted = saved(reps.join(shared.select("node"), "node", "left_semi").select(F.col("doc_id").alias("want")).distinct(), "wanted")
    few = wanted.count() <= MOST_IDS
    texts = d.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("want")), "left_semi")
    sets = saved(full_sets(texts, width).groupBy("node").agg(F.first("items").alias("items")), "sets")
    labels = shared.select("node", F.col("node").alias("comp"))
    links = saved(_confirm(pairs, sets, percent), "links")
    labels = _relabel(labels, links)
    tested = pairs
    for turn in range(HUBS + 1):
        here = shared.join(labels, "node")
        mixed = saved(keyed(here).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"), "mixed")
        if mixed.isEmpty():
            break
        rows = saved(keyed(here).join(mixed, "key", "left_semi"), "rows")
        if turn < HUBS:
            hubs = saved(rows.groupBy("key").agg(F.min_by(F.struct("node", "n", "odd", "comp"), F.xxhash64("node", F.lit(turn))).alias("h")).select("key", F.col("h.node").alias("a"), F.col("h.n").alias("hub_n"), F.col("h.odd").alias("hub_odd"), F.col("h.comp").alias("hub_comp")), "hubs")
            found = rows.join(hubs, "key").where((F.col("comp") != F.col("hub_comp")) & _near(percent))
        else:
            found = _meet(_rare(rows.select("node", "n", "odd", "comp").distinct(), sets, percent), percent)
        new = found.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()
        new = saved(new.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = saved(_confirm(new, sets, percent), "links")
        labels = _relabel(labels, links)
        tested = tested.unionByName(new)
    # from nodes back to documents
    comps = labels.join(reps.select("node", "doc_id"), "node")
    smallest = saved(comps.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "smallest")
    named = comps.join(smallest, "comp").select("node", "component_id")
    alone = reps.join(labels.select("node"), "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    named = saved(named.unionByName(alone), "named")
    out = every.select("doc_id", "n", "node").join(named, "node", "left")
    cid = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), cid.alias("component_id"), F.coalesce(F.col("doc_id").eqNullSafe(cid), F.lit(True)).alias("kept"))
