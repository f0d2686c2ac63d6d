"""Operator 3: mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Each source's rows, in a shuffled but fixed order, are cut into blocks. Weights become whole numbers of slots in a period
of `grid` slots (largest remainders). Block i of a source with weight w = slots / grid has release floor(i / w) and
deadline ceil((i + 1) / w). One period is scheduled earliest deadline first among released blocks (ties: larger source
name last); every slot is filled and every window met, so in each prefix a source is less than one block away from its
share; the next periods repeat it. A row's place is (slot, place in block); slots of sources that have ended stay empty, so the
others go on in proportion. No row is dropped or repeated.

Numbering rows inside a source: rows fall into `lanes` by hash, and lanes are numbered by a window of a lane of a source
after the sizes of the lanes before it, so a source with a third of all rows is dealt out like the others.

Only the schedule of one period and the weights (a row per source) are computed in one task; both are bounded by grid and
by the number of sources, at most MOST_SOURCES (more raise an error).

Defined cases: null source is a source of its own; null doc_id sorts first; rows equal in doc_id and text follow one
another; weights name sources that are absent: they get no slots; sources without a weight raise an error; empty table:
empty result; other columns are kept by `order` and not read by `places`. Rows equal in doc_id and source have places of
their own (which of them has which is open).
"""

from __future__ import annotations

import bisect
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

MOST_SOURCES, MOST_CUTS, NULL = 1000, 1_000_000, "\x00null"


def sizes(docs: DataFrame, source_col: str = "source") -> dict[str, int]:
    """Rows by source; a row per source comes to the driver."""
    rows = docs.groupBy(F.coalesce(F.col(source_col), F.lit(NULL)).alias("s")).agg(F.count("*").alias("k")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return {r.s: r.k for r in rows}


def tempered(n: dict[str, int], power: float = 0.5) -> dict[str, float]:
    """Target weights in proportion to size ** power."""
    total = sum(v**power for v in n.values())
    return {s: v**power / total for s, v in n.items()}


def slots_of(weights: dict[str, float], grid: int) -> dict[str, int]:
    """Slots in a period by largest remainders, at least one each; ties by name."""
    grid = max(grid, 4 * len(weights))
    total = sum(weights.values())
    share = {s: w / total * grid for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in share.items()}
    order = sorted(weights, key=lambda s: (out[s] - share[s], s))
    k = 0
    while sum(out.values()) < grid:
        out[order[k % len(order)]] += 1
        k += 1
    while sum(out.values()) > grid:
        s = max(out, key=lambda s: (out[s] - share[s] if out[s] > 1 else -math.inf, s))
        out[s] -= 1
    return out


def schedule(spark, slots: dict[str, int]) -> DataFrame:
    """source, i (block in the period), slot, release, deadline: one period, earliest deadline first, as one SQL fold."""
    grid = sum(slots.values())
    names = sorted(slots)
    one = spark.range(1).select(
        F.array(*[F.lit(s) for s in names]).alias("names"),
        F.array(*[F.lit(slots[s]).cast("long") for s in names]).alias("w"),
    )
    # done[s]: blocks of s so far; block done[s] is released at floor(done * grid / w), due at ceil((done + 1) * grid / w)
    folded = one.select(
        "names",
        "w",
        F.expr(f"""
        aggregate(sequence(0L, {grid - 1}L),
          named_struct('done', transform(w, x -> 0L), 'out', cast(array() as array<int>)),
          (acc, t) -> transform(array(array_min(filter(transform(w, (x, s) ->
              if(acc.done[s] < x and acc.done[s] * {grid}L div x <= t,
                 named_struct('due', ((acc.done[s] + 1L) * {grid}L + x - 1L) div x, 's', s), null)), c -> c is not null)).s),
            k -> named_struct('done', transform(acc.done, (v, s) -> if(s = k, v + 1L, v)), 'out', array_append(acc.out, k)))[0],
          acc -> acc.out)""").alias("out"),
    )
    rows = folded.select("names", "w", F.posexplode("out").alias("slot", "s"))
    w = Window.partitionBy("s").orderBy("slot")
    rows = rows.select(F.get("names", F.col("s")).alias("source"), F.get("w", F.col("s")).alias("w"), F.col("slot").cast("long").alias("slot"), (F.row_number().over(w) - 1).cast("long").alias("i"))
    return rows.select("source", "w", "i", "slot", F.expr(f"i * {grid}L div w").alias("release"), F.expr(f"((i + 1L) * {grid}L + w - 1L) div w").alias("deadline"))


def places(docs: DataFrame, slots: dict[str, int], block: int = 16, lanes: int = 512, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """doc_id, source, block, slot, place, release, deadline of each row; (slot, place) is the order of the mixture."""
    grid = sum(slots.values())
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.col(source_col), F.lit(NULL)).alias("s"))
    return _placed(d, schedule(docs.sparkSession, slots), grid, block, lanes, seed).select("doc_id", "source", "block", "slot", "place", "release", "deadline")


def _placed(d: DataFrame, plan: DataFrame, grid: int, block: int, lanes: int, seed: int) -> DataFrame:
    """d: doc_id, s and any more columns without the names added here."""
    d = d.withColumn("_key", F.xxhash64("doc_id", F.lit(seed)))
    d = d.withColumn("_lane", F.pmod("_key", F.lit(lanes)))
    count = d.groupBy("s", "_lane").agg(F.count("*").alias("_k"))
    # at most `lanes` rows a source
    before = count.select("s", "_lane", (F.sum("_k").over(Window.partitionBy("s").orderBy("_lane")) - F.col("_k")).alias("_before"))
    n = F.row_number().over(Window.partitionBy("s", "_lane").orderBy("_key", "doc_id")) - 1
    d = d.withColumn("_n", n).join(F.broadcast(before), ["s", "_lane"])
    d = d.withColumn("_at", F.col("_before") + F.col("_n")).withColumn("block", F.expr(f"_at div {block}"))
    slot_of = plan.select(F.col("source").alias("s"), F.col("w").alias("_w"), "i", F.col("slot").alias("_slot"), F.col("release").alias("_r"), F.col("deadline").alias("_d"))
    d = d.join(F.broadcast(slot_of.select("s", "_w").distinct()), "s", "left")
    d = d.withColumn("_period", F.expr("block div coalesce(_w, raise_error('a source has no weight'))")).withColumn("i", F.expr("block % _w"))
    d = d.drop("_w").join(F.broadcast(slot_of.drop("_w")), ["s", "i"])
    base = F.col("_period") * grid
    return d.select("*", (base + F.col("_slot")).alias("slot"), F.expr(f"_at % {block}").alias("place"), (base + F.col("_r")).alias("release"), (base + F.col("_d")).alias("deadline"))


def _preimages(spark, parts: int) -> list[int]:
    """For each partition a number that hash partitioning sends there, so that partitions follow one another in order."""
    found: dict[int, int] = {}
    lo, step = 0, 16 * parts
    while len(found) < parts:
        rows = spark.range(lo, lo + step).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(parts)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()
        for r in rows:
            found.setdefault(r.p, r.id)
        lo += step
    return [found[p] for p in range(parts)]


def order(docs: DataFrame, slots: dict[str, int], block: int = 16, lanes: int = 512, seed: int = 17, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """All rows and columns of docs, in partitions by ranges of slots and sorted by their place in the mixture.

    Whole rows are shuffled once. The slots in use are cut into even ranges, one a partition (fewer, if sources x ranges would
    be more than MOST_CUTS). A range begins in a source at a row of known number, inside a lane of known size: that row's key
    is looked up among the keys of such lanes, and each row knows its range by its lane and key before it moves. Rows equal
    in doc_id and source are numbered one after another but stay in one partition, where the last of them begins a range.
    """
    spark, cols = docs.sparkSession, docs.columns
    grid = sum(slots.values())
    key = F.xxhash64(F.col(id_col), F.lit(seed))
    d = docs.select(F.struct(*[F.col(c) for c in cols]).alias("row"), F.coalesce(F.col(source_col), F.lit(NULL)).alias("s"), F.pmod(key, F.lit(lanes)).alias("lane"), F.struct(key.alias("key"), F.col(id_col).alias("id")).alias("k"))
    small = d.select("s", "lane", "k")
    # a row per lane of a source, at most `lanes` x MOST_SOURCES
    size = {(r.s, r.lane): r.n for r in small.groupBy("s", "lane").agg(F.count("*").alias("n")).collect()}
    before: dict[str, list[int]] = {s: [0] for s, _ in size}
    for s, upto in before.items():
        for k in range(lanes):
            upto.append(upto[-1] + size.get((s, k), 0))
    if missing := set(before) - set(slots):
        raise ValueError(f"a source has no weight: {sorted(missing)[:3]}")
    at: dict[str, list[int]] = {s: [] for s in slots}
    for r in schedule(spark, slots).orderBy("slot").collect():
        at[r.source].append(r.slot)
    last = max((grid * ((u[-1] - 1) // block // slots[s]) + at[s][(u[-1] - 1) // block % slots[s]] for s, u in before.items()), default=0)
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_CUTS // max(len(before), 1)))
    width = last // ranges + 1
    known, wanted = [], []
    for s, upto in before.items():
        # the numbers of the rows that begin ranges; of ranges that begin at one row the others are empty
        first: dict[int, int] = {}
        for b in range(ranges):
            period, rest = divmod(b * width, grid)
            first[block * (period * slots[s] + bisect.bisect_left(at[s], rest))] = b
        marks = sorted(first)
        for k in range(lanes):
            if upto[k] < upto[k + 1]:
                known.append((s, k, upto[k], first[marks[bisect.bisect_right(marks, upto[k]) - 1]]))
                inside = marks[bisect.bisect_right(marks, upto[k]) : bisect.bisect_left(marks, upto[k + 1])]
                if inside:
                    wanted.append((s, k, [(x - upto[k] + 1, first[x]) for x in inside]))
    looked = spark.createDataFrame(wanted, "s string, lane long, w array<struct<n:int,b:int>>")
    order_in = Window.partitionBy("s", "lane").orderBy("k")
    cut = small.join(F.broadcast(looked), ["s", "lane"]).select("*", F.row_number().over(order_in).alias("_n"), F.rank().over(order_in).alias("_rank"))
    cut = cut.withColumn("_b", F.get(F.filter("w", lambda x: x["n"] == F.col("_n")), F.lit(0))["b"]).where("_b is not null")
    # rows equal to one that begins a range go there with it
    cut = cut.groupBy("s", "lane", "k").agg(F.max("_b").alias("b"), F.first("_rank").alias("rank"))
    cut = cut.groupBy("s", "lane").agg(F.sort_array(F.collect_list(F.struct("k", "b", "rank"))).alias("cuts"))
    table = spark.createDataFrame(known, "s string, lane long, before long, b0 int").join(saved(cut, "cuts"), ["s", "lane"], "left")
    d = d.join(F.broadcast(table), ["s", "lane"])
    d = d.withColumn("_x", F.get(F.reverse(F.filter("cuts", lambda x: x["k"] <= F.col("k"))), F.lit(0)))
    d = d.select("row", "s", "lane", "k", F.coalesce("_x.b", "b0").alias("b"), (F.col("before") + F.coalesce(F.col("_x.rank") - 1, F.lit(0))).alias("_from"))
    there = spark.createDataFrame(list(enumerate(_preimages(spark, ranges))), "b int, to int")
    # the window needs no further shuffle: its keys begin with that of the partitioning
    d = d.join(F.broadcast(there), "b").drop("b").repartition(ranges, "to")
    d = d.withColumn("_at", F.col("_from") + F.row_number().over(Window.partitionBy("to", "s", "lane", "_from").orderBy("k")) - 1).withColumn("i", F.expr(f"_at div {block}"))
    plan = spark.createDataFrame([(s, slots[s], at[s]) for s in sorted(slots)], "s string, _w long, _slots array<long>")
    d = d.join(F.broadcast(plan), "s")
    slot = F.expr("i div _w") * grid + F.get("_slots", F.expr("cast(i % _w as int)"))
    out = d.select("row", slot.alias("slot"), F.expr(f"_at % {block}").alias("place")).sortWithinPartitions("slot", "place")
    return out.select(*[F.col("row")[c].alias(c) for c in cols])
