"""Spans: detection by phrase and pattern, merging, greedy selection, patches. Offsets are code points, half-open."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T


#: Matches whose positions are summed at a time, so that a text with many costs no more than in proportion.
CHUNK = 256
#: Texts of a batch that are handed on at a time.
SCAN = 256
FOUND = T_.StructType([T_.StructField("start", T_.IntegerType()), T_.StructField("end", T_.IntegerType()), T_.StructField("v", T_.StringType())])


def located(d: DataFrame, text_col: str, pattern: str | Column) -> DataFrame:
    """d with an array column `found` of (start, end, v, before, after): a pattern's matches, and the characters next to them.

    Positions are sums of the lengths of matches and of the gaps between them. The arrays are columns of their own, each
    used more than once, so that no expression of a whole text is evaluated per match.
    """
    t = F.col(text_col)
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    d = d.withColumn("_m", F.regexp_extract_all(t, p, F.lit(0))).withColumn("_g", F.split(t, p, -1))
    d = d.withColumn("_l", F.transform("_m", lambda m, i: F.length(m) + F.length(F.get(F.col("_g"), i))))
    n = F.size("_l")
    total = lambda k: F.aggregate(F.slice("_l", k * CHUNK + 1, CHUNK), F.lit(0), lambda a, x: a + x)
    chunks = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))
    d = d.withColumn("_b", F.aggregate(chunks, F.array(F.lit(0)), lambda acc, k: F.array_append(acc, F.element_at(acc, -1) + total(k))))

    def ends(k: Column) -> Column:
        """Where each match of chunk k ends."""
        first = F.array(F.get(F.col("_b"), k))
        return F.slice(F.aggregate(F.slice("_l", k * CHUNK + 1, CHUNK), first, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)), 2, CHUNK)

    d = d.withColumn("_e", F.flatten(F.transform(chunks, ends)))

    def one(e: Column, i: Column) -> Column:
        m, left, right = F.get(F.col("_m"), i), F.get(F.col("_g"), i), F.get(F.col("_g"), i + 1)
        left = F.when(left != "", left).otherwise(F.coalesce(F.get(F.col("_m"), i - 1), F.lit("")))
        right = F.when(right != "", right).otherwise(F.coalesce(F.get(F.col("_m"), i + 1), F.lit("")))
        return F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("v"), F.right(left, F.lit(1)).alias("before"), F.left(right, F.lit(1)).alias("after"))

    return d.withColumn("found", F.when(F.size("_e") > 0, F.transform("_e", one)).otherwise(F.transform(F.slice("_e", 1, 1), one))).drop("_m", "_g", "_l", "_b", "_e")


def literal_spans(docs: DataFrame, phrases: list[str], channel: str = "literal", keep: tuple[str, ...] = ()) -> DataFrame:
    """Leftmost-longest phrases; a match that is not bounded by non-letters goes, without another try (it hides shorter ones).

    keep: columns of docs that go with each span, so that none is joined back.
    """
    pattern = "|".join(re.escape(p) for p in sorted(phrases, key=lambda p: (-len(p), p)))
    schema = T_.StructType([docs.schema["doc_id"], *[docs.schema[c] for c in keep], T_.StructField("s", T_.ArrayType(FOUND))])
    regex, lower = re.compile(pattern), bytes.maketrans(T.UPPER.encode(), T.LOWER.encode())

    def found(texts) -> pa.Array:
        upto, start, end, v = [0], [], [], []
        for x in texts:
            t = (x.as_py() or b"").translate(lower).decode(errors="surrogateescape")
            for m in regex.finditer(t):
                i, j = m.span()
                # letters of a word are \p{L} and the apostrophe
                if not (i and (t[i - 1].isalpha() or t[i - 1] == "'")) and not (j < len(t) and (t[j].isalpha() or t[j] == "'")):
                    start.append(i)
                    end.append(j)
                    v.append(m[0])
            upto.append(len(start))
        spans = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(v, pa.string())], ["start", "end", "v"])
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spans)

    def scan(batches):
        for b in batches:
            for k in range(0, len(b), SCAN):
                part = b.slice(k, SCAN)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", *keep)] + [found(part.column("_t"))], ["doc_id", *keep, "s"])

    d = docs.select("doc_id", *keep, F.col("text").cast("binary").alias("_t")).mapInArrow(scan, schema)
    return d.select("doc_id", *keep, F.explode("s").alias("s")).select("doc_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(channel).alias("channel"), F.col("s.v").alias("frame_id"), *keep)


def regex_spans(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """patterns: frame_id, pattern (a small table by contract): matches per sentence, positions in the sentence."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sent_ix", "s"))
    rows = patterns.agg(F.collect_list(F.struct("frame_id", "pattern")).alias("ps"))
    e = s.join(F.broadcast(rows)).select("doc_id", F.col("sent_ix").cast("long").alias("sent_ix"), "s", F.explode("ps").alias("p"))
    m = e.select("doc_id", "sent_ix", F.col("p.frame_id").alias("frame_id"), F.regexp_count("s", F.col("p.pattern")).cast("long").alias("n"))
    return m.where("n > 0")


def merge(spans: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Drops exact duplicates, keeps overlaps, and numbers spans in total order (start, end, channel rank, frame)."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    d = spans.dropDuplicates(["doc_id", "start", "end", "channel", "frame_id"])
    w = Window.partitionBy("doc_id").orderBy("start", "end", rank[F.col("channel")], "frame_id")
    return d.select("doc_id", "start", "end", "channel", "frame_id", F.row_number().over(w).cast("long").alias("ix"))


def islands(spans: DataFrame) -> DataFrame:
    """Merges overlapping or adjacent spans; the name is that of the largest score, ties to the first in (start, end, frame_id)."""
    # rows of the same span tie in the order; one stays
    spans = spans.groupBy("doc_id", "start", "end", "frame_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("doc_id").orderBy("start", "end", "frame_id")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = spans.withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    d = d.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min_by("frame_id", F.struct(-F.col("score"), "start", "end", "frame_id"))
    return d.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), first.alias("frame_id")).drop("island")


def resolve(patches: DataFrame) -> DataFrame:
    """Greedy: leftmost first, longest, then rule; a patch that begins before the last accepted end goes."""
    kept = F.aggregate(
        F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("neg"), "rule", "replacement"))),
        F.struct(F.lit(-1).alias("upto"), F.array().cast("array<struct<start:int,end:int,rule:string,replacement:string>>").alias("out")),
        lambda acc, p: F.when(
            p["start"] >= acc["upto"],
            F.struct((-p["neg"]).alias("upto"), F.array_append(acc["out"], F.struct(p["start"].alias("start"), (-p["neg"]).alias("end"), p["rule"].alias("rule"), p["replacement"].alias("replacement"))).alias("out")),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    typed = patches.select("doc_id", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "rule", "replacement")
    return typed.groupBy("doc_id").agg(kept.alias("patches"))


def apply_patches(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """doc_id, fixed: texts with their resolved patches applied, each text cut once at all of them."""
    j = docs.join(resolved, "doc_id", "left")
    at = lambda f: F.transform("patches", lambda p: p[f]).alias(f)
    schema = T_.StructType([docs.schema["doc_id"], T_.StructField("fixed", T_.BinaryType())])

    def one(text, start, end, new):
        if text is None or start is None:
            return text
        text, out, upto = text.decode(errors="surrogateescape"), [], 0
        for i, j, x in zip(start, end, new, strict=True):
            if x is None:
                return None
            out += (text[upto:i], x)
            upto = j
        return "".join([*out, text[upto:]]).encode(errors="surrogateescape")

    def cut(batches):
        for b in batches:
            for k in range(0, len(b), SCAN):
                part = b.slice(k, SCAN)
                rows = zip(*(part.column(c).to_pylist() for c in ("text", "start", "end", "replacement")), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([one(*r) for r in rows], pa.binary())], ["doc_id", "fixed"])

    j = j.select("doc_id", F.col("text").cast("binary").alias("text"), at("start"), at("end"), at("replacement")).mapInArrow(cut, schema)
    return j.select("doc_id", F.col("fixed").cast("string").alias("fixed"))


def line_column(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of an offset."""
    head = F.substring(text, F.lit(1), offset)
    lines = F.split(head, "\n", -1)
    return F.size(lines), F.length(F.element_at(lines, -1)) + 1


def runs(stats: DataFrame, start: int = 3, keep: int = 2, least: int = 2) -> DataFrame:
    """stats: doc_id, tok_ix, d -> runs that begin at d >= start, go on while d >= keep, and have `least` tokens or more."""
    w = Window.partitionBy("doc_id").orderBy("tok_ix")
    hi = stats.where(F.col("d") >= keep).withColumn("g", F.col("tok_ix") - F.row_number().over(w))
    first = F.min(F.when(F.col("d") >= start, F.col("tok_ix"))).over(Window.partitionBy("doc_id", "g"))
    r = hi.withColumn("first", first).where(F.col("tok_ix") >= F.col("first"))
    r = r.groupBy("doc_id", "g").agg(F.min("tok_ix").alias("start_ix"), (F.max("tok_ix") + 1).alias("end_ix"), F.sum("d").alias("score"))
    return r.where(F.col("end_ix") - F.col("start_ix") >= least).drop("g")


def budgeted(candidates: DataFrame, words: DataFrame, per_1000: float) -> DataFrame:
    """The first ceil(per_1000 * words / 1000) candidates (doc_id, start) of each document."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    d = candidates.withColumn("k", F.row_number().over(w)).join(words, "doc_id")
    return d.where(F.col("k") <= F.ceil(F.col("n_words") * per_1000 / 1000)).drop("k", "n_words")
