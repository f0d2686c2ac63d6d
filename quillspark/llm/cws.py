"""Operator 7: fingerprints by consistent weighted sampling, in DataFrame functions alone.

Terms are words [^\\x20\\x09-\\x0D]+, weighted by how often a text has them. For sample k and term j with weight S, hashes
of (j, k) give r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); t = floor(ln S / r + b), ln a = ln c - r (t - b + 1). The sample
is the (term, t) with the smallest a; two texts agree on a sample with the probability of their generalised Jaccard
similarity, sum of minima over sum of maxima of weights. A sample is kept as 24 bits of a hash of (term, t).

ln a goes to the upper 39 bits of a long (steps of 2^-32) above the sample's 24 bits, so that one long minimum per sample
is all that is aggregated: in the task that explodes a text's terms, before any shuffle.

Edited text: the last floor(n / 2) code points are replaced by as many first ones of the next document, by doc_id (then by
the text's hash), after the last the first. Neighbours are found on ids alone: a range partitioning, a window in each
partition, and one row per partition to link them. Each text then sends its neighbour only the prefix it needs.

Defined cases: null text is empty; a text without terms has an empty fingerprint, likeness 1 to another such and 0 to
others; rows equal in doc_id and text are one document and give one row; several texts of a doc_id are each a document;
null doc_id sorts first; a single document is its own neighbour; empty table: empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import never_null, pick, saved, text_or_empty

SAMPLES = 32
WHITE = r"[\x20\x09-\x0D]+"


def _unit(bits: Column, at: int, n: int) -> Column:
    """n bits of a long as a number inside (0, 1)."""
    return (F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << n) - 1)) + 0.5) / float(1 << n)


def sample(term: Column, ln_weight: Column, k: int) -> Column:
    """ln a above 24 bits that name (term, t)."""
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.log(_unit(h, 0, 16) * _unit(h, 16, 16))
    ln_c = F.log(-F.log(_unit(g, 0, 31) * _unit(g, 31, 31)))
    b = _unit(h, 32, 16)
    t = F.floor(ln_weight / r + b)
    ln_a = ln_c - r * (t - b + 1)
    name = F.shiftrightunsigned(h, 40).bitwiseXOR(t * 40503).bitwiseAND(F.lit(0xFFFFFF))
    return F.shiftleft(((ln_a + 80) * float(1 << 32)).cast("long"), 24).bitwiseOR(name)


def weighted_terms(text: Column) -> list[tuple[str, Column]]:
    """Columns to add one after another; the last, terms, is an array of (term hash, ln weight)."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n = F.size("_s")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get(F.col("_s"), i - 1) != F.get(F.col("_s"), i)))
    terms = F.transform("_e", lambda e, j: F.struct(F.get(F.col("_s"), e - 1).alias("h"), F.log((e - F.when(j == 0, 0).otherwise(F.get(F.col("_e"), j - 1))).cast("double")).alias("w")))
    return [("_s", F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))), ("_e", F.when(n > 0, ends).otherwise(F.array().cast("array<int>"))), ("terms", terms)]


def fingerprints(texts: DataFrame, text_col: str, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """keys and fp (array of samples; null without terms) of each text; keys name a row and are fixed-width."""
    t = texts
    for name, c in weighted_terms(F.col(text_col)):
        t = t.withColumn(name, c)
    t = t.select(*keys, F.explode_outer("terms").alias("x")).select(*keys, F.col("x.h").alias("_h"), F.col("x.w").alias("_w"))
    mins = t.groupBy(*keys).agg(*[F.min(sample(F.col("_h"), F.col("_w"), k)).alias(f"m{k}") for k in range(samples)])
    fp = F.array(*[F.col(f"m{k}").bitwiseAND(F.lit(0xFFFFFF)).cast("int") for k in range(samples)])
    return mins.select(*keys, F.when(F.col("m0").isNotNull(), fp).alias("fp"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of samples that agree."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(same / samples)


def spelled(fp: Column) -> Column:
    """Six hexadecimal digits a sample; empty without terms."""
    return F.coalesce(F.array_join(F.transform(fp, lambda v: F.lpad(F.lower(F.hex(v.cast("long"))), 6, "0")), ""), F.lit(""))


def neighbours(d: DataFrame) -> DataFrame:
    """g (doc_id, never null), h, n, and the keys of the next and the previous document by (g, h), in a circle; the previous one's n."""
    spark = d.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = d.select("g", "h", "n").distinct().repartitionByRange(parts, "g", "h")
    ids = saved(ids.withColumn("part", F.spark_partition_id()), "ids")
    at = F.struct("g", "h", "n")
    # one row a partition
    ends = ids.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    line = Window.orderBy("part")
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lead("first").over(line), F.first("first").over(whole)).alias("after"), F.coalesce(F.lag("last").over(line), F.last("last").over(whole)).alias("before"))
    w = Window.partitionBy("part").orderBy("g", "h")
    near = ids.withColumn("x", F.lead(at).over(w)).withColumn("y", F.lag(at).over(w)).join(F.broadcast(ends), "part")
    nxt, prv = F.coalesce("x", "after"), F.coalesce("y", "before")
    return near.select("g", "h", "n", nxt["g"].alias("next_g"), nxt["h"].alias("next_h"), prv["g"].alias("prev_g"), prv["h"].alias("prev_h"), prv["n"].alias("prev_n"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, g, h, n, next_g, next_h, text, edited of each distinct (doc_id, text)."""
    d = pick(docs, doc_id=id_col, text=text_col).select("doc_id", text_or_empty(F.col("text")).alias("text"))
    d = d.withColumn("g", never_null(d, "doc_id")).withColumn("h", F.xxhash64("text")).withColumn("n", F.length("text").cast("long"))
    near = saved(neighbours(d), "neighbours")
    # one shuffle of the texts serves the grouping and both joins: either use reads the same columns, as one struct
    one = d.groupBy("g", "h").agg(F.first(F.struct("doc_id", "text")).alias("row"))
    t = one.join(near, ["g", "h"])
    sent = t.select(F.col("prev_g").alias("g"), F.col("prev_h").alias("h"), F.substring(F.col("row.text"), F.lit(1), F.floor(F.col("prev_n") / 2).cast("int")).alias("tail"))
    both = t.join(sent, ["g", "h"])
    keep = F.substring(F.col("row.text"), F.lit(1), (F.col("n") - F.floor(F.col("n") / 2)).cast("int"))
    return both.select("row.doc_id", "g", "h", "n", "next_g", "next_h", "row.text", F.concat(keep, F.col("tail")).alias("edited"))


def compare(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    e = edited(docs, id_col, text_col)
    # the digest travels as four longs, so that all keys of the aggregation have a fixed width
    e = e.withColumn("sha", F.sha2("edited", 256))
    for k in range(4):
        e = e.withColumn(f"s{k}", F.conv(F.substring("sha", 1 + 16 * k, 16), 16, -10).cast("long"))
    fixed = ["doc_id", "g", "h", "n", "next_g", "next_h", "s0", "s1", "s2", "s3"]
    both = e.select(*fixed, F.explode(F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t")), F.struct(F.lit(1).alias("v"), F.col("edited").alias("t")))).alias("x"))
    fp = saved(fingerprints(both.select(*fixed, F.col("x.v").alias("v"), F.col("x.t").alias("t")), "t", [*fixed, "v"], samples), "fingerprints")
    own = fp.where("v = 0").alias("a")
    other = fp.where("v = 1").select("g", "h", F.col("fp").alias("efp")).alias("b")
    nxt = fp.where("v = 0").select(F.col("g").alias("next_g"), F.col("h").alias("next_h"), F.col("fp").alias("nfp")).alias("c")
    j = own.join(other, ["g", "h"]).join(nxt, ["next_g", "next_h"])
    sha = F.concat(*[F.lpad(F.lower(F.hex(F.col(f"s{k}"))), 16, "0") for k in range(4)])
    return j.select("doc_id", F.col("n").alias("n_chars"), sha.alias("edited_sha256"), spelled(F.col("fp")).alias("fingerprint"), spelled(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp"), samples).alias("near_edited"), likeness(F.col("fp"), F.col("nfp"), samples).alias("near_next"))
