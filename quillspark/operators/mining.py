"""Mining jobs over classes a and b: counts by conditional aggregation, one shuffle on the n-gram."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import log_odds, smoothed_ratio
from .matches import matches, rows_of
from .spans import runs


def ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """ngram, a, b: occurrences by class; n-grams stay inside a mining segment. docs has class."""
    grams = F.flatten(F.transform(T.mining_segments(F.coalesce("text", F.lit(""))), lambda s: T.ngrams(s, order)))
    e = docs.select("class", F.explode(grams).alias("ngram"))
    return e.groupBy("ngram").agg(F.count_if(F.col("class") == "a").alias("a"), F.count_if(F.col("class") == "b").alias("b"))


def with_totals(counts: DataFrame) -> DataFrame:
    """Adds ta, tb: class totals; one row is broadcast."""
    return counts.join(F.broadcast(counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))))


def log_odds_table(counts: DataFrame) -> DataFrame:
    """z by n-gram; the prior is the pooled count."""
    c = with_totals(counts)
    prior = (F.col("a") + F.col("b")).cast("double")
    delta, z = log_odds(F.col("a"), F.col("ta"), F.col("b"), F.col("tb"), prior, (F.col("ta") + F.col("tb")).cast("double"))
    return c.select("ngram", "a", "b", F.round(delta, 6).alias("delta"), F.round(z, 6).alias("z"))


def top_both(table: DataFrame, k: int) -> DataFrame:
    """The k highest and k lowest z, ties by text."""
    hi = table.orderBy(F.desc("z"), "ngram").limit(k).withColumn("side", F.lit("a"))
    lo = table.orderBy("z", "ngram").limit(k).withColumn("side", F.lit("b"))
    return hi.unionByName(lo)


def ratio_top(docs: DataFrame, order: int, unigrams: DataFrame, least: int, k: int) -> DataFrame:
    """n-grams by smoothed ratio b over a, whose words all have `least` occurrences in unigrams (ngram, a, b)."""
    c = with_totals(ngram_counts(docs, order)).select("ngram", "a", "b", F.round(smoothed_ratio(F.col("b"), F.col("tb"), F.col("a"), F.col("ta")), 6).alias("ratio")).where("b >= 2")
    if least > 0:
        often = unigrams.where(F.col("a") + F.col("b") >= least).select(F.col("ngram").alias("w"))
        for i in range(order):
            c = c.join(often, F.split_part("ngram", F.lit(" "), F.lit(i + 1)) == F.col("w"), "left_semi")
    return c.orderBy(F.desc("ratio"), "ngram").limit(k).select("ngram", "a", "b", "ratio")


def burst_envelope(docs: DataFrame, least_tokens: int = 120, floor: int = 5) -> DataFrame:
    """word, n, burst: occurrences, and the largest rate per million in a document of least_tokens tokens or more."""
    t = docs.select("doc_id", T.clean_tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("n", F.size("t"))
    per = t.select("doc_id", "n", F.explode("t").alias("word")).where(~F.col("word").isin(*".,;:!?")).groupBy("doc_id", "n", "word").agg(F.count("*").alias("k"))
    burst = F.max(F.when(F.col("n") >= least_tokens, F.round(F.col("k") * 1e6 / F.col("n"))))
    return per.groupBy("word").agg(F.sum("k").alias("n"), F.coalesce(burst, F.lit(0.0)).alias("burst")).where(F.col("n") >= floor)


def overuse(docs: DataFrame, envelope: DataFrame, least: int = 4, least_tokens: int = 120, headroom: float = 1.2) -> DataFrame:
    """Words of three letters or more whose Wilson lower rate per million in a document is above headroom * burst."""
    from ..functions.stats import wilson

    t = docs.select("doc_id", T.clean_tokens(F.coalesce("text", F.lit(""))).alias("t")).withColumn("n", F.size("t")).where(F.col("n") >= least_tokens)
    per = t.select("doc_id", "n", F.explode("t").alias("word")).where(F.length("word") >= 3).groupBy("doc_id", "n", "word").agg(F.count("*").alias("k")).where(F.col("k") >= least)
    lo = wilson(F.col("k"), F.col("n").cast("double"))[0] * 1e6
    return per.join(envelope.select("word", "burst"), "word").where(lo > headroom * F.col("burst")).select("doc_id", "word", F.col("k").alias("n_word"), F.round(lo, 3).alias("lower_pm"), "burst")


def seams(docs: DataFrame) -> DataFrame:
    """left, right, n: adjacent tokens of a sentence, the first after <s>."""
    s = docs.select(F.explode(T.sentences(F.coalesce("text", F.lit("")))).alias("s"))
    # a filter on the tokens would make them twice: a sentence without tokens has no pairs
    s = s.select(T.clean_tokens(F.col("s")).alias("t"))
    pairs = F.transform("t", lambda x, i: F.struct(F.when(i == 0, F.lit("<s>")).otherwise(F.get(F.col("t"), i - 1)).alias("left"), x.alias("right")))
    return s.select(F.explode(pairs).alias("p")).select("p.left", "p.right").groupBy("left", "right").agg(F.count("*").alias("n"))


def midrank_auc(values: DataFrame) -> DataFrame:
    """values: metric, class (a or b), v -> metric, auc of b over a, tie-corrected; null if a side is empty.

    Ranks come from counts of distinct values, so a window holds a row per distinct value of a metric.
    """
    c = values.groupBy("metric", "v").agg(F.count_if(F.col("class") == "a").alias("na"), F.count_if(F.col("class") == "b").alias("nb"))
    w = Window.partitionBy("metric").orderBy("v")
    below = F.coalesce(F.sum("na").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("u", F.col("nb") * (below + F.col("na") / 2.0))
    g = c.groupBy("metric").agg(F.sum("u").alias("u"), F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    auc = F.when((F.col("na") > 0) & (F.col("nb") > 0), F.round(F.col("u") / (F.col("na") * F.col("nb")), 6))
    return g.select("metric", auc.alias("auc"), "na", "nb")


def split_assign(docs: DataFrame, strata: list[str]) -> DataFrame:
    """train, dev, holdout by sha256 order of the id in each stratum: below n * 70 / 100, n * 85 / 100, the rest."""
    h = F.sha2(F.col("doc_id").cast("string"), 256)
    d = docs.select("doc_id", *strata, h.alias("h")).withColumn("lane", F.substring("h", 1, 3))
    # lanes are ranges of the hash: 4,096 rows a stratum say how many rows stand before a lane and in all
    w = Window.partitionBy(*strata)
    lanes = d.groupBy(*strata, "lane").agg(F.count("*").alias("k"))
    lanes = lanes.select(*strata, "lane", (F.sum("k").over(w.orderBy("lane")) - F.col("k")).alias("before"), F.sum("k").over(w).alias("n"))
    inside = F.row_number().over(Window.partitionBy(*strata, "lane").orderBy("h", "doc_id")) - 1
    here, there = d.withColumn("inside", inside).alias("a"), lanes.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*strata, "lane")]
    d = here.join(there, reduce(and_, same)).select("a.doc_id", *[f"a.{c}" for c in strata], (F.col("inside") + F.col("before")).alias("i"), "n")
    return d.select("doc_id", *strata, F.when(F.expr("i < n * 70 div 100"), "train").when(F.expr("i < n * 85 div 100"), "dev").otherwise("holdout").alias("split"))


def matching_stats(docs: DataFrame, reference: DataFrame, cap: int) -> DataFrame:
    """doc_id, tok_ix, m: length of the longest suffix at each token, up to cap, that the reference has inside a document.

    Documents of either table stand for themselves, whatever their ids.
    """
    return matches(rows_of(docs, 0).unionByName(rows_of(reference, 1)), 1, cap).withColumnRenamed("m1", "m")


def differential(docs: DataFrame, machine: DataFrame, human: DataFrame, cap: int) -> DataFrame:
    """doc_id, tok_ix, m, h, d: matching statistics of each token in either reference, up to cap, and m - h."""
    rows = rows_of(docs, 0).unionByName(rows_of(machine, 1)).unionByName(rows_of(human, 2))
    return differences(matches(rows, 2, cap))


def differences(found: DataFrame) -> DataFrame:
    """doc_id, tok_ix, m, h, d of the statistics in two references."""
    return found.select("doc_id", "tok_ix", F.col("m1").alias("m"), F.col("m2").alias("h"), (F.col("m1") - F.col("m2")).alias("d"))


def differential_spans(curve: DataFrame, start: int = 3, keep: int = 2, least: int = 2, widest: int = 4) -> DataFrame:
    """doc_id, left_ix, end_ix, score, window_ix, window_len of the runs of a differential curve (end excluded).

    A run begins at d >= start and goes on while d >= keep; its score is the sum of d over that region. The span reaches
    m - 1 tokens further left, to where the phrase matched at the region's first token begins. The window is the 2 to
    `widest` tokens in the span with the largest sum of d, the earliest of these, then the shortest.
    """
    r = runs(curve.select("doc_id", "tok_ix", "d"), start, keep, least)
    first = curve.select("doc_id", F.col("tok_ix").alias("start_ix"), "m")
    r = r.join(first, ["doc_id", "start_ix"]).withColumn("left_ix", F.greatest(F.col("start_ix") - F.greatest(F.col("m") - 1, F.lit(0)), F.lit(0)))
    w = Window.partitionBy("doc_id").orderBy("tok_ix")
    sums = F.array(*[F.struct(F.sum("d").over(w.rowsBetween(0, k - 1)).alias("sum"), (-F.col("tok_ix")).alias("from"), F.lit(-k).alias("len")) for k in range(2, widest + 1)])
    windows = curve.select("doc_id", "tok_ix", sums.alias("ws"))
    e = r.select("doc_id", "left_ix", "end_ix", "score", F.explode(F.sequence("left_ix", F.col("end_ix") - 2)).alias("tok_ix")).join(windows, ["doc_id", "tok_ix"])
    best = F.array_max(F.filter("ws", lambda x: F.col("tok_ix") - x["len"] <= F.col("end_ix")))
    g = e.groupBy("doc_id", "left_ix", "end_ix", "score").agg(F.max(best).alias("b"))
    return g.select("doc_id", "left_ix", "end_ix", "score", (-F.col("b.from")).alias("window_ix"), (-F.col("b.len")).cast("long").alias("window_len"))


def differential_report(curve: DataFrame) -> DataFrame:
    """Mean m, mean h and their difference for each document that has a token."""
    g = curve.groupBy("doc_id").agg(F.avg("m").alias("m"), F.avg("h").alias("h"), F.count("*").alias("n_tokens"))
    return g.select("doc_id", F.round("m", 6).alias("mean_machine"), F.round("h", 6).alias("mean_human"), F.round(F.col("m") - F.col("h"), 6).alias("differential"), "n_tokens")
