"""Document metrics: one row per document, from arrays inside the row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stats import rate


def _mean_sd(a):
    n = F.size(a)
    mean = F.when(n > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / n).otherwise(0.0)
    sq = F.when(n > 0, F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v) / n).otherwise(0.0)
    sd = F.sqrt(F.greatest(sq - mean * mean, F.lit(0.0)))
    return mean, sd, F.when(mean > 0, sd / mean).otherwise(0.0)


def token_stats(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", T.clean_tokens(F.coalesce("text", F.lit(""))).alias("t"))
    d = d.withColumn("w", F.filter("t", lambda x: ~x.isin(*".,;:!?")))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def rhythm(docs: DataFrame) -> DataFrame:
    """Population mean, deviation and variation of words per sentence."""
    d = docs.select("doc_id", F.transform(T.sentences(F.coalesce("text", F.lit(""))), lambda s: F.size(T.spaced_words(s)).cast("double")).alias("n"))
    mean, sd, cv = _mean_sd(F.col("n"))
    return d.select("doc_id", F.size("n").cast("long").alias("n_sentences"), F.round(mean, 6).alias("mean_words"), F.round(sd, 6).alias("sd_words"), F.round(cv, 6).alias("cv_words"))


def _openers(docs: DataFrame) -> DataFrame:
    first = F.transform(T.sentences(F.coalesce("text", F.lit(""))), lambda s: F.get(T.metric_words(s), F.lit(0)))
    return docs.select("doc_id", F.filter(first, lambda w: w.isNotNull()).alias("o"))


def opener_repeat(docs: DataFrame) -> DataFrame:
    """Share of sentences that open with the word of the one before; over one less than all."""
    d = _openers(docs)
    n = F.size("o")
    same = F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get("o", i) == F.get("o", i - 1)))
    return d.select("doc_id", F.when(n > 1, F.round(same / (n - 1), 6)).otherwise(0.0).alias("opener_repeat"))


def top_opener(docs: DataFrame) -> DataFrame:
    """Share of the most frequent opening word."""
    d = _openers(docs).select("doc_id", F.explode_outer("o").alias("o"))
    c = d.groupBy("doc_id", "o").agg(F.count("o").alias("k"))
    return c.groupBy("doc_id").agg(F.max("k").alias("top"), F.sum("k").alias("n")).select("doc_id", F.when(F.col("n") > 0, F.round(F.col("top") / F.col("n"), 6)).otherwise(0.0).alias("top_opener"))


def densities(docs: DataFrame) -> DataFrame:
    """Signs per 1000 words, bold spans per sentence."""
    t = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(T.spaced_words(t))
    count = lambda p: F.regexp_count(t, F.lit(p))
    dash = count("—") + count(r"(?<=[A-Za-z0-9] ?)(?<!-)--(?!-)(?= ?[A-Za-z0-9])")
    s = F.size(T.sentences(t))
    bold = F.floor((count(r"\*\*") + count("__")) / 2)
    return docs.select(
        "doc_id",
        F.round(rate(dash, n, 1000.0), 6).alias("em_dash"),
        F.round(rate(count(";"), n, 1000.0), 6).alias("semicolon"),
        F.round(rate(count(","), n, 1000.0), 6).alias("comma"),
        F.round(F.when(s > 0, bold / s).otherwise(0.0), 6).alias("bold"),
    )


def marker_density(docs: DataFrame, markers: list[str]) -> DataFrame:
    """Sentences that open with a marker, per 1000 metric words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    hit = F.size(F.filter(T.sentences(t), lambda s: T.ascii_lower(s).rlike(r"^[\s*_#>]*(?:" + "|".join(markers) + r")(?:[^\p{L}]|$)")))
    return docs.select("doc_id", F.round(rate(hit, F.size(T.metric_words(t)), 1000.0), 6).alias("marker_density"))


def phrase_rate(docs: DataFrame, phrases: list[str] | DataFrame) -> DataFrame:
    """Occurrences of the phrases (words joined by spaces, overlapping ones count) per 1000 metric words.

    A list is looked up inside the row. A table (phrase) of any size is joined by n-gram, for lengths up to the longest.
    """
    d = docs.select("doc_id", T.metric_words(F.coalesce("text", F.lit(""))).alias("w"))
    if not isinstance(phrases, DataFrame):
        wanted = sorted(set(phrases))
        by_length = {n: [p for p in wanted if len(p.split(" ")) == n] for n in {len(p.split(" ")) for p in wanted}}
        hits = F.lit(0)
        for n, ps in sorted(by_length.items()):
            hits = hits + F.size(F.filter(T.ngrams(F.col("w"), n), _one_of(ps)))
        return d.select("doc_id", F.round(rate(hits, F.size("w"), 1000.0), 6).alias("phrase_rate"))
    longest = phrases.agg(F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(0))).first()[0]
    grams = F.concat(*[T.ngrams(F.col("w"), n) for n in range(1, longest + 1)]) if longest else F.array().cast("array<string>")
    hits = d.select("doc_id", F.explode(grams).alias("phrase")).join(phrases.select("phrase").distinct(), "phrase", "left_semi").groupBy("doc_id").agg(F.count("*").alias("k"))
    return d.join(hits, "doc_id", "left").select("doc_id", F.round(rate(F.coalesce("k", F.lit(0)), F.size("w"), 1000.0), 6).alias("phrase_rate"))


def _one_of(values: list[str]):
    return lambda x: x.isin(values)
