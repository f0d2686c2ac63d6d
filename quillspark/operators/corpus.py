"""Corpus lifecycle: statistics, bands, separation, manifests, boilerplate, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import exceedance

BADGE, IMAGE, WRAPPER = r"^\s*(?:\[?!\[[^\]]*\]\([^)]*\)\]?(?:\([^)]*\))?\s*)+$", r"^\s*<img[^>]*>\s*$", r"^\s*</?(?:div|p|center|a|br|details|summary)[^>]*>\s*$"


def stats(docs: DataFrame) -> DataFrame:
    """Documents and words by class and language, with totals (rollup)."""
    n = F.size(F.filter(F.split("text", r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))
    d = docs.select("class", "lang", n.alias("n"))
    return d.rollup("class", "lang").agg(F.count("*").alias("docs"), F.min("n").cast("long").alias("min_words"), F.round(F.avg("n"), 6).alias("mean_words"), F.max("n").cast("long").alias("max_words"))


def bands(values: DataFrame, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Nearest-rank percentiles of v by genre and metric."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by v)")
    return values.groupBy("genre", "metric").agg(p(lo).alias("lo"), p(0.5).alias("mid"), p(hi).alias("hi"))


def union_bands(table: DataFrame) -> DataFrame:
    """Widest band over genres; included if a strict majority of genres includes it."""
    g = table.groupBy("metric").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if("include").alias("yes"), F.count("*").alias("n"))
    return g.select("metric", "lo", "hi", (F.col("yes") * 2 > F.col("n")).alias("include"))


def combined_score(values: DataFrame, table: DataFrame) -> DataFrame:
    """Mean exceedance of a document over the banded metrics."""
    j = values.join(F.broadcast(table), ["genre", "metric"])
    return j.groupBy("doc_id").agg(F.round(F.avg(exceedance(F.col("v"), F.col("lo"), F.col("hi"))), 6).alias("score"))


def boilerplate(text: Column) -> Column:
    """Lines without badge, image-only and wrapper-tag lines, joined again."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(BADGE) & ~x.rlike(IMAGE) & ~x.rlike(WRAPPER))
    return F.array_join(lines, "\n")


def validate(manifest: DataFrame) -> DataFrame:
    """id, problem: duplicate ids, wrong digests, missing fields."""
    twice = manifest.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    rows = [
        (F.col("sha256") != F.sha2(F.coalesce("text", F.lit("")), 256), "digest"),
        (F.col("lang").isNull(), "language"),
        (F.col("class").isNull() | ~F.col("class").isin("human", "llm"), "class"),
        ((F.col("class") == "human") & F.col("model").isNotNull(), "model of a human text"),
    ]
    out = twice
    for bad, name in rows:
        out = out.unionByName(manifest.where(bad).select("id", F.lit(name).alias("problem")))
    return out


def plan(models: DataFrame, prompts: DataFrame, per_pair: int) -> DataFrame:
    """Each model with each prompt, per_pair slices, with a derived seed; the tables are configuration."""
    return models.crossJoin(F.broadcast(prompts)).select("model", "prompt_id", F.explode(F.sequence(F.lit(0), F.lit(per_pair - 1))).alias("slice")).withColumn("seed", F.substring(F.sha2(F.concat_ws("|", "model", "prompt_id", "slice"), 256), 1, 16))


def licence(c: Column) -> Column:
    """SPDX name or null."""
    k = F.regexp_replace(F.lower(F.trim(c)), r"[\s_]+", "-")
    return F.when(k.isin("mit", "mit-license"), "MIT").when(k.isin("apache-2.0", "apache-2", "apache-license-2.0", "apache"), "Apache-2.0").when(k.isin("cc-by-4.0", "cc-by"), "CC-BY-4.0").when(k.isin("cc0", "cc0-1.0"), "CC0-1.0").when(k.isin("bsd-3-clause", "bsd-3", "bsd"), "BSD-3-Clause")
