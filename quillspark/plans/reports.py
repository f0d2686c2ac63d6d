"""Queries over the driver's tables, each an application of library operators with stated parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import corpus, edits, extract, metrics, mining, relations, spans
from ..operators.matches import matches, units_of
from ..session import table
from ..streaming import rates

QUERIES: dict = {}
MARKERS = ["the", "is", "it", "la", "der"]
PHRASES = ["of the", "the", "is the", "it is", "de la", "and the other"]
CAP = 4


def query(f):
    QUERIES[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _classed(spark: SparkSession, d: str) -> DataFrame:
    return relations.classed(_docs(spark, d), table(spark, d, "labels"))


def _side(spark: SparkSession, d: str, c: str) -> DataFrame:
    return _classed(spark, d).where(F.col("class") == c)


@query
def doc_token_stats(spark, d):
    return metrics.token_stats(_docs(spark, d))


@query
def sentence_rhythm(spark, d):
    return metrics.rhythm(_docs(spark, d))


@query
def opener_repeat(spark, d):
    return metrics.opener_repeat(_docs(spark, d))


@query
def top_opener(spark, d):
    return metrics.top_opener(_docs(spark, d))


@query
def punct_density(spark, d):
    return metrics.densities(_docs(spark, d)).select("doc_id", "semicolon", "comma", "bold")


@query
def marker_density(spark, d):
    return metrics.marker_density(_docs(spark, d), MARKERS)


@query
def phrase_rate(spark, d):
    return metrics.phrase_rate(_docs(spark, d), ["of the", "the", "is the", "de la"])


@query
def tokenizer_sizes(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, d).select("doc_id", F.size(T.analysis_tokens(t)).cast("long").alias("k1"), F.size(T.clean_tokens(t)).cast("long").alias("k2"), F.size(T.metric_words(t)).cast("long").alias("k3"), F.size(T.spaced_words(t)).cast("long").alias("k6"), F.octet_length(t).cast("long").alias("bytes"))


@query
def text_digest(spark, d):
    t = F.coalesce(F.col("text"), F.lit(""))
    return _docs(spark, d).select("doc_id", F.sha2(t, 256).alias("sha256"), F.sha2(T.compound(t), 256).alias("compound_sha256"), F.sha2(T.capitalise(T.plain_lower(t)), 256).alias("capitalised_sha256"), T.ends_terminal(t).alias("ends_terminal"))


@query
def ngram_counts(spark, d):
    return mining.ngram_counts(_classed(spark, d), 2).where("a + b >= 5")


@query
def log_odds_top(spark, d):
    return mining.top_both(mining.log_odds_table(mining.ngram_counts(_classed(spark, d), 1)), 40)


@query
def ratio_top(spark, d):
    c = _classed(spark, d)
    return mining.ratio_top(c, 2, mining.ngram_counts(c, 1), 5, 50)


@query
def class_vocab_overlap(spark, d):
    c = mining.ngram_counts(_classed(spark, d), 1)
    return c.agg(F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))


@query
def split_assign(spark, d):
    return mining.split_assign(_docs(spark, d).select("doc_id", "lang"), ["lang"])


@query
def corpus_stats(spark, d):
    return corpus.stats(_classed(spark, d))


def _values(spark, d) -> DataFrame:
    """doc_id, genre, metric, v of a few metrics."""
    r = metrics.rhythm(_docs(spark, d)).join(metrics.opener_repeat(_docs(spark, d)), "doc_id").join(_docs(spark, d).select("doc_id", F.col("lang").alias("genre")), "doc_id")
    return r.select("doc_id", "genre", F.expr("stack(3, 'mean_words', mean_words, 'cv_words', cv_words, 'opener_repeat', opener_repeat) as (metric, v)"))


@query
def metric_bands(spark, d):
    return corpus.bands(_values(spark, d))


@query
def metric_auc(spark, d):
    c = _classed(spark, d).select("doc_id", "class")
    return mining.midrank_auc(_values(spark, d).join(c, "doc_id").select("metric", "class", "v"))


@query
def combined_score(spark, d):
    v = _values(spark, d)
    return corpus.combined_score(v, corpus.bands(v))


@query
def envelope_union(spark, d):
    return corpus.union_bands(corpus.bands(_values(spark, d)).withColumn("include", F.col("hi") > 2 * F.col("lo")))


@query
def separation_gate(spark, d):
    c = _classed(spark, d).select("doc_id", "class")
    v = _values(spark, d).join(c, "doc_id")
    auc = mining.midrank_auc(v.select(F.concat_ws("/", "genre", "metric").alias("metric"), "class", "v"))
    return auc.agg(F.count_if(F.greatest("auc", 1 - F.col("auc")) >= 0.85).alias("passed"), F.count("auc").alias("measured"))


@query
def burst_envelope(spark, d):
    return mining.burst_envelope(_docs(spark, d))


@query
def overuse_words(spark, d):
    return mining.overuse(_side(spark, d, "b"), mining.burst_envelope(_side(spark, d, "a")))


@query
def seam_bigrams(spark, d):
    return mining.seams(_docs(spark, d)).where("n >= 2")


@query
def unattested_seams(spark, d):
    """Seams of class b that class a never has."""
    return mining.seams(_side(spark, d, "b")).join(mining.seams(_side(spark, d, "a")), ["left", "right"], "left_anti")


@query
def seam_attested(spark, d):
    return mining.seams(_side(spark, d, "b")).join(mining.seams(_side(spark, d, "a")), ["left", "right"], "left_semi")


@query
def dms_curve(spark, d):
    """Matching statistics of class b in class a, capped at CAP."""
    rows = relations.sided(_docs(spark, d), table(spark, d, "labels"), {"b": 0, "a": 1})
    return matches(rows, 1, CAP, units_of(_docs(spark, d))).withColumnRenamed("m1", "m")


@query
def dms_doc_report(spark, d):
    return dms_curve(spark, d).groupBy("doc_id").agg(F.round(F.avg("m"), 6).alias("mean_match"), F.count("*").alias("n_tokens"))


@query
def dms_runs(spark, d):
    return spans.runs(dms_curve(spark, d).select("doc_id", "tok_ix", F.col("m").alias("d")))


@query
def literal_spans(spark, d):
    return spans.literal_spans(_docs(spark, d), PHRASES)


@query
def regex_spans(spark, d):
    p = spark.createDataFrame([("r.open", "^The [a-z]+"), ("r.end", "[a-z]+tion[.]"), ("r.pair", "of the")], "frame_id string, pattern string")
    return spans.regex_spans(_docs(spark, d), p)


def _two(spark, d) -> DataFrame:
    a = spans.literal_spans(_docs(spark, d), PHRASES)
    return a.unionByName(spans.literal_spans(_docs(spark, d), ["the", "of", "it"], "word")).unionByName(a)


@query
def merge_spans(spark, d):
    return spans.merge(_two(spark, d), {"literal": 1, "word": 2})


@query
def tell_counts(spark, d):
    return _two(spark, d).groupBy("doc_id", "channel").agg(F.count("*").alias("n"))


@query
def span_islands(spark, d):
    return spans.islands(_two(spark, d).withColumn("score", F.col("end") - F.col("start")))


def _patches(spark, d) -> DataFrame:
    return _two(spark, d).select("doc_id", "start", "end", F.col("channel").alias("rule"), F.concat(F.lit("<"), "frame_id", F.lit(">")).alias("replacement"))


@query
def resolve_patches(spark, d):
    return spans.resolve(_patches(spark, d)).select("doc_id", F.explode("patches").alias("p")).select("doc_id", "p.start", "p.end", "p.rule", "p.replacement")


@query
def apply_patches(spark, d):
    return spans.apply_patches(_docs(spark, d).select("doc_id", "text"), spans.resolve(_patches(spark, d))).select("doc_id", F.sha2(F.coalesce("fixed", F.lit("")), 256).alias("fixed_sha256"), F.length("fixed").cast("long").alias("n_chars"))


@query
def line_col(spark, d):
    s = spans.literal_spans(_docs(spark, d), PHRASES).join(_docs(spark, d).select("doc_id", "text"), "doc_id")
    line, col = spans.line_column(F.col("text"), F.col("start"))
    return s.select("doc_id", "start", line.alias("line"), col.alias("col"), T.byte_offset(F.col("text"), F.col("start")).alias("byte_start"))


@query
def probe_counts(spark, d):
    """Non-overlapping occurrences of token sequences per document."""
    t = F.coalesce(F.col("text"), F.lit(""))
    joined = F.concat(F.lit("␟"), F.array_join(T.clean_tokens(t), "␟␟"), F.lit("␟"))
    n = lambda p: F.regexp_count(joined, F.lit(p)).cast("long")
    return _docs(spark, d).select("doc_id", n("␟of␟␟the␟").alias("of_the"), n("␟the␟").alias("the"), n("␟[,]␟␟the␟").alias("comma_the"))


@query
def wilson_arming(spark, d):
    s = metrics.token_stats(_docs(spark, d))
    lo, hi = stats.wilson(F.col("n_distinct"), F.col("n_words").cast("double"))
    return s.select("doc_id", F.round(lo, 6).alias("lower"), F.round(hi, 6).alias("upper"))


@query
def pivot_budget(spark, d):
    words = _docs(spark, d).select("doc_id", F.size(T.spaced_words(F.coalesce("text", F.lit("")))).alias("n_words"))
    return spans.budgeted(spans.literal_spans(_docs(spark, d), PHRASES), words, 5.0).select("doc_id", "start", "end")


@query
def boilerplate_lines(spark, d):
    return _docs(spark, d).select("doc_id", F.sha2(corpus.boilerplate(F.coalesce("text", F.lit(""))), 256).alias("kept_sha256"))


@query
def manifest_validate(spark, d):
    docs = _docs(spark, d)
    bad = F.col("doc_id") % 50 == 7
    m = docs.select(F.col("doc_id").cast("string").alias("id"), "text", F.when(F.col("doc_id") % 40 == 3, None).otherwise(F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 2 == 0, "human").otherwise("llm").alias("class"), F.when(F.col("doc_id") % 30 == 0, "m").alias("model"), F.when(bad, "0").otherwise(F.sha2("text", 256)).alias("sha256"))
    return corpus.validate(m.unionByName(m.where("cast(id as long) % 60 = 1")))


@query
def adjudicate_verdicts(spark, d):
    c = mining.with_totals(mining.ngram_counts(_classed(spark, d), 2).where("a + b >= 4"))
    ratio = F.round(stats.smoothed_ratio(F.col("b"), F.col("tb"), F.col("a"), F.col("ta")), 6)
    return c.select("ngram", stats.verdict(ratio, F.col("b")).alias("verdict"))


@query
def verdict_matrix(spark, d):
    v = adjudicate_verdicts(spark, d).withColumn("bucket", F.length("ngram") % 3)
    return v.groupBy("bucket").pivot("verdict", ["confirmed", "direction-error", "weak", "none"]).count().select("bucket", F.coalesce("confirmed", F.lit(0)).alias("confirmed"), F.coalesce("direction-error", F.lit(0)).alias("direction_error"), F.coalesce("weak", F.lit(0)).alias("weak"), F.coalesce("none", F.lit(0)).alias("none_found"))


@query
def generation_plan(spark, d):
    models = table(spark, d, "nation").select(F.col("n_name").alias("model"))
    prompts = table(spark, d, "region").select(F.col("r_name").alias("prompt_id"))
    return corpus.plan(models, prompts, 2)


@query
def html_prose(spark, d):
    return extract.html_prose(table(spark, d, "pages"))


@query
def block_kinds(spark, d):
    return extract.line_kinds(_docs(spark, d)).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query
def markdown_blocks(spark, d):
    return extract.blocks(_docs(spark, d))


@query
def previous_opener(spark, d):
    """Rows of sentences that open as the one before: the window form of opener_repeat."""
    s = relations.sentences(_docs(spark, d)).withColumn("o", F.get(T.metric_words(F.col("sentence")), F.lit(0))).where("o is not null")
    w = Window.partitionBy("doc_id").orderBy("sent_ix")
    return s.withColumn("p", F.lag("o").over(w)).where("o = p").groupBy("doc_id").agg(F.count("*").alias("n"))


@query
def speaker_log_odds(spark, d):
    """Log-odds of words of user against assistant turns."""
    t = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant"))
    return mining.log_odds_table(mining.ngram_counts(t.select("text", F.when(F.col("role") == "user", "a").otherwise("b").alias("class")), 1)).where("a + b >= 5")


@query
def event_rates(spark, d):
    return rates.event_rates(table(spark, d, "events"))


@query
def fixed_texts(spark, d):
    """Two passes of deletions and substitutions, seams attested by the corpus."""
    docs = _docs(spark, d)
    out = edits.fix(docs, ["of the"], {"it is": "that was"}, mining.seams(docs).where("n >= 2"))
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))
