"""Contrast frames: closed vocabularies over the sentences of a text, with no tagger.

Rows: doc_id, sent_ix, n_sents (1 or 2 sentences), frame_id, marker (null for corrections).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Markers that belittle an alternative, auxiliaries that open a question, words that guard a marker before them.
MARKERS = ["just", "merely", "simply", "only"]
AUXILIARIES = ["is", "are", "was", "were", "does", "do", "can", "could"]
GUARDS = ["as", "about", "now", "yet", "enough"]
QUESTION, CORRECTION = "frame.contrast.question", "frame.contrast.correction"

_IT_IS = r"(?:it'?s|it\s+is)"
#: `not just X, it's Y`; `It's not X — it's Y`; `It's not X.` and `It's Y.`
MARKED = rf"(?i)\bnot\s+(?:just|only|merely)\b.*?(?:—|,)\s*{_IT_IS}\b"
SINGLE = rf"(?i)^\s*{_IT_IS}\s+not\b.*—\s*{_IT_IS}\b"
FIRST, SECOND = rf"(?i)^\s*{_IT_IS}\s+not\b", rf"(?i)^\s*{_IT_IS}\b"


def guarded(tokens: Column, i: Column) -> Column:
    """Whether the marker at i is part of another sense: after `not`, or before a word like `about`."""
    return F.coalesce(F.when(i > 0, F.get(tokens, i - 1) == "not"), F.lit(False)) | F.coalesce(F.get(tokens, i + 1).isin(*GUARDS), F.lit(False))


def questions(docs: DataFrame) -> DataFrame:
    """Questions `<auxiliary> ... <marker> ... or ...?`: the first auxiliary, the first `or` after it, an unguarded marker between."""
    s = docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sent_ix", "s"))
    # a sentence without a question mark has no match and is not cut into tokens
    s = s.where(F.col("s").contains("?")).select("doc_id", "sent_ix", T.analysis_tokens(F.col("s")).alias("t"))
    s = s.where(F.element_at("t", -1) == "?").withColumn("at", F.sequence(F.lit(0), F.size("t") - 1))
    s = s.withColumn("aux", F.array_min(F.filter("at", lambda i: F.get("t", i).isin(*AUXILIARIES))))
    s = s.withColumn("or_ix", F.array_min(F.filter("at", lambda i: (i > F.col("aux")) & (F.get("t", i) == "or"))))
    s = s.where(F.col("or_ix") + 1 < F.size("t") - 1)
    marks = F.filter("at", lambda i: (i > F.col("aux")) & (i < F.col("or_ix")) & F.get("t", i).isin(*MARKERS) & ~guarded(F.col("t"), i))
    s = s.withColumn("mark", F.array_min(marks)).where("mark is not null")
    return s.select("doc_id", F.col("sent_ix").cast("long").alias("sent_ix"), F.lit(1).cast("long").alias("n_sents"), F.lit(QUESTION).alias("frame_id"), F.get("t", F.col("mark")).alias("marker"))


def corrections(docs: DataFrame) -> DataFrame:
    """Corrections in one sentence, or in two that follow each other; a sentence that ends a pair begins nothing."""
    d = docs.select("doc_id", T.sentences(F.coalesce("text", F.lit(""))).alias("s"))
    pair = lambda x, i: x.rlike(FIRST) & x.rlike(r"\.\s*$") & F.coalesce(F.get("s", i + 1).rlike(SECOND), F.lit(False))
    kind = lambda x, i: F.when(x.rlike(MARKED) | x.rlike(SINGLE), 1).when(pair(x, i), 2).otherwise(0)
    e = d.select("doc_id", F.posexplode(F.transform("s", kind)).alias("i", "k")).where("k > 0")
    w = Window.partitionBy("doc_id").orderBy("i")
    # of a run of sentences that could each begin a pair, every second one does
    e = e.withColumn("g", F.when(F.col("k") == 2, F.col("i") - F.row_number().over(Window.partitionBy("doc_id", "k").orderBy("i"))))
    first = F.min("i").over(Window.partitionBy("doc_id", "k", "g"))
    e = e.withColumn("taken", (F.col("k") == 2) & ((F.col("i") - first) % 2 == 0))
    ends_pair = F.coalesce(F.lag("taken").over(w) & (F.lag("i").over(w) == F.col("i") - 1), F.lit(False))
    e = e.withColumn("out", F.col("taken") | ((F.col("k") == 1) & ~ends_pair)).where("out")
    return e.select("doc_id", F.col("i").cast("long").alias("sent_ix"), F.col("k").cast("long").alias("n_sents"), F.lit(CORRECTION).alias("frame_id"), F.lit(None).cast("string").alias("marker"))


def contrast(docs: DataFrame) -> DataFrame:
    return questions(docs).unionByName(corrections(docs))
