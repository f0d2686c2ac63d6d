"""The relation chain: documents -> sentences -> tokens, and labelled classes. Keys: doc_id, sent_ix, tok_ix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sent_ix", "sentence"))


def tokens(docs: DataFrame, tokenizer=T.clean_tokens) -> DataFrame:
    return docs.select("doc_id", F.posexplode(tokenizer(F.coalesce("text", F.lit("")))).alias("tok_ix", "token"))


def sentence_tokens(docs: DataFrame) -> DataFrame:
    return sentences(docs).select("doc_id", "sent_ix", F.posexplode(T.clean_tokens(F.col("sentence"))).alias("tok_ix", "token"))


def classed(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents with class a (quality 1) or b (quality 0)."""
    c = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("b").alias("class"))
    return docs.join(c, "doc_id")


def sided(docs: DataFrame, labels: DataFrame, sides: dict[str, int], rest: int | None = None) -> DataFrame:
    """doc_id, text, side: a number for each class, `rest` for documents without one (None: they go); one join."""
    c = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 1, sides["a"]).otherwise(sides["b"]).alias("side"))
    if rest is None:
        return docs.select("doc_id", "text").join(c, "doc_id")
    return docs.select("doc_id", "text").join(c, "doc_id", "left").withColumn("side", F.coalesce("side", F.lit(rest)))
