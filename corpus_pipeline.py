"""The corpus pipeline: from raw documents to token ids in five stages.

Each stage gets what its predecessor kept and reads the folder of tables only for labels. Documents with a null or empty
text pass the filters like any other; an empty table passes through. Rows of a doc_id share every verdict.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, disclosure, minhash, pfair, ranking
from quillspark.llm.common import saved

#: Not expressible in SQL: a fitted classifier and a tokenizer. The tests hold run() against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Learns from labels of documents whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    model = ranking.train(docs, labels, "quality")
    return ranking.keep(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id."""
    out = minhash.classes(docs, percent=80, width=5).where("not kept").select("doc_id").distinct()
    return docs.join(saved(out, "copies"), "doc_id", "left_anti").select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and what discloses it are generalised in the texts; n_chars follows."""
    out = disclosure.sanitise(docs, support=1.0)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in an order whose every prefix has the target weights, square roots of the sources' sizes."""
    return pfair.order(docs, pfair.slots_of(pfair.tempered(pfair.sizes(docs)), 1000))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document; the ids decode to its text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("personal data", personal_data),
    ("mixing sources", mixture),
    ("byte-level bpe", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
