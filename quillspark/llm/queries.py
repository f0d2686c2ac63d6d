"""The queries op1_ to op10_, with production parameters, and the SQL that says the same where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, compression, crf, cws, disclosure, minhash, pfair, ranking, simple8b, styletree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(ids, path))


def op2_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digest(disclosure.find(_table(spark, sf_dir, "documents"), support=1.0))


def op3_pfair(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pfair.places(docs, pfair.slots_of(pfair.tempered(pfair.sizes(docs)), 1000))


def op4_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = simple8b.write_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return simple8b.read_ids(spark, path)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"), percent=85, width=5)


def _remainder(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(_table(spark, sf_dir, "documents"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return styletree.extract(_table(spark, sf_dir, "pages"))


def op6_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ranking.train(docs, _table(spark, sf_dir, "labels").where(_remainder(3) != 1), "quality")
    return ranking.score(docs, model).select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cws.compare(_table(spark, sf_dir, "documents"))


def op9_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = crf.train(docs, _table(spark, sf_dir, "labels").where(_remainder(5) != 0), "toxic")
    return crf.score(docs, model).select("doc_id", F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


QUERIES = {"op1_compression_bands": op1_compression_bands, "op2_disclosure": op2_disclosure, "op3_pfair": op3_pfair, "op4_simple8b": op4_simple8b, "op5_style_tree": op5_style_tree, "op6_bradley_terry": op6_bradley_terry, "op7_weighted_sampling": op7_weighted_sampling, "op8_minhash": op8_minhash, "op9_crf": op9_crf, "op10_bpe": op10_bpe}

ORACLES: dict[str, str] = {
    "op8_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT doc_id, CASE WHEN coalesce(len(x), 0) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')]
  ELSE list_distinct(list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS sh FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)
""",
}
