"""Readers and writers: strict JSON-lines manifests, text folders, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "id string, class string, genre string, source string, model struct<name:string,quantization:string>, prompt_id string, license string, lang string, split string, sha256 string, provenance_evidence string, style_prompted boolean, gen_config string"
PAIRED = "pair_id string, side string, genre string, model struct<name:string,quantization:string>, model_digest string, prompt_id string, seed bigint, temperature double, num_predict int, reproducible boolean, sha256 string"


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Fails on a record that does not fit the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (hash of the path), path, text of each file below path; a text that is not valid UTF-8 is an error."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    text = F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(F.raise_error(F.concat(F.lit("not valid UTF-8: "), F.col("path"))))
    return d.select(F.xxhash64("path").alias("doc_id"), "path", text.alias("text"))


def read_bucket(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with id and text; adds the texts' digests."""
    return spark.read.schema("id string, text string").option("mode", "FAILFAST").json(path).withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256))


def syntax_of(path, text):
    head = F.lower(F.ltrim(F.substring(text, 1, 64)))
    return F.when(F.lower(path).rlike(r"\.html?$") | head.startswith("<!doctype html") | head.startswith("<html"), "html").otherwise("markdown")


def sarif(spans: DataFrame, uri_col: str = "uri") -> DataFrame:
    """One SARIF 2.1.0 log (JSON) per document; spans: doc_id, line, column, rule, message and where the document is."""
    loc = F.array(F.struct(F.struct(F.struct(F.col(uri_col).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), F.lit("warning").alias("level"), F.struct(F.col("message").alias("text")).alias("message"), loc.alias("locations"))
    g = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "column", "rule", result.alias("r")))).alias("rs"))
    run = F.struct(F.struct(F.struct(F.lit("quillspark").alias("name")).alias("driver")).alias("tool"), F.transform("rs", lambda x: x["r"]).alias("results"))
    return g.select("doc_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))
