"""All queries of the library by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import frames, lifecycle, matching, oracles, reports, style

QUERIES = {**reports.QUERIES, **style.QUERIES, **matching.QUERIES, **frames.QUERIES, **lifecycle.QUERIES}
ORACLES = {**oracles.ORACLES, **style.ORACLES, **matching.ORACLES, **frames.ORACLES, **lifecycle.ORACLES}
__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["doc_token_stats"](spark, sf_dir)
