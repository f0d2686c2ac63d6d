"""What the operators of this subpackage share: folders, input columns, batches."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir.

    Where that is unset, a temporary folder is made and set once on one machine (tests); on a cluster it is an error, as
    executors would each write to disks of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quillspark/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared folder and read again: lineage ends here."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(docs: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that other columns cannot clash.

    pick(docs, doc_id="id", text="body") selects id as doc_id and body as text.
    """
    return docs.select(*[docs[c].alias(n) for n, c in cols.items()])


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bounds what a Python worker holds at a time: so many rows of whole texts, and so many bytes (a longer row is alone).

    Also lets workers on this machine import the library wherever they start; a cluster ships it (--py-files).
    """
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


#: What operators keep in a worker from one task to the next: functions under lru_cache.
KEPT: list = []


def given_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *keeps) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, such that a worker holds no more than it uses.

    Workers outlive their tasks, and serve other operators' or wait beside a JVM that needs the memory. So what other
    operators kept goes before the first batch (all of KEPT but keeps), and free memory goes back to the system after the last.
    """

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in KEPT:
            if f not in keeps:
                f.cache_clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError, TypeError):
                pass  # not the C library that has it

    return bounded


def text_or_empty(col) -> F.Column:
    return F.coalesce(col, F.lit(""))


def never_null(df: DataFrame, name: str) -> F.Column:
    """The column as a key that joins by plain equality: null is below all values (the smallest long, or an odd string)."""
    if df.schema[name].dataType.simpleString() == "string":
        return F.coalesce(F.col(name), F.lit("\x00null"))
    return F.coalesce(F.col(name).cast("long"), F.lit(-(2**63)))
