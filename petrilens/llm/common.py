"""Small helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from petrilens.operators.graph import cut, packed, shared_dir

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def maybe_broadcast(df: DataFrame, max_rows: int = 50_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` narrow rows (counted), else with one that keeps Spark,
    which may size it too low (after an explode), from broadcasting it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def n_words(text):
    """Number of words of a text column (0 for null)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to as many tasks as the session has shuffle partitions or cores, whichever is more:
    for narrow rows that grow in the next step, which adaptive plans would put into a few tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def hand_back() -> None:
    """Gives the memory which Arrow and the allocator hold back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # other C libraries have no such call
        pass


def handing_back(run):
    """``run``, a function on batches, that at its end gives the memory which Arrow and the allocator hold back to the
    system: a Python worker lives on beside the executor's JVM, for other tasks and between them."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Arrow batches of at most ``rows`` rows and about ``size`` bytes for the session from now on (results are
    evaluated later, so the bound can't end with the call): texts can be long, and a batch stands several times in the
    memory of an executor and of its Python worker.  Smaller settings of the session stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).removesuffix("b")
        if now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


__all__ = ["WORD", "bounded_batches", "cut", "fresh_path", "hand_back", "handing_back", "maybe_broadcast", "n_words", "packed", "shared_dir", "spread", "table"]
