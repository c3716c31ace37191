"""Input tables of the queries, and what Arrow stages over whole texts share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow stage looks at together; Spark bounds the bytes of a batch itself.
ARROW_ROWS = 1000
#: Text of one range of a shuffled table, and the most ranges.
RANGE_BYTES, MAX_RANGES = 24 << 20, 100_000


def bounded_batches(spark: SparkSession) -> None:
    """Lets the session send ``ARROW_ROWS`` rows of whole texts to Python at once, unless it has a setting of its own.

    Queries and pipeline stages call this; operators set nothing and are right with batches of any size, but the memory
    of an executor is smaller with small ones.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, ARROW_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ARROW_ROWS):
    """``run`` over slices of its batches, so that what it builds for a batch stays small; no session setting is needed."""

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))

    return again


def range_count(spark: SparkSession, size: int | None) -> int:
    """Ranges for ``size`` bytes of text, each with about ``RANGE_BYTES``: one a shuffle partition at least."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(MAX_RANGES, max(least, -(-(size or 0) // RANGE_BYTES)))


def ranges(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, ranges to shuffle ``docs`` to)."""
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(text_col)).alias("bytes")).first()
    return total.n, range_count(docs.sparkSession, total.bytes)
