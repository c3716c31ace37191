"""Shared-folder tables that cut lineage, and broadcasts that are only used behind a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A table is broadcast only if its rows take less than this many bytes.
BROADCAST_BYTES = 32 << 20
#: Bytes that a row, and an array or a string in it, take besides their values.
ROW_BYTES, VALUE_BYTES = 32, 16
#: Stored bytes of an input for each partition that :func:`deal` makes.
DEAL_BYTES = 2 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a temporary one where it is unset in local mode (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="lumenframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    """Of this application, so that dropping its tables leaves those of others."""
    return f"{shared_dir(spark)}/lumenframe/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Lineage ends here: a lost executor costs a re-read, not a recomputation. An empty table keeps its schema.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # the write's shuffle files are of no use once the table stands
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Size of a table that is read from files, as :func:`materialize` returns it, from its statistics (no job)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def deal(rows: DataFrame, key: str | Column, source: DataFrame) -> DataFrame:
    """``rows`` shuffled by ``key`` into as many partitions as ``source``, the files behind them, is large; the session's number at least.

    So a task's share stays the same when the input grows, and whatever goes by ``key`` next needs no further shuffle.
    """
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-stored_bytes(source) // DEAL_BYTES)), key)


def _width(value: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory."""
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(VALUE_BYTES))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
            return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda n, x: n + _width(x, kind.elementType)), F.lit(0)) + VALUE_BYTES
        return F.greatest(F.size(value), F.lit(0)) * 8 + VALUE_BYTES
    if isinstance(kind, T.MapType):
        return _width(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + VALUE_BYTES
    return F.lit(8)


def memory_bytes(df: DataFrame) -> int:
    """What the rows of ``df`` take in memory: their number times their widths, measured over all of them."""
    row = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(ROW_BYTES))
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a materialised table may be broadcast. Its stored size, which is free to read, rules out the large ones."""
    return stored_bytes(df) <= limit and memory_bytes(df) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if a materialised table's rows take less than ``limit``, else leave it to a shuffle join."""
    return F.broadcast(df) if fits_broadcast(df, limit) else df


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` returned, when nothing reads it any more."""
    spark = df.sparkSession
    own = _own_folder(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if f"/{own.split('://')[-1].strip('/')}/" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_scratch(spark: SparkSession) -> None:
    """Delete every table that :func:`materialize` and :func:`scratch_path` gave this application; for its end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
