"""Scans along ordered series (running sums, previous rows) without one task a series.

Rows are dealt to ranges of (keys, order) and stored with the number of their range, so a long series lies in many. A scan
goes over each range by itself; what the ranges before it hand on, one row a series and range, is scanned the same way and
joined back. A window over a whole series never runs: its largest group is one range of it, or its ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

PART = "_part"


def ranged(rows: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` stored in ranges of ``keys`` and ``order``, with the range's number in ``_part``; rows equal in both are in one."""
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *keys, *order).withColumn(PART, F.spark_partition_id()), "ranges")


def _same(keys: list[str]) -> Column:
    out = F.col(f"a.{PART}") == F.col(f"b.{PART}")
    for k in keys:
        out &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def _handed(stored: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """``stored`` with the columns of its (keys, range) in ``carried``."""
    new = [c for c in carried.columns if c not in (*keys, PART)]
    # Spark broadcasts the carries if they turn out small when they are there, else both sides shuffle on (keys, range).
    joined = stored.alias("a").join(carried.alias("b"), _same(keys), "left")
    return joined.select("a.*", *(F.col(f"b.{c}") for c in new))


def running_sum(stored: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """``stored`` (of :func:`ranged`) with the sum of ``value`` up to and with each row of its series."""
    sums = stored.groupBy(*keys, PART).agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy(PART).rowsBetween(W.unboundedPreceding, -1))
    carried = sums.select(*keys, PART, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(W.partitionBy(*keys, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return _handed(stored, carried, keys).withColumn(out, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_before")


def previous(stored: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``stored`` with the values that ``columns`` (name of the value: name of the result) had in the row before of its series; null in the first."""
    packed = F.struct(*(F.col(c).alias(o) for c, o in columns.items()))
    last = stored.groupBy(*keys, PART).agg(F.max_by(packed, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, PART, F.lag("_last").over(W.partitionBy(*keys).orderBy(PART)).alias("_from"))
    w = W.partitionBy(*keys, PART).orderBy(*order)
    here = _handed(stored, carried, keys).withColumn("_own", F.lag(packed).over(w)).withColumn("_n", F.row_number().over(w))
    found = F.when(F.col("_n") == 1, F.col("_from")).otherwise(F.col("_own"))
    here = here.withColumn("_found", found)
    return here.select(*stored.columns, *(F.col(f"_found.{o}").alias(o) for o in columns.values()))


def first_of_series(stored: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``stored`` with values of the first row of its series."""
    packed = F.struct(*(F.col(c).alias(o) for c, o in columns.items()))
    heads = stored.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_head"))
    carried = stored.select(*keys, PART).distinct().alias("a")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    carried = carried.join(heads.alias("b"), same).select("a.*", *(F.col(f"b._head.{o}").alias(o) for o in columns.values()))
    return _handed(stored, carried, keys)


def picked(counts: DataFrame, keys: list[str], value: str, n: str, places: dict[str, Column]) -> DataFrame:
    """Values at places (from 0) of each key's sorted values, given as ``(keys, value, n)`` with each value once.

    ``places`` are columns of ``_total``, the number of a key's values. One running count, no sort of a key.
    """
    stored = ranged(counts, keys, [value])
    totals = stored.groupBy(*keys).agg(F.sum(n).alias("_total"))
    carried = stored.select(*keys, PART).distinct().alias("a")
    same = F.lit(True)
    for k in keys:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    carried = carried.join(totals.alias("b"), same).select("a.*", "b._total")
    scanned = _handed(running_sum(stored, keys, [value], n, "_upto"), carried, keys)
    at = lambda p: F.max(F.when((F.col("_upto") > p) & (F.col("_upto") - F.col(n) <= p), F.col(value)))
    return scanned.groupBy(*keys).agg(*(at(p).alias(name) for name, p in places.items()))
