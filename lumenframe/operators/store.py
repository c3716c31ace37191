"""Document-style mutations as snapshot rewrites: each returns the new table, lazily."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import manifest


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with the same key, whole."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def partial_update(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Non-null fields of ``changes`` replace those of ``old``; changes to missing keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    right = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields))
    out = old.join(right, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in old.columns))


def set_fields(old: DataFrame, where: Column, **values) -> DataFrame:
    """Update by query: set fields (None sets null) where a predicate holds."""
    hit = F.coalesce(where, F.lit(False))
    for name, value in values.items():
        to = value if isinstance(value, Column) else F.lit(value).cast(old.schema[name].dataType)
        old = old.withColumn(name, F.when(hit, to).otherwise(F.col(name)))
    return old


def delete(old: DataFrame, where: Column) -> DataFrame:
    """Rows where the predicate holds go; rows where it is unknown stay."""
    return old.where(~F.coalesce(where, F.lit(False)))


def cascade_delete(tables: dict[str, DataFrame], image_id: str) -> dict[str, DataFrame]:
    """Remove an image from every table, text rows included."""
    return {name: delete(df, F.col("image_id") == image_id) for name, df in tables.items()}


def project(rows: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The columns that are included (default: all) and not excluded; unknown names are ignored."""
    return rows.select(*(c for c in rows.columns if (include is None or c in include) and c not in (exclude or [])))


def point_get(rows: DataFrame, key: str, value, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """The row of one id, or none; the equality reaches the Parquet scan."""
    return project(rows.where(F.col(key) == F.lit(value)), include, exclude)


def keyset_page(rows: DataFrame, key: str, after=None, size: int = 1000) -> DataFrame:
    """The next ``size`` rows in order of a unique key after the last one seen; a page costs a filter, not an offset."""
    return (rows if after is None else rows.where(F.col(key) > F.lit(after))).orderBy(key).limit(size)


def vectors(rows: DataFrame, key: str, vec: str = "embedding", most: int | None = None) -> DataFrame:
    """``(key, vec)`` of all rows with a vector; ``most`` takes the first by key."""
    out = rows.where(F.col(vec).isNotNull()).select(key, vec)
    return out if most is None else out.orderBy(key).limit(most)


def with_metadata(rows: DataFrame, wanted: dict[str, str], column: str = "metadata") -> DataFrame:
    """Rows whose JSON metadata has every wanted value; missing fields don't match."""
    for name, value in wanted.items():
        rows = rows.where(F.get_json_object(column, f"$.{name}") == F.lit(value))
    return rows


def commit(rows: DataFrame, root: str) -> int:
    """Write ``rows`` as the table's next snapshot and make it the one that readers see; returns its number.

    One table of :mod:`manifest`: a reader sees all of a snapshot or none, a writer that dies or comes second leaves the
    last one as it is.
    """
    return manifest.publish(rows.sparkSession, root, replace={"rows": rows}).number


def current(spark, root: str) -> int | None:
    """Number of the visible snapshot; none before the first commit."""
    return manifest.read(spark, root).number or None


def snapshot(spark, root: str, number: int | None = None) -> DataFrame:
    """The table as of a snapshot, by default the visible one; later commits don't change what it reads."""
    return manifest.table(spark, root, "rows", manifest.read(spark, root, number))
