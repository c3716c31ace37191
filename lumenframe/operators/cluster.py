"""IVF-style clustering of vector tables: train, assign, probe, sizes, balance, albums, members."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.vectors import l2_normalize
from lumenframe.operators import manifest
from lumenframe.schema import CLUSTER_DEFAULTS
from lumenframe.plans.storage import materialize

#: Key and vector of the tables that have clusters, and their default numbers of clusters.
CLUSTERED = {"global": ("image_id", "global_embedding"), "vehicles": ("detection_id", "embedding"), "people": ("detection_id", "embedding"), "faces": ("face_id", "embedding")}
DEFAULTS = {name: default for name, (default, _) in CLUSTER_DEFAULTS.items()}
#: Centroids that one broadcast may hold; the trainer never makes more.
MAX_CENTROIDS = 8192


def cluster_count(rows: int, default: int) -> int:
    """The default number of clusters, held between max(16, sqrt(n)) and n / 10, and never above n."""
    low = max(16, math.isqrt(rows))
    return max(1, min(rows, max(low, min(default, max(low, rows // 10)))))


def mean_centroids(vectors: DataFrame, key: str = "label", vec: str = "embedding") -> DataFrame:
    """``(cluster_id, centroid)``: normalised element-wise mean of each key's vectors; sums combine before the shuffle."""
    parts = vectors.where(F.col(vec).isNotNull()).select(F.col(key).alias("cluster_id"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "x"))
    sums = parts.groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"))
    rows = sums.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"))
    return rows.select("cluster_id", l2_normalize(F.col("v.x")).alias("centroid"))


def train(vectors: DataFrame, n_clusters: int | None = None, default: int = 1024, vec: str = "embedding", seed: int = 42, max_iter: int = 25) -> DataFrame:
    """Spherical k-means; returns stored ``(cluster_id, centroid)``. Rows are spread over the cluster, only centroids reach the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where(F.col(vec).isNotNull()).select(array_to_vector(l2_normalize(F.col(vec))).alias("features"))
    n = rows.count()
    if n == 0:
        raise ValueError("nothing to train on")
    k = min(MAX_CENTROIDS, n_clusters or cluster_count(n, default))
    model = KMeans(k=max(2, k), distanceMeasure="cosine", maxIter=max_iter, seed=seed).fit(rows)
    spark = vectors.sparkSession
    found = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster_id int, centroid array<double>")
    return materialize(found.select("cluster_id", l2_normalize(F.col("centroid")).alias("centroid")), "centroids")


def assign(vectors: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(id, cluster_id, cluster_distance)``: nearest centroid by inner product, ties to the smaller cluster.

    Every row is scored where it stands: a batch of vectors times the matrix of the centroids, of which there are at most
    ``MAX_CENTROIDS``. Nothing is shuffled. Null vectors are left out; a zero vector is at distance 1 of all.
    """
    found = sorted((r.cluster_id, r.centroid) for r in centroids.select("cluster_id", "centroid").limit(MAX_CENTROIDS + 1).collect())
    if len(found) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows = vectors.where(F.col(vec).isNotNull()).select(F.col(id_col), F.col(vec).cast("array<double>").alias("_vec"))
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, cluster_id int, cluster_distance double"
    if not found:
        return rows.limit(0).select(id_col, F.lit(0).alias("cluster_id"), F.lit(0.0).alias("cluster_distance"))
    names, matrix = np.array([c for c, _ in found], np.int32), np.array([v for _, v in found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                scores = (x / np.where(norm == 0, 1.0, norm)) @ matrix.T
                best = scores.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[best]), pa.array(1 - scores[np.arange(len(best)), best])], [id_col, "cluster_id", "cluster_distance"])

    return rows.mapInArrow(run, schema)


def nearest(centroids: DataFrame, vec: Column) -> Column:
    """``struct<cluster_id, cluster_distance>`` of a vector column, where the row stands; null without a vector or a model."""
    found = sorted((r.cluster_id, r.centroid) for r in centroids.select("cluster_id", "centroid").limit(MAX_CENTROIDS + 1).collect())
    if len(found) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    if not found:
        return F.lit(None).cast("struct<cluster_id: int, cluster_distance: double>")
    names, matrix = np.array([c for c, _ in found], np.int32), np.array([v for _, v in found])

    @F.pandas_udf("struct<cluster_id: int, cluster_distance: double>")
    def pick(vectors: pd.Series) -> pd.DataFrame:
        there = vectors.notna().to_numpy()
        out = pd.DataFrame({"cluster_id": pd.array([None] * len(vectors), "Int32"), "cluster_distance": np.full(len(vectors), np.nan)})
        if there.any():
            x = np.stack(vectors[there].to_numpy()).astype(float)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            scores = (x / np.where(norm == 0, 1.0, norm)) @ matrix.T
            best = scores.argmax(axis=1)
            out.loc[there, "cluster_id"] = names[best]
            out.loc[there, "cluster_distance"] = 1 - scores[np.arange(len(best)), best]
        return out

    got = pick(vec.cast("array<double>"))
    return F.when(vec.isNotNull(), got)


def assign_unclustered(table: DataFrame, centroids: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Assignments of the rows that have no cluster yet."""
    return assign(table.where(F.col("cluster_id").isNull()), centroids, id_col, vec)


def probe(queries: DataFrame, centroids: DataFrame, nprobe: int = 16) -> DataFrame:
    """``(query_id, cluster_id, rank)``: the nprobe nearest clusters of each query vector."""
    found = sorted((r.cluster_id, r.centroid) for r in centroids.select("cluster_id", "centroid").limit(MAX_CENTROIDS + 1).collect())
    if len(found) > MAX_CENTROIDS:
        raise ValueError(f"more than {MAX_CENTROIDS} centroids")
    rows = queries.where(F.col("query_vec").isNotNull()).select("query_id", F.col("query_vec").cast("array<double>").alias("_vec"))
    names, matrix = np.array([c for c, _ in found], np.int64), np.array([v for _, v in found], float)
    kind = rows.schema["query_id"].dataType.simpleString()
    if not found:
        return rows.limit(0).select("query_id", F.lit(0).cast("long").alias("cluster_id"), F.lit(0).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = min(nprobe, len(names))
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                scores = np.round((x / np.where(norm == 0, 1.0, norm)) @ matrix.T, 12)
                best = np.argsort(-scores, axis=1, kind="stable")[:, :n]  # names ascend: ties go to the smaller cluster
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), n)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(names[best].ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(x)))], ["query_id", "cluster_id", "rank"])

    return rows.mapInArrow(run, f"query_id {kind}, cluster_id long, rank int")


def cluster_stats(rows: DataFrame, limit: int = 10_000) -> DataFrame:
    """Per cluster: count, mean and least distance; largest first, then smallest id; rows without a cluster are left out."""
    out = rows.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("count"), F.avg("cluster_distance").alias("avg_distance"), F.min("cluster_distance").alias("min_distance"))
    return out.orderBy(F.desc("count"), "cluster_id").limit(limit)


def size_distribution(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """One row: n_clusters, n_vectors, avg/min/max size (min and max over non-empty), empty_clusters."""
    counts = rows.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("n"))
    sizes = centroids.select("cluster_id").join(counts, "cluster_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = F.when(F.col("n") > 0, F.col("n"))
    return sizes.agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_vectors"), (F.sum("n") / F.count("*")).alias("avg_size"), F.coalesce(F.min(full), F.lit(0)).alias("min_size"), F.coalesce(F.max(full), F.lit(0)).alias("max_size"), F.count_if(F.col("n") == 0).alias("empty_clusters"))


def check_balance(rows: DataFrame, centroids: DataFrame, trained_on: int, growth: float = 0.5, imbalance: float = 10.0, emptiness: float = 0.1) -> DataFrame:
    """Size distribution with ``imbalance, empty_ratio, growth_ratio, needs_rebalance, reason``; reasons in that precedence."""
    d = size_distribution(rows, centroids)
    d = d.withColumn("imbalance", F.when(F.col("min_size") > 0, F.col("max_size") / F.col("min_size")).otherwise(0.0))
    d = d.withColumn("empty_ratio", F.when(F.col("n_clusters") > 0, F.col("empty_clusters") / F.col("n_clusters")).otherwise(0.0))
    d = d.withColumn("growth_ratio", (F.col("n_vectors") - trained_on) / F.lit(float(max(1, trained_on))))
    reason = F.when(F.col("imbalance") > imbalance, "imbalance").when(F.col("empty_ratio") > emptiness, "empty").when(F.col("growth_ratio") > growth, "growth").otherwise("balanced")
    return d.withColumn("reason", reason).withColumn("needs_rebalance", F.col("reason") != "balanced")


def albums(rows: DataFrame, min_size: int = 2, limit: int = 100) -> DataFrame:
    """Clusters of at least ``min_size``, largest first; ``total_albums`` counts before the cut."""
    sized = rows.where(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)
    total = sized.agg(F.count("*").alias("total_albums"))
    return sized.orderBy(F.desc("size"), "cluster_id").limit(limit).join(F.broadcast(total))


def members(rows: DataFrame, cluster_id: int, page: int = 0, size: int = 50, id_col: str = "vec_id") -> DataFrame:
    """One cluster by distance (missing last), paged."""
    return rows.where(F.col("cluster_id") == cluster_id).orderBy(F.asc_nulls_last("cluster_distance"), id_col).offset(page * size).limit(size)


# Growth threshold and hours between rebalances for each update pattern.
PATTERNS = {"low": (0.5, 24.0), "medium": (0.4, 6.0), "high": (0.3, 2.0), "very_high": (0.2, 0.5)}


def maintenance(rows: DataFrame, centroids: DataFrame, trained_on: int, pattern: str = "medium", hours_since: float | None = None) -> DataFrame:
    """Balance with the pattern's growth threshold, and ``due``: needed, and the cool-down is over."""
    growth, pause = PATTERNS[pattern]
    ready = hours_since is None or hours_since >= pause
    return check_balance(rows, centroids, trained_on, growth).withColumn("due", F.col("needs_rebalance") & F.lit(ready))


def save_model(centroids: DataFrame, root: str, index_name: str, trained_on: int = 0) -> None:
    """Keep the model of an index under its name; readers see the older one of that name until the new one is whole."""
    rows = centroids.select("cluster_id", "centroid", F.lit(trained_on).cast("long").alias("trained_on"))
    manifest.publish(centroids.sparkSession, root, replace={index_name: rows})


def load_model(spark, root: str, index_name: str | None = None) -> DataFrame:
    """``(cluster_id, centroid, trained_on)`` of one index, or of all with their ``index_name``."""
    now = manifest.read(spark, root)
    if index_name is not None:
        return manifest.table(spark, root, index_name, now)
    parts = [manifest.table(spark, root, name, now).withColumn("index_name", F.lit(name)) for name in sorted(now.folders)]
    if not parts:
        raise ValueError(f"no model is kept at {root}")
    return reduce(DataFrame.unionByName, parts)


def centroid_of(centroids: DataFrame, cluster_id: int) -> DataFrame:
    """The centroid of one cluster, or no row."""
    return centroids.where(F.col("cluster_id") == cluster_id).select("cluster_id", "centroid")


def write_back(table: DataFrame, assigned: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """``table`` with ``cluster_id`` and ``cluster_distance`` of the assigned rows; others keep theirs, or null."""
    new = assigned.select(id_col, F.col("cluster_id").alias("_c"), F.col("cluster_distance").alias("_d"))
    old = {c: F.col(c) if c in table.columns else F.lit(None) for c in ("cluster_id", "cluster_distance")}
    rest = [c for c in table.columns if c not in old]
    out = table.join(new, id_col, "left")
    return out.select(*rest, F.coalesce("_c", old["cluster_id"]).cast("int").alias("cluster_id"), F.when(F.col("_c").isNotNull(), F.col("_d")).otherwise(old["cluster_distance"]).cast("double").alias("cluster_distance"))


def retrain(table: DataFrame, n_clusters: int | None = None, id_col: str = "vec_id", vec: str = "embedding", **options) -> tuple[DataFrame, DataFrame]:
    """Train on a table, assign all of its rows anew and write that back: ``(table, centroids)``. A rebalance is this, run again."""
    centroids = train(table, n_clusters, vec=vec, **options)
    return write_back(table, assign(table, centroids, id_col, vec), id_col), centroids
