"""Connected components by alternating star contractions: O(log n) rounds, every round a few partial-aggregated shuffles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

#: Links that one task remembers while it looks for needless ones, and the most that it joins up by itself.
FEW_LINKS = 200_000


def _root(parent: dict, x):
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def spanning_links(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` without links that others of the same task make needless; the components are the same.

    A task forgets what it has seen after ``FEW_LINKS`` links kept, so its memory is bounded; it may keep some needless links then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        for batch in batches:
            kept = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a is None or b is None:
                    kept.append(False)
                    continue
                new = a not in parent or b not in parent
                ra, rb = _root(parent, a), _root(parent, b)
                kept.append(ra != rb or (new and a == b))
                parent[max(ra, rb)] = min(ra, rb)
            if len(parent) > 2 * FEW_LINKS:
                parent = {}
            yield batch.filter(pa.array(kept, pa.bool_()))

    edges = edges.select("a", "b")
    return edges.mapInArrow(run, edges.schema)


def components_of(edges: DataFrame) -> DataFrame:
    """As :func:`connected_components`, of ``edges(a, b)``: links are thinned inside their tasks first.

    What is left is joined up by one task if it is at most ``FEW_LINKS`` links, counted, and by rounds of contractions if it is more.
    """
    left = materialize(spanning_links(edges), "cc-links")
    if left.count() > FEW_LINKS:
        return connected_components(left)
    kind = left.schema["a"].dataType.simpleString()
    types = {f.name: f.dataType for f in left.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        parent: dict = {}
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ra, rb = _root(parent, a), _root(parent, b)
                parent[max(ra, rb)] = min(ra, rb)  # a root is the smallest node of its tree
        nodes = list(parent)
        arrow = to_arrow_type(types["a"])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array([_root(parent, x) for x in nodes], arrow)], ["node", "component"])

    return left.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of one orderable type -> ``(node, component)``; the component is its smallest node.

    Nodes that appear in no edge are not returned; self-loops give single-node components. Null ends are ignored.
    No round collects rows: only a count and a checksum reach the driver.
    """
    clean = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = clean.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    first = pairs = materialize(pairs, "cc")
    last = None
    for _ in range(max_rounds):
        proper = pairs.where("u <> v")
        both = proper.unionByName(proper.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        seen = Observation()
        pairs = materialize(small.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("check")), "cc")
        now = (seen.get["n"], seen.get["check"])
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("connected components did not converge")
    roots = pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    nodes = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
