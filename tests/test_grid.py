"""Similarity join over a grid of groups, and components of thinned links, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from lumenframe.operators.dedup import similarity_edges
from lumenframe.plans import components


def _vectors(n: int = 240) -> np.ndarray:
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, n)] + 0.3 * rng.normal(size=(n, 8))
    x[: n // 3] = x[0] * np.array([[2.0]])  # a third of the rows in one direction
    x[-1] = 0
    return x


@pytest.mark.parametrize("threshold", [-0.2, 0.6, 0.98])
@pytest.mark.parametrize("group_bytes", [1 << 26, 3000])
def test_grid_equals_all_pairs(spark, threshold, group_bytes):
    x = _vectors()
    new = np.arange(len(x)) % 7 == 0
    rows = [(f"v{i:03d}", v.tolist(), bool(new[i]), i) for i, v in enumerate(x)] + [("v999", None, True, 0)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<float>, new boolean, p0 int")
    x = x.astype(np.float32).astype(float)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    scores = unit @ unit.T
    want = {(f"v{i:03d}", f"v{j:03d}") for i in range(len(x)) for j in range(i + 1, len(x)) if scores[i, j] >= threshold}
    got = [(r.a, r.b) for r in similarity_edges(df, threshold, group_bytes=group_bytes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    fresh = [(r.a, r.b) for r in similarity_edges(df, threshold, group_bytes=group_bytes, fresh="new").collect()]
    assert len(fresh) == len(set(fresh)) and set(fresh) == {(a, b) for a, b in want if new[int(a[1:])] or new[int(b[1:])]}


def test_grid_of_no_rows_and_of_unlike_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert similarity_edges(spark.createDataFrame([], schema), 0.5).count() == 0
    assert similarity_edges(spark.createDataFrame([(1, [1.0, 0.0])], schema), 0.5).count() == 0
    with pytest.raises(Exception, match="unlike numbers"):
        similarity_edges(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], schema).coalesce(1), 0.5).count()


@pytest.mark.parametrize("few", [components.FEW_LINKS, 5])
def test_components_of_thinned_links(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = np.random.default_rng(1)
    links = [tuple(f"n{x}" for x in p) for p in rng.integers(0, 150, (90, 2)).tolist()] + [("z", "z"), ("n1", None), (None, None)]
    root: dict = {}
    for a, b in links:
        if a and b:
            root.setdefault(a, {a}), root.setdefault(b, {b})
            if root[a] is not root[b]:
                joined = root[a] | root[b]
                root.update(dict.fromkeys(joined, joined))
    df = spark.createDataFrame(links, "a string, b string").repartition(3)
    got = components.components_of(df).collect()
    assert len(got) == len(root) and {r.node: r.component for r in got} == {n: min(s) for n, s in root.items()}
