import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import catalog, catalog_more  # noqa: F401
from lumenframe.operators import dedup, detect, search

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.1"])
def test_ivf_recall_on_the_ids_divisible_by_50(spark, sf_dir):
    q = catalog.QUERIES
    truth = {(r.query_id, r.vec_id) for r in q["knn_search_each50"](spark, sf_dir).where("rank <= 5").collect()}
    found = {(r.query_id, r.vec_id) for r in q["ivf_search_each50"](spark, sf_dir).collect()}
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 50 = 0").count()
    assert len(truth) == 5 * n and len(truth & found) >= 0.9 * len(truth)


def test_query_sets_beyond_the_bound_are_searched_in_blocks(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    rows = lambda df: sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())
    want = rows(search.knn_join(queries, vectors, 3, exclude_self=True))
    monkeypatch.setattr(search, "MAX_QUERIES", 4)
    assert len(want) == 30 and rows(search.knn_blocks(queries, vectors, 3, exclude_self=True)) == want


def test_whole_searches_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    names = [n for n in catalog.QUERIES if n.endswith(("_each50", "verify_faces_all"))]
    assert len(names) == 8
    for name in names:
        df = catalog.QUERIES[name](spark, SF)
        key = lambda r: tuple(round(x, 4) if isinstance(x, float) else x for x in r)
        got = sorted(map(key, df.collect()))
        columns = ", ".join(f'"{c}"' for c in df.columns)
        want = sorted(map(key, db.execute(f"select {columns} from ({catalog.ORACLES[name]})").fetchall()))
        assert len(got) == len(want) > 0, name
        assert all(x == pytest.approx(y, abs=2e-4) if isinstance(x, float) else x == y for a, b in zip(got, want) for x, y in zip(a, b)), name


def test_highlight_takes_all_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: n for i, t in docs.items() if (n := len(re.findall(r"\bidiot\b", t or "", re.I)))}
    assert {r.doc_id: r.n for r in catalog.QUERIES["highlight_all"](spark, SF).collect()} == want


def test_ingest_equals_the_sequential_fold(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    data = {}
    for i in range(60):
        v = centres[i % 6] + 0.12 * rng.normal(size=8)
        data[i if i < 40 else i + 60] = [float(x) for x in v / np.linalg.norm(v)]  # 40 new, 20 indexed
    groups = {i: (f"g{i}" if i % 6 == 4 else None) for i in data if i >= 100}
    unit = {i: np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for i, v in data.items()}
    have, want = dict(groups), {}
    for a in sorted(i for i in data if i < 100):
        near = sorted((-(1 + unit[a] @ unit[b]) / 2, b) for b in have)[:10]
        near = [(-s, b) for s, b in near if -s >= 0.97]
        have[a] = None
        if near:
            got = next((have[b] for _, b in near if have[b]), None)
            have[a] = got or "dup_" + hashlib.sha256(str(a).encode()).hexdigest()[:12]
            want[a] = (have[a], not got, near[0][0] if got else 1.0)
            if not got:
                have[near[0][1]] = have[a]
                want[near[0][1]] = (have[a], False, near[0][0])
    new = spark.createDataFrame([(i, v) for i, v in data.items() if i < 100], "vec_id long, embedding array<float>")
    old = spark.createDataFrame([(i, v, groups[i]) for i, v in data.items() if i >= 100], "vec_id long, embedding array<float>, duplicate_group_id string")
    rows = dedup.ingest_in_order(new, old, 0.97).collect()
    got = {r.id: (r.duplicate_group_id, r.is_duplicate_primary, pytest.approx(r.duplicate_score, abs=1e-6)) for r in rows}
    assert len(rows) == len(want) > 20 and {g[0] for g in want.values()} == {g[0] for g in got.values()} and want == got


def sequential(new, old, threshold, k):
    """The fold by plain loops: {id: group}, groups named by their members' first maker."""
    group = {i: g for i, _, g in old if g}
    seen = [(i, v) for i, v, _ in old]
    for i, v in sorted(new):
        near = sorted((-round((1 + float(np.dot(v, w))) / 2, 12), j) for j, w in seen)[:k]
        near = [j for s, j in near if -s >= threshold]
        if near:
            into = next((j for j in near if j in group), None)
            if into is None:
                group[i] = group[near[0]] = f"made {i}"
            else:
                group[i] = group[into]
        seen.append((i, v))
    return group


def test_a_batch_of_copies_is_ingested_like_one_by_one(spark):
    draw = np.random.default_rng(2)
    unit = lambda x: x / np.linalg.norm(x)
    base = [unit(draw.normal(size=6)) for _ in range(5)]
    old = [(i, unit(base[i % 5] + 0.05 * draw.normal(size=6)), f"g{i}" if i % 4 == 0 else None) for i in range(12)]
    new = [(100 + i, base[0] if i % 2 else unit(base[i % 5] + 0.1 * draw.normal(size=6))) for i in range(80)]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in new], "vec_id long, embedding array<double>")
    held = spark.createDataFrame([(i, [float(x) for x in v], g) for i, v, g in old], "vec_id long, embedding array<double>, duplicate_group_id string")
    for k, threshold in ((3, 0.985), (10, 0.97), (1, 0.985)):
        got = {r.id: r.duplicate_group_id for r in dedup.ingest_in_order(rows, held, threshold, k).collect()}
        want = {i: g for i, g in sequential(new, old, threshold, k).items() if i in got or i >= 100}
        assert set(got) >= {i for i in want if i >= 100} and len(want) > 40
        same = {}
        for i in want:
            assert same.setdefault(want[i], got[i]) == got[i]
        assert len(set(same.values())) == len(same)


def test_matching_is_greedy_in_reference_order(spark):
    draw = np.random.default_rng(3)

    def boxes(n):
        at = draw.random((n, 2)) * 3
        return [(f"i{int(draw.integers(0, 4))}", k, int(draw.integers(0, 2)), *at[k].tolist(), *(at[k] + 1 + draw.random(2)).tolist(), float(draw.random())) for k in range(n)]

    schema = "image_id string, box_index long, class_id int, x1 double, y1 double, x2 double, y2 double, confidence double"
    a, b = boxes(60), boxes(60)

    def overlap(p, q):
        w, h = min(p[5], q[5]) - max(p[3], q[3]), min(p[6], q[6]) - max(p[4], q[4])
        both = max(w, 0) * max(h, 0)
        return both / ((p[5] - p[3]) * (p[6] - p[4]) + (q[5] - q[3]) * (q[6] - q[4]) - both)

    want, used = set(), set()
    for p in sorted(a, key=lambda r: (r[0], r[1])):
        fits = [(-overlap(p, q), q[1]) for q in b if q[0] == p[0] and q[2] == p[2] and (q[0], q[1]) not in used and overlap(p, q) >= 0.3]
        if fits:
            used.add((p[0], min(fits)[1]))
            want.add((p[0], p[1], min(fits)[1]))
    got = detect.match_detections(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 0.3).collect()
    assert {(r.image_id, r.ref, r.test) for r in got} == want and len(want) > 10
