import os

import duckdb
import numpy as np
import pytest

from lumenframe import catalog, catalog_flows  # noqa: F401
from lumenframe.functions import scalars
from lumenframe.operators import cluster, dedup, detect, metrics, search, store, text
from lumenframe.plans import storage
from lumenframe.plans.embed import HashEncoder

SF = "/root/testdata/sf0.001"
NAMES = [n for n, f in catalog.QUERIES.items() if f.__module__ == "lumenframe.catalog_flows"]


@pytest.mark.parametrize("name", [n for n in NAMES if n in catalog.ORACLES])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = db.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    cell = lambda v: "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_snapshots_show_whole_commits(spark, tmp_path):
    got = {tuple(r) for r in catalog.QUERIES["snapshot_commit"](spark, SF).collect()}
    orders = {(r.o_orderkey, r.o_orderstatus) for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    assert got == {o for o in orders if o[1] != "F"} and got != orders
    root = str(tmp_path / "t")
    with pytest.raises(ValueError):
        store.snapshot(spark, root)
    assert store.commit(spark.range(3).toDF("x"), root) == 1
    before = store.snapshot(spark, root)
    assert store.commit(spark.range(5).toDF("x"), root) == 2 and before.count() == 3 and store.snapshot(spark, root).count() == 5 and store.snapshot(spark, root, 1).count() == 3


def test_retrained_rows_are_at_their_nearest_centroid(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").drop("label")
    table, centroids = cluster.retrain(rows, 8)
    c = {r.cluster_id: np.array(r.centroid) for r in centroids.collect()}
    for r in table.collect():
        v = np.array(r.embedding, float)
        ips = {k: v @ x / np.linalg.norm(v) for k, x in c.items()}
        assert abs(ips[r.cluster_id] - max(ips.values())) < 1e-9 and abs(1 - ips[r.cluster_id] - r.cluster_distance) < 1e-6
    assert cluster.assign(rows.limit(0), centroids).collect() == [] and cluster.assign(rows, centroids.limit(0)).collect() == []


def test_content_search_equals_numpy(spark):
    items = spark.createDataFrame([(i, [float(x) for x in HashEncoder().encode([f"page {i}"])[0]]) for i in range(60)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, "page 7"), (2, "unseen"), (3, None)], "id long, content string")
    got = search.content_search(queries, items, HashEncoder, 3).collect()
    assert {r.query_id for r in got} == {1, 2} and next(r.vec_id for r in got if r.query_id == 1 and r.rank == 1) == 7
    x, q = HashEncoder().encode([f"page {i}" for i in range(60)]), HashEncoder().encode(["unseen"])[0]
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 2] == list(np.argsort(-(x @ q))[:3])


def test_matched_and_unmatched_make_up_both_sides(spark):
    det = catalog._detections(spark, SF)
    other = det.where("box_index % 5 <> 1").withColumn("x1", det.x1 + 0.02)
    matches = detect.match_detections(det, other)
    pairs, rest = matches.collect(), catalog.QUERIES["unmatched_boxes"](spark, SF).collect()
    assert len(pairs) + sum(r.side == "reference" for r in rest) == det.count() and len(pairs) + sum(r.side == "test" for r in rest) == other.count()
    assert len({(r.image_id, r.ref) for r in pairs}) == len({(r.image_id, r.test) for r in pairs}) == len(pairs)
    m = detect.comparison_metrics(matches, det.count(), other.count()).first()
    assert m.matched == len(pairs) and abs(m.mean_shift - np.mean([r["shift"] for r in pairs])) < 1e-9 and m.precision <= 1


def test_greedy_groups_finish_long_chains_or_raise(spark, monkeypatch):
    path = spark.createDataFrame([(i, i + 1) for i in range(3000)] + [(9000, 9001)], "a long, b long")
    got = {r.member: r.leader for r in dedup.greedy_groups(path).collect()}
    assert got == {i: i if i % 2 == 0 else i - 1 for i in range(3001)} | {9000: 9000, 9001: 9000}
    monkeypatch.setattr(dedup, "FOLD_EDGES", 10)
    with pytest.raises(RuntimeError):
        dedup.greedy_groups(path, 3)


def test_similarity_edges_without_pairs_lost_between_cells(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    for threshold in (0.9, 0.99, 0.2):
        want = {(i, j) for i in range(300) for j in range(i + 1, 300) if x[i] @ x[j] >= threshold}
        got = [(r.a, r.b) for r in dedup.similarity_edges(df, threshold, block=16).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fused_rows_and_keypoints(spark):
    images = spark.createDataFrame([("a", [[1.0, 2.0, 3.0, 4.0, 0.9, 5.0], [1.0, 1.0, 2.0, 2.0, 0.1, 0.0]]), ("b", [])], "image_id string, output array<array<double>>")
    assert [tuple(r) for r in detect.explode_fused(images).collect()] == [("a", 0, 1.0, 2.0, 3.0, 4.0, 0.9, 5)]
    assert detect.detector_layout(["num_dets", "det_boxes", "det_scores", "det_classes"]) == "four"
    with pytest.raises(ValueError):
        detect.detector_layout(["boxes"])
    middle = 2 * (20 * 40 + 20)  # a planted face: stride 16, cell (20, 20), 50 pixels on each side
    rows = [("f", 16, middle + a, 0.95 - a / 100, *[50 / 16] * 4, [0.5 * k for k in range(10)]) for a in (0, 1)] + [("f", 16, 3, 0.01, *[1.0] * 4, [0.0] * 10)]
    out = spark.createDataFrame(rows, "image_id string, stride int, idx long, score double, left double, top double, right double, bottom double, kps array<double>")
    (face,) = detect.decode_faces(out).collect()
    assert (face.x1, face.y1, face.x2, face.y2, face.confidence) == (270.0, 270.0, 370.0, 370.0, 0.95)
    assert face.landmarks == [[320.0 + 16 * 0.5 * k, 320.0 + 16 * 0.5 * (k + 1)] for k in range(0, 10, 2)]


def test_sampled_hash_of_large_contents(spark):
    big = bytes(range(256)) * 1024
    changed = bytearray(big)
    changed[20_000] ^= 1  # outside of the samples
    other = bytearray(big)
    other[-1] ^= 1
    rows = spark.createDataFrame([(0, bytearray(big)), (1, changed), (2, other), (3, bytearray(big[:-1])), (4, None)], "i int, c binary")
    h = {r.i: r.h for r in rows.select("i", scalars.sampled_hash(rows.c).alias("h")).collect()}
    assert h[0] == h[1] and len({h[0], h[2], h[3]}) == 3 and h[4] is None


def test_cache_replay_equals_a_sequential_cache(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(t)) for k, t in zip(rng.integers(0, 5, 300), rng.integers(0, 5000, 300))]
    df = spark.createDataFrame(rows, "key long, s double").selectExpr("key", "timestamp_seconds(s) ts")
    want: dict = {}
    written: dict = {}
    for k, t in sorted(rows, key=lambda r: r[1]):
        fresh = k in written and t - written[k] <= 60
        want[k] = want.get(k, 0) + fresh
        if not fresh:
            written[k] = t
    assert {r.key: r.hits for r in metrics.cache_replay(df, 60.0).collect()} == want


def test_rates_and_their_ratio(spark):
    rows = [("s", n, t, float(v)) for n, vs in {"bad": [0, 1, 1, 4, 0, 2], "all": [0, 10, 20, 30, 5, 15]}.items() for t, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "series string, name string, m int, value double").selectExpr("series", "name", "value", "timestamp_seconds(m * 60) ts")
    (r,) = metrics.ratio_of_rates(df, "bad", "all", 600).collect()
    assert r.ratio == pytest.approx((1 + 0 + 3 + 0 + 2) / (10 + 10 + 10 + 5 + 10))


def test_best_fields_mark_and_page(spark):
    docs = spark.createDataFrame([(1, "Quick brown fox", "nothing"), (2, "slow", "quick quack fox"), (3, None, None), (4, "quik fxo", "")], "doc_id long, title string, body string")
    got = text.best_fields_search(docs, "quick fox", {"title": 2.0, "body": 1.0}).collect()
    assert [(r.doc_id, r.score, r.field) for r in got] == [(1, 4.0, "title"), (2, 2.0, "body"), (4, 2.0, "title")] and got[0].highlighted == "<em>Quick</em> brown <em>fox</em>"
    assert text.best_fields_search(docs, "quick fox", {"title": 2.0, "body": 1.0}, page=1, size=2).first().total_hits == 3


def test_broadcast_sizes_are_measured_by_rows(spark):
    plain = storage.materialize(spark.range(100_000).selectExpr("id", "'the same text' t", "array('a', 'b') a"), "sizes")
    assert storage.stored_bytes(plain) < storage.memory_bytes(plain) / 4
    assert storage.fits_broadcast(plain) and not storage.fits_broadcast(plain, 1 << 20)
    assert storage.memory_bytes(plain.limit(0)) == 0
