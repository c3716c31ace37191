import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import schema
from lumenframe.functions import geometry as G
from lumenframe.functions import scalars as S
from lumenframe.functions import vectors as V
from lumenframe.operators import cluster, dedup, detect, identity, ingest, metrics, search, store, text
from lumenframe.plans.components import connected_components


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def unit_rows(n, dim=8, seed=1, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 4), dim))
    out = []
    for i in range(n):
        v = centres[i % len(centres)] + spread * rng.normal(size=dim)
        out.append((i, [float(x) for x in v / np.linalg.norm(v)]))
    return out


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = df.select(V.dot(F.col("a"), F.col("b")), V.l2_norm(F.col("a")), V.cosine(F.col("a"), F.col("b")), V.knn_score(F.col("a"), F.col("b")), V.l2_normalize(F.col("a"))).collect()
    assert got[0][:4] == (24.0, 5.0, 0.96, 0.98) and got[0][4] == [0.6, 0.8]
    assert got[1][:4] == (0.0, 0.0, 0.0, 0.5) and got[1][4] == [0.0, 0.0]


def test_knn_equals_brute_force(spark):
    data = unit_rows(40)
    items = spark.createDataFrame(data + [(99, None)], "vec_id long, embedding array<float>")
    queries = items.where("vec_id < 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.knn_join(queries, items, k=5, exclude_self=True).collect()}
    for q in range(3):
        want = sorted((-(1 + float(np.dot(np.float32(data[q][1]), np.float32(v)))) / 2, i) for i, v in data if i != q)[:5]
        assert [got[q, r + 1] for r in range(5)] == [i for _, i in want]


def test_knn_refuses_unbounded_query_sets(spark, monkeypatch):
    monkeypatch.setattr(search, "MAX_QUERIES", 2)
    items = spark.createDataFrame(unit_rows(5), "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        search.knn_join(items.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), items)


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.99])
def test_similarity_edges_equal_all_pairs(spark, threshold):
    data = unit_rows(60, spread=0.15)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    want = {(i, j) for i, v in data for j, w in data if i < j and float(np.dot(v, w)) >= threshold}
    assert {(r.a, r.b) for r in dedup.similarity_edges(df, threshold).collect()} == want


def sequential_groups(ids, near):
    leader = {}
    for i in ids:
        if i not in leader and near.get(i):
            leader[i] = i
            for j in sorted(near[i]):
                leader.setdefault(j, i)
    return leader


def test_greedy_groups_equal_the_sequential_scan(spark):
    rng = random.Random(5)
    edges = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(70)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    got = {r.member: r.leader for r in dedup.greedy_groups(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == sequential_groups(range(60), near)


def test_components_equal_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7), (None, 3)]
    comp = {x: x for e in edges if None not in e for x in e}
    for _ in comp:
        for a, b in edges:
            if a is not None:
                comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == comp
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cluster_sizes_and_balance(spark):
    assert cluster.cluster_count(100, 1024) == 16 and cluster.cluster_count(10_000, 1024) == 1000 and cluster.cluster_count(1_000_000, 1024) == 1024 and cluster.cluster_count(5, 1024) == 5
    rows = spark.createDataFrame([(i, 0 if i < 22 else 1, 0.1) for i in range(24)] + [(90, None, None)], "vec_id long, cluster_id int, cluster_distance double")
    centroids = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0])], "cluster_id int, centroid array<double>")
    r = cluster.check_balance(rows, centroids, 24).first()
    assert (r.n_clusters, r.n_vectors, r.min_size, r.max_size, r.empty_clusters, r.reason) == (3, 24, 2, 22, 1, "imbalance")
    assert cluster.check_balance(rows, centroids, 24, imbalance=20).first().reason == "empty"
    assert cluster.check_balance(rows, centroids, 10, imbalance=20, emptiness=0.5).first().reason == "growth"
    assert not cluster.maintenance(rows, centroids, 24, "high", hours_since=1.0).first().due


def test_trained_centroids_are_unit_and_assign_everything(spark):
    df = spark.createDataFrame(unit_rows(60), "vec_id long, embedding array<float>")
    centroids = cluster.train(df, n_clusters=4, max_iter=5)
    assert all(math.isclose(np.linalg.norm(r.centroid), 1.0, abs_tol=1e-9) for r in centroids.collect())
    assert cluster.assign(df, centroids).count() == 60


GROUP_SCHEMA = "image_id string, duplicate_group_id string, is_duplicate_primary boolean, duplicate_score double"


def test_removal_promotes_the_best_member_and_keeps_singletons(spark):
    df = spark.createDataFrame([("a", "g", True, 1.0), ("b", "g", False, 0.7), ("c", "g", False, 0.9), ("d", None, None, None), ("e", "h", True, 1.0)], GROUP_SCHEMA)
    got = {r.image_id: (r.duplicate_group_id, r.is_duplicate_primary) for r in dedup.remove_from_group(df, "a").collect()}
    assert got == {"a": (None, None), "b": ("g", False), "c": ("g", True), "d": (None, None), "e": ("h", True)}
    assert {r.image_id: r.duplicate_group_id for r in dedup.remove_from_group(df, "e").collect()}["e"] is None
    with pytest.raises(ValueError):
        dedup.merge_groups(df, ["g"])


def test_identity_edits(spark):
    df = spark.createDataFrame([("f1", "p", "N", 0.5, True), ("f2", "p", "M", 0.9, False), ("f3", None, None, 0.1, False)], "face_id string, person_id string, person_name string, confidence double, is_reference boolean")
    assert identity.list_persons(df).collect()[0][:] == ("p", 2, "f2", "M")
    assert identity.delete_person(df, "p").count() == 1
    assert {r.person_id for r in identity.delete_person(df, "p", dissolve=True).collect()} == {"person_f1", "person_f2", None}
    assert {r.person_name for r in identity.rename_person(df, "p", "O'Hara").where("person_id = 'p'").collect()} == {"O'Hara"}


def test_text_functions(spark):
    df = spark.createDataFrame([(1, "The quick brown fox"), (2, "brown quick"), (3, None), (4, "ab")], "doc_id long, text string")
    assert rows_of(df.select("doc_id", text.ngrams(text.tokens(F.col("text"))).alias("g")).where("doc_id = 4")) == [(4, ["ab"])]
    assert rows_of(df.where(text.phrase_match(F.col("text"), "Quick brown")).select("doc_id")) == [(1,)]
    assert rows_of(df.where(text.fuzzy_match(F.col("text"), "quikc")).select("doc_id")) == []
    assert rows_of(df.where(text.fuzzy_match(F.col("text"), "quack")).select("doc_id")) == [(1,), (2,)]
    assert text.bm25(df, "absent").collect() == []
    assert df.where("doc_id = 1").select(text.highlight(F.col("text"), "fox")).first()[0] == "The quick brown <em>fox</em>"


def test_ingest_explodes_and_keeps_ordinals(spark):
    df = spark.createDataFrame([("i", ["a", " ", "c", "d"], [[0.0]] * 3, [0.9, 0.9, 0.4], [0.9, 0.9, 0.9])], "image_id string, texts array<string>, boxes array<array<double>>, det_scores array<double>, rec_scores array<double>")
    assert [r.ocr_id for r in ingest.explode_ocr(df).collect()] == ["i_ocr_0", "i_ocr_2"]
    assert [r.ocr_id for r in ingest.explode_ocr(df, 0.5, 0.8).collect()] == ["i_ocr_0"]
    det = spark.createDataFrame([("i", 2, [[0.0]] * 3, [0.9, 0.0, 0.8], [0, 2, 4])], "image_id string, num_dets int, boxes array<array<double>>, scores array<double>, classes array<int>")
    assert [(r.detection_id, r.category) for r in ingest.explode_detections(det).collect()] == [("i_box_0", "person")]
    assert schema.index_name(" Faces ") == "faces"
    with pytest.raises(ValueError):
        schema.index_name("ocr")


def test_nms_equals_its_definition(spark):
    rng = random.Random(2)
    data = [("i", 0, k, rng.random(), x := rng.random(), y := rng.random(), x + 0.3, y + 0.3) for k in range(40)]
    df = spark.createDataFrame(data, "image_id string, class_id int, box_index int, confidence double, x1 double, y1 double, x2 double, y2 double")

    def overlap(a, b):
        w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
        return 0 if w <= 0 or h <= 0 else w * h / (2 * 0.09 - w * h)

    kept = []
    for r in sorted(data, key=lambda r: -r[3]):
        if all(overlap(r, k) <= 0.4 for k in kept):
            kept.append(r)
    got = detect.nms(df, 0.4)
    assert {r.box_index for r in got.collect()} == {k[2] for k in kept}
    assert rows_of(detect.nms(got, 0.4)) == rows_of(got)


def test_anchor_decode_reading_order_and_ctc(spark):
    out = spark.createDataFrame([("i", 8, 2 * (3 * 80 + 5), 0.95, 1.0, 2.0, 3.0, 4.0), ("i", 8, 0, 0.01, 1.0, 1.0, 1.0, 1.0)], "image_id string, stride int, idx long, score double, left double, top double, right double, bottom double")
    assert rows_of(detect.decode_anchors(out).select("x1", "y1", "x2", "y2")) == [(32.0, 8.0, 64.0, 56.0)]
    boxes = spark.createDataFrame([("i", 0, 50.0, 12.0), ("i", 1, 10.0, 15.0), ("i", 2, 0.0, 40.0)], "image_id string, box_index int, x double, y double")
    assert [r.box_index for r in detect.reading_order(boxes).orderBy("position").collect()] == [1, 0, 2]
    steps = spark.createDataFrame([("l", t, s, 0.5) for t, s in enumerate([0, 1, 1, 0, 1, 2])], "line_id string, t int, symbol int, prob double")
    assert detect.ctc_decode(steps, ["a", "b"]).first()[1:] == ("aab", 0.5)


def test_similarity_transform_recovers_a_known_one():
    rng = np.random.default_rng(0)
    src = rng.normal(size=(5, 2))
    angle, scale, shift = 0.7, 2.5, np.array([3.0, -1.0])
    r = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    m = detect.similarity_transform(src, scale * src @ r.T + shift)
    assert np.allclose(m, np.column_stack([scale * r, shift]))


def test_geometry_scalars(spark):
    one = spark.range(1)
    p = G.letterbox(F.lit(1280), F.lit(720))
    assert one.select(p["scale"], p["pad_x"], p["pad_y"]).first()[:] == (0.5, 0.0, 140.0)
    quad = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((9, 9), (0, 0), (10, 1), (1, 8))))
    assert [tuple(x) for x in one.select(G.order_quad(quad)).first()[0]] == [(0, 0), (10, 1), (9, 9), (1, 8)]
    assert one.select(*G.ocr_input(F.lit(1920), F.lit(1080))).first()[:] == (960, 544)
    assert one.select(S.landmarks(F.array(F.lit(1.0)))).first()[0] is None
    assert one.select(S.route_template(F.lit("/v1/detect/abc"))).first()[0] == "/v1/detect"
    assert one.select(S.format_bytes(F.lit(1536.0))).first()[0] == "1.5 KB"


def test_metrics(spark):
    df = spark.createDataFrame([("s", t, v) for t, v in ((0, 1.0), (1, 5.0), (2, 2.0), (3, 4.0))], "series string, ts int, value double")
    assert [r.delta for r in metrics.increases(df).orderBy("ts").collect()] == [0.0, 4.0, 2.0, 2.0]
    r = metrics.latency_summary(df, ["series"]).first()
    assert (r.n, r.p50, r.p99, r.min) == (4, 4.0, 5.0, 1.0)
    assert metrics.latency_summary(df.limit(1), ["series"]).first().stdev == 0.0
    assert df.groupBy("series").agg(metrics.index_percentile(0.5, "value").alias("p")).first().p == 4.0


def test_store(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "id int, p string, q string")
    assert rows_of(store.partial_update(old, spark.createDataFrame([(2, "z"), (9, "n")], "id int, p string"), "id").fillna("-")) == [(1, "a", "x"), (2, "z", "-")]
    assert rows_of(store.set_fields(old, F.col("q") == "x", p=None).fillna("-")) == [(1, "-", "x"), (2, "b", "-")]
    assert rows_of(store.delete(old, F.col("q") == "x").select("id")) == [(2,)]
    assert rows_of(store.upsert(old, spark.createDataFrame([(2, "n", "m"), (3, "o", "o")], old.schema), "id").select("id", "p")) == [(1, "a"), (2, "n"), (3, "o")]


def test_formatted_keeps_gigabytes_of_large_keys_as_its_sql(spark, tmp_path):
    import duckdb

    from lumenframe import catalog, catalog_more  # noqa: F401

    keys = [0, 1, 5, 150, 5000, 172388, 172389, 900000, 2**31]
    spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = sorted(tuple(r) for r in catalog.QUERIES["formatted"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    assert got == sorted(con.execute(catalog.ORACLES["formatted"]).fetchall()) and got[7][1].endswith(" GB")
    sizes = spark.createDataFrame([(2.0**45,), (2.0**52,), (None,)], "b double").select(S.format_bytes(F.col("b")).alias("s"))
    assert [r.s for r in sizes.collect()] == ["32.0 TB", "4.0 PB", spark.sql("select format_string('%.1f PB', cast(null as double)) s").first().s]


def test_outputs_of_one_anchor_keep_their_own_points(spark, tmp_path):
    import duckdb

    from lumenframe import catalog, catalog_more  # noqa: F401

    # Lines 2 and 5 of an order share the stride 32; these parts put them on one cell, both sure enough.
    sure = lambda p, s: (25 + (p * 7 + s * 13) % 75) >= 98
    at = lambda p, i: (p % 500 * 7919 + i * 104729) % 800
    pairs = [(p, q) for p in range(500) for q in range(500) if at(p, 2) == at(q, 5)][:6]
    supplier = lambda p: next(s for s in range(75) if sure(p, s))
    unsure = lambda p: next(s for s in range(75) if not sure(p, s))
    lines = []
    for order, (p, q) in enumerate(pairs):
        parts = [(1, unsure(1))] * 2 + [(p, supplier(p))] + [(1, unsure(1))] * 2 + [(q, supplier(q))]
        lines += [(order, a, s, i + 1, 10.0, 1.0, 0) for i, (a, s) in enumerate(parts)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate int").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = rows_of(catalog.QUERIES["decoded_faces"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    want = sorted(con.execute(catalog.ORACLES["decoded_faces"]).fetchall())
    assert len(want) == 2 * len(pairs) > 0 and got == want
    mark = lambda x: [float(x)] * 10
    two = spark.createDataFrame([("a", 8, 2000, 0.9, 1.0, 1.0, 1.0, 1.0, mark(1)), ("a", 8, 2000, 0.8, -5.0, 1.0, 9.0, 1.0, mark(2))], "image_id string, stride int, idx long, score double, left double, top double, right double, bottom double, kps array<double>")
    faces = {r.confidence: r.landmarks[0][0] for r in detect.decode_faces(two).collect()}
    assert len(faces) == 2 and faces[0.8] - faces[0.9] == 8.0
