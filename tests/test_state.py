"""State that is kept from batch to batch: commits of several tables, ingestion, deferred groups, maintenance."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import catalog, catalog_state  # noqa: F401
from lumenframe.operators import cluster, manifest, store
from lumenframe.operators.dedup import similarity_edges
from lumenframe.plans import storage
from lumenframe.plans.components import connected_components
from lumenframe.streaming import flows, ingestion, maintenance

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ == "lumenframe.catalog_state"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = db.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    cell = lambda v: "null" if v is None or v != v else f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) else str(v)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def numbers(spark, n, column="x"):
    return spark.range(n).toDF(column)


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "r")
    assert manifest.read(spark, root) == manifest.Manifest()
    first = manifest.publish(spark, root, add={"a": numbers(spark, 3), "b": numbers(spark, 1)}, writer=("w", 0))
    broken = numbers(spark, 2).select(F.raise_error(F.lit("killed")).cast("long").alias("x"))
    with pytest.raises(Exception, match="killed"):  # dies between its two tables
        manifest.publish(spark, root, add={"a": numbers(spark, 5), "b": broken}, writer=("w", 1))
    assert manifest.read(spark, root) == first and manifest.table(spark, root, "a").count() == 3
    assert manifest.publish(spark, root, add={"a": broken}, writer=("w", 0)) == first  # known: not even looked at
    second = manifest.publish(spark, root, add={"a": numbers(spark, 5), "b": numbers(spark, 2)}, writer=("w", 1))
    assert (second.number, manifest.table(spark, root, "a").count(), manifest.table(spark, root, "b").count()) == (2, 8, 3)
    assert manifest.table(spark, root, "a", since=1).count() == 5 and manifest.table(spark, root, "a", manifest.read(spark, root, 1)).count() == 3
    third = manifest.compact(spark, root, "a")
    assert len(third.folders["a"]) == 1 and manifest.table(spark, root, "a").count() == 8 and third.epochs == {"w": 1}


def test_the_second_of_two_writers_changes_nothing(spark, tmp_path):
    root = str(tmp_path / "r")
    store.commit(numbers(spark, 2), root)
    base = manifest.read(spark, root)  # both read this one
    manifest.publish(spark, root, replace={"rows": numbers(spark, 5)}, base=base)
    with pytest.raises(manifest.Conflict):
        manifest.publish(spark, root, replace={"rows": spark.range(100, 103).toDF("x")}, base=base)
    assert sorted(r.x for r in store.snapshot(spark, root).collect()) == [0, 1, 2, 3, 4] and store.current(spark, root) == 2


def test_a_commit_that_was_not_finished_is_not_seen(spark, tmp_path):
    root = str(tmp_path / "r")
    store.commit(numbers(spark, 2), root)
    (tmp_path / "r" / "_commits" / f"{2:012d}.json").write_text('{"number": 2, "fol')
    assert store.current(spark, root) == 1 and store.snapshot(spark, root).count() == 2
    with pytest.raises(manifest.Conflict):
        store.commit(numbers(spark, 9), root)
    assert manifest.abandon(spark, root) == [2] and store.commit(numbers(spark, 9), root) == 2


def test_models_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "m")
    with pytest.raises(ValueError):
        cluster.load_model(spark, root)
    for k in (2, 3):
        cluster.save_model(spark.createDataFrame([(i, [1.0, 0.0]) for i in range(k)], "cluster_id int, centroid array<double>"), root, "faces", 7)
    cluster.save_model(spark.createDataFrame([(0, [1.0])], "cluster_id int, centroid array<double>"), root, "people")
    assert cluster.load_model(spark, root, "faces").count() == 3 and {r.index_name for r in cluster.load_model(spark, root).collect()} == {"faces", "people"}


def test_scratch_of_other_applications_stays(spark):
    mine = storage.scratch_path(spark, "t")
    other = f"{storage.shared_dir(spark)}/lumenframe/another-application"
    numbers(spark, 1).write.parquet(mine)
    numbers(spark, 1).write.parquet(other)
    storage.drop_scratch(spark)
    assert spark.read.parquet(other).count() == 1 and not os.path.exists(mine.removeprefix("file:"))


V = [1.0, 0.5]


def image(image_id, h, v=V, **more):
    row = {"image_id": image_id, "imohash": h, "global_embedding": v, "num_dets": 0} | more
    return tuple(row.get(c) for c in ingestion.RECORD)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} {k}" for c, k in ingestion.RECORD.items()))


def test_fates_of_images(spark, tmp_path):
    root = str(tmp_path / "r")
    rich = dict(num_dets=3, boxes=[[0.0] * 4] * 5, scores=[0.9, 0.8, 0.7, 0.9, 0.0], classes=[0, 2, 9, 0, 0], box_embeddings=[[1.0, 0.0]] * 3, face_boxes=[[0.1] * 4] * 2, face_embeddings=[V, V, V], face_landmarks=[[float(i) for i in range(10)]], texts=["a", "  ", "b"], text_boxes=[[0.0]] * 3, det_scores=[0.5] * 3, rec_scores=[0.5] * 3)
    first = batch(spark, image("b", "h1"), image("a", "h1"), image(None, "h2"), image("", "h3"), image("c", "h4", None), image("d", "h5", [0.0, 0.0]), image("e", "h6", [float("nan"), 1.0]), image("f", None), image("g", None), image("g", "h7"), image("z", "h8", **rich))
    counts = ingestion.ingest_batch(first, root, "q", 0)
    assert (counts["total"], counts["processed"], counts["duplicates"], counts["rejected"]) == (11, 4, 1, 6)
    assert (counts["people"], counts["vehicles"], counts["skipped"], counts["faces"], counts["texts"]) == (1, 1, 1, 2, 2)
    t = lambda name: manifest.table(spark, root, name)
    assert sorted(r.image_id for r in t("global").collect()) == ["a", "f", "g", "z"]
    assert {(r.image_id, r.reason) for r in t("quarantine").collect()} == {(None, "no id"), ("", "no id"), ("c", "no vector"), ("d", "a zero vector"), ("e", "a vector that is not numbers"), ("g", "a repeated id")}
    faces = {r.face_id: r for r in t("faces").collect()}
    assert faces["z_face_0"].landmarks.nose == [4.0, 5.0] and faces["z_face_1"].landmarks is None and faces["z_face_1"].confidence == 0.0
    assert {(r.ocr_id, r.text, r.full_text) for r in t("ocr").collect()} == {("z_ocr_0", "a", "a b"), ("z_ocr_2", "b", "a b")}
    assert t("vehicles").first().class_name == "car" and t("vehicles").first().embedding == [1.0, 0.0]
    before = manifest.read(spark, root)
    assert ingestion.ingest_batch(first, root, "q", 0) is None and manifest.read(spark, root) == before  # sent twice
    again = ingestion.ingest_batch(first, root, "other", 0)  # as a new batch: all known
    assert again["processed"] == 0 and again["duplicates"] == 4 and t("global").count() == 4
    assert ingestion.ingest_batch(batch(spark, image("a", "new")), root, "q", 1)["rejected"] == 1  # a known id
    assert ingestion.ingest_batch(first.limit(0), root, "q", 2)["total"] == 0


def test_a_batch_is_judged_again_after_another_writer(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "r")
    ingestion.ingest_batch(batch(spark, image("a", "h1")), root, "one", 0)
    right = manifest.publish
    raced = []

    def race(*args, **options):
        if not raced:
            raced.append(1)
            right(spark, root, add={"global": manifest.table(spark, root, "global").withColumn("image_id", F.lit("b")).withColumn("imohash", F.lit("h2"))})
        return right(*args, **options)

    monkeypatch.setattr(manifest, "publish", race)
    counts = ingestion.ingest_batch(batch(spark, image("x", "h2"), image("y", "h3")), root, "two", 0)
    assert counts["processed"] == 1 and counts["duplicates"] == 1 and manifest.table(spark, root, "global").count() == 3


def test_groups_equal_the_offline_ones_after_every_delivery(spark, tmp_path):
    root = str(tmp_path / "r")
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 300").select(F.concat(F.lit("i"), F.col("vec_id")).alias("image_id"), F.col("embedding").alias("global_embedding"), (F.col("vec_id") * 7 % 4).alias("k"))
    assert ingestion.group_new(spark, root, 0.35) == 0
    for k in range(4):
        ingestion.ingest_batch(e.where(F.col("k") == k), root, "q", k)
        done = ingestion.group_new(spark, root, 0.35)
        assert ingestion.group_new(spark, root, 0.35) == done  # nothing new
        want = connected_components(similarity_edges(e.where(F.col("k") <= k), 0.35, "image_id", "global_embedding"))
        got = {(r.image_id, r.component) for r in ingestion.groups(spark, root).collect()}
        assert got == {(r.node, r.component) for r in want.collect()} and got


def test_only_pairs_with_a_fresh_row_are_sought(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumn("new", F.col("vec_id") % 5 == 0)
    every = {(r.a, r.b) for r in similarity_edges(e, 0.35).collect()}
    fresh = {(r.a, r.b) for r in similarity_edges(e, 0.35, fresh="new").collect()}
    assert fresh == {(a, b) for a, b in every if a % 5 == 0 or b % 5 == 0} and fresh != every


def test_maintenance_does_not_depend_on_the_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows, inbox = [], str(tmp_path / "in")
    before = maintenance.with_state_store(spark)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    try:
        cuts = [0.0, 0.2, 0.55, 1.0]
        edges = events.select(F.unix_micros("ts").alias("t")).approxQuantile("t", cuts[1:-1], 0.0)
        micros = F.unix_micros("ts")
        for low, high in zip([-1, *edges], [*edges, 1 << 62]):  # a run for each: what it knows comes from the checkpoint
            events.where((micros > low) & (micros <= high)).coalesce(1).write.mode("append").parquet(inbox)
            stream = spark.readStream.schema(events.schema).parquet(inbox)
            query = maintenance.due_events(stream, index="event_type").writeStream.foreachBatch(lambda df, _: rows.extend(df.collect()) and None).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
        whole = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(inbox)
        once = flows.run_to_table(spark, maintenance.due_events(whole, index="event_type"), "due", "append").collect()
    finally:
        maintenance.restore_state_store(spark, before)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, once), key=str) and len(rows) > 20


def test_due_tables_are_retrained_in_one_commit(spark, tmp_path):
    root = str(tmp_path / "r")
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.concat(F.lit("i"), F.col("vec_id")).alias("image_id"), F.col("embedding").alias("global_embedding"), "vec_id")
    ingestion.ingest_batch(e.where("vec_id < 200"), root, "q", 0)
    run = lambda **o: {r.index_name: (r.reason, r.action) for r in maintenance.retrain_due(spark, root, n_clusters=4, **o).collect()}
    empty = {n: ("empty", "none") for n in ("faces", "people", "vehicles")}
    assert run() == empty | {"global": ("not_trained", "trained")}
    now = manifest.read(spark, root)
    assert manifest.table(spark, root, "model_global").first().trained_on == 200 and {r.cluster_id is None for r in manifest.table(spark, root, "global").collect()} == {False}
    assert run(names=["global"])["global"][1] == "none" and manifest.read(spark, root) == now
    ingestion.ingest_batch(e.where("vec_id >= 200"), root, "q", 1)
    rows = manifest.table(spark, root, "global")
    assert rows.where("cluster_id is null").isEmpty()  # new images get the clusters of the model that stands
    assert run(names=["global"], hours_since={"global": 1.0})["global"] == ("growth", "waiting")
    assert run(names=["global"])["global"] == ("growth", "rebalanced")
    model = {r.cluster_id: np.array(r.centroid) for r in manifest.table(spark, root, "model_global").collect()}
    for r in manifest.table(spark, root, "global").collect():
        v = np.array(r.global_embedding, float)
        assert abs((v @ model[r.cluster_id]) / np.linalg.norm(v) - max(v @ c / np.linalg.norm(v) for c in model.values())) < 1e-6


def test_a_batch_leaves_nothing_beside_its_tables(spark, tmp_path):
    from pathlib import Path

    from lumenframe.plans.storage import scratch_path

    own = Path(scratch_path(spark, "x")).parent
    before = set(own.glob("*")) if own.exists() else set()
    batch = spark.createDataFrame([("a", "h1", [1.0, 0.0]), ("b", "h1", [1.0, 0.0]), ("c", "h2", None)], "image_id string, imohash string, global_embedding array<float>")
    counts = ingestion.ingest_batch(batch, str(tmp_path / "t"), "q", 0)
    assert (counts["total"], counts["processed"], counts["duplicates"], counts["rejected"]) == (3, 1, 1, 1)
    assert [tuple(r)[1:6] for r in manifest.table(spark, str(tmp_path / "t"), "log").collect()] == [(0, 3, 1, 1, 1)]
    assert [r.image_id for r in manifest.table(spark, str(tmp_path / "t"), "global").collect()] == ["a"]
    assert set(own.glob("*")) == before
