"""Ingestion shuffles ids, hashes and places of records; whole records, with their vectors, are read where they lie."""

import pytest
from pyspark.sql import functions as F

from lumenframe import catalog_state
from lumenframe.operators import manifest
from lumenframe.plans.storage import materialize
from lumenframe.streaming import ingestion

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    """No adaptive plans, no join that is broadcast without a hint."""
    held = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffles(df):
    return sum("Exchange " in line and "BroadcastExchange" not in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_records_are_routed_without_a_shuffle(plain):
    images = ingestion.records(plain.createDataFrame([("a", [1.0])], "image_id string, global_embedding array<float>"))
    assert {name: shuffles(rows) for name, rows in ingestion.routed(images).items()} == dict.fromkeys(["global", "vehicles", "people", "faces", "ocr", "skipped"], 0)


def test_vectors_come_to_what_was_shuffled(plain):
    assert shuffles(catalog_state._records(plain, SF, 1)) == 3  # orders, lines and turns, as they lie in their tables


def test_only_the_place_of_a_record_is_judged(plain):
    images = ingestion.records(plain.createDataFrame([(f"i{k % 70}", f"h{k % 40}", [float(k % 3)]) for k in range(200)], "image_id string, imohash string, global_embedding array<float>"))
    staged = materialize(images.repartition(3), "batch")
    plan = ingestion.judged(staged, staged.where("image_id < 'i2'"))._jdf.queryExecution().executedPlan()
    widths, todo = [], [plan]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Exchange":
            widths.append(node.schema().simpleString())
    assert widths and not [w for w in widths if "array" in w]


@pytest.mark.parametrize("small", [True, False])
def test_marked_rows_are_those_of_their_places(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(ingestion, "broadcast_if_small", lambda df: df)
    staged = materialize(spark.range(5000).selectExpr("id", "array(id) v").repartition(3), "batch")
    wanted = "id % 7 = 0 or id between 1000 and 2100 or id % 512 = 63"
    found = ingestion.marks(staged.select("id", *ingestion._place()).where(wanted).drop("id"))
    got = ingestion.marked(staged, found)
    assert got.columns == ["id", "v"] and sorted(r.id for r in got.collect()) == [r.id for r in spark.range(5000).where(wanted).collect()]
    assert ingestion.marked(staged, ingestion.marks(staged.select(*ingestion._place()).limit(0))).isEmpty()


def test_a_known_hash_goes_before_a_known_id_and_neither_hides_a_new_image(spark, tmp_path):
    kind, root = "image_id string, imohash string, global_embedding array<float>", str(tmp_path / "t")
    v = [1.0]
    ingestion.ingest_batch(spark.createDataFrame([("a", "h1", v), ("b", "h2", v)], kind), root, "q", 0)
    rows = [("a", "h2", v), ("a0", "h1", v), ("b", "h9", v), ("c", "h9", v), ("d", "h9", v), ("e", "h8", None), ("f", "h8", v), ("g", None, v)]
    counts = ingestion.ingest_batch(spark.createDataFrame(rows, kind), root, "q", 1)
    assert [counts[c] for c in ("total", "processed", "duplicates", "rejected")] == [8, 3, 3, 2]
    assert sorted(r.image_id for r in manifest.table(spark, root, "global").where(F.col("imohash").isNull() | F.col("imohash").isin("h8", "h9")).collect()) == ["c", "f", "g"]
    assert {(r.image_id, r.reason) for r in manifest.table(spark, root, "quarantine").collect()} == {("b", "a known id"), ("e", "no vector")}


def test_what_goes_to_no_table_is_not_written(spark, tmp_path, monkeypatch):
    rows, staged = [("a", 3, [[0.1] * 4] * 3, [0.9] * 3, [0, 9, 2], [[1.0], [2.0], [3.0]], [1.0]), ("b", 2, [[0.1] * 4] * 2, [0.9] * 2, [None, 2], [[4.0]], [2.0]), ("c", 1, [[0.1] * 4], [0.9], None, [[5.0]], [3.0]), ("d", 1, [[0.1] * 4], [0.9], [2], None, [4.0])], []
    right = ingestion.materialize
    monkeypatch.setattr(ingestion, "materialize", lambda df, tag: (staged.extend(df.select("image_id", "box_embeddings").collect() if tag == "batch" else []), right(df, tag))[1])
    batch = spark.createDataFrame(rows, "image_id string, num_dets int, boxes array<array<float>>, scores array<float>, classes array<int>, box_embeddings array<array<float>>, global_embedding array<float>")
    counts = ingestion.ingest_batch(batch, str(tmp_path / "t"), "q", 0)
    assert [counts[c] for c in ("total", "processed", "vehicles", "people", "skipped")] == [4, 4, 3, 1, 3]
    assert {r.image_id: r.box_embeddings for r in staged} == {"a": [[1.0], None, [3.0]], "b": [None, None], "c": None, "d": None}
    assert {(r.detection_id, r.embedding and r.embedding[0]) for r in manifest.table(spark, str(tmp_path / "t"), "vehicles").collect()} == {("a_box_2", 3.0), ("b_box_1", None), ("d_box_0", None)}
