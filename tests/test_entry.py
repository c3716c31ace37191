import importlib
import sys

import pytest
from pyspark.sql import functions as F

from lumenframe.sources import files
from lumenframe.streaming import flows

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "vec_id", "score", "rank"] and df.count() == 100  # ten queries: the ids divisible by 50


def test_every_oracle_has_a_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    for gone in ("corpus_pipeline", "lumenframe.llm", "lumenframe.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "knn_search" in entry.queries() and not any(k.startswith("op") or k == "pipeline" for k in entry.queries())
    sys.modules.pop("__spark_entry__")


def test_directory_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.JPG", "sub/b.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    images, skipped = files.scan_directory(spark, str(tmp_path))
    assert sorted(r.image_id for r in images.collect()) == ["a.JPG", "sub/b.png"]
    assert [r.ext for r in skipped.collect()] == ["txt"]


def test_jpeg_header():
    data = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x01\x02\x03\x04\x03" + b"\0" * 12
    assert files.jpeg_size(data) == (0x0304, 0x0102)
    assert files.jpeg_size(b"no") is None and files.jpeg_size(b"\xff\xd8\xff\xd9") is None


def test_stream_equals_batch(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    got = flows.run_to_table(spark, flows.windowed_counts(stream), "t_windows")
    want = flows.windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp")))
    key = lambda df: sorted((r.window_start, r.event_type, r.n) for r in df.collect())
    assert key(got) == key(want)


def test_ingest_stream_runs_batches(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    seen = []
    flows.ingest(stream, lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "ck"), "t_ingest").awaitTermination()
    assert sum(seen) == 1000


@pytest.mark.parametrize("text,want", [('{"k": 3}', {"k": "3"}), ("[1]", None), (None, None)])
def test_json_object(spark, text, want):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(files.json_object(F.col("j"))).first()[0] == want
