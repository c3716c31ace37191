import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe import catalog, catalog_faces, catalog_index, catalog_pixels  # noqa: F401
from lumenframe.functions import keys
from lumenframe.operators import identity, ingest

SF = "/root/testdata/sf0.001"
MODULES = ("lumenframe.catalog_faces", "lumenframe.catalog_pixels", "lumenframe.catalog_index")


@pytest.mark.parametrize("name", [n for n, f in catalog.QUERIES.items() if f.__module__ in MODULES and n in catalog.ORACLES])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    want = db.execute(catalog.ORACLES[name]).df()
    got = catalog.QUERIES[name](spark, SF).toPandas()
    cell = lambda v: "null" if v is None or v != v else f"{float(v) + 0.0:.5f}" if isinstance(v, (int, float, np.number)) else str(v)
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and (len(got) or name == "nth_face_search")  # too few images there


def test_content_keys():
    # Published values: the hash of a word, and its key, whose first byte is the size.
    assert keys.murmur128(b"hello") == (0xCBD8A7B341BD9B02, 0x5B1E906A48AE1D19)
    assert keys.murmur128(b"") == (0, 0) and keys.content_key(b"") == "00" * 16
    assert keys.content_key(b"hello") == "05d8a7b341bd9b025b1e906a48ae1d19"
    data = bytes(range(256)) * 600
    parts = data[: 16 << 10] + data[len(data) // 2 :][: 16 << 10] + data[-(16 << 10) :]
    h1, h2 = keys.murmur128(parts)
    assert keys.content_key(data)[6:] == f"{h1:016x}{h2:016x}"[6:] and bytes.fromhex(keys.content_key(data))[:3] == bytes([0x80, 0xB0, 0x09])
    other = bytearray(data)
    other[20_000] ^= 1  # between the samples
    assert keys.content_key(bytes(other)) == keys.content_key(data) != keys.content_key(data + b"x")


def test_content_keys_of_rows(spark):
    rows = spark.createDataFrame([(1, b"hello", "x"), (2, None, "x"), (3, b"", "x")], "id long, content binary, other string")
    got = {r.id: r.imohash for r in keys.with_content_key(rows).collect()}
    assert got == {1: keys.content_key(b"hello"), 2: None, 3: "00" * 16}
    pages = {r.page_id: r.html.encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    sizes = [len(p) >= 8192 for p in pages.values()]
    assert {r.page_id: r.imohash for r in catalog.QUERIES["content_keys"](spark, SF).collect()} == {i: keys.content_key(p, 512, 8192) for i, p in pages.items()} and len(sizes)


def test_faces_without_boxes_or_vectors(spark):
    schema = "image_id string, width int, height int, face_boxes array<array<double>>, face_embeddings array<array<float>>, face_landmarks array<array<double>>, face_scores array<double>, person_id string"
    rows = [("a", 100, 50, [[0.0, 0.0, 0.5, 1.0], [0.9, 0.9, 1.0, 1.0]], [[1.0], [2.0], [3.0]], None, None, None), ("b", 10, 10, None, [[1.0]], None, None, "p"), ("c", 10, 10, [[0.0] * 4], [[1.0]], [[1.0] * 10], [0.5], "p")]
    got = {r.face_id: r for r in identity.ingest_faces(spark.createDataFrame(rows, schema)).collect()}
    assert got.keys() == {"a_face_0", "a_face_1", "c_face_0"}
    assert got["a_face_0"].crop == [0, 0, 55, 50] and got["a_face_1"].crop == [89, 45, 100, 50] and got["a_face_0"].person_id == got["a_face_1"].person_id
    assert got["a_face_0"].is_reference and not got["a_face_1"].is_reference and not got["c_face_0"].is_reference and got["c_face_0"].person_id == "p"


def test_bulk_writes_quarantine_the_rest(spark):
    written, bad, report = ingest.bulk(spark.range(30), "id", F.when(F.col("id") % 2 == 0, "odd"))
    assert written.count() == 15 and bad.count() == 15 and len(report.first().errors) == 10
    none = ingest.bulk(spark.range(0), "id", F.lit(None).cast("string"))[2].first()
    assert (none.written, none.failed, none.errors) == (0, 0, [])
