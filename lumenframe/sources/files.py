"""File sources: image directories, JPEG headers, JSON metadata, dictionaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Image file endings.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "tif")


def scan_directory(spark: SparkSession, path: str, recursive: bool = True, max_images: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(images, skipped)``: files by ending, case-insensitive; ids are paths below ``path``; skipped endings, distinct.

    ``max_images`` takes the first by path.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = reader.load(path).withColumn("ext", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)))
    base = path.rstrip("/").split("://")[-1]
    image_id = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), f"^{base}/", "")
    images = files.where(F.col("ext").isin(*EXTENSIONS)).select(image_id.alias("image_id"), F.col("path").alias("image_path"), "length", "content")
    skipped = files.where(~F.col("ext").isin(*EXTENSIONS)).select("ext").distinct()
    return (images if max_images is None else images.orderBy("image_path").limit(max_images)), skipped


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from the frame header; None if there is none."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xC0, 0xC1, 0xC2):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        at += 2 if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8 else 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def with_jpeg_size(images: DataFrame, content: str = "content") -> DataFrame:
    """``image_id, width, height``; nulls where the content isn't JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [jpeg_size(c.as_py() or b"") or (None, None) for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], ["image_id", "width", "height"])

    return images.select("image_id", content).mapInArrow(run, "image_id string, width int, height int")


def json_object(column: Column) -> Column:
    """A JSON object as map<string, string>; null if it isn't an object."""
    return F.when(F.trim(column).startswith("{"), F.from_json(column, "map<string,string>"))


def read_dictionary(spark: SparkSession, path: str) -> list[str]:
    """One token a line; the blank at 0 is implied and a space is added at the end. A vocabulary file, bounded by its alphabet."""
    return [r.value for r in spark.read.text(path).collect()] + [" "]
