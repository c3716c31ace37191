"""Ingestion: explode an image's detections, faces and text lines to rows, route them, count them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.geometry import inverse_letterbox, letterbox
from lumenframe.functions.scalars import category, class_name, detector_class, landmarks, ordinal_id


def zip_shortest(*arrays: Column) -> Column:
    """``arrays_zip`` cut to the shortest input."""
    n = F.least(*(F.size(a) for a in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    return F.slice(F.arrays_zip(*arrays), F.lit(1), F.greatest(n, F.lit(0)))


def explode_detections(images: DataFrame, vectors: str | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """``image_id, box_index, category, detection_id, class_name`` and the box of each detection of padded arrays.

    ``images(image_id, num_dets, boxes, scores, classes)``: the first ``num_dets`` count, rows without score are padding.
    ``vectors`` names a column of the boxes' vectors, given as ``embedding``; ``beside`` columns of the image that its rows keep.
    """
    zipped = F.slice(F.arrays_zip("boxes", "scores", "classes", *([vectors] if vectors else [])), F.lit(1), F.col("num_dets"))
    flat = images.select("image_id", *beside, F.posexplode(zipped).alias("box_index", "d")).where("d.scores > 0")
    out = flat.select("image_id", *beside, "box_index", F.col("d.boxes").alias("box"), F.col("d.scores").alias("confidence"), F.col("d.classes").alias("class_id"), *([F.col(f"d.{vectors}").alias("embedding")] if vectors else []))
    return out.withColumn("category", category(F.col("class_id"))).withColumn("class_name", class_name(F.col("class_id"))).withColumn("detection_id", ordinal_id(F.col("image_id"), "box", F.col("box_index")))


def route(detections: DataFrame) -> dict[str, DataFrame]:
    """One plan, three branches: ``people``, ``vehicles`` and ``skipped``."""
    d = detections.withColumn("category", category(F.col("class_id")))
    return {"people": d.where("category = 'person'"), "vehicles": d.where("category = 'vehicle'"), "skipped": d.where("category = 'other'")}


def nth_of_category(detections: DataFrame, kind: str, n: int) -> DataFrame:
    """The n-th (from 0) detection of a category in each image."""
    order = W.partitionBy("image_id").orderBy("box_index")
    d = detections.where(category(F.col("class_id")) == kind)
    return d.withColumn("_n", F.row_number().over(order) - 1).where(F.col("_n") == n).drop("_n")


def explode_ocr(images: DataFrame, min_det: float | None = None, min_rec: float | None = None, beside: Sequence[str] = ()) -> DataFrame:
    """Text rows: arrays are zipped to the shortest, blank text is left out but keeps its ordinal in the id; ``beside`` as in :func:`explode_detections`."""
    z = zip_shortest(F.col("texts"), F.col("boxes"), F.col("det_scores"), F.col("rec_scores"))
    flat = images.select("image_id", *beside, F.posexplode(z).alias("i", "t")).where(F.trim("t.texts") != "")
    out = flat.select(ordinal_id(F.col("image_id"), "ocr", F.col("i")).alias("ocr_id"), "image_id", *beside, F.col("t.texts").alias("text"), F.col("t.boxes").alias("box"), F.col("t.det_scores").alias("det_score"), F.col("t.rec_scores").alias("rec_score"))
    if min_det is not None:
        out = out.where(F.col("det_score") >= min_det)
    return out if min_rec is None else out.where(F.col("rec_score") >= min_rec)


def explode_faces(images: DataFrame) -> DataFrame:
    """Face rows with named landmarks; embeddings and faces are zipped to the shortest."""
    z = zip_shortest(F.col("face_boxes"), F.col("face_landmarks"), F.col("face_scores"), F.col("face_embeddings"))
    flat = images.select("image_id", F.posexplode(z).alias("i", "f"))
    return flat.select(ordinal_id(F.col("image_id"), "face", F.col("i")).alias("face_id"), "image_id", F.col("f.face_boxes").alias("box"), landmarks(F.col("f.face_landmarks")).alias("landmarks"), F.col("f.face_scores").alias("confidence"), F.col("f.face_embeddings").alias("embedding"))


def counters(detections: DataFrame) -> DataFrame:
    """people, vehicles, skipped and images of a routed batch."""
    c = category(F.col("class_id"))
    return detections.agg(F.count_distinct("image_id").alias("images"), F.count_if(c == "person").alias("people"), F.count_if(c == "vehicle").alias("vehicles"), F.count_if(c == "other").alias("skipped"))


def batch_status(processed: Column, errors: Column) -> Column:
    return F.when((errors > 0) & (processed > 0), "partial").when(errors > 0, "error").otherwise("success")


def image_summary(images: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Rows of each child table by image, ``num_detections`` and the tables that hold it; children are counted before they are joined."""
    out = images.select("image_id")
    for name, child in children.items():
        out = out.join(child.groupBy("image_id").agg(F.count("*").alias(name)), "image_id", "left")
    out = out.select("image_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in children))
    present = F.filter(F.array(F.lit("global"), *(F.when(F.col(n) > 0, n) for n in children)), lambda x: x.isNotNull())
    total = F.col("vehicles") + F.col("people") if {"vehicles", "people"} <= children.keys() else F.lit(0)
    return out.withColumn("num_detections", total).withColumn("indexed_in", present)


def bulk(rows: DataFrame, key: str, faults: Column, most: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(written, quarantine, report)``: rows without a fault, the others with ``reason``, and one row of counts with the first ``most`` errors by key."""
    judged = rows.withColumn("reason", faults)
    bad = judged.where(F.col("reason").isNotNull())
    first = bad.orderBy(key).limit(most).agg(F.array_sort(F.collect_list(F.concat_ws(": ", F.coalesce(F.col(key).cast("string"), F.lit("null")), "reason"))).alias("errors"))
    report = judged.agg(F.count_if(F.col("reason").isNull()).alias("written"), F.count("reason").alias("failed")).join(F.broadcast(first))  # one row
    return judged.where(F.col("reason").isNull()).drop("reason"), bad, report


def formatted_detections(detections: DataFrame, images: DataFrame, size: int = 640) -> DataFrame:
    """``image_id, box_index, detection``: a struct with the box as shares of the original image, confidence, class id and name.

    ``detections`` are in the letterboxed image, as shares or, if any of an image's is over 1, in pixels.
    """
    pixels = F.max(F.greatest("x1", "y1", "x2", "y2")).over(W.partitionBy("image_id")) > 1
    rows = detections.withColumn("_px", pixels).join(images.select("image_id", "width", "height"), "image_id")
    p = letterbox(F.col("width"), F.col("height"), size)
    back = lambda c, axis, side: inverse_letterbox(F.col(c), p[f"pad_{axis}"], p["scale"], F.col(side), F.col("_px"), size).alias(c)
    box = back("x1", "x", "width"), back("y1", "y", "height"), back("x2", "x", "width"), back("y2", "y", "height")
    return rows.select("image_id", "box_index", F.struct(*box, "confidence", "class_id", detector_class(F.col("class_id")).alias("class_name")).alias("detection"))


def image_texts(ocr: DataFrame, image_id: str, most: int = 1000) -> DataFrame:
    """Text rows of an image, surest detection first (missing last), at most ``most``."""
    return ocr.where(F.col("image_id") == image_id).orderBy(F.desc_nulls_last("det_score"), "ocr_id").limit(most)


def with_results(batch: DataFrame, results: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """A batch's rows with the results of those that were processed, matched by their place in the batch; others have nulls.

    Filters in between may drop and reorder rows: the ordinal, not the position, says whose result it is.
    """
    return batch.join(results, ordinal, "left")
