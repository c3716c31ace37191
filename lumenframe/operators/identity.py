"""Identities: cluster faces by a similarity graph, list persons, edit assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import landmarks, ordinal_id, stable_id
from lumenframe.functions.vectors import cosine
from lumenframe.operators.dedup import similarity_edges
from lumenframe.plans.components import components_of


def cluster_faces(faces: DataFrame, threshold: float = 0.7, min_faces: int = 2, max_persons: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """``(face, component, size, person_id)``: components of raw cosine >= threshold; smaller ones than ``min_faces`` get no person.

    ``max_persons`` keeps the largest components (ties by smallest member).
    """
    comps = components_of(similarity_edges(faces, threshold, id_col, vec)).withColumnRenamed("node", "face")
    out = faces.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("face")).join(comps, "face", "left").withColumn("component", F.coalesce("component", "face"))
    sizes = out.groupBy("component").agg(F.count("*").alias("size"))
    big = sizes.where(F.col("size") >= min_faces)
    if max_persons is not None:
        big = big.orderBy(F.desc("size"), "component").limit(max_persons)
    named = big.select("component", stable_id("person_", F.col("component")).alias("person_id"))
    return out.join(sizes, "component").join(named, "component", "left").select("face", "component", "size", "person_id")


def cluster_summary(clustered: DataFrame) -> DataFrame:
    """persons_created, faces_assigned, singletons (faces in components that are too small)."""
    return clustered.agg(F.count_distinct("person_id").alias("persons_created"), F.count("person_id").alias("faces_assigned"), F.count_if(F.col("person_id").isNull()).alias("singletons"))


def list_persons(faces: DataFrame, limit: int = 100) -> DataFrame:
    """Persons by number of faces; reference face and name come from the most confident face (ties: smallest id)."""
    grouped = faces.where(F.col("person_id").isNotNull()).groupBy("person_id").agg(F.count("*").alias("face_count"), F.max("confidence").alias("top"))
    heads = faces.join(grouped, "person_id").where(F.col("confidence") == F.col("top")).groupBy("person_id").agg(F.min(F.struct("face_id", "person_name")).alias("ref"))
    out = grouped.join(heads, "person_id", "left").select("person_id", "face_count", F.col("ref.face_id").alias("reference_face_id"), F.col("ref.person_name").alias("person_name"))
    return out.orderBy(F.desc("face_count"), "person_id").limit(limit)


def person_faces(faces: DataFrame, person_id: str, limit: int = 1000) -> DataFrame:
    return faces.where(F.col("person_id") == person_id).orderBy(F.desc_nulls_last("confidence"), "face_id").limit(limit)


def verify(a, b, threshold: float = 0.6):
    """Columns ``similarity`` (raw cosine, 4 places) and ``is_match`` of two vectors."""
    raw = cosine(a, b)
    return F.round(raw, 4).alias("similarity"), (raw >= threshold).alias("is_match")


def reassign(faces: DataFrame, face_id: str, person_id: str) -> DataFrame:
    """Move a face; ``previous_person_id`` tells where it was. It stops being a reference."""
    hit = F.col("face_id") == face_id
    out = faces.withColumn("previous_person_id", F.when(hit, F.col("person_id")))
    return out.withColumn("is_reference", F.when(hit, False).otherwise(F.col("is_reference"))).withColumn("person_id", F.when(hit, person_id).otherwise(F.col("person_id")))


def merge_persons(faces: DataFrame, sources: list[str], target: str) -> DataFrame:
    """Faces of ``sources`` go to ``target``; ``merged_from`` keeps where they were."""
    hit = F.col("person_id").isin(*sources) & (F.col("person_id") != target)
    return faces.withColumn("merged_from", F.when(hit, F.col("person_id"))).withColumn("person_id", F.when(hit, target).otherwise(F.col("person_id")))


def rename_person(faces: DataFrame, person_id: str, name: str) -> DataFrame:
    return faces.withColumn("person_name", F.when(F.col("person_id") == person_id, name).otherwise(F.col("person_name")))


def delete_person(faces: DataFrame, person_id: str, dissolve: bool = False) -> DataFrame:
    """Drop the person's faces, or dissolve: each becomes a person of its own without a name."""
    hit = F.coalesce(F.col("person_id") == person_id, F.lit(False))
    if not dissolve:
        return faces.where(~hit)
    return faces.withColumn("person_name", F.when(~hit, F.col("person_name"))).withColumn("person_id", F.when(hit, F.concat(F.lit("person_"), F.col("face_id"))).otherwise(F.col("person_id")))


def identify(faces: DataFrame, known: DataFrame, top_k: int = 5, threshold: float = 0.6, id_col: str = "vec_id", vec: str = "embedding", **options) -> DataFrame:
    """1:N identification: ``query_id, person_id, score`` of each face's best match among the ``top_k`` nearest known faces; nulls below the threshold.

    ``known`` carries ``person_id``; faces without one are not candidates, as the filter comes before the top-k.
    """
    from lumenframe.operators.search import knn_blocks

    wanted = faces.select(F.col(id_col).alias("query_id"), F.col(vec).alias("query_vec"))
    near = knn_blocks(wanted, known, top_k, min_score=threshold, pre_filter=F.col("person_id").isNotNull(), item_id=id_col, item_vec=vec, columns=[id_col, "person_id"], **options)
    best = near.groupBy("query_id").agg(F.min_by(F.struct("person_id", "score"), "rank").alias("b"))
    return wanted.select("query_id").join(best, "query_id", "left").select("query_id", F.col("b.person_id").alias("person_id"), F.col("b.score").alias("score"))


def ingest_faces(images: DataFrame, pad: float = 0.1, cap: int = 128) -> DataFrame:
    """Face rows of ``images(image_id, width, height, face_boxes, face_embeddings, face_landmarks, face_scores, person_id)`` with their person.

    All faces of an image get its ``person_id``, or share a new person named by the image; the first face of a new person is the
    reference. Boxes are shares of the image; ``crop`` is the box in whole pixels, grown by ``pad`` on each side and
    clipped to the image. At most ``cap`` faces of an image count, those with a box and a vector.
    """
    n = F.least(F.size("face_boxes"), F.size("face_embeddings"), F.lit(cap))
    lists = [F.coalesce(F.col(c), F.array().cast(images.schema[c].dataType.simpleString())).alias(c) for c in ("face_boxes", "face_embeddings", "face_landmarks", "face_scores")]
    known = F.nullif(F.col("person_id"), F.lit(""))
    rows = images.select("image_id", "width", "height", known.alias("given"), *lists)
    zipped = F.slice(F.arrays_zip("face_boxes", "face_embeddings", "face_landmarks", "face_scores"), F.lit(1), n)
    rows = rows.select("image_id", "width", "height", "given", F.posexplode(zipped).alias("i", "f"))
    side = lambda k, of: (F.get("f.face_boxes", F.lit(k)) * F.col(of)).cast("int")
    rows = rows.select("*", side(0, "width").alias("x1"), side(1, "height").alias("y1"), side(2, "width").alias("x2"), side(3, "height").alias("y2"))
    wide, high = ((F.col("x2") - F.col("x1")) * pad).cast("int"), ((F.col("y2") - F.col("y1")) * pad).cast("int")
    crop = F.array(F.greatest(F.col("x1") - wide, F.lit(0)), F.greatest(F.col("y1") - high, F.lit(0)), F.least(F.col("x2") + wide, F.col("width")), F.least(F.col("y2") + high, F.col("height")))
    return rows.select(
        ordinal_id(F.col("image_id"), "face", F.col("i")).alias("face_id"), "image_id", F.col("f.face_embeddings").alias("embedding"), F.col("f.face_boxes").alias("box"), landmarks(F.col("f.face_landmarks")).alias("landmarks"),
        F.coalesce("f.face_scores", F.lit(0.0)).alias("confidence"), F.coalesce("given", stable_id("person_", F.col("image_id"))).alias("person_id"), ((F.col("i") == 0) & F.col("given").isNull()).alias("is_reference"), crop.alias("crop"),
    )
