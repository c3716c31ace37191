"""Ingestion of analysed images into the five tables, batch by batch, each batch once; and the pass that was put off.

A batch is read once. Images without an id or a usable vector, and known ids, go to ``quarantine`` with a reason; images
whose content is known, or stands earlier in the batch, count as duplicates. What is left is routed to ``global``,
``vehicles``, ``people``, ``faces`` and ``ocr``, gets its clusters where an index has a model, and is committed with the
quarantine and a row of counts in one step (:mod:`~lumenframe.operators.manifest`). A batch that comes again under the
same query name and epoch changes nothing.

Near-duplicate groups are the deferred part: a second query takes what was committed since its last run, looks for links
of the new images with all, and adds them to the components that stand. It keeps the component that each image entered
with (``group_labels``) and a log of what components became (``group_roots``); new links meet both by joins, and only
components that they touch are contracted. The result equals components over all links after every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions.scalars import category, default_path, landmarks, ordinal_id, stable_id
from lumenframe.operators import cluster, ingest, manifest
from lumenframe.operators.dedup import similarity_edges
from lumenframe.plans.components import components_of
from lumenframe.plans.storage import broadcast_if_small, drop_table, materialize
from lumenframe.schema import TABLES

_VEC = "array<float>"
#: What the analysis of an image gives; missing columns are taken as null.
RECORD = {
    "image_id": "string", "image_path": "string", "width": "int", "height": "int", "imohash": "string", "file_size_bytes": "long", "global_embedding": _VEC, "metadata": "map<string,string>", "indexed_at": "timestamp",
    "num_dets": "int", "boxes": f"array<{_VEC}>", "scores": _VEC, "classes": "array<int>", "box_embeddings": f"array<{_VEC}>",
    "face_boxes": f"array<{_VEC}>", "face_landmarks": f"array<{_VEC}>", "face_scores": _VEC, "face_embeddings": f"array<{_VEC}>", "face_quality": _VEC,
    "texts": "array<string>", "text_boxes": f"array<{_VEC}>", "det_scores": _VEC, "rec_scores": _VEC,
}
COUNTS = "query string, epoch long, total long, processed long, duplicates long, rejected long, vehicles long, people long, skipped long, faces long, texts long"
QUARANTINE = "image_id string, image_path string, reason string"
#: Rows that one entry of :func:`marks` stands for.
BLOCK = 512


def records(images: DataFrame) -> DataFrame:
    return images.select(*((F.col(c) if c in images.columns else F.lit(None)).cast(kind).alias(c) for c, kind in RECORD.items()))


def kept_vectors(rows: DataFrame) -> DataFrame:
    """Records without the vectors of detections of no kept class: these are counted, and go to no table."""
    return rows.withColumn("box_embeddings", F.zip_with("box_embeddings", "classes", lambda v, c: F.when(category(c) != "other", v)))


def _fault() -> Column:
    """Why an image can't be taken; null if it can."""
    v = F.col("global_embedding")
    return (
        F.when(F.col("image_id").isNull() | (F.trim("image_id") == ""), "no id").when(v.isNull() | (F.size(v) == 0), "no vector")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x)), "a vector that is not numbers").when(~F.exists(v, lambda x: x != 0), "a zero vector")
    )


def _place() -> list[Column]:
    """Where a row of a staged table lies: its file, whose name none of the table's others has, and its number there."""
    return [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]


def _shaped(rows: DataFrame, name: str, model: DataFrame | None) -> DataFrame:
    """``rows`` as a table's columns, with their clusters."""
    if name in cluster.CLUSTERED:
        vec = cluster.CLUSTERED[name][1]
        at = cluster.nearest(model, F.col(vec)) if model is not None else F.lit(None).cast("struct<cluster_id: int, cluster_distance: double>")
        rows = rows.withColumn("_at", at)
        rows = rows.withColumn("cluster_id", F.col("_at.cluster_id")).withColumn("cluster_distance", F.col("_at.cluster_distance"))
        rows = rows.withColumn("clustered_at", F.when(F.col("cluster_id").isNotNull(), F.col("indexed_at")))
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType.simpleString()).alias(f.name) for f in TABLES[name].fields))


def routed(images: DataFrame, models: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The rows of each of the five tables that clean records give, and ``skipped``: detections of no kept class."""
    models = models or {}
    lists = [c for c, kind in RECORD.items() if kind.startswith("array") and c != "global_embedding"]
    images = images.select(*(F.coalesce(F.col(c), F.array().cast(RECORD[c])).alias(c) if c in lists else F.col(c) for c in images.columns))
    images = images.withColumn("image_path", default_path(F.col("image_path"), F.col("image_id")))
    shared = ["image_path", "metadata", "indexed_at"]  # they come along when an image is exploded
    some = images.where("num_dets > 0")
    kinds = ingest.route(ingest.explode_detections(some, "box_embeddings", shared).withColumn("has_face", F.lit(False)))
    skipped = ingest.route(ingest.explode_detections(some))["skipped"]  # counted without their vectors
    both = F.slice(F.arrays_zip("face_embeddings", "face_boxes", "face_landmarks", "face_scores", "face_quality"), F.lit(1), F.least(F.size("face_embeddings"), F.size("face_boxes")))
    faces = images.select("image_id", *shared, F.posexplode(both).alias("i", "f")).where(F.size("f.face_embeddings") > 0)
    faces = faces.select(
        "image_id", *shared, ordinal_id(F.col("image_id"), "face", F.col("i")).alias("face_id"), F.col("f.face_embeddings").alias("embedding"), F.col("f.face_boxes").alias("box"), landmarks(F.col("f.face_landmarks")).alias("landmarks"),
        F.coalesce("f.face_scores", F.lit(0.0)).alias("confidence"), F.coalesce("f.face_quality", F.lit(0.0)).alias("quality_score"),
    )
    text = images.select("image_id", *shared, "texts", F.col("text_boxes").alias("boxes"), "det_scores", "rec_scores", F.array_join(F.filter("texts", lambda t: F.trim(t) != ""), " ").alias("full_text"))
    ocr = ingest.explode_ocr(text, beside=[*shared, "full_text"]).withColumn("text_raw", F.col("text"))
    rows = {"global": images, "vehicles": kinds["vehicles"], "people": kinds["people"], "faces": faces, "ocr": ocr}
    return {name: _shaped(r, name, models.get(name)) for name, r in rows.items()} | {"skipped": skipped}


def judged(staged: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``image_id, image_path, file, row, fate`` of each record of a staged table: ``new``, ``duplicate``, or the reason why it is rejected.

    ``known`` has ``image_id`` and ``imohash`` of what is indexed. Of equal contents in a batch the smallest id is taken;
    of equal ids the one with the smallest hash. An unknown content (null hash) duplicates nothing. A record's vectors are
    looked at where it lies; what is shuffled is its id, its hash and its place.
    """
    rows = staged.select("image_id", "image_path", "imohash", _fault().alias("fate"), F.xxhash64("global_embedding").alias("_v"), *_place())
    good = F.col("fate").isNull()
    one = W.partitionBy("image_id").orderBy(good.desc(), F.asc_nulls_last("imohash"), "_v")
    rows = rows.withColumn("fate", F.when(good & (F.row_number().over(one) > 1), "a repeated id").otherwise(F.col("fate"))).drop("_v")
    # A content is ranked among the rows that are still good; the others are keyed apart, so that no key gathers them.
    content = lambda h: F.concat(F.lit("h:"), h)
    apart = F.concat_ws(":", F.lit("r"), "file", F.col("row").cast("string"))
    seen = known_id = F.lit(False)
    if known is not None:
        rows = rows.join(known.select("image_id").distinct().withColumn("_known", F.lit(True)), "image_id", "left")
        known_id = F.col("_known").isNotNull()
    rows = rows.withColumn("_key", F.when(good & F.col("imohash").isNotNull(), content(F.col("imohash"))).otherwise(apart)).drop("imohash")
    if known is not None:
        hashes = known.where("imohash is not null").select(content(F.col("imohash")).alias("_key")).distinct().withColumn("_seen", F.lit(True))
        rows = rows.join(hashes, "_key", "left")
        seen = F.col("_seen").isNotNull()
    first = F.row_number().over(W.partitionBy("_key").orderBy(known_id, F.asc_nulls_last("image_id")))
    fate = F.when(~good, F.col("fate")).when(seen, "duplicate").when(known_id, "a known id").when(first > 1, "duplicate").otherwise("new")
    return rows.select("image_id", "image_path", "file", "row", fate.alias("fate"))


def marks(places: DataFrame) -> DataFrame:
    """Rows of files as bits: ``file, block, bits``, one entry for each :data:`BLOCK` rows that hold any."""
    word, bit = F.expr(f"cast(row % {BLOCK} div 64 as int)"), F.expr("shiftleft(1L, cast(row % 64 as int))")
    words = (F.bit_or(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))) for i in range(BLOCK // 64))
    return places.groupBy("file", F.expr(f"row div {BLOCK}").alias("block")).agg(F.array(*words).alias("bits"))


def marked(staged: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of a staged table that ``found`` (see :func:`marks`) marks, read where they lie: a bit a row is all that travels."""
    rows = staged.select("*", *_place()).withColumn("block", F.expr(f"row div {BLOCK}")).join(broadcast_if_small(found), ["file", "block"])
    own = F.expr(f"shiftright(element_at(bits, cast(row % {BLOCK} div 64 as int) + 1), cast(row % 64 as int)) & 1L = 1L")
    return rows.where(own).select(*staged.columns)


def ingest_batch(batch: DataFrame, root: str, query: str, epoch: int, tries: int = 3) -> dict | None:
    """Take one batch; returns its counts, or None where the epoch was committed before.

    The batch is written once as it comes (:func:`kept_vectors`), and whole records stay there: they are judged by their ids and hashes, and those
    that are new are routed from where they lie. All that is written hangs on one commit after the state that was read. If
    another writer commits between, the batch is judged again by the new state.
    """
    spark = batch.sparkSession
    if manifest.read(spark, root).has(query, epoch):
        return None
    staged = materialize(kept_vectors(records(batch)), "batch")
    try:
        for turn in range(tries):
            counts = _take(staged, root, query, epoch, last=turn == tries - 1)
            if counts is not False:
                return counts
    finally:
        drop_table(staged)


def _take(staged: DataFrame, root: str, query: str, epoch: int, last: bool) -> dict | None | bool:
    """One try at a staged batch; False where another writer has committed meanwhile, and this isn't the ``last``."""
    spark, scratch = staged.sparkSession, []

    def kept(rows: DataFrame, tag: str) -> DataFrame:
        scratch.append(materialize(rows, tag))
        return scratch[-1]

    now = manifest.read(spark, root)
    if now.has(query, epoch):
        return None
    try:
        known = manifest.table(spark, root, "global", now).select("image_id", "imohash") if "global" in now.schemas else None
        said = ~F.col("fate").isin("new", "duplicate")
        rows = kept(judged(staged, known).select("file", "row", "fate", *(F.when(said, F.col(c)).alias(c) for c in ("image_id", "image_path"))), "fates")
        found = kept(marks(rows.where("fate = 'new'")), "marks")
        models = {name: manifest.table(spark, root, f"model_{name}", now) for name in cluster.CLUSTERED if f"model_{name}" in now.folders}
        parts = routed(marked(staged, found), models)
        skipped = parts.pop("skipped").count()
        fates = rows.agg(F.count("*").alias("total"), F.count_if(F.col("fate") == "new").alias("processed"), F.count_if(F.col("fate") == "duplicate").alias("duplicates")).first()
        counts = {"query": query, "epoch": epoch, **fates.asDict(), "rejected": fates.total - fates.processed - fates.duplicates}
        rejected = rows.where(said).select("image_id", "image_path", F.col("fate").alias("reason"))

        def logged(written: dict[str, DataFrame]) -> dict[str, DataFrame]:
            sizes = {name: df.count() for name, df in written.items()}
            counts.update(vehicles=sizes["vehicles"], people=sizes["people"], skipped=skipped, faces=sizes["faces"], texts=sizes["ocr"])
            return {"log": spark.createDataFrame([tuple(counts.values())], COUNTS)}

        # rows are written once, to the folders that the commit names
        manifest.publish(spark, root, add={**parts, "quarantine": rejected}, base=now, writer=(query, epoch), then=logged)
        return counts
    except manifest.Conflict:
        if last:
            raise
        return False
    finally:
        for table in scratch:
            drop_table(table)


def run_ingest(stream: DataFrame, root: str, checkpoint: str, query: str = "ingest") -> StreamingQuery:
    """Ingest what is available of a stream of records. A restart with the same checkpoint goes on; a batch it replays is known."""
    take = lambda batch, epoch: ingest_batch(batch, root, query, epoch) and None
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).queryName(query).start()


_LABELS = T.StructType([T.StructField("image_id", T.StringType()), T.StructField("label", T.StringType())])
_ROOTS = T.StructType([T.StructField("label", T.StringType()), T.StructField("root", T.StringType())])


def group_new(spark: SparkSession, root: str, threshold: float = 0.99, query: str = "groups") -> int:
    """Add the links of all images committed since the last run to the groups; returns the commit number grouped up to."""
    now = manifest.read(spark, root)
    done = now.epochs.get(query, 0)
    if now.number <= done or "global" not in now.schemas:
        return done
    newest = max((n for n, _ in now.folders["global"]), default=0)
    if newest <= done:
        return done
    images = manifest.table(spark, root, "global", now).select("image_id", "global_embedding")
    marked = images.withColumn("fresh", F.lit(True))
    if done:
        fresh = manifest.table(spark, root, "global", now, since=done).select("image_id").withColumn("_new", F.lit(True))
        marked = images.join(fresh, "image_id", "left").withColumn("fresh", F.coalesce("_new", F.lit(False)))
    links = materialize(similarity_edges(marked, threshold, "image_id", "global_embedding", fresh="fresh").select("a", "b"), "new-links")
    labels = manifest.table(spark, root, "group_labels", now, schema=_LABELS)
    roots = manifest.table(spark, root, "group_roots", now, schema=_ROOTS)
    ends = links.select(F.col("a").alias("image_id")).unionByName(links.select(F.col("b").alias("image_id"))).distinct()
    known = labels.join(ends, "image_id", "left_semi").join(roots, "label", "left").select("image_id", F.coalesce("root", "label").alias("at"))
    at = materialize(ends.join(known, "image_id", "left").select("image_id", F.col("at").alias("had"), F.coalesce("at", "image_id").alias("at")), "link-ends")
    side = lambda c: at.select(F.col("image_id").alias(c), F.col("at").alias(f"{c}_at"))
    contracted = links.join(side("a"), "a").join(side("b"), "b").select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
    merged = materialize(components_of(contracted).select(F.col("node").alias("label"), F.col("component").alias("root")), "merged")
    entered = at.where("had is null").join(merged, F.col("at") == F.col("label")).select("image_id", F.col("root").alias("label"))
    onward = merged.select(F.col("label").alias("root"), F.col("root").alias("to"))
    moved = roots.join(onward, "root", "left").select("label", F.coalesce("to", "root").alias("root"))
    old = at.where("had is not null").select(F.col("had").alias("label")).distinct()
    added = merged.where("label <> root").join(old, "label", "left_semi").join(roots.select("label"), "label", "left_anti")
    manifest.publish(spark, root, add={"group_labels": entered}, replace={"group_roots": moved.unionByName(added)}, base=now, writer=(query, newest))
    return newest


def groups(spark: SparkSession, root: str) -> DataFrame:
    """``(image_id, component, duplicate_group_id)`` of every image that has a link; the component is its smallest id."""
    now = manifest.read(spark, root)
    labels = manifest.table(spark, root, "group_labels", now, schema=_LABELS)
    roots = manifest.table(spark, root, "group_roots", now, schema=_ROOTS)
    found = labels.join(broadcast_if_small(materialize(roots, "roots")), "label", "left").select("image_id", F.coalesce("root", "label").alias("component"))
    return found.withColumn("duplicate_group_id", stable_id("dup_", F.col("component")))

