"""Registered queries of face ingestion, formatting and of scalar rules over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog import _CAT, _DET, _IMG, _detections, _images, _read, query
from lumenframe.functions import geometry as G
from lumenframe.functions import scalars as S
from lumenframe.functions.keys import with_content_key
from lumenframe.functions.vectors import l2_normalize
from lumenframe.operators import dedup, identity, ingest, search


def _face_images(spark, d):
    """Images with the boxes and vectors of their people; every fifth image names its person."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    people = _detections(spark, d).where("class_id = 0").join(e, "vec_id")
    box = F.array(*(F.least(F.col(c), F.lit(1.0)) for c in ("x1", "y1", "x2", "y2")))
    mark = F.when(F.col("box_index") % 2 == 0, F.array(*(F.col("x1") * k for k in range(10)))).otherwise(F.array("x1"))
    rows = people.select("image_id", F.struct("box_index", box.alias("box"), "embedding", mark.alias("mark"), "confidence").alias("t")).groupBy("image_id").agg(F.collect_list("t").alias("t"))
    rows = rows.withColumn("t", F.array_sort("t", lambda a, b: a["box_index"] - b["box_index"]))
    number = F.substring("image_id", 5, 20).cast("long")
    rows = rows.select("image_id", F.col("t.box").alias("face_boxes"), F.col("t.embedding").alias("face_embeddings"), F.col("t.mark").alias("face_landmarks"), F.col("t.confidence").alias("face_scores"), F.when(number % 5 == 0, F.concat(F.lit("person_"), (number % 7).cast("string"))).otherwise(F.when(number % 5 == 1, "")).alias("person_id"))
    return rows.join(_images(spark, d).select("image_id", "width", "height"), "image_id")


@query(f"""with {_DET}, {_IMG}, p as (select det.*, row_number() over (partition by image_id order by box_index) - 1 i, cast(substr(image_id, 5) as bigint) k from det join embeddings using (vec_id) where class_id = 0),
  c as (select p.*, width, height, cast(trunc(least(x1, 1) * width) as int) a, cast(trunc(least(y1, 1) * height) as int) b, cast(trunc(least(x2, 1) * width) as int) c, cast(trunc(least(y2, 1) * height) as int) e from p join img using (image_id))
  select image_id || '_face_' || cast(i as varchar) face_id, case when k % 5 = 0 then 'person_' || cast(k % 7 as varchar) else 'person_' || sha256(image_id)[1:12] end person_id, i = 0 and k % 5 <> 0 is_reference, confidence,
    greatest(a - cast(trunc((c - a) * 0.1::double) as int), 0) x1, greatest(b - cast(trunc((e - b) * 0.1::double) as int), 0) y1, least(c + cast(trunc((c - a) * 0.1::double) as int), width) x2, least(e + cast(trunc((e - b) * 0.1::double) as int), height) y2,
    case when box_index % 2 = 0 then round(x1 * 4, 6) end nose_x from c where i < 128""")
def faces_with_identity(spark, d):
    """Faces of each image share a given or a new person; the first of a new one is its reference; padded crops."""
    rows = identity.ingest_faces(_face_images(spark, d))
    corners = (F.get("crop", F.lit(k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2")))
    return rows.select("face_id", "person_id", "is_reference", "confidence", *corners, F.round(F.get("landmarks.nose", F.lit(0)), 6).alias("nose_x"))


@query(f"""with {_DET}, b as (select image_id, vec_id, row_number() over (partition by image_id order by box_index) n from det where class_id = 0 and cast(substr(image_id, 5) as bigint) % 50 = 0),
  q as (select b.image_id, e.embedding from b join embeddings e using (vec_id) where b.n = 2),
  s as (select q.image_id, e.vec_id, (1 + list_cosine_similarity(q.embedding::double[], e.embedding::double[])) / 2 score from q, embeddings e)
  select image_id query_id, vec_id, round(score, 6) score, cast(r as int) rank from (select *, row_number() over (partition by image_id order by score desc, vec_id) r from s) where r <= 5""")
def nth_face_search(spark, d):
    """Search by the second face of the images whose number is divisible by 50; images with fewer give nothing."""
    faces = _detections(spark, d).where("class_id = 0").where(F.substring("image_id", 5, 20).cast("long") % 50 == 0)
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    return search.nth_box_search(faces, e, e, 1, 5, columns=["vec_id"]).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_BACK = ", ".join(f"round(least(greatest(((case when px then {c} else {c} * 640 end) - (640 - round_even({side} * scale, 0)) / 2) / scale / {side}, 0), 1), 9) {c}" for c, side in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))


@query(f"""with {_DET}, {_IMG}, m as (select *, max(greatest(x1, y1, x2, y2)) over (partition by image_id) > 1 px from det), s as (select m.*, width, height, least(640.0::double / greatest(width, height), 1.0::double) scale from m join img using (image_id))
  select image_id, box_index, confidence, class_id, {_BACK}, case class_id when 0 then 'person' when 1 then 'bicycle' when 2 then 'car' when 3 then 'motorcycle' when 4 then 'airplane' when 5 then 'bus' when 6 then 'train' when 7 then 'truck' when 8 then 'boat' else 'traffic light' end class_name from s""")
def format_detections(spark, d):
    out = ingest.formatted_detections(_detections(spark, d), _images(spark, d)).select("image_id", "box_index", "detection.*")
    return out.select("image_id", "box_index", "confidence", "class_id", *(F.round(c, 9).alias(c) for c in ("x1", "y1", "x2", "y2")), "class_name")


@query("""with j as (select vec_id, case when vec_id % 11 = 0 then 'no vector' when label = 9 then 'no such person' end reason from embeddings)
  select count(*) filter (reason is null) written, count(*) filter (reason is not null) failed, (select array_to_string(list(e order by e), '|') from (select cast(vec_id as varchar) || ': ' || reason e from j where reason is not null order by vec_id limit 10)) errors from j""")
def bulk_report(spark, d):
    """What a bulk write of faces took, and the first ten errors."""
    e = _read(spark, d, "embeddings")
    _, _, report = ingest.bulk(e, "vec_id", F.when(F.col("vec_id") % 11 == 0, "no vector").when(F.col("label") == 9, "no such person"))
    return report.select("written", "failed", F.array_join("errors", "|").alias("errors"))


@query("""select ocr_id, det_score from (select cast(event_id as varchar) ocr_id, value / 100 det_score, user_id from events) where user_id = (select min(user_id) from events) order by det_score desc nulls last, ocr_id limit 1000""")
def texts_of_image(spark, d):
    """Text rows of one image, surest first; an event stands for a line of text on its user's image."""
    e = _read(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("ocr_id"), (F.col("value") / 100).alias("det_score"), F.col("user_id").cast("string").alias("image_id"))
    one = e.agg(F.min("user_id")).first()[0]
    return ingest.image_texts(rows, str(one)).select("ocr_id", "det_score")


@query("""with b as (select doc_id ordinal, sha256(coalesce(text, '')) h from documents where doc_id % 2 = 0), k as (select distinct sha256(coalesce(text, '')) h from documents where doc_id % 2 = 1)
  select ordinal, case when h not in (select h from k) then 'result of ' || h end result from b""")
def deferred_results(spark, d):
    """Results of what a batch still had to process, back at their places in it."""
    docs = _read(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("imohash"))
    batch = docs.where("doc_id % 2 = 0").withColumnRenamed("doc_id", "ordinal")
    rest = dedup.to_process(batch, docs.where("doc_id % 2 = 1"))
    results = rest.repartition(4, "imohash").select("ordinal", F.concat(F.lit("result of "), "imohash").alias("result"))
    return ingest.with_results(batch, results).select("ordinal", "result")


@query(f"""with {_DET}, n as (select image_id, count(*) c from det group by 1), x as (select det.*, row_number() over (partition by image_id order by box_index) - 1 i, c from det join n using (image_id))
  select image_id, cast(i as int) box_index, image_id || '_box_' || cast(i as varchar) detection_id, {_CAT} category, round(x1, 6) x1, round(y2, 6) y2 from x where i < greatest(c - 1, 1) and confidence >= 0.3""")
def padded_detections(spark, d):
    """Detections from padded arrays: the first ``num_dets`` count, and those without a score are padding."""
    det = _detections(spark, d)
    score = F.when(F.col("confidence") >= 0.3, F.col("confidence")).otherwise(0.0)
    rows = det.select("image_id", F.struct("box_index", F.array("x1", "y1", "x2", "y2").alias("box"), score.alias("s"), "class_id").alias("t")).groupBy("image_id").agg(F.collect_list("t").alias("t"))
    rows = rows.withColumn("t", F.array_sort("t", lambda a, b: a["box_index"] - b["box_index"]))
    images = rows.select("image_id", F.greatest(F.size("t") - 1, F.lit(1)).alias("num_dets"), F.col("t.box").alias("boxes"), F.col("t.s").alias("scores"), F.col("t.class_id").alias("classes"))
    out = ingest.explode_detections(images)
    return out.select("image_id", "box_index", "detection_id", "category", F.round(F.get("box", F.lit(0)), 6).alias("x1"), F.round(F.get("box", F.lit(3)), 6).alias("y2"))


@query("select page_id, case when page_id % 3 = 0 or coalesce(url, '') = '' then 'page_' || cast(page_id as varchar) else url end image_path, '/' || array_to_string(list_slice(list_filter(string_split(regexp_replace(url, '^[a-z]+://[^/]*', ''), '/'), lambda x: x <> ''), 1, 2), '/') route from pages")
def paths_and_routes(spark, d):
    """Default paths, and the metric label of a path."""
    p = _read(spark, d, "pages")
    path = F.when(F.col("page_id") % 3 == 0, F.when(F.col("page_id") % 2 == 0, "")).otherwise(F.col("url"))
    return p.select("page_id", S.default_path(path, F.concat(F.lit("page_"), F.col("page_id").cast("string"))).alias("image_path"), S.route_template(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("route"))


@query("select vec_id, round(list_inner_product(embedding::double[], embedding::double[]) / pow(greatest(sqrt(list_inner_product(embedding::double[], embedding::double[])), 2.0 * (vec_id % 2)), 2), 6) square from embeddings")
def floored_norms(spark, d):
    """Vectors brought to unit length, of every other one with a least divisor."""
    e = _read(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 2 == 1, l2_normalize(F.col("embedding"), floor=2.0)).otherwise(l2_normalize(F.col("embedding"), floor=1e-10))
    return e.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"))


@query(f"""with {_DET}, p as (select image_id, box_index, [[x2, y1 + 0.013], [x1 - 0.01, y2], [x1, y1], [x2 + 0.02, y2 + 0.03]] q from det)
  select image_id, box_index, round(q[3][1], 6) ax, round(q[3][2], 6) ay, round(q[4][1], 6) cx, round(q[4][2], 6) cy from p where q[3][1] + q[3][2] < least(q[1][1] + q[1][2], q[2][1] + q[2][2]) and q[4][1] + q[4][2] > greatest(q[1][1] + q[1][2], q[2][1] + q[2][2])""")
def ordered_quads(spark, d):
    """Corners of quadrilaterals in the order of reading, where the sums of all four differ."""
    det = _detections(spark, d)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    a, b, c, e = corner(F.col("x2"), F.col("y1") + 0.013), corner(F.col("x1") - 0.01, F.col("y2")), corner(F.col("x1"), F.col("y1")), corner(F.col("x2") + 0.02, F.col("y2") + 0.03)
    total = lambda p: p["x"] + p["y"]
    sure = det.where((total(c) < F.least(total(a), total(b))) & (total(e) > F.greatest(total(a), total(b))))
    rows = sure.select("image_id", "box_index", G.order_quad(F.array(a, b, c, e)).alias("q"))
    at = lambda i, k: F.round(F.get("q", F.lit(i))[k], 6)
    return rows.select("image_id", "box_index", at(0, "x").alias("ax"), at(0, "y").alias("ay"), at(2, "x").alias("cx"), at(2, "y").alias("cy"))


@query(f"""with {_IMG}, s as (select image_id, width, height, case when greatest(width, height) > 960 then 960.0::double / greatest(width, height) when greatest(width, height) < 640 then 640.0::double / greatest(width, height) else 1.0::double end k from img)
  select image_id, cast(ceil(greatest(cast(trunc(width * k) as int), 32) / 32.0) * 32 as int) in_width, cast(ceil(greatest(cast(trunc(height * k) as int), 32) / 32.0) * 32 as int) in_height from s""")
def text_input_sizes(spark, d):
    """Input sizes of text detection."""
    w, h = G.ocr_input(F.col("width"), F.col("height"))
    return _images(spark, d).select("image_id", w.alias("in_width"), h.alias("in_height"))


@query()
def content_keys(spark, d):
    """Sampled keys of pages, with samples small enough that pages of both kinds are there; tested by published values and by parts."""
    return with_content_key(_read(spark, d, "pages").select("page_id", "html"), "html", sample=512, whole=8192)
