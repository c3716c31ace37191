"""Registered queries, continued: reads and snapshots, composed searches, model life cycle, size and crop algebra, monitoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.catalog import _ASG, _CAT, _CEN, _DET, _IMG, _assigned, _centroids, _detections, _duplicates, _images, _queries_of, _read, query
from lumenframe.functions import geometry as G
from lumenframe.functions import scalars as S
from lumenframe.functions.vectors import l2_normalize
from lumenframe.operators import cluster, dedup, detect, identity, ingest, metrics, search, store
from lumenframe.plans import scan
from lumenframe.plans.storage import scratch_path

# ---- reads ----


@query("select o_orderkey, o_orderstatus, o_totalprice from orders where o_orderkey = 7")
def point_get(spark, d):
    return store.point_get(_read(spark, d, "orders"), "o_orderkey", 7, include=["o_orderkey", "o_orderstatus", "o_totalprice"])


@query("select doc_id, lang, source, n_chars from documents where doc_id > 100 order by doc_id limit 50")
def keyset_page(spark, d):
    """The second page of a scan in key order, without the text column."""
    return store.project(store.keyset_page(_read(spark, d, "documents"), "doc_id", 100, 50), exclude=["text"])


@query("select vec_id, len(embedding) dims from embeddings where embedding is not null")
def vector_scan(spark, d):
    return store.vectors(_read(spark, d, "embeddings"), "vec_id").select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query("select event_id, user_id from events where json_extract_string(props, '$.k') = '3'")
def metadata_filter(spark, d):
    return store.with_metadata(_read(spark, d, "events"), {"k": "3"}, "props").select("event_id", "user_id")


@query()
def snapshot_commit(spark, d):
    """A table as readers see it after two commits and one write that was never committed; tested row by row."""
    root = scratch_path(spark, "snapshots")
    orders = _read(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    store.commit(orders, root)
    store.commit(store.delete(orders, F.col("o_orderstatus") == "F"), root)
    orders.limit(1).write.parquet(f"{root}/snapshot=3")
    return store.snapshot(spark, root)


# ---- derivations ----

_COCO = "[" + ", ".join(f"'{c}'" for c in S.COCO) + "]"


@query(f"with {_DET} select class_name, count(*) n from (select coalesce({_COCO}[c + 1], 'class_' || c) class_name from (select class_id * 9 c from det)) group by 1")
def class_names(spark, d):
    det = _detections(spark, d).withColumn("class_name", S.detector_class(F.col("class_id") * 9))
    return det.groupBy("class_name").agg(F.count("*").alias("n"))


@query("select conv_id, string_agg(text, ' ' order by turn, role, text) full_text from conversations group by conv_id")
def full_text(spark, d):
    """Texts of an image in reading order."""
    rows = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", S.full_text(F.col("t.text")).alias("full_text"))


@query("select page_id, case when strlen(html) < 131072 then sha256(html) end content_key from pages")
def sampled_hash(spark, d):
    """Keys of contents; the sampled form for large ones is tested on made ones."""
    return _read(spark, d, "pages").select("page_id", S.sampled_hash(F.col("html")).alias("content_key"))


@query("select page_id, md5(base64(encode(html))) thumb from pages")
def base64_thumbnail(spark, d):
    return _read(spark, d, "pages").select("page_id", F.md5(F.translate(F.base64(F.encode("html", "UTF-8")), "\r\n", "")).alias("thumb"))


@query("select conv_id image_id, row_number() over (partition by conv_id order by turn) - 1 as text_index, text, s as confidence from (select *, (turn * 37 % 100) / 100 s, (turn * 53 % 100) / 100 r from conversations where trim(text) <> '') where s >= 0.3 and r >= 0.4")
def ocr_rows_confident(spark, d):
    """Text rows over both thresholds, numbered anew."""
    rows = _read(spark, d, "conversations").where("text is not null").withColumn("s", F.expr("(turn * 37 % 100) / 100")).withColumn("r", F.expr("(turn * 53 % 100) / 100"))
    packed = rows.groupBy(F.col("conv_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", "s", "r"))).alias("t"))
    images = packed.select("image_id", F.col("t.text").alias("texts"), F.transform("t", lambda t: F.array(F.lit(0.0))).alias("boxes"), F.col("t.s").alias("det_scores"), F.col("t.r").alias("rec_scores"))
    flat = ingest.explode_ocr(images.withColumn("image_id", F.col("image_id").cast("string")), 0.3, 0.4)
    place = F.element_at(F.split("ocr_id", "_"), -1).cast("int")
    kept = flat.select(F.col("image_id").cast("long").alias("image_id"), (F.row_number().over(W.partitionBy("image_id").orderBy(place)) - 1).cast("long").alias("text_index"), "text", F.col("det_score").alias("confidence"))
    return kept


@query("select count(*) n_regions, count(distinct case when n > 0 then conv_id end) images_with_text, cast(sum(n) as bigint) n_chars from (select conv_id, coalesce(length(text), 0) n from conversations)")
def ocr_totals(spark, d):
    rows = _read(spark, d, "conversations").select("conv_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    return rows.agg(F.count("*").alias("n_regions"), F.count_distinct(F.when(F.col("n") > 0, F.col("conv_id"))).alias("images_with_text"), F.sum("n").alias("n_chars"))


# ---- composed searches ----


@query(f"""with {_DET}, b as (select image_id, vec_id, row_number() over (partition by image_id order by box_index) n from (select *, {_CAT} cat from det where cast(substr(image_id, 5) as int) % 50 = 0) where cat = 'vehicle'),
  q as (select b.image_id, e.embedding from b join embeddings e using (vec_id) where b.n = 2),
  s as (select q.image_id, e.vec_id, (1 + list_cosine_similarity(q.embedding::double[], e.embedding::double[])) / 2 score from q, embeddings e)
  select image_id query_id, vec_id, round(score, 6) score, cast(r as int) rank from (select *, row_number() over (partition by image_id order by score desc, vec_id) r from s) where r <= 5""")
def nth_vehicle_search(spark, d):
    """Search by the second vehicle of the images whose number is divisible by 50."""
    det = _detections(spark, d).where(F.substring("image_id", 5, 20).cast("int") % 50 == 0).withColumn("category", S.category(F.col("class_id")))
    e = _read(spark, d, "embeddings").select("vec_id", "embedding")
    out = search.nth_box_search(det, e, e, 1, 5, "vehicle", columns=["vec_id"])
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("""with k as (select vec_id, embedding, 'person_' || label person_id from embeddings where label > 0),
  s as (select q.vec_id query_id, k.person_id, k.vec_id, (1 + list_cosine_similarity(q.embedding::double[], k.embedding::double[])) / 2 score from embeddings q, k where q.vec_id % 50 = 0 and q.vec_id <> k.vec_id),
  b as (select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from s) where r = 1 and score >= 0.62)
  select e.vec_id query_id, b.person_id, round(b.score, 6) score from (select vec_id from embeddings where vec_id % 50 = 0) e left join b on b.query_id = e.vec_id""")
def identify_faces(spark, d):
    """1:N identification of the faces whose id is divisible by 50; null where no known face is near enough."""
    e = _read(spark, d, "embeddings")
    known = e.select("vec_id", "embedding", F.when(F.col("label") > 0, F.concat(F.lit("person_"), F.col("label").cast("string"))).alias("person_id"))
    return identity.identify(e.where("vec_id % 50 = 0"), known, 5, 0.62, exclude_self=True).withColumn("score", F.round("score", 6))


@query()
def content_search(spark, d):
    """Pages whose id is divisible by 50 are encoded and searched among all encoded pages; tested against numpy."""
    from lumenframe.plans.embed import HashEncoder, encode
    from lumenframe.plans.storage import materialize

    pages = _read(spark, d, "pages").select("page_id", "html")
    items = materialize(encode(pages, "page_id", "html", HashEncoder), "encoded").withColumnRenamed("page_id", "vec_id")
    out = search.content_search(pages.where("page_id % 50 = 0"), items, HashEncoder, 5, id_col="page_id", content_col="html", columns=["vec_id"])
    return out.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


_NEAR = """n as (select q.vec_id query_id, d.vec_id, (1 + list_cosine_similarity(q.embedding::double[], d.embedding::double[])) / 2 score from embeddings q join embeddings d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id)"""


@query(f"with {_NEAR} select query_id, vec_id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, vec_id) r from n) where r <= 10 and vec_id % 3 <> 0 and vec_id not in (select vec_id from embeddings where label = 1)")
def neighbours_left(spark, d):
    """Neighbours that are neither processed (ids divisible by 3) nor in a group (label 1)."""
    e = _read(spark, d, "embeddings")
    near = search.knn_blocks(_queries_of(spark, d), e.select("vec_id", "embedding"), 10, exclude_self=True, columns=["vec_id"])
    done = e.where("vec_id % 3 = 0 or label = 1").select("vec_id")
    return near.join(done, "vec_id", "left_anti").select("query_id", "vec_id", F.round("score", 6).alias("score"))


# ---- models ----


@query(f"with {_CEN} select cid cluster_id, len(v) dims, round(list_inner_product(v, v), 6) norm from c where cid = 3")
def centroid_lookup(spark, d):
    """One centroid of a model that was saved and loaded by its name."""
    root = scratch_path(spark, "models")
    cluster.save_model(_centroids(spark, d), root, "faces", 500)
    one = cluster.centroid_of(cluster.load_model(spark, root, "faces"), 3)
    square = F.aggregate("centroid", F.lit(0.0), lambda acc, x: acc + x * x)
    return one.select("cluster_id", F.size("centroid").cast("long").alias("dims"), F.round(square, 6).alias("norm"))


@query()
def retrained_table(spark, d):
    """Train, assign anew and write back; tested: each row is at its nearest centroid."""
    return cluster.retrain(_read(spark, d, "embeddings").drop("label"), 8)[0].select("vec_id", "cluster_id", F.round("cluster_distance", 6).alias("cluster_distance"))


@query(f"{_ASG} select e.vec_id, case when e.vec_id % 2 = 0 then -1 else a.cluster_id end cluster_id, round(case when e.vec_id % 2 = 0 then 0 else a.cluster_distance end, 6) cluster_distance from embeddings e join asg a using (vec_id)")
def assign_missing(spark, d):
    """Only rows without a cluster are assigned; the others keep theirs."""
    e = _read(spark, d, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 2 == 0, -1).alias("cluster_id"), F.when(F.col("vec_id") % 2 == 0, 0.0).alias("cluster_distance"))
    out = cluster.write_back(e, cluster.assign_unclustered(e, _centroids(spark, d)))
    return out.select("vec_id", "cluster_id", F.round("cluster_distance", 6).alias("cluster_distance"))


@query(f"{_ASG} select cluster_id, count(*) n, max(cnt) over () > 0 due from (select cluster_id, count(*) over (partition by cluster_id) cnt from asg) group by cluster_id, cnt")
def cluster_sizes_due(spark, d):
    """Cluster sizes beside whether maintenance is due for a table that was trained on one row."""
    rows = _assigned(spark, d)
    due = cluster.maintenance(rows, _centroids(spark, d), 1).select("due")
    return rows.groupBy("cluster_id").agg(F.count("*").alias("n")).join(F.broadcast(due))  # one row


# ---- sizes and crops ----


@query(f"with {_IMG} select image_id, cast(floor(width * (256 / least(width, height))) as bigint) new_width, cast(floor(height * (256 / least(width, height))) as bigint) new_height, cast(floor((floor(width * (256 / least(width, height))) - 256) / 2) as bigint) crop_x, cast(floor((floor(height * (256 / least(width, height))) - 256) / 2) as bigint) crop_y from img")
def center_crop(spark, d):
    return _images(spark, d).select("image_id", *(c.cast("long").alias(n) for n, c in G.center_crop(F.col("width"), F.col("height")).items()))


@query(f"with {_IMG} select image_id, cast(round_even(width * least(768 / greatest(width, height), 1.0), 0) as int) new_width, cast(round_even(height * least(768 / greatest(width, height), 1.0), 0) as int) new_height, greatest(width, height) > 1024 resized from img")
def shrink_to(spark, d):
    w, h = F.col("width"), F.col("height")
    return _images(spark, d).select("image_id", *(c.alias(n) for n, c in G.shrink_to(w, h, 768).items()), G.needs_resize(w, h).alias("resized"))


@query(f"with {_IMG} select image_id, w, h from (select image_id, width % 40 w, height * 20 h from img) where w >= 16 and h >= 16 and w <= 16384 and h <= 16384")
def valid_sizes(spark, d):
    rows = _images(spark, d).select("image_id", (F.col("width") % 40).alias("w"), (F.col("height") * 20).alias("h"))
    return rows.where(G.valid_size(F.col("w"), F.col("h")))


_QUAD = [("x1", "y1"), ("x2 + 3", "y1 + 1"), ("x2", "y2 + 2"), ("x1 - 2", "y2")]


def _quads(spark, d):
    det = _detections(spark, d).select("image_id", "box_index", *((F.col(c) * 20).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return det, [F.expr(x) for x, _ in _QUAD], [F.expr(y) for _, y in _QUAD]


_QSQL = "q as (select image_id, box_index, x1 * 20 x1, y1 * 20 y1, x2 * 20 x2, y2 * 20 y2 from det)"
_EDGES = "greatest(sqrt(pow(x1 - (x2 + 3), 2) + pow(y1 - (y1 + 1), 2)), sqrt(pow(x2 - (x1 - 2), 2) + pow(y2 + 2 - y2, 2)))", "greatest(sqrt(pow(x1 - (x1 - 2), 2) + pow(y1 - y2, 2)), sqrt(pow(x2 + 3 - x2, 2) + pow(y1 + 1 - (y2 + 2), 2)))"


@query(f"with {_DET}, {_QSQL} select image_id, box_index, round(least(x1, x2 + 3, x2, x1 - 2) / 640, 9) x_low, round(least(y1, y1 + 1, y2 + 2, y2) / 480, 9) y_low, round(greatest(x1, x2 + 3, x2, x1 - 2) / 640, 9) x_high, round(greatest(y1, y1 + 1, y2 + 2, y2) / 480, 9) y_high, w crop_width, h crop_height, w >= 3 and h >= 3 kept, w >= 3 and h >= 3 and h >= 1.5 * w turned from (select *, cast(floor({_EDGES[0]}) as bigint) w, cast(floor({_EDGES[1]}) as bigint) h from q)")
def quad_crops(spark, d):
    """Boxes and crop sizes of quadrilaterals around text."""
    det, xs, ys = _quads(spark, d)
    box, crop = G.quad_box(xs, ys, F.lit(640.0), F.lit(480.0)), G.quad_crop(xs, ys)
    return det.select("image_id", "box_index", *(F.round(b, 9).alias(n) for b, n in zip(box, ("x_low", "y_low", "x_high", "y_high"))), *(c.alias(n) for n, c in crop.items()))


@query(f"with {_DET}, {_QSQL}, g as (select *, x2 - x1 w, y2 - y1 h, coalesce((x2 - x1) * (y2 - y1) * 1.5 / nullif(2 * ((x2 - x1) + (y2 - y1)), 0), 0) g from q) select image_id, box_index, round((x1 - g) * 2, 9) + 0.0 x1, round((y1 - g) * 3, 9) + 0.0 y1, round((x2 + g) * 2, 9) x2, round((y2 + g) * 3, 9) y2 from g where least(w, h) >= 3 and least(w, h) + 2 * g >= 5")
def unclipped_boxes(spark, d):
    det, _, _ = _quads(spark, d)
    grown = G.unclip_box(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.lit(2.0), F.lit(3.0))
    return det.where(grown["kept"]).select("image_id", "box_index", *((F.round(grown[c], 9) + 0.0).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"with {_DET} select image_id, cast(r - 1 as int) box_index, x2, confidence, class_id from (select *, row_number() over (partition by image_id order by box_index) r from det) where confidence >= 0.5 and r <= 4")
def fused_detections(spark, d):
    """Detections from fused rows of six numbers, at most four of an image."""
    det = _detections(spark, d)
    row = F.array("x1", "y1", "x2", "y2", "confidence", F.col("class_id").cast("double"))
    images = det.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("box_index", row.alias("d")))).alias("s")).select("image_id", F.col("s.d").alias("output"))
    assert detect.detector_layout(images.columns) == "fused"
    return detect.explode_fused(images, min_score=0.5, cap=4).select("image_id", "box_index", "x2", "confidence", "class_id")


@query()
def unmatched_boxes(spark, d):
    """Boxes without a partner on the other side; tested: matched and unmatched make up both sides."""
    det = _detections(spark, d, dealt=True)
    other = det.where("box_index % 5 <> 1").withColumn("x1", F.col("x1") + 0.02)
    return detect.unmatched(det, other, detect.match_detections(det, other))


# ---- monitoring ----


@query("select event_type, h, round(case when u = 0 then 0 else o / u end, 6) ratio from (select event_type, strftime(ts, '%Y-%m-%d %H') h, count(*) filter (where user_id % 20 = 0) o, count(*) u from events group by 1, 2)")
def failure_ratio(spark, d):
    """Rate of failed requests by the rate of all, an hour and series, from two counters that each event moves on."""
    e = _read(spark, d, "events").select("event_type", "ts", "event_id", (F.col("user_id") % 20 == 0).cast("int").alias("bad"))
    stored = scan.ranged(e.withColumn("one", F.lit(1)), ["event_type"], ["ts", "event_id"])
    counted = scan.running_sum(scan.running_sum(stored, ["event_type"], ["ts", "event_id"], "bad", "failed"), ["event_type"], ["ts", "event_id"], "one", "all")
    begun = e.groupBy("event_type").agg(F.min("ts").alias("ts")).select("event_type", "ts", F.lit(-1).alias("event_id"), F.lit(0).alias("failed"), F.lit(0).alias("all"))
    both = counted.select(*begun.columns).unionByName(begun)
    samples = both.select("event_type", F.col("ts").cast("timestamp").alias("time"), F.struct("ts", "event_id").alias("ts"), F.explode(F.create_map(F.lit("failed"), F.col("failed"), F.lit("all"), F.col("all"))).alias("name", "value"))
    out = metrics.ratio_of_rates(samples, "failed", "all", 3600, "event_type", time="time")
    return out.select("event_type", F.date_format("window_start", "yyyy-MM-dd HH").alias("h"), F.round("ratio", 6).alias("ratio"))


@query("select event_type, round(1 - avg(case when value > 20 then 0.0 else 1.0 end), 6) busy_share from events group by event_type")
def busy_share(spark, d):
    return metrics.idle_share(_read(spark, d, "events"), F.col("value") > 20, ["event_type"]).withColumn("busy_share", F.round("busy_share", 6))


@query("select event_type, count(*) n_groups from (select distinct event_type, user_id from events) group by event_type")
def count_of_groups(spark, d):
    return metrics.count_of_groups(_read(spark, d, "events"), ["event_type"], ["user_id"])


@query("select user_id, count(*) n from events where regexp_full_match(cast(user_id as varchar), '5..?') and event_type <> 'view' group by user_id")
def label_match(spark, d):
    e = _read(spark, d, "events").where(metrics.label_match("user_id", "=~", "5..?") & metrics.label_match("event_type", "!=", "view"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"))


@query("select source, count(*) n from documents where contains(text, 'rights') and not regexp_matches(text, 'idiot|loser') group by source")
def line_filters(spark, d):
    docs = _read(spark, d, "documents").where(metrics.line_filter(F.col("text"), "|=", "rights") & metrics.line_filter(F.col("text"), "!~", "idiot|loser"))
    return docs.groupBy("source").agg(F.count("*").alias("n"))


@query("""with t as (select event_type, ts, event_id, row_number() over (partition by event_type order by ts, event_id) p from (select *, row_number() over (partition by event_type, ts order by event_id) z from events) where z = 1),
  s as (select *, (epoch_us(ts) - min(epoch_us(ts)) over (partition by event_type)) / 1e6 sec from t)
  select event_type, event_id, round(100.0 * p / 5000, 6) percent, round(case when sec = 0 then 0 else p / sec end, 8) rate, round(case when sec > 0 then greatest(5000 - p, 0) / (p / sec) end, 3) eta_seconds from s""")
def ingest_progress(spark, d):
    one = W.partitionBy("event_type", "ts").orderBy("event_id")
    ticks = _read(spark, d, "events").withColumn("z", F.row_number().over(one)).where("z = 1").withColumn("processed", F.row_number().over(W.partitionBy("event_type").orderBy("ts", "event_id")))
    out = metrics.progress(ticks, 5000, series="event_type")
    return out.select("event_type", "event_id", F.round("percent", 6).alias("percent"), F.round("rate", 8).alias("rate"), F.round("eta_seconds", 3).alias("eta_seconds"))


@query("select event_type, count(*) requests, round(avg(value), 6) avg_latency, round(avg(case when user_id % 20 <> 0 then 1.0 else 0.0 end), 6) success_rate from events group by event_type")
def pool_stats(spark, d):
    out = metrics.pool_stats(_read(spark, d, "events"), "event_type", "value", F.col("user_id") % 20 != 0)
    return out.select("event_type", "requests", F.round("avg_latency", 6).alias("avg_latency"), F.round("success_rate", 6).alias("success_rate"))


@query("""with r as (select event_type, epoch_us(ts) a, epoch_us(ts) + 600000000 b from events), s as (select event_type, a t, 1 d from r union all select event_type, b, -1 from r),
  g as (select event_type, t, d, sum(d) y from s group by 1, 2, 3), w as (select event_type, sum(y) over (partition by event_type order by t, d rows unbounded preceding) n from g) select event_type, cast(max(n) as bigint) peak from w group by event_type""")
def peak_concurrency(spark, d):
    """Requests of ten minutes each that run at once."""
    r = _read(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("a")).withColumn("b", F.col("a") + 600_000_000)
    return metrics.peak_concurrency(r, "a", "b", ["event_type"])
