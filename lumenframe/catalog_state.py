"""Registered queries over state that is kept from batch to batch: ingestion, deferred groups, maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.catalog import _CAT, _DET, _detections, _pointed, _read, query
from lumenframe.operators import manifest
from lumenframe.plans.storage import DEAL_BYTES, broadcast_if_small, scratch_path, stored_bytes
from lumenframe.streaming import flows, ingestion, maintenance

#: Deliveries that the ingestion queries take one after the other.
ARRIVALS = 3


def _records(spark, d, arrival: int) -> DataFrame:
    """What an analysis of the derived images of one delivery would give: an order is an image, its lines are detections, the conversation of its number is its text.

    Orders of one customer and month have one content; every 97th vector is missing. What goes by image is shuffled as it lies in
    the tables; vectors come to it when it has arrived.
    """
    e, lines, orders = _read(spark, d, "embeddings").select("vec_id", "embedding"), _read(spark, d, "lineitem"), _read(spark, d, "orders")
    n, top = e.count(), orders.agg(F.max("o_orderkey")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored_bytes(lines) // (ARRIVALS * DEAL_BYTES)))
    image = lambda key: F.concat(F.lit("img_"), F.col(key).cast("string"))
    arrived = lambda rows, key: rows.where(F.floor(F.col(key) * ARRIVALS / (top + 1)).cast("int") == arrival).repartition(parts, image(key))
    o = arrived(orders.select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey")
    o = o.select(image("o_orderkey").alias("image_id"), F.md5(F.concat_ws("/", F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM"))).alias("imohash"), F.expr("cast(320 + o_custkey % 1600 as int)").alias("width"),
        F.expr("cast(240 + o_orderkey % 1200 as int)").alias("height"), F.col("o_orderdate").cast("timestamp").alias("indexed_at"), (F.col("o_orderkey") % n).alias("vec_id"), (F.col("o_orderkey") % 97 != 0).alias("whole"))
    o = o.join(broadcast_if_small(e), "vec_id", "left").withColumn("global_embedding", F.when(F.col("whole"), F.col("embedding"))).drop("vec_id", "whole", "embedding")
    box = F.array(*(F.col(c).cast("float") for c in ("x1", "y1", "x2", "y2")))
    slim = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    det = _detections(spark, d, lines=arrived(slim, "l_orderkey")).join(_pointed(spark, d).select("vec_id", "embedding"), "vec_id")
    det = det.select("image_id", F.struct("box_index", box.alias("box"), F.col("confidence").cast("float").alias("s"), "class_id", F.col("embedding").alias("v")).alias("t"))
    det = det.groupBy("image_id").agg(F.sort_array(F.collect_list("t")).alias("t"))  # by box_index
    people = F.filter("t", lambda t: t["class_id"] == 0)
    det = det.select("image_id", F.size("t").alias("num_dets"), F.col("t.box").alias("boxes"), F.col("t.s").alias("scores"), F.col("t.class_id").alias("classes"), F.col("t.v").alias("box_embeddings"),
        F.transform(people, lambda t: t["box"]).alias("face_boxes"), F.transform(people, lambda t: t["v"]).alias("face_embeddings"), F.transform(people, lambda t: t["s"]).alias("face_scores"))
    talk = arrived(_read(spark, d, "conversations"), "conv_id").groupBy(image("conv_id").alias("image_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    zeros = lambda x: F.transform("t", lambda t: x)
    talk = talk.select("image_id", F.transform("t", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"), zeros(F.array(F.lit(0.0).cast("float"))).alias("text_boxes"), zeros(F.lit(0.5).cast("float")).alias("det_scores"), zeros(F.lit(0.5).cast("float")).alias("rec_scores"))
    return o.join(det, "image_id", "left").join(talk, "image_id", "left")


_ARRIVE = f"""{_DET}, o as (select 'img_' || cast(o_orderkey as varchar) image_id, md5(cast(o_custkey as varchar) || '/' || strftime(o_orderdate, '%Y-%m')) h, o_orderkey % 97 = 0 bad, cast(320 + o_custkey % 1600 as int) width,
    floor(o_orderkey * {ARRIVALS} / ((select max(o_orderkey) from orders) + 1)) arrival from orders),
  f as (select *, case when bad then 'no vector' when row_number() over (partition by h, bad order by arrival, image_id) > 1 then 'duplicate' else 'new' end fate from o)"""


@query(f"""with {_ARRIVE}, n as (select * from f where fate = 'new'), dd as (select det.*, {_CAT} cat from det join n using (image_id)),
  p as (select *, row_number() over (partition by image_id order by box_index) - 1 i from dd where cat = 'person'),
  t as (select 'img_' || cast(conv_id as varchar) image_id, row_number() over (partition by conv_id order by turn, role, text) - 1 i, text from conversations)
  select 'global' as tbl, image_id as key, image_id, cast(width as varchar) as detail from n
  union all select 'vehicles', image_id || '_box_' || cast(box_index as varchar), image_id, cast(class_id as varchar) from dd where cat = 'vehicle'
  union all select 'people', image_id || '_box_' || cast(box_index as varchar), image_id, printf('%.2f', confidence) from dd where cat = 'person'
  union all select 'faces', image_id || '_face_' || cast(i as varchar), image_id, printf('%.2f', confidence) from p
  union all select 'ocr', image_id || '_ocr_' || cast(i as varchar), image_id, md5(text) from t join n using (image_id) where trim(text) <> ''
  union all select 'quarantine', image_id, image_id, fate from f where fate not in ('new', 'duplicate')""")
def ingest_tables(spark, d):
    """All rows of the five tables and the quarantine after three deliveries of a stream of images, the second of which is sent again."""
    root, inbox = scratch_path(spark, "tables"), scratch_path(spark, "inbox")
    for k in range(ARRIVALS):
        rows = _records(spark, d, k)
        rows.write.mode("append").option("compression", "zstd").parquet(inbox)
        for again in range(2 if k == 1 else 1):  # a second run whose own memory is lost: the same files, the same epochs
            stream = spark.readStream.schema(rows.schema).parquet(inbox)
            ingestion.run_ingest(stream, root, f"{root}-state" if not again else f"{root}-again").awaitTermination()
    t = {name: manifest.table(spark, root, name) for name in ("global", "vehicles", "people", "faces", "ocr", "quarantine")}
    two = lambda c: F.format_string("%.2f", c)
    detail = {"global": ("image_id", F.col("width").cast("string")), "vehicles": ("detection_id", F.col("class_id").cast("string")), "people": ("detection_id", two("confidence")), "faces": ("face_id", two("confidence")), "ocr": ("ocr_id", F.md5("text")), "quarantine": ("image_id", F.col("reason"))}
    out = None
    for name, (key, what) in detail.items():
        part = t[name].select(F.lit(name).alias("tbl"), F.col(key).alias("key"), "image_id", what.alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""with {_ARRIVE}, c as (select arrival, count(*) total, count(*) filter (fate = 'new') processed, count(*) filter (fate = 'duplicate') duplicates from f group by 1),
  k as (select arrival, count(*) filter ({_CAT} = 'vehicle') vehicles, count(*) filter ({_CAT} = 'person') people, count(*) filter ({_CAT} = 'other') skipped from f join det using (image_id) where fate = 'new' group by 1)
  select cast(arrival as bigint) epoch, total, processed, duplicates, total - processed - duplicates rejected, coalesce(vehicles, 0) vehicles, coalesce(people, 0) people, coalesce(skipped, 0) skipped from c left join k using (arrival)""")
def ingest_log(spark, d):
    """Counts of each batch, as committed with its rows."""
    root = scratch_path(spark, "tables")
    for k in range(ARRIVALS):
        ingestion.ingest_batch(_records(spark, d, k), root, "log", k)
    return manifest.table(spark, root, "log").select("epoch", "total", "processed", "duplicates", "rejected", "vehicles", "people", "skipped")


@query("""with recursive v as (select 'img_' || lpad(cast(vec_id as varchar), 9, '0') id, embedding::double[] e from embeddings), e as (select x.id a, y.id b from v x join v y on x.id <> y.id and list_cosine_similarity(x.e, y.e) >= 0.4),
  reach as (select distinct a, a b from e union select r.a, e.b from reach r join e on r.b = e.a), c as (select a image_id, min(b) component from reach group by a)
  select image_id, component, 'dup_' || sha256(component)[1:12] duplicate_group_id from c""")
def deferred_groups(spark, d):
    """Groups of near-duplicates, kept up to date after each of three deliveries by the links of its images alone."""
    root = scratch_path(spark, "groups")
    e = _read(spark, d, "embeddings").select(F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 9, "0")).alias("image_id"), F.col("embedding").alias("global_embedding"), (F.col("vec_id") % ARRIVALS).alias("arrival"))
    for k in range(ARRIVALS):
        ingestion.ingest_batch(e.where(F.col("arrival") == k), root, "ingest", k)
        ingestion.group_new(spark, root, 0.4)
    return ingestion.groups(spark, root)


@query("""with recursive p as (select event_type index_name, cast(ceil(epoch_ms(ts) / 21600000.0) as bigint) tick, count(*) n from events group by 1, 2), w as (select max(epoch_ms(ts)) - 3600000 hi, min(epoch_ms(ts)) lo from events),
  g as (select i.index_name, t.tick from (select distinct index_name from p) i, (select unnest(range(cast(floor(lo / 21600000.0) as bigint), cast(floor(hi / 21600000.0) as bigint) + 1)) tick from w) t),
  z as (select g.index_name, g.tick, cast(coalesce(sum(n) over (partition by g.index_name order by g.tick), 0) as bigint) size from g left join p using (index_name, tick)),
  r as (select index_name, min(tick) - 1 tick, cast(0 as bigint) as size, cast(null as bigint) as trained, cast(null as bigint) as last, cast(null as bigint) as trained_on, cast(null as double) as hrs, false as due from z group by 1
    union all select z.index_name, z.tick, z.size, case when y.due then z.size else r.trained end, case when y.due then z.tick else r.last end, coalesce(r.trained, 0), (z.tick - r.last) * 6.0, y.due
    from r join z on z.index_name = r.index_name and z.tick = r.tick + 1, lateral (select (r.last is null or z.tick - r.last >= 1) and case when r.trained is null then z.size >= 100 else (z.size - r.trained) / greatest(1, r.trained) > 0.4 end as due) y)
  select index_name, tick * 21600 as at, size, trained_on, hrs as hours_since, case when hrs is null then 'trained' else 'rebalanced' end as action from r where due""")
def maintenance_due(spark, d):
    """When each index is trained and rebalanced, if every event is a vector of its type's index: a stateful stream with timers."""
    events = _read(spark, d, "events")
    before = maintenance.with_state_store(spark)
    try:
        stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
        due = flows.run_to_table(spark, maintenance.due_events(stream, index="event_type"), "due", "append")
    finally:
        maintenance.restore_state_store(spark, before)
    return due.withColumn("at", F.unix_seconds("at"))
