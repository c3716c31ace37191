"""Exact and near-duplicate groups of images: lookup, grouping, listing, merging, removal with promotion."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.scalars import stable_id
from lumenframe.functions.vectors import cosine, l2_normalize
from lumenframe.plans.scan import PART, ranged
from lumenframe.plans.storage import broadcast_if_small, materialize

#: Directions whose bands prune pairs of vectors.
DIRECTIONS = 3
#: Bytes of one of the groups of vectors whose pairs a task scores, what a row takes besides its values, and rows multiplied at once.
GROUP_BYTES, ROW_BYTES, STRIPE = 64 << 20, 64, 1024
#: Rounds of a greedy grouping before small rests are folded one by one, and the largest rest that one task folds, in edges.
ROUNDS, FOLD_EDGES = 6, 200_000

GROUP, PRIMARY, SCORE = "duplicate_group_id", "is_duplicate_primary", "duplicate_score"


def hash_lookup(incoming: DataFrame, indexed: DataFrame, hash_col: str = "imohash", id_col: str = "image_id") -> DataFrame:
    """``incoming`` with ``existing_id``: the smallest indexed id of the same content hash, or null."""
    known = indexed.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(id_col).alias("existing_id"))
    return incoming.join(known, hash_col, "left")


def to_process(incoming: DataFrame, indexed: DataFrame, hash_col: str = "imohash") -> DataFrame:
    """Rows whose content isn't indexed yet."""
    return incoming.join(indexed.select(hash_col), hash_col, "left_anti")


def _unit_vectors(base: DataFrame) -> DataFrame:
    """``(id, v, fresh)`` with unit vectors and ``p0, p1, ...``: their positions along ``DIRECTIONS`` orthogonal unit directions.

    Direction d is the normalised sum of every DIRECTIONS-th coordinate, with pseudo-random signs. Vectors of zero length
    stay zero; vectors of unlike numbers of coordinates raise.
    """
    names = [f"p{d}" for d in range(DIRECTIONS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v")
            if pc.count_distinct(pc.list_value_length(v)).as_py() > 1:
                raise ValueError("vectors have unlike numbers of coordinates")
            x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
            x = x / np.where(norms == 0, 1.0, norms)
            signs = np.random.default_rng(7).choice([-1.0, 1.0], x.shape[1])  # the same in every task
            along = [x[:, d::DIRECTIONS] @ signs[d::DIRECTIONS] / math.sqrt(max(1, len(signs[d::DIRECTIONS]))) for d in range(DIRECTIONS)]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.size else np.zeros(len(x) + 1, np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), vectors, batch.column("fresh"), *map(pa.array, along)], ["id", "v", "fresh", *names])

    kind = base.schema["id"].dataType.simpleString()
    return base.mapInArrow(run, f"id {kind}, v array<double>, fresh boolean, " + ", ".join(f"{n} double" for n in names))


def similarity_edges(items: DataFrame, threshold: float, id_col: str = "vec_id", vec: str = "embedding", block: int = 128, group_bytes: int = GROUP_BYTES, fresh: str | None = None) -> DataFrame:
    """``(a, b, score)`` with a < b and raw cosine >= threshold, exactly.

    ``fresh`` names a boolean column: then only pairs with a fresh row are sought, and groups of other rows never meet.

    Fragments and replicas: vectors are dealt to G even groups of at most about ``group_bytes``, and a task multiplies the
    matrices of two groups. A vector travels once for every group that its own meets, G times at most, in one shuffle; so G
    is as small as tasks' memory allows, but not so small that a cluster's tasks are idle or groups have under ``block`` rows.

    Unit vectors within a threshold differ little along any direction: |x.r - y.r| <= |x - y| = sqrt(2 - 2 threshold) for
    a unit direction r. Groups are ranges of cells of that width along ``DIRECTIONS`` orthogonal directions (a dense cell is
    split by a hash of ids), and only groups whose boxes come that near meet; inside a task, slices along the first
    direction. High thresholds leave a small share of all pairs. Low thresholds on vectors without structure remain
    quadratic: that is what an exact join of such vectors costs; ``cluster.assign`` with :func:`search.ivf_search` is the
    lossy way.

    Zero vectors have no cosine and no pairs.
    """
    width = max(math.sqrt(max(0.0, 2 - 2 * threshold)), 1e-6) * (1 + 1e-9)
    spark = items.sparkSession
    flag = F.coalesce(F.col(fresh), F.lit(False)) if fresh else F.lit(True)
    base = items.where(F.col(vec).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec).alias("v"), flag.alias("fresh"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.size("v").cast("long") * 8 + ROW_BYTES).alias("bytes")).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = min(math.ceil(math.sqrt(2 * tasks)), -(-size.n // block))
    groups = max(1, least, -(-(size.bytes or 0) // group_bytes))
    base = _unit_vectors(base).withColumn("_h", F.xxhash64("id"))
    base = base.withColumns({f"_c{d}": F.floor(F.col(f"p{d}") / width) for d in range(DIRECTIONS)})
    stored = ranged(base, ["fresh", *(f"_c{d}" for d in range(DIRECTIONS))], ["_h"], parts=groups)
    sides = [f(f"p{d}").alias(f"{name}{d}") for d in range(DIRECTIONS) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    boxes = stored.groupBy(PART).agg(F.max("fresh").alias("any"), *sides)
    # One row of G boxes, so that each group filters those it meets; a group's size bounds G.
    every = F.broadcast(boxes.agg(F.collect_list(F.struct("*")).alias("boxes")))

    def meets(o: Column) -> Column:
        near = (o[PART] >= F.col(PART)) & (o["any"] | F.col("any"))
        for d in range(DIRECTIONS):
            near &= (o[f"lo{d}"] - F.col(f"hi{d}") <= width) & (F.col(f"lo{d}") - o[f"hi{d}"] <= width)
        return near

    met = boxes.join(every).select(F.col(PART).alias("l"), F.explode(F.filter("boxes", meets)).alias("o")).select("l", F.col(f"o.{PART}").alias("r"))
    ends = F.array(F.struct(F.col("l").alias(PART), F.lit(0).alias("side")), F.struct(F.col("r").alias(PART), F.lit(1).alias("side")))
    copies = met.select("l", "r", F.explode(ends).alias("end")).select("l", "r", "end.*").where("l <> r or side = 0")
    targets = copies.groupBy(PART).agg(F.collect_list(F.struct("l", "r", "side")).alias("to"))
    rows = stored.join(broadcast_if_small(materialize(targets, "group-targets")), PART)
    rows = rows.select(F.explode("to").alias("to"), "id", "v", "fresh", "p0").select("to.*", "id", "v", "fresh", "p0")
    kind = base.schema["id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("p0", "ascending")]).combine_chunks()
        right = table.filter(pc.equal(table["side"], 1))
        left = table.filter(pc.equal(table["side"], 0)) if right.num_rows else table
        one = right.num_rows == 0  # a group against itself: each pair once
        right = left if one else right
        (ids, x, xf, xp), (rids, y, yf, yp) = _matrix(left), _matrix(right)
        found = []
        for at in range(0, len(xp), STRIPE):
            end = min(at + STRIPE, len(xp))
            lo, hi = np.searchsorted(yp, xp[at] - width), np.searchsorted(yp, xp[end - 1] + width, side="right")
            for at2 in range(max(lo, at) if one else lo, hi, STRIPE):
                end2 = min(at2 + STRIPE, hi)
                scores = x[at:end] @ y[at2:end2].T
                i, j = np.nonzero((scores >= threshold) & (xf[at:end, None] | yf[None, at2:end2]))
                s = scores[i, j]
                if one:
                    once = i + at < j + at2
                    i, j, s = i[once], j[once], s[once]
                a, b = ids.take(pa.array(i + at)), rids.take(pa.array(j + at2))
                less, unlike = pc.less(a, b), pc.not_equal(a, b)
                found.append(pa.table([pc.if_else(less, a, b).filter(unlike), pc.if_else(less, b, a).filter(unlike), pa.array(s).filter(unlike)], ["a", "b", "score"]))
        return pa.concat_tables(found) if found else pa.table([ids.slice(0, 0), ids.slice(0, 0), pa.array([], pa.float64())], ["a", "b", "score"])

    return rows.groupBy("l", "r").applyInArrow(run, f"a {kind}, b {kind}, score double")


def _matrix(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors, marks of fresh rows and positions along the first direction of a group's rows."""
    ids, v = (rows[c].chunk(0) if rows[c].num_chunks else pa.array([], rows.schema.field(c).type) for c in ("id", "v"))
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    return ids, x, rows["fresh"].to_numpy(), rows["p0"].to_numpy()


def find_duplicates(query_id, items: DataFrame, threshold: float, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", self_slot: bool = False) -> DataFrame:
    """Nearest other items of one item with search score >= threshold. ``self_slot``: the item itself takes one of the k."""
    one = items.where(F.col(id_col) == query_id).select(F.col(vec).alias("qv")).limit(1)
    scored = items.join(F.broadcast(one)).withColumn("score", (1 + cosine(F.col("qv"), F.col(vec))) / 2)
    top = scored.orderBy(F.desc("score"), id_col).limit(k if self_slot else k + 1).where(F.col(id_col) != query_id)
    return top.where(F.col("score") >= threshold).select(id_col, "score")


def _fold_rest(state: DataFrame, smaller: DataFrame) -> DataFrame:
    """Decides the undecided items of every component of at most ``FOLD_EDGES`` edges, each in one task, by scanning ids in order."""
    from lumenframe.plans.components import components_of

    open_ = state.where("leads is null").select("id")
    rest = smaller.join(open_, smaller.a == open_.id, "left_semi").join(open_.withColumnRenamed("id", "o"), smaller.b == F.col("o"), "left_semi")
    rest = materialize(rest, "greedy")
    parts = components_of(rest).select(F.col("node").alias("a"), "component")
    dealt = rest.join(parts, "a")
    few = dealt.groupBy("component").count().where(F.col("count") <= FOLD_EDGES).select("component")
    led = smaller.join(state.where("leads").select(F.col("id").alias("b")), "b", "left_semi").select("a").distinct().withColumn("led", F.lit(True))
    kind = smaller.schema["a"].dataType.simpleString()

    def fold(pdf):
        import pandas as pd

        below: dict = {}
        for a, b in zip(pdf.a, pdf.b):
            below.setdefault(a, []).append(b)
            below.setdefault(b, [])
        claimed = {a for a, led in zip(pdf.a, pdf.led) if led is True} | {b for b, led in zip(pdf.b, pdf.b_led) if led is True}
        leads: dict = {}
        for a in sorted(below):
            leads[a] = a not in claimed and not any(leads[b] for b in below[a])
        return pd.DataFrame({"id": list(leads), "now": list(leads.values())})

    ready = dealt.join(few, "component", "left_semi").join(led, "a", "left").join(led.withColumnsRenamed({"a": "b", "led": "b_led"}), "b", "left")
    done = ready.select("component", "a", "b", "led", "b_led").groupBy("component").applyInPandas(fold, f"id {kind}, now boolean")
    return materialize(state.join(done, "id", "left").select("id", F.coalesce("leads", "now").alias("leads")), "greedy")


def greedy_groups(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(member, leader)`` as by scanning ids in order: an unclaimed item leads and claims its unclaimed neighbours.

    The leaders are the lexicographically first maximal independent set, found in rounds: an undecided item leads once
    every smaller neighbour is decided and doesn't lead. Items without edges are in no group. Each round is
    two joins on the edge table, stored in the shared folder. Long chains would take a round an item, so after ``ROUNDS``
    rounds the components that are still open and have few edges are folded, each in one task. If any item is undecided
    after ``max_rounds`` rounds, this raises.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "greedy")
    state = materialize(both.select(F.col("a").alias("id")).distinct().withColumn("leads", F.lit(None).cast("boolean")), "greedy")
    smaller = both.where("b < a")
    for turn in range(max_rounds):
        if state.where("leads is null").isEmpty():
            break
        if turn % 100 == ROUNDS:
            state = _fold_rest(state, smaller)
            continue
        seen = smaller.join(state.select(F.col("id").alias("b"), "leads"), "b").groupBy("a").agg(F.coalesce(F.max("leads"), F.lit(False)).alias("led"), F.count_if(F.col("leads").isNull()).alias("open"))
        step = state.join(seen, state.id == seen.a, "left")
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = materialize(step.select("id", decided.alias("leads")), "greedy")
    else:
        if not state.where("leads is null").isEmpty():
            raise RuntimeError(f"greedy groups are not decided after {max_rounds} rounds")
    leaders = state.where("leads").select(F.col("id").alias("leader"))
    claimed = both.join(leaders, both.b == leaders.leader).groupBy(F.col("a").alias("member")).agg(F.min("leader").alias("leader"))
    return claimed.join(leaders, claimed.member == leaders.leader, "left_anti").unionByName(leaders.select(F.col("leader").alias("member"), "leader"))


def label_groups(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """Group columns of members: reproducible group id, primary flag, similarity to the leader (1.0 for itself)."""
    near = edges.select(F.col("a").alias("leader"), F.col("b").alias("member"), "score").unionByName(edges.select(F.col("b").alias("leader"), F.col("a").alias("member"), "score"))
    out = groups.join(near, ["leader", "member"], "left")
    return out.select("member", stable_id("dup_", F.col("leader")).alias(GROUP), (F.col("member") == F.col("leader")).alias(PRIMARY), F.coalesce("score", F.lit(1.0)).alias(SCORE))


def list_groups(rows: DataFrame, min_size: int = 2, page: int = 0, size: int = 20, id_col: str = "image_id") -> DataFrame:
    """Groups by size, then id: ``duplicate_group_id, member_count, primary_id`` ('' without a primary), paged after the aggregate."""
    primary = F.min(F.when(F.coalesce(PRIMARY, F.lit(False)), F.col(id_col)))
    sized = rows.where(F.col(GROUP).isNotNull()).groupBy(GROUP).agg(F.count("*").alias("member_count"), F.coalesce(primary, F.lit("")).alias("primary_id"))
    return sized.where(F.col("member_count") >= min_size).orderBy(F.desc("member_count"), GROUP).offset(page * size).limit(size)


def group_members(rows: DataFrame, group_id: str, exclude_primary: bool = False, id_col: str = "image_id", cap: int = 1000) -> DataFrame:
    """Members: primary first, then by score."""
    picked = rows.where(F.col(GROUP) == group_id)
    if exclude_primary:
        picked = picked.where(~F.coalesce(PRIMARY, F.lit(False)))
    return picked.orderBy(F.desc_nulls_last(PRIMARY), F.desc_nulls_last(SCORE), id_col).limit(cap)


def duplicate_stats(rows: DataFrame) -> DataFrame:
    """total, grouped, ungrouped, num_groups, avg_group_size in one pass."""
    grouped, groups = F.count(GROUP), F.count_distinct(GROUP)
    avg = F.when(groups > 0, grouped / groups).otherwise(0.0)
    return rows.agg(F.count("*").alias("total"), grouped.alias("grouped"), (F.count("*") - grouped).alias("ungrouped"), groups.alias("num_groups"), avg.alias("avg_group_size"))


def remove_from_group(rows: DataFrame, member, id_col: str = "image_id") -> DataFrame:
    """The member loses its group; if it was primary, the best other member is promoted. A group of one stays."""
    gone = F.col(id_col) == member
    order = W.partitionBy(GROUP).orderBy(gone.cast("int"), F.desc_nulls_last(SCORE), id_col)
    lost = F.max((gone & F.coalesce(PRIMARY, F.lit(False))).cast("int")).over(W.partitionBy(GROUP)) == 1
    hit = rows.where(gone).select(GROUP).where(F.col(GROUP).isNotNull())
    touched, rest = rows.join(F.broadcast(hit.limit(1)), GROUP, "left_semi"), rows.join(F.broadcast(hit.limit(1)), GROUP, "left_anti")
    touched = touched.withColumn("_rank", F.row_number().over(order)).withColumn("_lost", lost)
    touched = touched.withColumn(PRIMARY, F.when(gone, F.lit(None)).when(F.col("_lost") & (F.col("_rank") == 1), True).otherwise(F.col(PRIMARY)))
    touched = touched.withColumn(SCORE, F.when(~gone, F.col(SCORE))).withColumn(GROUP, F.when(~gone, F.col(GROUP)))
    return rest.unionByName(touched.select(*rest.columns))


def merge_groups(rows: DataFrame, groups: list[str]) -> DataFrame:
    """All of ``groups`` become the first; the others' primaries step down, scores stay."""
    if len(set(groups)) < 2:
        raise ValueError("merging takes two groups at least")
    moved = F.col(GROUP).isin(groups[1:])
    return rows.withColumn(PRIMARY, F.when(moved, False).otherwise(F.col(PRIMARY))).withColumn(GROUP, F.when(moved, groups[0]).otherwise(F.col(GROUP)))


def ingest_in_order(incoming: DataFrame, indexed: DataFrame, threshold: float = 0.99, k: int = 10, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Group changes as if the items of a batch were ingested one by one by id: ``id, duplicate_group_id, is_duplicate_primary, duplicate_score``.

    An item sees the indexed items and the smaller ids of its batch, with the groups they have by then: it joins the
    group of the first of its k best neighbours (search score of at least ``threshold``, ties by id) that has one, else it makes a
    group with the best. Only linked items depend on each other, so the fold runs per component. Every item of a batch
    with the same vector as a smaller one follows it: copies beyond the first k + 1 of a vector see k copies before them, of which the
    first has a group, so they are settled by a join and never enter a fold. A component of more than
    ``FOLD_EDGES`` links raises.
    """
    from lumenframe.operators.search import knn_blocks
    from lumenframe.plans.components import components_of

    kind = incoming.schema[id_col].dataType.simpleString()
    unit = F.transform(l2_normalize(F.col(vec)), lambda x: F.round(x, 12) + 0.0)
    alike = W.partitionBy("_h").orderBy(id_col)
    rows = incoming.where(F.col(vec).isNotNull()).withColumn("_h", F.xxhash64(unit)).withColumn("_copy", F.row_number().over(alike)).withColumn("_first", F.first(id_col).over(alike))
    rows = materialize(rows.select(id_col, vec, "_copy", "_first", "_h"), "ingest-batch")
    if not rows.where(F.col("_copy") > 1).isEmpty() and threshold > 1 - 1e-9:
        raise ValueError("a threshold of 1 leaves equal vectors to rounding")
    most = max(k, 2) + 1
    batch = rows.where(F.col("_copy") <= most)
    wanted = batch.select(F.col(id_col).alias("query_id"), F.col(vec).alias("query_vec"))
    known = indexed.select(id_col, vec, GROUP)
    old = knn_blocks(wanted, known, k, exclude_self=True, min_score=threshold, item_id=id_col, item_vec=vec, columns=[id_col, GROUP]).select("query_id", id_col, "score", GROUP)
    # Links inside the batch: pairs of blocks, not every pair of the batch in one task's reach.
    raw = similarity_edges(batch.select(id_col, vec), max(-1.0, 2 * threshold - 1 - 1e-9), id_col, vec)
    score = F.round((1 + F.col("score")) / 2, 12)
    fresh = raw.select(F.col("b").alias("query_id"), F.col("a").alias(id_col), score.alias("score"), F.lit(None).cast("string").alias(GROUP)).where(F.col("score") >= threshold)
    links = old.unionByName(fresh)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    links = links.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    links = materialize(links.select(F.col("query_id").alias("a"), F.col(id_col).alias("b"), "score", "rank", F.col(GROUP).alias("had")), "ingest-links")
    parts = materialize(components_of(links.select("a", "b")), "ingest-parts")
    node, part = parts.columns[:2]
    dealt = links.join(parts.select(F.col(node).alias("a"), F.col(part).alias("part")), "a")
    if not dealt.groupBy("part").count().where(F.col("count") > FOLD_EDGES).isEmpty():
        raise RuntimeError(f"a component of the batch has more than {FOLD_EDGES} links; ingest it in smaller batches")

    def fold(pdf):
        import pandas as pd

        had = {b: g for b, g in zip(pdf.b, pdf.had) if isinstance(g, str)}
        made: dict = {}  # id -> the item that made its group
        out = []
        for a, near in pdf.sort_values(["a", "rank"]).groupby("a", sort=True):
            ids, scores = list(near.b), list(near.score)
            into = next((b for b in ids if b in had or b in made), None)
            if into is None:
                made[a] = made[ids[0]] = a
                out += [(a, None, a, True, 1.0), (ids[0], None, a, False, scores[0])]
                continue
            if into in had:
                had[a] = had[into]
            else:
                made[a] = made[into]
            out.append((a, had.get(a), made.get(a), False, scores[0]))
        return pd.DataFrame(out, columns=["id", "had", "maker", PRIMARY, SCORE], dtype=object)

    done = dealt.groupBy("part").applyInPandas(fold, f"id {kind}, had string, maker {kind}, {PRIMARY} boolean, {SCORE} double")
    done = materialize(done.select("id", F.coalesce("had", stable_id("dup_", F.col("maker"))).alias(GROUP), PRIMARY, SCORE), "ingested")
    # Copies of higher number do what copy k + 1 did, whose neighbours are the copies before it.
    last = batch.where(F.col("_copy") == most).select("_h", F.col(id_col).alias("id")).join(done, "id").select("_h", GROUP, SCORE)
    rest = rows.where(F.col("_copy") > most).join(last, "_h").select(F.col(id_col).alias("id"), GROUP, F.lit(False).alias(PRIMARY), SCORE)
    return done.unionByName(rest)
