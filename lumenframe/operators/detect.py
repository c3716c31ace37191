"""Detection post-processing: suppression, matching, anchor decoding, text decoding, reading order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.functions.geometry import distance_to_points, iou
from lumenframe.plans.storage import materialize


def suppressed(group: np.ndarray, boxes: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows stay of groups that stand together, best first: a box goes if its overlap with a kept one of its group is over ``threshold``.

    All groups advance at once: each round keeps the first box that is left of every group and drops what it covers.
    """
    area = np.maximum(boxes[:, 2] - boxes[:, 0], 0) * np.maximum(boxes[:, 3] - boxes[:, 1], 0)
    keep, left = np.zeros(len(group), bool), np.arange(len(group))
    while len(left):
        first = _starts(group[left])
        keep[left[first]] = True
        i, rest = left[first][np.cumsum(first) - 1][~first], left[~first]
        w = np.maximum(np.minimum(boxes[i, 2], boxes[rest, 2]) - np.maximum(boxes[i, 0], boxes[rest, 0]), 0)
        h = np.maximum(np.minimum(boxes[i, 3], boxes[rest, 3]) - np.maximum(boxes[i, 1], boxes[rest, 1]), 0)
        union = area[i] + area[rest] - w * h
        over = np.divide(w * h, union, out=np.zeros_like(union, dtype=float), where=union > 0)
        left = rest[over <= threshold]
    return keep


def _starts(group: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(group)), bool), group[1:] != group[:-1]])


def _codes(values: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Small numbers that are equal where the values are."""
    return np.asarray(values.dictionary_encode(null_encoding="encode").indices)


def _within_groups(rows: DataFrame, key: str, order: list, pick: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows that ``pick`` chooses (a mask) of whole bounded groups in ``order``, many groups a call: it is given their rows and which group each is of.

    The window shuffles and sorts, but only what is not yet dealt by ``key``. A group that reaches over Arrow batches waits for its end.
    """
    columns = rows.columns
    numbered = rows.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy(*order)))

    def chosen(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts):
            batch = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
            group = np.cumsum(batch.column("_r").to_numpy() == 1)
            yield batch.select(columns).filter(pa.array(pick(batch, group)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_r").to_numpy() == 1)
            if len(begins):
                yield from chosen([*held, batch.slice(0, int(begins[-1]))])
                held = []
            held.append(batch.slice(int(begins[-1])) if len(begins) else batch)
        yield from chosen(held)

    return numbered.mapInArrow(run, rows.schema)


def _numbers(batch: pa.RecordBatch, *names: str) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(c).to_numpy(zero_copy_only=False), float) for c in names])


def nms(detections: DataFrame, threshold: float = 0.4, min_score: float = 0.0, per_class: bool = True, cap: int = 300) -> DataFrame:
    """Greedy suppression in each image (and class). One image's boxes are a bounded group: the detector gives at most a few hundred."""
    rows = detections.where(F.col("confidence") >= min_score)

    def pick(batch: pa.RecordBatch, image: np.ndarray) -> np.ndarray:
        kind = _codes(batch.column("class_id")) if per_class else np.zeros(len(image), int)
        scores = _numbers(batch, "confidence")[:, 0]
        best = np.lexsort((np.arange(len(image)), -scores, kind, image))
        group = np.cumsum(_starts(image[best]) | _starts(kind[best]))
        keep = np.zeros(len(image), bool)
        keep[best] = suppressed(group, _numbers(batch, "x1", "y1", "x2", "y2")[best], threshold)
        place = np.cumsum(keep)  # among the kept ones, less those of the images before
        return keep & (place - np.maximum.accumulate(np.where(_starts(image), place - keep, 0)) <= cap)

    return _within_groups(rows, "image_id", [F.desc("confidence"), F.col("box_index")], pick)


def _centre_gap(a: str, b: str):
    centre = lambda p, c: (F.col(f"{p}_{c}1") + F.col(f"{p}_{c}2")) / 2
    return F.sqrt(F.pow(centre(a, "x") - centre(b, "x"), 2) + F.pow(centre(a, "y") - centre(b, "y"), 2))


def match_detections(reference: DataFrame, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one matching in reference order: each takes the unused test box of its class with the largest overlap (first wins).

    The overlap join is by image, so that sides which are dealt by image meet where they are; only pairs over the threshold reach the sequential part.
    """
    a = reference.select("image_id", F.col("class_id").alias("r_class"), F.col("box_index").alias("ref"), *(F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2", "confidence")))
    b = test.select("image_id", F.col("class_id").alias("t_class"), F.col("box_index").alias("test"), *(F.col(c).alias(f"t_{c}") for c in ("x1", "y1", "x2", "y2", "confidence")))
    box = lambda p: tuple(F.col(f"{p}_{c}") for c in ("x1", "y1", "x2", "y2"))
    # The class is no key of the join: as one it would have both sides shuffled and sorted anew.
    overlap = F.when(F.col("r_class") == F.col("t_class"), iou(box("r"), box("t")))
    pairs = a.join(b, "image_id").withColumn("iou", overlap).where(F.col("iou") >= threshold).select("image_id", "ref", "test", "iou", F.abs(F.col("r_confidence") - F.col("t_confidence")).alias("gap"), _centre_gap("r", "t").alias("shift"))

    def pick(batch: pa.RecordBatch, image: np.ndarray) -> np.ndarray:
        ref, test = _codes(batch.column("ref")), _codes(batch.column("test"))
        keep, left = np.zeros(len(image), bool), np.arange(len(image))
        while len(left):  # the first pair that is left of every image is taken
            first = _starts(image[left])
            keep[left[first]] = True
            i, rest = left[first][np.cumsum(first) - 1][~first], left[~first]
            left = rest[(ref[rest] != ref[i]) & (test[rest] != test[i])]
        return keep

    return _within_groups(pairs, "image_id", [F.col("ref"), F.desc("iou"), F.col("test")], pick)


def comparison_metrics(matches: DataFrame, n_reference: int, n_test: int) -> DataFrame:
    """precision, recall, f1, mean IoU, mean confidence gap and mean distance of the centres, zero-guarded."""
    m = matches.agg(F.count("*").alias("matched"), F.coalesce(F.avg("iou"), F.lit(0.0)).alias("mean_iou"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("mean_gap"), F.coalesce(F.avg("shift"), F.lit(0.0)).alias("mean_shift"))
    p, r = F.col("matched") / float(max(1, n_test)), F.col("matched") / float(max(1, n_reference))
    return m.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


def decode_anchors(outputs: DataFrame, scale: float = 1.0, size: int = 640, min_score: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Face boxes from anchor outputs ``(image_id, stride, idx, score, left, top, right, bottom)`` with the columns ``keep``; two anchors a cell."""
    width = F.lit(size) / F.col("stride")
    cell = F.floor(F.col("idx") / 2)
    cx, cy = (cell % width) * F.col("stride"), F.floor(cell / width) * F.col("stride")
    d = [F.col(c) * F.col("stride") for c in ("left", "top", "right", "bottom")]
    rows = outputs.where(F.col("score") >= min_score)
    return rows.select("image_id", "stride", "idx", F.col("score").alias("confidence"), ((cx - d[0]) / scale).alias("x1"), ((cy - d[1]) / scale).alias("y1"), ((cx + d[2]) / scale).alias("x2"), ((cy + d[3]) / scale).alias("y2"), *keep)


def ctc_decode(steps: DataFrame, dictionary: list[str], key: str = "line_id") -> DataFrame:
    """Greedy decoding of ``(key, t, symbol, prob)``: blanks (0) and repeats go, ``text`` and mean ``confidence`` stay."""
    w = W.partitionBy(key).orderBy("t")
    kept = steps.withColumn("_before", F.lag("symbol", 1, 0).over(w)).withColumn("_keep", (F.col("symbol") != 0) & (F.col("symbol") != F.col("_before")))
    table = F.array(F.lit(""), *(F.lit(c) for c in dictionary))
    shown = F.when(F.col("_keep"), F.struct("t", F.get(table, F.col("symbol")).alias("c")))
    out = kept.groupBy(key).agg(F.array_sort(F.collect_list(shown)).alias("s"), F.coalesce(F.avg(F.when(F.col("_keep"), F.col("prob"))), F.lit(0.0)).alias("confidence"))
    return out.select(key, F.array_join(F.col("s.c"), "").alias("text"), "confidence")


def reading_order(boxes: DataFrame, gap: float = 10.0, key: str = "image_id") -> DataFrame:
    """``line`` and ``position``: boxes by y; a step of at least ``gap`` starts a line; inside a line by x."""
    by_y = W.partitionBy(key).orderBy("y", "x", "box_index")
    new = F.when(F.coalesce(F.abs(F.col("y") - F.lag("y").over(by_y)) >= gap, F.lit(False)), 1).otherwise(0)
    lined = boxes.withColumn("_new", new).withColumn("line", F.sum("_new").over(by_y.rowsBetween(W.unboundedPreceding, 0))).drop("_new")
    return lined.withColumn("position", F.row_number().over(W.partitionBy(key).orderBy("line", "x", "y", "box_index")))


def similarity_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The 2 x 3 least-squares rotation, scale and shift that takes ``source`` points to ``target`` (Umeyama 1991)."""
    ms, mt = source.mean(axis=0), target.mean(axis=0)
    s, t = source - ms, target - mt
    u, d, vt = np.linalg.svd(t.T @ s / len(source))
    flip = np.array([1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    rotation = (u * flip) @ vt
    scale = float((d * flip).sum() / max(s.var(axis=0).sum(), 1e-12))
    return np.column_stack([scale * rotation, mt - scale * rotation @ ms])


def unmatched(reference: DataFrame, test: DataFrame, matches: DataFrame) -> DataFrame:
    """Boxes of either side without a match: ``side, image_id, box_index, class_id``.

    The matches are made once, for both sides. A box meets those of its image, so that a side which is dealt by image stays where it is.
    """
    made = materialize(matches.select("image_id", "ref", "test"), "matches")

    def left(rows: DataFrame, side: str, name: str) -> DataFrame:
        taken = made.select(F.col("image_id").alias("_image"), F.col(name).alias("_box"))
        same = (F.col("image_id") == F.col("_image")) & F.coalesce(F.col("box_index") == F.col("_box"), F.lit(False))
        # Stored ids are packed so small that they would pass for a table to broadcast.
        return rows.join(taken.hint("shuffle_hash"), same, "left_anti").select(F.lit(side).alias("side"), "image_id", "box_index", "class_id")

    return left(reference, "reference", "ref").unionByName(left(test, "test", "test"))


def explode_fused(images: DataFrame, column: str = "output", min_score: float = 0.25, cap: int = 300) -> DataFrame:
    """Detections of fused rows ``[x1, y1, x2, y2, score, class]``: ``image_id, box_index, x1 ... confidence, class_id``, at most ``cap`` an image."""
    rows = images.select("image_id", F.posexplode(F.slice(column, 1, cap)).alias("box_index", "d")).where(F.get("d", F.lit(4)) >= min_score)
    return rows.select("image_id", "box_index", *(F.get("d", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "confidence"))), F.get("d", F.lit(5)).cast("int").alias("class_id"))


def detector_layout(columns: list[str]) -> str:
    """Which adapter reads a detector's outputs: ``four`` arrays, or one ``fused`` array; others raise."""
    if {"num_dets", "det_boxes", "det_scores", "det_classes"} <= set(columns):
        return "four"
    if "output" in columns:
        return "fused"
    raise ValueError(f"no adapter reads the outputs {sorted(columns)}")


def decode_faces(outputs: DataFrame, scale: float = 1.0, size: int = 640, min_score: float = 0.5, threshold: float = 0.4, cap: int = 128) -> DataFrame:
    """Faces from anchor outputs with ten key point offsets in ``kps``: decoded, suppressed per image, the best ``cap`` kept.

    A face's points are those of its own output, also where an anchor has several.
    """
    width, cell = F.lit(size) / F.col("stride"), F.floor(F.col("idx") / 2)
    cx, cy = (cell % width) * F.col("stride"), F.floor(cell / width) * F.col("stride")
    points = distance_to_points(cx, cy, [F.get("kps", F.lit(i)) * F.col("stride") for i in range(10)])
    marked = outputs.withColumn("landmarks", F.array(*(F.array(x / scale, y / scale) for x, y in points)))
    rows = decode_anchors(marked, scale, size, min_score, keep=("landmarks",)).withColumn("class_id", F.lit(0)).withColumn("box_index", (F.col("stride") * 1_000_000 + F.col("idx")).cast("long"))
    return nms(rows, threshold, min_score, per_class=False, cap=cap)
