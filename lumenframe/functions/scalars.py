"""Scalar expressions: routing, ids, formats, boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.schema import CLASS_NAMES, PERSON_CLASS, VEHICLE_CLASSES


def category(class_id: Column) -> Column:
    """``person``, ``vehicle`` or ``other``."""
    return F.when(class_id == PERSON_CLASS, "person").when(class_id.isin(*VEHICLE_CLASSES), "vehicle").otherwise("other")


def class_name(class_id: Column) -> Column:
    """Known name, else ``class_<id>``."""
    out = F.concat(F.lit("class_"), class_id.cast("string"))
    for k, name in CLASS_NAMES.items():
        out = F.when(class_id == k, name).otherwise(out)
    return out


def stable_id(prefix: str, member: Column) -> Column:
    """A reproducible id: prefix and 12 hex digits of the member's hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(member.cast("string"), 256), 1, 12))


def ordinal_id(parent: Column, kind: str, ordinal: Column) -> Column:
    """``<parent>_<kind>_<ordinal>``."""
    return F.concat(parent, F.lit(f"_{kind}_"), ordinal.cast("string"))


def default_path(path: Column, image_id: Column) -> Column:
    return F.coalesce(F.nullif(path, F.lit("")), image_id)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def format_bytes(size: Column, largest: str = "PB") -> Column:
    """``12.3 MB``: steps of 1024, one decimal, no unit beyond ``largest``."""
    units = ("B", "KB", "MB", "GB", "TB", "PB")
    units = units[: units.index(largest) + 1]
    text = [F.format_string(f"%.1f {unit}", size / F.lit(1024.0**i)) for i, unit in enumerate(units)]
    out = text[-1]
    for i in reversed(range(len(units) - 1)):
        out = F.when(size / F.lit(1024.0**i) < 1024, text[i]).otherwise(out)
    return out


def format_duration(seconds: Column) -> Column:
    """``12.3s``, ``4.5m`` or ``1.2h``."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds)).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3.6e9)


def landmarks(flat: Column) -> Column:
    """Five named points from ten numbers; null with fewer."""
    names = ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")
    points = F.struct(*(F.slice(flat, 2 * i + 1, 2).alias(n) for i, n in enumerate(names)))
    return F.when(F.size(flat) >= 10, points)


def route_template(path: Column) -> Column:
    """Metric label of an unmatched path: its first two segments."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, 2), "/"))


# Class names of the detector by number.
COCO = (
    "person", "bicycle", "car", "motorcycle", "airplane", "bus", "train", "truck", "boat", "traffic light", "fire hydrant", "stop sign", "parking meter", "bench", "bird", "cat",
    "dog", "horse", "sheep", "cow", "elephant", "bear", "zebra", "giraffe", "backpack", "umbrella", "handbag", "tie", "suitcase", "frisbee", "skis", "snowboard", "sports ball",
    "kite", "baseball bat", "baseball glove", "skateboard", "surfboard", "tennis racket", "bottle", "wine glass", "cup", "fork", "knife", "spoon", "bowl", "banana", "apple",
    "sandwich", "orange", "broccoli", "carrot", "hot dog", "pizza", "donut", "cake", "chair", "couch", "potted plant", "bed", "dining table", "toilet", "tv", "laptop", "mouse",
    "remote", "keyboard", "cell phone", "microwave", "oven", "toaster", "sink", "refrigerator", "book", "clock", "vase", "scissors", "teddy bear", "hair drier", "toothbrush",
)


def detector_class(class_id: Column) -> Column:
    """Name of a detector class; ``class_<n>`` for a number without one, null for null."""
    named = F.get(F.array(*(F.lit(c) for c in COCO)), F.when(class_id.between(0, len(COCO) - 1), class_id))
    return F.coalesce(named, F.concat(F.lit("class_"), class_id.cast("string")))


def full_text(texts: Column) -> Column:
    """Texts of an image in their order, joined by spaces; null texts are skipped."""
    return F.array_join(texts, " ")


def sampled_hash(content: Column, sample: int = 16 << 10, whole: int = 128 << 10) -> Column:
    """Key of a content: the whole of a small one, else its size with ``sample`` bytes from its head, middle and tail. Hex of SHA-256."""
    size = F.octet_length(content)
    piece = lambda at: F.substring(content, at.cast("int"), F.lit(sample))
    parts = F.concat(size.cast("string").cast("binary"), piece(F.lit(1)).cast("binary"), piece(F.floor(F.length(content) / 2) + 1).cast("binary"), piece(F.greatest(F.length(content) - sample + 1, F.lit(1))).cast("binary"))
    return F.when(size < whole, F.sha2(content.cast("binary"), 256)).otherwise(F.sha2(parts, 256))
