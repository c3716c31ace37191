"""Box and tensor algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.functions.scalars import clamp


def letterbox(width: Column, height: Column, size: int = 640) -> dict[str, Column]:
    """``scale, pad_x, pad_y`` of fitting an image into a square without enlarging it; sides round half to even."""
    scale = F.least(F.lit(float(size)) / F.greatest(width, height), F.lit(1.0))
    pad = lambda side: (F.lit(float(size)) - F.bround(side * scale, 0)) / 2
    return {"scale": scale, "pad_x": pad(width), "pad_y": pad(height)}


def inverse_letterbox(value: Column, pad: Column, scale: Column, side: Column, pixels: Column, size: int = 640) -> Column:
    """A letterbox coordinate as a share of the original side. ``pixels``: the image's boxes are in pixels already."""
    in_pixels = F.when(pixels, value).otherwise(value * size)
    return clamp((in_pixels - pad) / scale / side, 0.0, 1.0)


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of two (x1, y1, x2, y2); 0 without a union."""
    inter = box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = box_area(*a) + box_area(*b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def valid_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """In [0, 1] and not empty after truncation to pixels."""
    inside = (x1 >= 0) & (y1 >= 0) & (x2 <= 1) & (y2 <= 1) & (x1 <= 1) & (y1 <= 1) & (x2 >= 0) & (y2 >= 0)
    pixel = lambda v, side: (v * side).cast("int")
    return inside & (pixel(x2, width) > pixel(x1, width)) & (pixel(y2, height) > pixel(y1, height))


def face_quality(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> Column:
    """Size (10 x its share of the image, at most 1), 0.8 near an edge, and squareness."""
    w, h = x2 - x1, y2 - y1
    size = F.least(10 * w * h / (width * height), F.lit(1.0))
    edge = (x1 < 0.02 * width) | (y1 < 0.02 * height) | (x2 > 0.98 * width) | (y2 > 0.98 * height)
    return clamp(size * F.when(edge, 0.8).otherwise(1.0) * (F.least(w, h) / (F.greatest(w, h) + 1e-6)), 0.0, 1.0)


def quad_area(xs: list[Column], ys: list[Column]) -> Column:
    """Shoelace area."""
    n = len(xs)
    return F.abs(sum((xs[i] * ys[(i + 1) % n] - xs[(i + 1) % n] * ys[i] for i in range(n)), F.lit(0.0))) / 2


def perimeter(xs: list[Column], ys: list[Column]) -> Column:
    n = len(xs)
    return sum((F.sqrt(F.pow(xs[(i + 1) % n] - xs[i], 2) + F.pow(ys[(i + 1) % n] - ys[i], 2)) for i in range(n)), F.lit(0.0))


def unclip_distance(xs: list[Column], ys: list[Column], ratio: float = 1.5) -> Column:
    """How far a text region is grown: area x ratio / perimeter."""
    length = perimeter(xs, ys)
    return F.when(length > 0, quad_area(xs, ys) * ratio / length).otherwise(0.0)


def order_quad(points: Column) -> Column:
    """Corners from array<struct<x, y>>: top-left, top-right, bottom-right, bottom-left."""
    by = lambda f: F.get(F.array_sort(points, lambda a, b: F.when(f(a) < f(b), -1).when(f(a) > f(b), 1).otherwise(0)), F.lit(0))
    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(by(total), by(diff), by(lambda p: -total(p)), by(lambda p: -diff(p)))


def recognition_width(width: Column, height: Column) -> Column:
    """Input width of a 48-high text line, 8 to 2048."""
    return clamp(F.ceil(48.0 * width / height), 8, 2048)


def ocr_input(width: Column, height: Column) -> tuple[Column, Column]:
    """Input size of text detection: longest side within 640..960, each side at least 32 and a multiple of 32."""
    longest = F.greatest(width, height)
    scale = F.when(longest > 960, 960.0 / longest).when(longest < 640, 640.0 / longest).otherwise(1.0)
    padded = lambda side: (F.ceil(F.greatest((side * scale).cast("int"), F.lit(32)) / 32) * 32).cast("int")
    return padded(width), padded(height)


def distance_to_box(cx: Column, cy: Column, left: Column, top: Column, right: Column, bottom: Column) -> tuple:
    """Anchor distances to corners."""
    return cx - left, cy - top, cx + right, cy + bottom


def distance_to_points(cx: Column, cy: Column, offsets: list[Column]) -> list[tuple[Column, Column]]:
    """Key points from offsets ``dx, dy`` in turn, as seen from an anchor centre."""
    return [(cx + offsets[i], cy + offsets[i + 1]) for i in range(0, len(offsets), 2)]


def center_crop(width: Column, height: Column, size: int = 256) -> dict[str, Column]:
    """Shortest edge resized to ``size`` (sizes cut to whole pixels), then the window in the middle."""
    scale = F.lit(size) / F.least(width, height)
    w, h = F.floor(width * scale), F.floor(height * scale)
    return {"new_width": w, "new_height": h, "crop_x": F.floor((w - size) / 2), "crop_y": F.floor((h - size) / 2)}


def shrink_to(width: Column, height: Column, most: int = 1920) -> dict[str, Column]:
    """The longest edge brought down to ``most``, never up; halves go to the even side."""
    scale = F.least(F.lit(most) / F.greatest(width, height), F.lit(1.0))
    return {"new_width": F.bround(width * scale).cast("int"), "new_height": F.bround(height * scale).cast("int")}


def valid_size(width: Column, height: Column, least: int = 16, most: int = 16384) -> Column:
    """Both edges within the limits of a decodable image; an unknown edge is not."""
    return F.coalesce(F.least(width, height) >= least, F.lit(False)) & F.coalesce(F.greatest(width, height) <= most, F.lit(False)) & width.isNotNull() & height.isNotNull()


def needs_resize(width: Column, height: Column, most: int = 1024, model: int = 640) -> Column:
    """Larger than ``most``, and not below what a model takes."""
    longest = F.greatest(width, height)
    return (longest > most) & (longest >= model)


def quad_box(xs: list[Column], ys: list[Column], width: Column, height: Column) -> list[Column]:
    """Axis-aligned box of a quadrilateral, as shares of the image."""
    return [F.least(*xs) / width, F.least(*ys) / height, F.greatest(*xs) / width, F.greatest(*ys) / height]


def quad_crop(xs: list[Column], ys: list[Column]) -> dict[str, Column]:
    """Whole-pixel size of a text crop (the longer of opposite edges), whether it is 3 pixels at least, and turned if it is tall."""
    edge = lambda i, j: F.sqrt(F.pow(xs[i] - xs[j], 2) + F.pow(ys[i] - ys[j], 2))
    w, h = F.floor(F.greatest(edge(0, 1), edge(2, 3))), F.floor(F.greatest(edge(0, 3), edge(1, 2)))
    return {"crop_width": w, "crop_height": h, "kept": (w >= 3) & (h >= 3), "turned": (w >= 3) & (h >= 3) & (h >= 1.5 * w)}


def unclip_box(x1: Column, y1: Column, x2: Column, y2: Column, scale_x: Column, scale_y: Column, ratio: float = 1.5, least: float = 3.0) -> dict[str, Column]:
    """A text box after its contour: grown on all sides by area x ratio / perimeter, scaled to the image; ``kept`` if its short side is long enough."""
    w, h = x2 - x1, y2 - y1
    grow = F.coalesce(w * h * ratio / F.nullif(2 * (w + h), F.lit(0.0)), F.lit(0.0))
    return {"x1": (x1 - grow) * scale_x, "y1": (y1 - grow) * scale_y, "x2": (x2 + grow) * scale_x, "y2": (y2 + grow) * scale_y, "kept": (F.least(w, h) >= least) & (F.least(w, h) + 2 * grow >= least + 2)}
