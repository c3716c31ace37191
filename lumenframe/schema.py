"""Table schemas of the engine and its fixed classes."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _F, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.FloatType(), T.BooleanType(), T.TimestampType()
_VEC = T.ArrayType(_F, False)
_META = T.MapType(_S, _S)


def _table(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


_CLUSTER = {"cluster_id": _I, "cluster_distance": _F}
_STAMPS = {"metadata": _META, "indexed_at": _TS, "clustered_at": _TS}
_POINT = T.ArrayType(_F)
LANDMARKS = T.StructType([T.StructField(n, _POINT) for n in ("left_eye", "right_eye", "nose", "left_mouth", "right_mouth")])

GLOBAL = _table(image_id=_S, image_path=_S, global_embedding=_VEC, **_CLUSTER, width=_I, height=_I, **_STAMPS, imohash=_S, file_size_bytes=_L, duplicate_group_id=_S, is_duplicate_primary=_B, duplicate_score=_F)
VEHICLES = _table(detection_id=_S, image_id=_S, image_path=_S, embedding=_VEC, **_CLUSTER, box=_POINT, class_id=_I, class_name=_S, confidence=_F, **_STAMPS)
PEOPLE = _table(detection_id=_S, image_id=_S, image_path=_S, embedding=_VEC, **_CLUSTER, box=_POINT, confidence=_F, has_face=_B, face_id=_S, **_STAMPS)
FACES = _table(
    face_id=_S, image_id=_S, image_path=_S, person_detection_id=_S, embedding=_VEC, **_CLUSTER, box=_POINT, landmarks=LANDMARKS, confidence=_F, quality_score=_F, person_id=_S, person_name=_S,
    is_reference=_B, **_STAMPS, thumbnail_b64=_S, cluster_assigned_at=_TS, merged_from=_S, merged_at=_TS, named_at=_TS, updated_at=_TS,
)
OCR = _table(ocr_id=_S, image_id=_S, image_path=_S, text=_S, text_raw=_S, box=_POINT, box_normalized=_POINT, det_score=_F, rec_score=_F, language=_S, metadata=_META, indexed_at=_TS, full_text=_S)
TABLES = {"global": GLOBAL, "vehicles": VEHICLES, "people": PEOPLE, "faces": FACES, "ocr": OCR}
KEYS = {"global": "image_id", "vehicles": "detection_id", "people": "detection_id", "faces": "face_id", "ocr": "ocr_id"}

# Detector classes that the router keeps, and their names.
PERSON_CLASS = 0
VEHICLE_CLASSES = (2, 3, 5, 7, 8)
CLASS_NAMES = {0: "person", 2: "car", 3: "motorcycle", 5: "bus", 7: "truck", 8: "boat"}
# Default clusters, probes and growth threshold of each vector table.
CLUSTER_DEFAULTS = {"global": (1024, 32), "vehicles": (512, 24), "people": (512, 24), "faces": (2048, 64)}


def index_name(name: str) -> str:
    """A vector table's name, case-folded; anything else is an error."""
    if (folded := name.strip().lower()) not in CLUSTER_DEFAULTS:
        raise ValueError(f"unknown vector table {name!r}; one of {', '.join(CLUSTER_DEFAULTS)}")
    return folded
