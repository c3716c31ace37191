"""The model boundary: encoders are pluggable, run as Arrow stages, and load once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Encoder(Protocol):
    """Turns a batch of contents into unit vectors."""

    dim: int

    def encode(self, contents: list) -> np.ndarray: ...


class HashEncoder:
    """Deterministic stand-in for a model: a seeded random unit vector for each content."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, contents: list) -> np.ndarray:
        import zlib

        raw = [np.random.default_rng(zlib.crc32(c if isinstance(c, bytes) else str(c).encode())).normal(size=self.dim) for c in contents]
        return np.stack([v / np.linalg.norm(v) for v in raw]) if raw else np.zeros((0, self.dim))


def encode(rows: DataFrame, id_col: str, content_col: str, factory: Callable[[], Encoder], batch: int = 64) -> DataFrame:
    """``(id, embedding)``; null contents give null. ``factory`` runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for record in batches:
            for at in range(0, record.num_rows, batch):
                part = record.slice(at, batch)
                contents = part.column(1).to_pylist()
                known = [i for i, c in enumerate(contents) if c is not None]
                vectors: list = [None] * len(contents)
                for i, v in zip(known, model.encode([contents[i] for i in known])):
                    vectors[i] = v.astype(np.float32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float32()))], [id_col, "embedding"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, content_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>")
