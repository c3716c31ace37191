"""Sampled content keys: a 128-bit hash of a file's size and at most three samples of its bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE, WHOLE = 16 << 10, 128 << 10
_MASK = (1 << 64) - 1
# Constants of MurmurHash3 for x64, 128 bits.
_C1, _C2, _M1, _M2 = 0x87C37B91114253D5, 0x4CF5AD432745937F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def _turn(x: int, by: int) -> int:
    return (x << by | x >> (64 - by)) & _MASK


def _finish(x: int) -> int:
    x = (x ^ x >> 33) * _M1 & _MASK
    x = (x ^ x >> 33) * _M2 & _MASK
    return x ^ x >> 33


def murmur128(data: bytes) -> tuple[int, int]:
    """MurmurHash3 (x64, 128 bits, seed 0). Multiplications and turns of the blocks are done for all at once; only the chain is a loop."""
    full = len(data) // 16
    words = np.frombuffer(data, "<u8", 2 * full).reshape(-1, 2)
    tail = data[16 * full :].ljust(16, b"\0")
    last = np.frombuffer(tail, "<u8").reshape(1, 2)
    both = np.concatenate([words, last])
    with np.errstate(over="ignore"):
        k1, k2 = both[:, 0] * np.uint64(_C1), both[:, 1] * np.uint64(_C2)
        k1 = (k1 << np.uint64(31) | k1 >> np.uint64(33)) * np.uint64(_C2)
        k2 = (k2 << np.uint64(33) | k2 >> np.uint64(31)) * np.uint64(_C1)
    h1 = h2 = 0
    for a, b in zip(k1[:full].tolist(), k2[:full].tolist()):
        h1 = ((_turn(h1 ^ a, 27) + h2) * 5 + 0x52DCE729) & _MASK
        h2 = ((_turn(h2 ^ b, 31) + h1) * 5 + 0x38495AB5) & _MASK
    h1, h2 = h1 ^ int(k1[full]) ^ len(data), h2 ^ int(k2[full]) ^ len(data)
    h1 = (h1 + h2) & _MASK
    h2 = (h2 + h1) & _MASK
    h1, h2 = _finish(h1), _finish(h2)
    h1 = (h1 + h2) & _MASK
    return h1, (h2 + h1) & _MASK


def content_key(data: bytes, sample: int = SAMPLE, whole: int = WHOLE) -> str:
    """Hex of 16 bytes: the size as a variable-length integer over the first bytes of the hash of the content, or of its head, middle and end."""
    size = len(data)
    if size >= whole and sample >= 1:
        data = data[:sample] + data[size // 2 : size // 2 + sample] + data[size - sample :]
    h1, h2 = murmur128(data)
    digest = h1.to_bytes(8, "big") + h2.to_bytes(8, "big")
    head = bytearray()
    while True:
        low, size = size & 0x7F, size >> 7
        head.append(low | (0x80 if size else 0))
        if not size:
            return (bytes(head) + digest[len(head) :]).hex()


def with_content_key(files: DataFrame, content: str = "content", out: str = "imohash", sample: int = SAMPLE, whole: int = WHOLE) -> DataFrame:
    """``files`` with the key of a binary (or text) column, which is dropped; null for null."""
    rest = [c for c in files.columns if c != content]
    rows = files.select(*rest, F.col(content).cast("binary").alias("_content"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [content_key(c.as_py(), sample, whole) if c.is_valid else None for c in batch.column(len(rest))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(keys, pa.string())], [*rest, out])

    return rows.mapInArrow(run, f"{schema}, `{out}` string")
