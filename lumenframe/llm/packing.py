"""Sequence packing along a space-filling curve.

A document's token counts are hashed to ``HASHED`` signed buckets, projected to 3 dimensions and ordered by their
Hilbert key, so that neighbours on the curve have similar vocabulary. Documents follow each other along the curve and
are cut every ``length`` tokens; the rest at the end is cut into powers of two. No sequence needs padding.

Plan: one tokenisation; one shuffle of 16-bit ids to range buckets of the curve; a running sum in each bucket; the
buckets' totals (one number a bucket) go through the driver. There are as many buckets as the text's size asks for, one a
task. Their borders come from a documented sample of ``SAMPLE_PER_BUCKET`` documents a bucket, weighted by tokens; they
balance tasks and don't affect the order.

Defined results: null or empty text is the end id alone; repeated rows are packed each; ties on the curve are ordered
by a hash of the id, the id and the ids' bytes; an empty table gives no piece; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tokens import shared_encoder
from lumenframe.llm.tables import ranges, small_batches
from lumenframe.plans.storage import materialize

LENGTH = 4096
END_ID = 2
HASHED = 256
DIMS, BITS = 3, 16
SAMPLE_PER_BUCKET = 40


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of ``cells[n, dims]`` (unsigned, below 2^bits), by bit-plane rotation."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        p = q - one
        for i in range(n):
            set_ = (x[i] & q) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


class CurveOrder:
    """Order keys of documents: 48 bits of curve, 15 bits of a hash of the id."""

    def __init__(self, vocab: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, HASHED, vocab)
        self.sign = rng.choice([-1.0, 1.0], vocab)
        self.plane = rng.normal(size=(HASHED, DIMS)) / np.sqrt(HASHED)

    def vector(self, ids: np.ndarray) -> np.ndarray:
        h = np.bincount(self.bucket[ids], weights=self.sign[ids], minlength=HASHED)
        h = np.sign(h) * np.sqrt(np.abs(h))
        return h / max(np.linalg.norm(h), 1e-12)

    def keys(self, vectors: np.ndarray, ids: list) -> np.ndarray:
        low = np.arctan(vectors @ self.plane * 12) / np.pi + 0.5  # spread the middle over the grid
        cells = np.minimum(low * (1 << BITS), (1 << BITS) - 1).astype(np.uint64)
        salt = np.array([zlib.crc32(str(i).encode()) & 0x7FFF for i in ids], dtype=np.uint64)
        return ((hilbert_key(cells) << np.uint64(15)) | salt).astype(np.int64)


def _tokenise(path: str, borders: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        order = CurveOrder(encoder.vocab)
        for batch in batches:
            end = np.array([END_ID], encoder.dtype)
            ids = [np.concatenate([encoder.encode(t.as_py()), end]) for t in batch.column(1)]
            if not ids:
                continue
            keys = order.keys(np.stack([order.vector(x) for x in ids]), batch.column(0).to_pylist())
            if borders is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) for x in ids], pa.int64())], ["okey", "n"])
                continue
            buckets = np.searchsorted(borders, keys, side="right").astype(np.int32)
            wide = [x.astype("<u2") if encoder.dtype.itemsize == 2 else x for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets), pa.array(keys), batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in wide], pa.binary())],
                ["bucket", "okey", "doc_id", "n", "ids"],
            )

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each document's start in its bucket; rows come sorted by bucket and key."""
    last, total = None, 0
    for batch in batches:
        starts = []
        for bucket, n in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if bucket != last:
                last, total = bucket, 0
            starts.append(total)
            total += n
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts, pa.int64()), batch.column(2), batch.column(3), batch.column(4)], ["bucket", "start", "doc_id", "n", "ids"])


def cut_points(total: int, length: int) -> np.ndarray:
    """Starts of the sequences after the last full one: the rest cut into powers of two, largest first."""
    at, rest = total - total % length, total % length
    out = []
    for b in range(length.bit_length(), -1, -1):
        if rest >> b & 1:
            out.append(at)
            at += 1 << b
    return np.array(out, dtype=np.int64)


def _cut(base: dict[int, int], total: int, length: int):
    full, tail = total // length, cut_points(total, length)
    ends = np.append(tail[1:], total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for bucket, start, doc, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                at, done = base[bucket] + start, 0
                while done < n:
                    g = at + done
                    if g < full * length:
                        seq, offset, end = g // length, g % length, (g // length + 1) * length
                    else:
                        i = int(np.searchsorted(tail, g, side="right")) - 1
                        seq, offset, end = full + i, g - int(tail[i]), int(ends[i])
                    size = min(n - done, end - g)
                    out.append((doc, done, size, zlib.crc32(ids[done : done + size].tobytes()), n, seq, offset))
                    done += size
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.column(2).type), *(pa.array(c, pa.int64()) for c in cols[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def even_borders(sample: list[tuple[int, int]], buckets: int) -> np.ndarray:
    """Keys that cut the sampled ``(key, tokens)`` into ``buckets`` ranges of about the same tokens."""
    if not sample:
        return np.zeros(0, np.int64)
    keys, tokens = (np.array(x, np.int64) for x in zip(*sorted(sample)))
    ends = np.cumsum(tokens)
    at = np.searchsorted(ends, ends[-1] * np.arange(1, buckets) / buckets)
    return np.unique(keys[at])


def packed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Stored table ``(bucket, start, doc_id, n, ids)``: documents with their ids (little-endian) along the curve."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    n, buckets = ranges(rows, "text")
    share = min(1.0, SAMPLE_PER_BUCKET * buckets / max(1, n))
    keys = rows.sample(fraction=share, seed=1).mapInArrow(small_batches(_tokenise(tokenizer, None)), "okey long, n long")
    borders = even_borders([(r.okey, r.n) for r in keys.collect()], buckets)
    rows = rows.mapInArrow(small_batches(_tokenise(tokenizer, borders)), f"bucket int, okey long, doc_id {kind}, n long, ids binary")
    rows = rows.repartitionById(len(borders) + 1, "bucket").sortWithinPartitions("bucket", "okey", "doc_id", "ids")
    return materialize(rows.mapInArrow(small_batches(_running), f"bucket int, start long, doc_id {kind}, n long, ids binary"), "packing")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", length: int = LENGTH) -> DataFrame:
    """Pieces ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of sequences of ``length`` tokens."""
    stored = packed_documents(docs, id_col, text_col, tokenizer)
    kind = stored.schema["doc_id"].dataType.simpleString()
    totals = sorted((r.bucket, r.tokens) for r in stored.groupBy("bucket").agg(F.sum("n").alias("tokens")).collect())
    base, total = {}, 0
    for bucket, tokens in totals:
        base[bucket], total = total, total + tokens
    return stored.mapInArrow(small_batches(_cut(base, total, length)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
