"""Token ids as byte-aligned variable-length integers with separate control bytes.

Ids are replaced by their frequency rank over the whole corpus (most frequent: 0), so the common half of a text takes one
byte an id. A block holds consecutive documents in ascending doc_id order:

    magic ``LFV1`` | documents u32 | ids u64 | doc ids i64[] | null mask u8[] | lengths u64[] | control bytes | data bytes

A control byte has two bits for each of four ids: their bytes less one. Data bytes are the ids' low bytes. Decoding looks
up a control byte's four lengths in a 256 x 4 table and gathers the bytes with numpy; no loop over ids.

Blocks are written by Spark's committer into a Parquet container (one binary column), so a retried task leaves no half
file and any store that Spark writes will do. ``dictionary`` beside it maps ranks to ids.

Defined results: null or empty text is the end id alone; ids are numbers or text that reads as one (others raise), null
ones come first; repeated rows are kept, ordered by their
ids' bytes; an empty table gives an empty container; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.tokens import shared_encoder
from lumenframe.llm.tables import range_count, small_batches
from lumenframe.plans.storage import materialize, scratch_path

END_ID = 2
MAGIC = b"LFV1"
#: A block is closed once it holds so many ids.
BLOCK_IDS = 1 << 18
#: Quantiles of doc_id that the pass over the texts' sizes takes along; more ranges need a pass of their own.
FINE = 1000

_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    v = np.ascontiguousarray(values, dtype="<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    four = np.zeros(-(-len(v) // 4) * 4, dtype=np.uint8)
    four[: len(v)] = size - 1
    four = four.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values again, by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:count]
    at = np.cumsum(size) - size
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype("<u4") if count else np.zeros(0, "<u4")
    for b in (1, 2, 3):
        more = size > b
        out[more] |= raw[at[more] + b].astype("<u4") << np.uint32(8 * b)
    return out


def write_block(doc_ids: list, lengths: list[int], values: np.ndarray) -> bytes:
    control, data = encode_values(values)
    null = np.array([d is None for d in doc_ids], np.uint8)
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<IQ", len(doc_ids), len(values)), ids.tobytes(), null.tobytes(), np.array(lengths, "<u8").tobytes(), control, data])


def read_block(blob: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(doc ids, lengths, values) of one block."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, count = struct.unpack_from("<IQ", blob, 4)
    at = 16
    ids = np.frombuffer(blob, "<i8", docs, at).tolist()
    null = np.frombuffer(blob, np.uint8, docs, at + 8 * docs)
    lengths = np.frombuffer(blob, "<u8", docs, at + 9 * docs).astype(np.int64)
    at += 17 * docs
    mid = at + -(-count // 4)
    return [None if z else i for i, z in zip(ids, null)], lengths, decode_values(blob[at:mid], blob[mid:], count)


def _tokenise(path: str, borders: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            end = np.array([END_ID], encoder.dtype)
            ids = [np.concatenate([encoder.encode(t.as_py()), end]).tobytes() for t in batch.column(1)]
            docs = batch.column(0)
            buckets = np.searchsorted(borders, docs.fill_null(0).to_numpy(zero_copy_only=False), side="right") + 1
            buckets[np.array(docs.is_null())] = 0
            yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), docs, pa.array(ids, pa.binary())], ["bucket", "doc_id", "ids"])

    return run


def _blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Closes a block at ``BLOCK_IDS`` ids or a new bucket; ``start`` counts the bucket's ids before it."""
        bucket, start, docs, parts = None, 0, [], []

        def close():
            nonlocal start, docs, parts
            lengths = [len(p) // width for p in parts]
            row = pa.RecordBatch.from_arrays(
                [pa.array([bucket], pa.int32()), pa.array([start], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([b"".join(parts)], pa.binary())],
                ["bucket", "start", "docs", "lengths", "ids"],
            )
            start, docs, parts = start + sum(lengths), [], []
            return row

        size = 0
        for batch in batches:
            for b, d, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if parts and (b != bucket or size >= BLOCK_IDS):
                    yield close()
                    size = 0
                if b != bucket:
                    bucket, start = b, 0
                docs.append(d)
                parts.append(raw)
                size += len(raw) // width
        if parts:
            yield close()

    return run


def _count(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                n = np.bincount(np.frombuffer(raw.as_py(), f"<u{width}"), minlength=len(total))
                n[: len(total)] += total
                total = n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])

    return run


def _encode(width: int, rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, start, docs, lengths, raw in zip(*(c.to_pylist() for c in batch.columns)):
                blob = write_block(docs, lengths, rank[np.frombuffer(raw, f"<u{width}")])
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([start], pa.int64()), pa.array([sum(lengths)], pa.int64()), pa.array([blob], pa.binary())], ["bucket", "start", "n", "block"])

    return run


def write_token_file(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> None:
    """Encode whole texts and write ``path/blocks`` and ``path/dictionary``.

    One tokenisation and one shuffle of 16-bit ids to doc_id ranges; the ranges are percentiles of doc_id, one a task, as many as
    the text's size asks for. The driver sees the range borders and one count for each entry of the vocabulary.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    quantiles = lambda n: F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10 * n)
    total = rows.agg(quantiles(FINE).alias("fine"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, fine = range_count(spark, total.bytes), total.fine or []
    if n <= FINE:
        borders = [fine[i * FINE // n - 1] for i in range(1, n)] if fine else []
    else:
        borders = rows.agg(quantiles(n)).first()[0] or []
    encoder = shared_encoder(tokenizer)
    width = encoder.dtype.itemsize
    tokens = rows.mapInArrow(small_batches(_tokenise(tokenizer, sorted(set(borders)))), "bucket int, doc_id long, ids binary")
    tokens = tokens.repartitionById(n + 1, "bucket").sortWithinPartitions("bucket", F.asc_nulls_first("doc_id"), "ids")
    blocks = materialize(tokens.mapInArrow(_blocks(width), "bucket int, start long, docs array<long>, lengths array<long>, ids binary"), "token-blocks")
    counts = blocks.select("ids").mapInArrow(small_batches(_count(width)), "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = [r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))]
    rank = np.zeros(encoder.vocab, "<u4")
    rank[order] = np.arange(len(order))
    blocks.mapInArrow(small_batches(_encode(width, rank)), "bucket int, start long, n long, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(i, int(x)) for i, x in enumerate(order)], "rank int, id int").coalesce(1).write.parquet(f"{path}/dictionary")


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (little-endian u32 bytes) of every document in the file at ``path``."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.array([r.id for r in spark.read.parquet(f"{path}/dictionary").orderBy("rank").collect()], "<u4")
    base, total = {}, 0
    for r in sorted(blocks.groupBy("bucket").agg(F.sum("n").alias("n")).collect()):
        base[r.bucket], total = total, total + r.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, start, blob in zip(*(c.to_pylist() for c in batch.columns)):
                docs, lengths, values = read_block(blob)
                ids = order[values] if len(values) else values
                ends = np.cumsum(lengths)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends, lengths)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base[bucket] + start + ends - lengths), pa.array(lengths), pa.array(parts, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return blocks.select("bucket", "start", "block").mapInArrow(small_batches(decode), "doc_id long, start long, n_tokens long, ids binary")


def token_digest(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Write the file in the shared folder, read it back and digest each document's ids."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write_token_file(docs, path, tokenizer=tokenizer)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
