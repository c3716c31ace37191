"""SimHash near-duplicates by anchor-point covering.

Fingerprint: ASCII letters lower-cased, words split at ASCII white space, 3-word shingles with repeats, XXH64 seed 42,
a bit is 1 if set in over half of the shingle hashes.

Search: two fingerprints that differ in at most 3 of 64 bits differ in at most 1 bit in one of the two 32-bit halves.
The anchors of a half are the 2^27 words (c, b) of a perfect [31, 26] Hamming code c and a free bit b: a covering code
of radius 1. A fingerprint is at home at its nearest anchor and is replicated to every anchor within covering radius
plus threshold (1 + 1 = 2), 17 of them. So whichever half is near, one of the two meets the other at its home anchor.
Fingerprints are compared per anchor only, and each anchor gives a spanning forest of its links instead of all pairs.
Anchors that are home to more than ``CHUNK`` fingerprints are split exactly: their homes are dealt to chunks and their
replicas go to every chunk.

Defined results: null or blank text has fingerprint zero and links like any other; repeated rows are kept; a null
doc_id keeps its fingerprint and takes the component of its class; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches
from lumenframe.plans.components import connected_components
from lumenframe.plans.storage import broadcast_if_small, materialize

THRESHOLD = 3
#: Homes of an anchor that one task compares.
CHUNK = 20_000


def simhash64(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < 3 else map(b" ".join, zip(words, words[1:], words[2:]))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, 42) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((simhash64(t.as_py()) for t in batch.column(1)), dtype="<u8", count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view("<i8"))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``; fp is the signed view of the 64 bits."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(small_batches(_fingerprint_batches), f"doc_id {kind}, fp long")


def _pair_masks() -> np.ndarray:
    """For each non-zero syndrome the 16 flips that lead to code words within distance 2."""
    table = np.zeros((32, 16), dtype=np.uint32)
    for s in range(1, 32):
        flips = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, 32) if i < (i ^ s) and i != s]
        table[s] = flips
    return table


_MASKS = _pair_masks()
_CHECKS = np.array([sum(1 << i for i in range(31) if (i + 1) >> b & 1) for b in range(5)], dtype=np.uint32)


def _syndrome(word: np.ndarray) -> np.ndarray:
    out = np.zeros(len(word), dtype=np.uint32)
    for b, check in enumerate(_CHECKS):
        out |= (np.bitwise_count(word & check).astype(np.uint32) & np.uint32(1)) << np.uint32(b)
    return out


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(keys[n, 34], used[n, 34])`` for unsigned fingerprints; columns 0 and 17 are the home anchors of the halves.

    A key is half << 32 | free bit << 31 | code word.
    """
    keys, used = np.zeros((len(fps), 34), dtype=np.int64), np.ones((len(fps), 34), dtype=bool)
    for half in (0, 1):
        word = ((fps >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        low, free = word & np.uint32(0x7FFFFFFF), word & np.uint32(0x80000000)
        s = _syndrome(low)
        near = low[:, None] ^ _MASKS[s]  # column 0: nearest code word (syndrome 0 has mask 0)
        at = half * 17
        keys[:, at : at + 16] = (near | free[:, None]).astype(np.int64) | half << 32
        used[s == 0, at + 1 : at + 16] = False
        keys[:, at + 16] = (near[:, 0] | (free ^ np.uint32(0x80000000))).astype(np.int64) | half << 32
    return keys, used


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        keys, used = anchors(fps.view("<u8"))
        home = np.zeros_like(used)
        home[:, [0, 17]] = True
        rows = np.repeat(np.arange(len(fps)), 34).reshape(-1, 34)[used]
        yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(fps[rows]), pa.array(home[used])], ["anchor", "fp", "home"])


def _home_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, _ = anchors(batch.column(0).to_numpy(zero_copy_only=False).view("<u8"))
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, [0, 17]].ravel())], ["anchor"])


class _Forest:
    """Union-find over the homes of one anchor chunk, in memory bounded by the chunk."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, roots: np.ndarray) -> None:
        found = sorted({self.find(int(r)) for r in roots})
        for r in found[1:]:
            self.parent[r] = found[0]


def _link_group(homes: np.ndarray, reps: np.ndarray, threshold: int, out: list) -> None:
    """Spanning forest of the links between homes and (homes + replicas) of one anchor."""
    forest = _Forest(len(homes))
    step = max(1, (1 << 22) // len(homes))
    for at in range(0, len(reps), step):
        part = reps[at : at + step]
        near = np.bitwise_count(part[:, None] ^ homes[None, :]) <= threshold
        hit = np.flatnonzero(near.any(axis=1))
        for i in hit:
            found = np.flatnonzero(near[i])
            if part[i] != homes[found[0]]:
                out.append((int(part[i]), int(homes[found[0]])))
            if len(found) > 1:
                forest.union(found)
    for i in range(len(homes)):
        r = forest.find(i)
        if r != i:
            out.append((int(homes[i]), int(homes[r])))


def _pack_edges(out: list) -> pa.RecordBatch:
    pairs = np.array(sorted(set(out)), dtype="<u8").reshape(-1, 2).view("<i8")
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])


def _link_batches(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by (anchor, chunk, home first). Homes are held (at most a chunk), replicas stream past."""
        out: list = []
        key, homes = None, np.zeros(0, dtype="<u8")

        def flush(keys, fps, home):
            nonlocal key, homes
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
            ends = np.append(starts[1:], len(keys))
            many = (ends - starts > 1) | (starts == 0) | (ends == len(keys))
            for s, e in zip(starts[many], ends[many]):
                k, h = (int(keys[s, 0]), int(keys[s, 1])), home[s:e]
                own = fps[s:e][h]
                if k != key:
                    key, homes = k, own
                elif len(own):
                    before, homes = homes, np.concatenate([homes, own])
                    _link_group(homes, before, threshold, out)
                if len(homes) and (len(homes) + e - s > 1):
                    _link_group(homes, fps[s:e], threshold, out)

        for batch in batches:
            keys = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            if len(keys):
                flush(keys, batch.column(2).to_numpy(zero_copy_only=False).view("<u8"), batch.column(3).to_numpy(zero_copy_only=False).astype(bool))
            if len(out) > 100_000:
                yield _pack_edges(out)
                out.clear()
        if out:
            yield _pack_edges(out)

    return run


def near_links(prints: DataFrame, threshold: int = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """``(a, b)`` fingerprints that link: a spanning forest per anchor, whose union has the components of all links.

    ``prints`` has distinct ``fp``. The scheme covers thresholds up to 3.
    """
    if not 0 <= threshold <= 3:
        raise ValueError("the covering of two 32-bit halves finds up to 3 differing bits")
    fps = prints.select("fp")
    hot = fps.mapInArrow(small_batches(_home_batches), "anchor long").groupBy("anchor").count().where(F.col("count") > chunk)
    hot = materialize(hot.select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("chunks")), "hot-anchors")
    rows = fps.mapInArrow(small_batches(_anchor_batches), "anchor long, fp long, home boolean")
    rows = rows.join(broadcast_if_small(hot), "anchor", "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    # In chunks other than its own, a home is a replica.
    rows = rows.select("anchor", "fp", "home", own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"))
    rows = rows.select("anchor", "chunk", "fp", (F.col("home") & (F.col("chunk") == F.col("own"))).alias("home"))
    rows = rows.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk", F.desc("home"))
    return rows.select("anchor", "chunk", "fp", "home").mapInArrow(small_batches(_link_batches(threshold)), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id, fingerprint`` (16 hex digits), ``component_id`` (smallest doc_id reachable).

    Copies meet by their fingerprint alone: only distinct fingerprints are replicated, and only those with links to
    other fingerprints enter the graph. What leaves the text scan is 16 bytes a document.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    links = near_links(distinct, threshold)
    comps = connected_components(links).withColumnRenamed("node", "fp")
    linked = distinct.join(comps, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    heads = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = materialize(linked.join(heads, "component").select("fp", "component_id"), "simhash-named")
    out = prints.join(broadcast_if_small(named), "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id. Repeated rows fall to one; null ids stay."""
    names = materialize(simhash_components(docs, id_col, text_col, threshold), "simhash-names")
    gone = names.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(f"`{id_col}`").alias("own_id"))  # own columns may be named like the result's
    kept = rows.join(broadcast_if_small(materialize(gone, "simhash-gone")), F.col("own_id") == F.col("gone_id"), "left_anti")
    if not names.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        kept = kept.where(F.col("own_id").isNotNull()).dropDuplicates(["own_id"]).unionByName(kept.where(F.col("own_id").isNull()))
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
