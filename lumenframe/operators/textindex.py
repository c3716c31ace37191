"""A stored positional index of texts, searched by batches of queries.

Documents are dealt to ranges of about ``RANGE_DOCS``, or of ``RANGE_WORDS`` words, by a hash of their id, and a range is
inverted, scored and searched for phrases as a whole, in one task. A block holds the postings of one term in one
range, documents ascending, each with its positions and its share of a BM25 score, and beside them the largest share. So a
term that stands in every document is many blocks, and a block is bounded by a range.

A query's best score in a range is at most the sum of its terms' largest shares there. Each query first reads the ranges with
the best bounds; its k-th score so far rules out the ranges whose bound is below it; the rest are read too. The result is that of
scoring every document. Texts are tokenised once, when the index is built.

Defined results: ids are unique (rows of one id are taken for one document); null ids are not indexed; null or empty texts count
as documents without terms; a query without terms finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import manifest
from lumenframe.operators.text import K1, B, auto_fuzziness, tokens
from lumenframe.plans.storage import DEAL_BYTES, broadcast_if_small, materialize, stored_bytes

RANGE_DOCS = 4096
#: Words of a range, about; longer texts make more ranges.
RANGE_WORDS = 2_000_000
#: Places of an Arrow batch of blocks, and queries that are scored at once in a range.
POSTINGS_BATCH, QUERY_BLOCK = 200_000, 256
#: Query terms of one search; more raise.
MAX_TERMS = 100_000


def build(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", range_docs: int = RANGE_DOCS) -> None:
    """Index ``docs`` under ``root``: tables ``blocks``, ``terms`` and ``stats`` in one commit, which replaces an index that stands there."""
    spark = docs.sparkSession
    words = tokens(F.col(text_col))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.array_join(words, " ").alias("words"), F.size(words).alias("dl"))
    rows = materialize(rows, "index-tokens")
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"), F.sum("dl").alias("n_words")).first()
    ranges = max(1, -(-stats.n_docs // range_docs), -(-(stats.n_words or 0) // RANGE_WORDS))
    dealt = rows.withColumn("range", F.pmod(F.xxhash64("doc_id"), F.lit(ranges)).cast("int"))
    # Texts are shuffled, not words: a range is inverted where it lies.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(ranges, -(-stored_bytes(rows) // DEAL_BYTES)))
    dealt = dealt.repartition(parts, "range").sortWithinPartitions("range", "doc_id")
    kind = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("share", T.DoubleType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
    schema = T.StructType([T.StructField("term", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("top", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("docs", T.ArrayType(kind))])
    blocks = dealt.mapInArrow(_inverter(float(stats.avgdl or 1.0) or 1.0), schema)
    summary = spark.createDataFrame([(stats.n_docs, float(stats.avgdl or 0.0), ranges)], "n_docs long, avgdl double, ranges int")
    manifest.publish(spark, root, replace={"blocks": blocks, "terms": lambda t: t["blocks"].groupBy("term").agg(F.sum("n").alias("df")), "stats": summary})


def _inverter(avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of the texts of a partition, which is ordered by range and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            number = batch.column("range").to_numpy()
            ends = [*(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
            begin = 0
            for end in ends:
                if end > begin:
                    if held and held[0].column("range")[0].as_py() != number[begin]:
                        yield from _inverted(held, avgdl)
                        held = []
                    held.append(batch.slice(begin, end - begin))
                begin = end
        if held:
            yield from _inverted(held, avgdl)

    return run


def _inverted(parts: list[pa.RecordBatch], avgdl: float) -> Iterator[pa.RecordBatch]:
    """The blocks of one range, terms ascending."""
    rows = pa.concat_batches(parts)
    rows = rows.filter(pc.greater(rows.column("dl"), 0))
    if not rows.num_rows:
        return
    ids, dl = rows.column("doc_id"), rows.column("dl").to_numpy().astype(np.int64)
    code = ids.dictionary_encode().indices.to_numpy()
    new = np.concatenate([[True], code[1:] != code[:-1]])
    length, doc = np.maximum.reduceat(dl, np.flatnonzero(new)), np.cumsum(new) - 1  # rows of one id are one document
    ids = ids.take(pa.array(np.flatnonzero(new)))
    flat = pc.split_pattern(rows.column("words").cast(pa.large_string()), " ").flatten().dictionary_encode()
    names = flat.dictionary
    by_name = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[by_name] = np.arange(len(names))
    term = rank[flat.indices.to_numpy()]
    del flat
    doc, place = np.repeat(doc, dl), np.arange(dl.sum()) - np.repeat(np.cumsum(dl) - dl, dl)
    order = np.argsort(term, kind="stable") if new.all() else np.lexsort((place, doc, term))
    term, doc, place = term[order], doc[order], place[order].astype(np.int32)
    begins = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])]))  # of a document's places
    tf = np.diff(np.append(begins, len(term)))
    term, doc = term[begins], doc[begins]
    share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / avgdl))
    heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # of a term's documents
    top, bounds, places = np.maximum.reduceat(share, heads), np.append(heads, len(term)), np.append(begins, len(place))
    number, i = rows.column("range")[0].as_py(), 0
    while i < len(heads):  # about POSTINGS_BATCH places a batch
        j = max(i + 1, int(np.searchsorted(places[bounds], places[bounds[i]] + POSTINGS_BATCH, "right")) - 1)
        lo, hi = bounds[i], bounds[j]
        at = pa.ListArray.from_arrays(pa.array((places[lo : hi + 1] - places[lo]).astype(np.int32)), pa.array(place[places[lo] : places[hi]]))
        docs = pa.StructArray.from_arrays([ids.take(pa.array(doc[lo:hi])), pa.array(share[lo:hi]), at], ["doc_id", "share", "positions"])
        docs = pa.ListArray.from_arrays(pa.array((bounds[i : j + 1] - lo).astype(np.int32)), docs)
        words = names.take(pa.array(by_name[i:j])).cast(pa.string())
        yield pa.RecordBatch.from_arrays([words, pa.array(np.full(j - i, number, np.int32)), pa.array(top[i:j]), pa.array(np.diff(bounds[i : j + 1]).astype(np.int64)), docs], ["term", "range", "top", "n", "docs"])
        i = j


def _postings(left: pa.Table, *columns: str) -> tuple[list[str], np.ndarray, list[pa.Array]]:
    """The blocks of a range: their terms, where the postings of each begin, and the ``columns`` of all postings."""
    lists = [left.column(c).combine_chunks() for c in columns]
    return left.column("term").to_pylist(), np.append(0, np.cumsum(pc.list_value_length(lists[0]).to_numpy())), [x.flatten() for x in lists]


class Index:
    """An index as of the commit that stood when it was opened."""

    def __init__(self, spark: SparkSession, root: str):
        now = manifest.read(spark, root)
        self.spark = spark
        self.blocks, self.terms = (manifest.table(spark, root, name, now) for name in ("blocks", "terms"))
        self.stats = manifest.table(spark, root, "stats", now).first()

    def _asked(self, queries: DataFrame) -> DataFrame:
        """``(query_id, term, idf)`` of the known terms of ``queries(query_id, query)``, each once a query; stored."""
        asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
        asked = materialize(asked, "query-terms")
        if asked.limit(MAX_TERMS + 1).count() > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} query terms; search in several calls")
        idf = F.log(1 + (F.lit(self.stats.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return materialize(self.terms.join(F.broadcast(asked), "term").select("query_id", "term", idf.alias("idf")), "query-idf")

    def _scored(self, asked: DataFrame, places: DataFrame, k: int) -> DataFrame:
        """The k best documents of each query in its ``places(query_id, range)``.

        A range's blocks are added up in one table of scores, query by document; what can be among a query's k best goes on.
        """
        terms = asked.select("term").distinct()  # as many as a search may ask
        blocks = self.blocks.select("term", "range", "docs.doc_id", "docs.share").join(F.broadcast(terms), "term", "left_semi")
        table = asked.toArrow()  # bounded by MAX_TERMS
        coded = table.column("query_id").combine_chunks().dictionary_encode()
        of, names = coded.indices, coded.dictionary
        wanted: dict[str, list[tuple[int, float]]] = {}
        for q, t, w in zip(of.to_pylist(), table.column("term").to_pylist(), table.column("idf").to_pylist()):
            wanted.setdefault(t, []).append((q, w))
        wanted = {t: (np.array([q for q, _ in x]), np.array([w for _, w in x])) for t, x in wanted.items()}
        kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", self.blocks.schema["docs"].dataType.elementType["doc_id"].dataType), T.StructField("score", T.DoubleType())])
        known = {v: i for i, v in enumerate(names.to_pylist())}

        def best(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            terms, begins, (docs, share) = _postings(left, "doc_id", "share")
            coded = docs.dictionary_encode()
            doc, share = coded.indices.to_numpy(), share.to_numpy()
            here = np.sort([known[v] for v in right.column("query_id").to_pylist()])
            out_q, out_d, out_s = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
            for lo in range(0, len(here), QUERY_BLOCK):
                part = here[lo : lo + QUERY_BLOCK]
                row = np.full(len(names), -1)
                row[part] = np.arange(len(part))
                scores, hit = np.zeros((len(part), len(coded.dictionary))), np.zeros((len(part), len(coded.dictionary)), bool)
                for t, a, b in zip(terms, begins[:-1], begins[1:]):
                    q, w = wanted[t]
                    q, w = row[q], w[row[q] >= 0]
                    for i, x in zip(q[q >= 0].tolist(), w.tolist()):
                        scores[i, doc[a:b]] += x * share[a:b]
                        hit[i, doc[a:b]] = True
                for i, q in enumerate(part):
                    found = np.flatnonzero(hit[i])
                    if len(found) > k:  # equal scores are told apart by id, after rounding
                        found = found[scores[i, found] >= np.partition(scores[i, found], len(found) - k)[len(found) - k] - 1e-8]
                    out_q.append(np.full(len(found), q))
                    out_d.append(found)
                    out_s.append(scores[i, found])
            return pa.table({"query_id": names.take(pa.array(np.concatenate(out_q))), "doc_id": coded.dictionary.take(pa.array(np.concatenate(out_d))), "score": pa.array(np.concatenate(out_s))})

        if not len(names):
            return self.spark.createDataFrame([], kind).withColumn("rank", F.lit(1))
        rows = blocks.groupBy("range").cogroup(places.groupBy("range")).applyInArrow(best, kind)
        rows = rows.withColumn("score", F.round("score", 9))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10, first: int = 2) -> tuple[DataFrame, DataFrame]:
        """``(result, read)``: ``query_id, doc_id, score, rank`` of the k best documents by BM25 (ties by id), and the (query, range) pairs that were read."""
        asked = self._asked(queries)
        tops = self.blocks.select("term", "range", "top").join(broadcast_if_small(asked), "term")
        bounds = materialize(tops.groupBy("query_id", "range").agg(F.sum(F.col("idf") * F.col("top")).alias("bound")), "range-bounds")
        ranked = bounds.withColumn("_r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "range")))
        early = ranked.where(F.col("_r") <= first).select("query_id", "range")
        top = materialize(self._scored(asked, early, k), "first-ranges")
        reached = top.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        late = ranked.where(F.col("_r") > first).join(reached, "query_id", "left")
        late = materialize(late.where((F.coalesce("found", F.lit(0)) < k) | (F.col("bound") >= F.col("least") - 1e-6)).select("query_id", "range"), "late-ranges")
        both = top.drop("rank").unionByName(self._scored(asked, late, k).drop("rank"))
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), early.unionByName(late)

    def phrases(self, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, n)``: documents in which the terms of a query follow each other, and how often."""
        words = queries.select("query_id", tokens(F.col("query")).alias("w")).where(F.size("w") > 0)
        asked = materialize(words.select("query_id", F.posexplode("w").alias("offset", "term")), "phrase-terms")
        if asked.limit(MAX_TERMS + 1).count() > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} query terms; search in several calls")
        table = asked.orderBy("query_id", "offset").toArrow()
        coded = table.column("query_id").combine_chunks().dictionary_encode()
        names, phrases = coded.dictionary, {}
        for q, t in zip(coded.indices.to_pylist(), table.column("term").to_pylist()):
            phrases.setdefault(q, []).append(t)
        kind = T.StructType([T.StructField("query_id", asked.schema["query_id"].dataType), T.StructField("doc_id", self.blocks.schema["docs"].dataType.elementType["doc_id"].dataType), T.StructField("n", T.LongType())])

        def found(left: pa.Table) -> pa.Table:
            terms, begins, (docs, lists) = _postings(left, "doc_id", "positions")
            doc = docs.dictionary_encode()
            # A place as one number: its document, then its position.
            count = pc.list_value_length(lists).to_numpy()
            place = np.repeat(doc.indices.to_numpy().astype(np.int64), count) << 32 | lists.flatten().to_numpy()
            ends = np.append(0, np.cumsum(count))
            at = {t: np.sort(place[ends[a] : ends[b]]) for t, a, b in zip(terms, begins[:-1], begins[1:])}
            out_q, out_d, out_n = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0, int)]
            for q, w in phrases.items():
                if all(t in at for t in w):
                    by_size = sorted(range(len(w)), key=lambda i: len(at[w[i]]))
                    starts = at[w[by_size[0]]] - by_size[0]  # a start before its text falls into the document before, where no place is so high
                    for i in by_size[1:]:
                        there = at[w[i]]
                        starts = starts[there[np.minimum(np.searchsorted(there, starts + i), len(there) - 1)] == starts + i]
                    docs, n = np.unique(starts >> 32, return_counts=True)
                    out_q.append(np.full(len(docs), q))
                    out_d.append(docs)
                    out_n.append(n)
            return pa.table({"query_id": names.take(pa.array(np.concatenate(out_q))), "doc_id": doc.dictionary.take(pa.array(np.concatenate(out_d))), "n": pa.array(np.concatenate(out_n), pa.int64())})

        if not len(names):
            return self.spark.createDataFrame([], kind)
        blocks = self.blocks.select("term", "range", "docs.doc_id", "docs.positions").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        return blocks.groupBy("range").applyInArrow(found, kind)

    def fuzzy(self, queries: DataFrame) -> DataFrame:
        """``(query_id, doc_id, matched)``: how many of a query's terms stand in a document within their edit distance.

        Distances are taken to the index's distinct terms, not to the texts; only terms of about the same length are compared.
        """
        asked = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("place", "wanted"))
        asked = materialize(asked.select("query_id", "place", "wanted", F.length("wanted").alias("size")), "fuzzy-terms")
        if asked.limit(MAX_TERMS + 1).count() > MAX_TERMS:
            raise ValueError(f"more than {MAX_TERMS} query terms; search in several calls")
        edits = F.when(F.col("size") <= 2, auto_fuzziness("aa")).when(F.col("size") <= 5, auto_fuzziness("aaaaa")).otherwise(auto_fuzziness("aaaaaa"))
        near = asked.withColumn("edits", edits)
        near = near.withColumn("length", F.explode(F.sequence(F.greatest(F.col("size") - F.col("edits"), F.lit(1)), F.col("size") + F.col("edits"))))
        alike = self.terms.select("term", F.length("term").alias("length")).join(F.broadcast(near), "length").where(F.levenshtein("term", "wanted") <= F.col("edits"))
        alike = materialize(alike.select("query_id", "place", "term"), "alike-terms")
        hits = self.blocks.select("term", "docs").join(broadcast_if_small(alike), "term").select("query_id", "place", F.explode("docs.doc_id").alias("doc_id")).distinct()
        return hits.groupBy("query_id", "doc_id").agg(F.count("*").cast("int").alias("matched"))
