"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

1. Corpus counts of the test vocabulary choose, for every window of the test items, its two rarest terms.
2. The index: postings ``(term, doc_id, pos)`` of those terms over all documents, as a stored table.
3. Offset-adjusted lists: a posting of a window's rarest term at ``pos`` puts the window's start at ``pos - offset``; the
   list is intersected with the one of the second rarest term on (document, window, start). ``slop`` widens the second to
   a proximity search.
4. What survives is checked against the document's words (by 128 bits of their hash), and the hits are laid over each other.

A frequent passage costs postings in proportion to its occurrences; no two documents are ever paired. The test items'
tables are broadcast below the checked limit and shuffled beyond it. The documents' text moves only in step 4, and
there only if the candidates exceed the broadcast limit.

Defined results: null or wordless text has no words, no hits and isn't contaminated; items without words have no
window; repeated items count by their distinct item_ids; rows with a null or repeated doc_id are judged each by
its own text, and their candidates are kept apart; an empty benchmark marks nothing; further columns are kept by ``contamination``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import broadcast_if_small, materialize

WINDOW = 13
#: A document is contaminated if it has a hit and at least this share of its words is hit: 1 / 20.
SHARE = 20
# The contract's word pattern, and the letters it lower-cases.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text; null has none. ``lower`` is the fast path for ASCII, where it is the same."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.regexp_extract_all(small, F.lit(WORD), F.lit(0))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``(wid, item_id, terms, phrase)``: every window of ``window`` consecutive words; a shorter item is one window."""
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    cut = rows.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("terms"))
    cut = cut.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids"))
    return cut.select(F.monotonically_increasing_id().alias("wid"), "item_ids", "terms", F.array_join("terms", " ").alias("phrase"))


def rarest_terms(docs: DataFrame, windows: DataFrame, text_col: str = "text") -> DataFrame:
    """``(wid, term, offset, rank)``: the two rarest terms of each window (one if it has one word), counted over ``docs``."""
    slots = windows.select("wid", F.posexplode("terms").alias("offset", "term"))
    vocabulary = materialize(slots.select("term").distinct(), "test-terms")
    tokens = docs.select(F.explode(words(F.col(text_col))).alias("term")).join(broadcast_if_small(vocabulary), "term")
    counts = materialize(tokens.groupBy("term").agg(F.count("*").alias("n")), "test-term-counts")
    # Broadcast below the limit: a frequent term stands in many windows, which a join by term would gather in one task.
    ranked = slots.join(broadcast_if_small(counts), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = W.partitionBy("wid").orderBy("n", "offset")
    return ranked.withColumn("rank", F.row_number().over(order)).where("rank <= 2").select("wid", "term", "offset", "rank")


def _key(id_col: str, text_col: str) -> Column:
    """What the index calls a document: a hash of its id and text, so rows without an id or with one id aren't gathered.

    Rows alike in both share their candidates. Unlike rows of one hash would too, which the check against the words undoes.
    """
    return F.xxhash64(F.col(id_col), F.col(text_col))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of ``terms``: stored ``(term, doc_id, pos)`` over whole texts; ``doc_id`` is the hash of :func:`_key`."""
    tokens = docs.select(_key(id_col, text_col).alias("doc_id"), F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return materialize(tokens.join(broadcast_if_small(terms), "term").select("term", "doc_id", "pos"), "postings")


def candidates(index: DataFrame, anchors: DataFrame, slop: int = 0) -> DataFrame:
    """``(doc_id, wid, start)`` where the offset-adjusted lists of a window's rarest terms meet (within ``slop``)."""

    def starts(rank: int) -> DataFrame:
        wanted = anchors.where(F.col("rank") == rank).select("wid", "term", "offset")
        hits = index.join(broadcast_if_small(wanted), "term")
        return hits.select("doc_id", "wid", (F.col("pos") - F.col("offset")).alias("start")).where(F.col("start") >= -slop)

    single = anchors.groupBy("wid").agg(F.max("rank").alias("ranks")).where("ranks = 1").select("wid")
    first, second = starts(1), starts(2)
    near = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.wid") == F.col("b.wid"))
    if slop:
        near &= F.abs(F.col("a.start") - F.col("b.start")) <= slop
    else:
        near &= F.col("a.start") == F.col("b.start")
    both = first.alias("a").join(second.alias("b"), near, "left_semi")
    alone = first.join(broadcast_if_small(materialize(single, "one-word")), "wid", "left_semi").select("doc_id", "wid", "start")
    return both.unionByName(alone).distinct()


def _hash(phrase: Column) -> tuple[Column, Column]:
    return F.xxhash64(phrase), F.xxhash64(F.lit("window"), phrase)


def _covered(hits: Column) -> Column:
    """Number of words under intervals ``struct(start, len)``."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def lay(acc: Column, x: Column) -> Column:
        end = (x["start"] + x["len"]).cast("long")
        return F.struct((acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"].cast("long")), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["end"], end).alias("end"))

    return F.aggregate(F.array_sort(hits), zero, lay, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", slop: int = 0, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of all its columns), with ``n_words, n_hit, n_items, items, contaminated``.

    With ``slop`` a window also counts where all its words stand, in any order, within ``slop`` words around its place.
    """
    windows = materialize(item_windows(items, text_col="text", window=window), "test-windows")
    anchors = materialize(rarest_terms(docs, windows, text_col), "test-anchors")
    terms = materialize(anchors.select("term").distinct(), "anchor-terms")
    index = postings(docs, terms, id_col, text_col)
    found = candidates(index, anchors, slop).join(broadcast_if_small(windows.select("wid", "item_ids", "terms", "phrase")), "wid")
    # A candidate carries 128 bits of its window's words; the words themselves are needed for proximity alone.
    told = [F.col("terms")] if slop else [c.alias(f"h{i}") for i, c in enumerate(_hash(F.col("phrase")))]
    entry = F.struct(F.col("start").cast("int").alias("start"), F.size("terms").alias("len"), "item_ids", *told)
    per_doc = materialize(found.groupBy("doc_id").agg(F.collect_list(entry).alias("cands")).withColumnRenamed("doc_id", "cand_id"), "candidates")
    rows = docs.select(F.struct("*").alias("row"), _key(id_col, text_col).alias("own_id"), F.col(text_col).alias("body"))
    rows = rows.join(broadcast_if_small(per_doc), F.col("own_id") == F.col("cand_id"), "left").withColumn("w", words(F.col("body")))

    def stands(c: Column) -> Column:
        if slop:
            span = F.slice(F.col("w"), F.greatest(c["start"] + 1 - slop, F.lit(1)), c["len"] + 2 * slop)
            return F.size(F.array_except(c["terms"], span)) == 0
        h0, h1 = _hash(F.array_join(F.slice(F.col("w"), c["start"] + 1, c["len"]), " "))
        return (h0 == c["h0"]) & (h1 == c["h1"])

    rows = rows.withColumn("hits", F.filter("cands", stands))
    spans = F.transform("hits", lambda c: F.struct(F.greatest(c["start"], F.lit(0)).alias("start"), c["len"].alias("len")))
    items_of = F.array_sort(F.array_distinct(F.transform(F.flatten(F.transform("hits", lambda c: c["item_ids"])), lambda x: x.cast("string"))))
    rows = rows.select("row", F.size("w").cast("long").alias("n_words"), F.coalesce(_covered(spans), F.lit(0)).cast("long").alias("n_hit"), F.coalesce(items_of, F.array().cast("array<string>")).alias("items"))
    bad = (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))
    return rows.select("row", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", bad.alias("contaminated"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(F.col("row")[id_col].alias("doc_id"), "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows."""
    clean = contamination(docs, items, id_col, text_col).where(~F.col("contaminated"))
    return clean.select(*(F.col("row")[c].alias(c) for c in docs.columns))


#: The query's result in DuckDB (doc_id is unique there).
SQL = rf"""
with dw as (select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) w from documents),
iw as (select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') w from benchmark),
win as (select distinct item_id, least(len(w), {WINDOW}) l, array_to_string(w[s : s + least(len(w), {WINDOW}) - 1], ' ') t
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) s from iw where len(w) > 0)),
grams as (select doc_id, p, l, array_to_string(w[p : p + l - 1], ' ') t
  from (select doc_id, w, l, unnest(range(1, len(w) - l + 2)) p from dw, (select distinct l from win))),
hits as (select doc_id, p, l, item_id from grams join win using (l, t)),
covered as (select doc_id, count(distinct q) n_hit from (select doc_id, unnest(range(p, p + l)) q from hits) group by doc_id),
named as (select doc_id, count(*) n_items, string_agg(i, ',' order by i) ids from (select distinct doc_id, cast(item_id as varchar) i from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and {SHARE} * n_hit >= len(w), false) as contaminated
from dw left join covered using (doc_id) left join named using (doc_id)
"""
