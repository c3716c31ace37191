"""Registered queries of the stored text index: all benchmark items are searched among all documents at once."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.catalog import _read, query
from lumenframe.operators import textindex
from lumenframe.plans.storage import scratch_path


def _index(spark, d) -> textindex.Index:
    root = scratch_path(spark, "text-index")
    textindex.build(_read(spark, d, "documents"), root)
    return textindex.Index(spark, root)


_TOKENS = """dt as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') w from documents), qt as (select item_id query_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') w from benchmark)"""


@query(f"""with {_TOKENS}, f as (select doc_id, unnest(w) term, len(w) dl from dt), p as (select doc_id, term, any_value(dl) dl, count(*) tf from f group by 1, 2), s as (select count(*) n, avg(len(w)) a from dt),
  x as (select term, count(*) df from p group by 1), q as (select distinct query_id, unnest(w) term from qt),
  r as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a))), 9) score from q join x using (term) join p using (term), s group by 1, 2),
  k as (select *, row_number() over (partition by query_id order by score desc, doc_id) rk from r) select query_id, doc_id, round(score, 6) score, cast(rk as int) rank from k where rk <= 10""")
def bm25_batch(spark, d):
    """The ten best documents of every benchmark item, by bounds of ranges."""
    queries = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found, _ = _index(spark, d).search(queries, 10)
    return found.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(f"""with {_TOKENS}, q as (select query_id, list_slice(w, 1, 3) w from qt where len(w) > 0), f as (select doc_id, ' ' || array_to_string(w, ' ') || ' ' t from dt)
  select query_id, doc_id from q join f on contains(t, ' ' || array_to_string(q.w, ' ') || ' ')""")
def phrase_batch(spark, d):
    """Documents that hold the first three words of a benchmark item as a phrase, for every item."""
    queries = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(textindex.tokens(F.col("text")), 1, 3), " ").alias("query"))
    return _index(spark, d).phrases(queries).select("query_id", "doc_id")
