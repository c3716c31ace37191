"""Line dedup by site-relative frequency.

A line's frequency on a site is the number of the site's pages that hold it divided by the site's pages. Lines over
``max_ratio`` are boilerplate and are dropped from every page of that site.

With ``passages``, lines of ``LONG_WORDS`` words and more, which don't repeat by chance, are counted over the whole corpus
too: one that stands on ``MIN_PAGES`` pages goes, if those pages are unlike ones. Copies of a page repeat its lines among
the same lines, so a passage must have different neighbours, or pages with different first and last lines, for half of its
pages.

Defined results: null text stays null (0 lines); blank lines are never counted nor dropped; a line is compared without
its outer spaces; a null host is a site of its own; each row is a page, so repeated rows count again; a page whose every
line is boilerplate loses them all, unless ``keep_repeated`` is set: it is then taken for a repeated page, which near-
duplicate removal is for, and keeps its text; on a site with fewer than ``min_pages`` pages no line is boilerplate; an
empty table gives an empty table; further columns pass through untouched, but for columns named like the counts, which
:func:`site_line_dedup` replaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.plans.storage import BROADCAST_BYTES, fits_broadcast, materialize

MAX_RATIO = 0.025
MIN_PAGES = 5
SALT = 32
#: Words of a line that is counted over all sites, and the share of its pages that must be unlike.
LONG_WORDS, UNLIKE = 9, 0.5
BUCKETS, HOST_BUCKETS = 4096, 64


def _key(line: Column) -> Column:
    """128 bits for a line, so that the shuffle never moves text."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("site-line"), bare).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _host(host: Column) -> Column:
    return F.coalesce(F.concat(F.lit("h:"), host.cast("string")), F.lit("-"))


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``(host_key, bad)``: per site the keys of its boilerplate lines, in ``HOST_BUCKETS`` lists by key, so that a line is sought in one.

    Counting is one map-side-combined shuffle of (host, 128-bit key); a hot site is spread by its line keys. The set of
    one site has at most (mean lines per page) / max_ratio entries, as each entry is on max_ratio of the pages.
    """
    pages = docs.select(_host(F.col(host_col)).alias("host_key"), F.col(text_col).alias("body"))
    totals = pages.groupBy("host_key").agg(F.count("*").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("body")), lambda x: F.trim(x) != ""), _key))
    counts = pages.select("host_key", F.explode(keys).alias("k")).groupBy("host_key", "k").agg(F.count("*").alias("df")).where(F.col("df") >= min_pages)
    over = counts.join(totals, "host_key").where(F.col("df") > F.lit(max_ratio) * F.col("pages"))
    by = over.groupBy("host_key", F.pmod(F.col("k.h1"), F.lit(HOST_BUCKETS)).cast("int").alias("b")).agg(F.collect_set("k").alias("ks"))
    by = by.groupBy("host_key").agg(F.map_from_entries(F.collect_list(F.struct("b", "ks"))).alias("m"))
    return by.select("host_key", F.transform(F.sequence(F.lit(0), F.lit(HOST_BUCKETS - 1)), lambda i: F.try_element_at("m", i)).alias("bad"))


def _long(line: Column) -> Column:
    return F.size(F.split(F.trim(line), r"\s+")) >= LONG_WORDS


def _bare_lines(body: Column) -> Column:
    return F.filter(_lines(body), lambda x: F.trim(x) != "")


def repeated_passages(docs: DataFrame, text_col: str = "text", min_pages: int = MIN_PAGES) -> DataFrame:
    """``(k)``: keys of the long lines that stand on at least ``min_pages`` unlike pages of any site.

    The distinct counts first group by (key, surroundings), so a passage on many pages is spread by its surroundings.
    """
    pages = docs.select(F.transform(_bare_lines(F.col(text_col)), lambda x: F.struct(F.trim(x).alias("line"), F.xxhash64(F.trim(x)).alias("h"))).alias("ls")).withColumn("page", F.monotonically_increasing_id())
    beside = lambda i: F.get("ls.h", i)
    around = F.transform("ls", lambda x, i: F.struct(x["line"].alias("line"), F.xxhash64(beside(i - 1), beside(i + 1), F.isnull(beside(i - 1))).alias("near")))
    one = F.transform(F.filter(around, lambda x: _long(x["line"])), lambda x: F.struct(_key(x["line"]).alias("k"), x["near"].alias("near")))
    ends = F.xxhash64(beside(F.lit(0)), beside(F.size("ls") - 1))
    uses = pages.select("page", ends.alias("ends"), F.explode(one).alias("u")).select("page", "ends", "u.k", "u.near")
    uses = uses.groupBy("page", "k").agg(F.first("ends").alias("ends"), F.min("near").alias("near"))  # a page counts once
    counts = uses.groupBy("k").agg(F.count("*").alias("df"), F.count_distinct("near").alias("near"), F.count_distinct("ends").alias("ends"))
    return counts.where((F.col("df") >= min_pages) & (F.greatest("near", "ends") >= UNLIKE * F.col("df"))).select("k")


def _with_passages(rows: DataFrame, docs: DataFrame, text_col: str, min_pages: int) -> tuple[DataFrame, Callable[[Column], Column]]:
    """``rows`` with the passages they need, and the test whether a line is one.

    A set below the limit is one broadcast row of buckets; a larger one is joined to the pages that hold its lines.
    """
    found = materialize(repeated_passages(docs, text_col, min_pages), "passages")
    if fits_broadcast(found, BROADCAST_BYTES):
        bucket = lambda k: F.pmod(k["h1"], F.lit(BUCKETS)).cast("int")
        lists = F.map_from_entries(F.collect_list(F.struct("b", "ks")))
        by = found.groupBy(bucket(F.col("k")).alias("b")).agg(F.collect_list("k").alias("ks")).agg(lists.alias("m"))
        table = by.select(F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.try_element_at("m", i)).alias("passages"))
        return rows.join(F.broadcast(table)), lambda x: _long(x) & F.coalesce(F.array_contains(F.get("passages", bucket(_key(x))), _key(x)), F.lit(False))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    page = lambda body: F.struct(F.xxhash64(body).alias("p1"), F.xxhash64(F.lit("page"), body).alias("p2"))
    body = F.col(text_col)
    keys = F.array_distinct(F.transform(F.filter(_bare_lines(body), _long), _key))
    held = docs.select(page(body).alias("page"), F.explode(keys).alias("k")).distinct().withColumn("cut", F.pmod(F.xxhash64("page"), F.lit(SALT)).cast("int"))
    sets = held.join(found.withColumn("cut", salts), ["k", "cut"]).groupBy("page").agg(F.collect_list("k").alias("passages"))
    rows = rows.withColumn("page", page(F.col("body"))).withColumn("cut", F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    return rows.join(sets.withColumn("cut", salts), ["page", "cut"], "left"), lambda x: F.coalesce(F.array_contains("passages", _key(x)), F.lit(False))


def cleaned_rows(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, passages: bool = False, keep_repeated: bool = False
) -> DataFrame:
    """Every row of ``docs`` as ``row`` (a struct of all its columns), with ``cleaned`` (its text without boilerplate), ``n_lines`` and ``n_dropped`` (long).

    The pages themselves are not shuffled while the boilerplate table is below the broadcast limit; beyond it the join
    is salted, so that a site with a third of all pages spreads over 32 tasks.
    """
    bad = materialize(boilerplate_lines(docs, host_col, text_col, max_ratio, min_pages), "boilerplate")
    rows = docs.select(F.struct("*").alias("row"), _host(F.col(host_col)).alias("host_key"), F.col(text_col).alias("body"))
    if fits_broadcast(bad, BROADCAST_BYTES):
        rows = rows.join(F.broadcast(bad), "host_key", "left")
    else:
        salted = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("body"), F.lit(SALT)).cast("int")).join(salted, ["host_key", "salt"], "left")
    rows, repeated = _with_passages(rows, docs, text_col, min_pages) if passages else (rows, lambda x: F.lit(False))
    rows = rows.withColumn("lines", _lines(F.col("body")))
    listed = lambda x: F.coalesce(F.array_contains(F.get("bad", F.pmod(_key(x)["h1"], F.lit(HOST_BUCKETS)).cast("int")), _key(x)), F.lit(False))
    kept = F.filter("lines", lambda x: (F.trim(x) == "") | ~(listed(x) | repeated(x)))
    rows = rows.withColumn("kept", kept)
    rows = rows.withColumn("whole", ~F.exists("kept", lambda x: F.trim(x) != "") if keep_repeated else F.lit(False))
    text = F.when(F.col("whole"), F.col("body")).otherwise(F.array_join("kept", "\n"))
    n_lines = F.coalesce(F.size(F.filter("lines", lambda x: F.trim(x) != "")), F.lit(0))
    dropped = F.when(F.col("whole") | F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size("kept"))
    n_lines = F.when(F.col("lines").isNull(), 0).otherwise(n_lines)
    return rows.select("row", text.alias("cleaned"), n_lines.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def site_line_dedup(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with boilerplate lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``; ``options`` are those of :func:`cleaned_rows`."""
    rows = cleaned_rows(docs, host_col, text_col, **options)
    out = [F.col("cleaned").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*out, "n_lines", "n_dropped")


#: The query's result in DuckDB.
SQL = f"""
with pages as (select doc_id, source, text, coalesce('h:' || source, '-') hk, row_number() over () rid from documents),
lines as (select hk, rid, unnest(list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), lambda x: trim(x)))) ln from pages),
bad as (select l.hk, list(l.ln) bad from (select hk, ln, count(*) df from lines group by hk, ln) l
  join (select hk, count(*) n from pages group by hk) t using (hk) where df >= {MIN_PAGES} and df > {MAX_RATIO} * n group by l.hk),
cut as (select p.*, string_split(text, chr(10)) ls, b.bad,
  list_filter(string_split(text, chr(10)), lambda x: trim(x) = '' or not list_contains(coalesce(b.bad, []), trim(x))) kept from pages p left join bad b using (hk)),
done as (select *, len(kept) = len(ls) whole from cut)
select doc_id, source, case when whole then text else array_to_string(kept, chr(10)) end as text,
  cast(coalesce(len(list_filter(ls, lambda x: trim(x) <> '')), 0) as bigint) as n_lines,
  cast(coalesce(len(ls) - len(kept), 0) as bigint) as n_dropped from done
"""
