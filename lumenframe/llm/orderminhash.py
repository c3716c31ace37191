"""Order MinHash fingerprints in DataFrame operations only.

A text is cut at white space into tokens of at most 16 characters; its k-mers are runs of ``K`` tokens. Each k-mer gets
its occurrence number in the text, so repeated k-mers stay distinct. One hash of (k-mer, occurrence) deals it to one of
``BINS`` bins and orders it there. A bin's sketch is its ``2`` minimal k-mers, kept in their text order and hashed as a
tuple; so it changes if the k-mers change or if their order does, which is what makes the likeness follow edit distance
and not set overlap. A bin with too few k-mers takes the next ones around the circle of bins.

All of it happens inside a row, on sorted arrays of packed longs (hash bits above, text position below): linear memory,
n log n time, and no row leaves its partition.

Defined results: null is the empty text, whose fingerprint is all zeros; a text of fewer than K tokens is one k-mer;
equal texts have equal fingerprints; rows with a null doc_id come first in the order of documents; repeated ids are
ordered by text; ids are numbers or text that reads as one (others raise); the document after the last is the first; further columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 3
BINS = 32
_POS = 27
_LOW = (1 << _POS) - 1
_BIN = 64 - 5
BUCKETS_PER_PARTITION = 4


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _none(kind: str) -> Column:
    """An empty array that is known to hold no null, so that sorts stay primitive."""
    return F.slice(F.array(F.lit(0).cast(kind)), 1, 0)


def _range(n: Column) -> Column:
    """0 .. n - 1 as an array; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(_none("int"))


def _pack(hash_: Column, pos: Column) -> Column:
    return hash_.bitwiseAND(F.lit(~_LOW)).bitwiseOR(pos.cast("long"))


def token_hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S{1,16}"), F.lit(0)), lambda t: F.xxhash64(t))


def kmers(tokens: Column) -> Column:
    """Sorted longs: k-mer hash, then position."""

    def of(x: Column, i: Column) -> Column:
        return _pack(F.xxhash64(x, *(F.get(tokens, i + j) for j in range(1, K))), i)

    many = F.slice(F.transform(tokens, of), F.lit(1), F.greatest(F.size(tokens) - (K - 1), F.lit(0)))
    few = F.when(F.size(tokens) > 0, F.array(_pack(F.xxhash64(tokens), F.lit(0)))).otherwise(_none("long"))
    return F.sort_array(F.when(F.size(tokens) >= K, many).otherwise(few))


def occurrences(sorted_kmers: Column) -> Column:
    """1, 2, .. within each run of equal k-mers; a run's positions ascend."""
    n = F.size(sorted_kmers)
    hash_at = lambda i: F.shiftright(F.get(sorted_kmers, i), _POS)
    firsts = F.filter(_range(n), lambda i: (i == 0) | (hash_at(i) != hash_at(i - 1)))
    return _let(firsts, lambda b: F.flatten(F.transform(b, lambda s, j: F.sequence(F.lit(1), F.coalesce(F.get(b, j + 1), n) - s))))


def numbered(sorted_kmers: Column, occ: Column) -> Column:
    """Sorted longs: hash of (k-mer, occurrence), whose top bits are the bin, then position."""

    def of(known: Column):
        return lambda x, i: _pack(F.xxhash64(F.shiftright(x, _POS), F.get(known, i)), x.bitwiseAND(F.lit(_LOW)))

    # Bound by _let: named once only, it would be inlined into the lambda and computed for each element.
    return F.sort_array(_let(occ, lambda known: F.transform(sorted_kmers, of(known))))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _BIN)


def minimal(mixed: Column) -> Column:
    """The two smallest of each bin, still sorted: those whose second predecessor is in another bin."""
    return F.filter(mixed, lambda x, i: (i < 2) | (_bin(F.get(mixed, i - 2)) != _bin(x)))


def sketch(chosen: Column) -> Column:
    """``BINS`` longs below 2^32: per bin the ordered tuple of its two minimal k-mers."""
    n = F.size(chosen)

    def of(b: Column, bins: Column) -> Column:
        here = F.array_position(bins, b)
        later = F.coalesce(F.get(F.filter(_range(n), lambda f: F.get(bins, f) > b), F.lit(0)), F.lit(0))
        at = F.when(here > 0, (here - 1).cast("int")).otherwise(later)

        def tuple_(i: Column) -> Column:
            x, y = F.get(chosen, i), F.get(chosen, (i + 1) % n)
            swap = x.bitwiseAND(F.lit(_LOW)) > y.bitwiseAND(F.lit(_LOW))
            hx, hy = F.shiftright(x, _POS), F.shiftright(y, _POS)
            return F.xxhash64(F.when(swap, hy).otherwise(hx), F.when(swap, hx).otherwise(hy)).bitwiseAND(F.lit(0xFFFFFFFF))

        return _let(at, tuple_)

    every = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
    full = _let(F.transform(chosen, _bin), lambda bins: F.transform(every, lambda b: of(b, bins)))
    return F.when(n > 0, full).otherwise(F.array_repeat(F.lit(0).cast("long"), BINS))


def with_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """``df`` with the sketch of ``text_col`` as array<long> ``out``."""
    keep = df.columns
    df = df.withColumn("_tokens", token_hashes(F.col(text_col)))
    df = df.select(*keep, kmers(F.col("_tokens")).alias("_kmers"))
    df = df.withColumn("_occ", occurrences(F.col("_kmers")))
    df = df.select(*keep, numbered(F.col("_kmers"), F.col("_occ")).alias("_mixed"))
    df = df.select(*keep, minimal(F.col("_mixed")).alias("_chosen"))
    return df.select(*keep, sketch(F.col("_chosen")).alias(out))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal components."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1.0).otherwise(0.0))
    return F.aggregate(same, F.lit(0.0), lambda acc, x: acc + x) / BINS


def written(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def with_next(rows: DataFrame, order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rows`` with ``next``: the whole following row as a struct, in ascending ``order_col`` (nulls first), round the end.

    One shuffle: rows go to ranges of the order (percentiles of ids, as many as there are tasks), each range's first row
    also to the range before it. The driver sees the range borders only.
    """
    spark = rows.sparkSession
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = rows.agg(F.percentile_approx(order_col, [i / n for i in range(1, n)], 10 * n).alias("p"), F.min(order_col).alias("low"), F.count_if(F.col(order_col).isNull()).alias("nulls")).first()
    borders = sorted(set(stats.p or []))
    key = F.col(order_col)
    known = F.array(*(F.lit(b) for b in borders)) if borders else F.array().cast("array<long>")
    bucket = F.when(key.isNull(), 0).otherwise(F.size(F.filter(known, lambda b: b <= key)))
    whole = F.struct(*rows.columns)
    own = rows.select(bucket.alias("_bucket"), F.lit(0).alias("_guest"), whole.alias("_row"))
    others = [c for c in rows.columns if c not in (order_col, text_col)]
    pick = lambda df, to: df.groupBy(order_col).agg(F.min(F.struct(text_col, *others)).alias("_m")).select(to.alias("_bucket"), F.lit(1).alias("_guest"), F.struct(*(key.alias(c) if c == order_col else F.col("_m")[c].alias(c) for c in rows.columns)).alias("_row"))
    first = rows.where(key.isNull() if stats.nulls else key == F.lit(stats.low))
    guests = pick(first, F.lit(len(borders)))
    if borders:
        guests = guests.unionByName(pick(rows.where(key.isin(borders)), F.size(F.filter(known, lambda b: b < key))))
    order = W.partitionBy("_bucket").orderBy("_guest", F.asc_nulls_first(F.col("_row")[order_col]), F.col("_row")[text_col])
    led = own.unionByName(guests).withColumn("next", F.lead("_row").over(order)).where("_guest = 0")
    return led.select(*(F.col("_row")[c].alias(c) for c in rows.columns), "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_fingerprint(rows, "text", "fp"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text")).withColumn("half", half)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - F.col("half")), F.substring(F.col("next.text"), F.lit(1), F.col("half")))
    rows = rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
