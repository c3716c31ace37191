"""Full-text search: tokens, n-grams, BM25, phrases, exact and fuzzy terms, collapsing, highlighting."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import materialize

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(toks: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams of each token; a token shorter than n has none of that length."""

    def of_length(t: Column, n: int) -> Column:
        starts = F.when(F.length(t) >= n, F.sequence(F.lit(1), F.length(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(t, i, F.lit(n)))

    def of(t: Column) -> Column:
        return F.concat(*(of_length(t, n) for n in range(low, high + 1)))

    return F.flatten(F.transform(toks, of))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, term, tf, dl)``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    flat = rows.select("doc_id", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    return flat.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))


def bm25(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", boost: float = 1.0) -> DataFrame:
    """``(doc_id, score)`` of documents with any query term. Documents without tokens count in N, with length zero.

    One pass over the texts gives every document's length and its counts of the query's terms, which are a constant of the
    plan; those few numbers are stored once and serve the corpus statistics, the document frequencies and the scores.
    """
    terms = sorted({t.lower() for t in re.findall(r"[^\W_]+", query)})
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("toks"))
    hits = F.filter("toks", lambda t: t.isin(terms)) if terms else F.array().cast("array<string>")
    rows = rows.select("doc_id", F.size("toks").alias("dl"), hits.alias("hits"))
    counts = F.map_from_arrays(F.array_distinct("hits"), F.transform(F.array_distinct("hits"), lambda t: F.size(F.filter("hits", lambda x: x == t))))
    rows = materialize(rows.select("doc_id", "dl", counts.alias("tf")), "bm25")
    stats = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = rows.where(F.size("tf") > 0).select("doc_id", "dl", F.explode("tf").alias("term", "tf"))
    # As many rows as the query has terms, and one row: broadcasts of a constant size.
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("doc_id").agg((boost * F.sum(part)).alias("score"))


def phrase_match(text: Column, phrase: str) -> Column:
    """The phrase's tokens follow each other in the text."""
    padded = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    words = " ".join(t.lower() for t in re.findall(r"[^\W_]+", phrase))
    return padded.contains(f" {words} ") if words else F.lit(False)


def auto_fuzziness(term: str) -> int:
    """Edits allowed: none to 2 characters, one to 5, else two."""
    return 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def fuzzy_match(text: Column, term: str) -> Column:
    """Some token is within the automatic edit distance of ``term``."""
    term, edits = term.lower(), auto_fuzziness(term)
    return F.exists(tokens(text), lambda t: F.levenshtein(t, F.lit(term), edits) >= 0)


def fuzzy_search(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text", page: int = 0, size: int = 20) -> DataFrame:
    """Documents by the number of query terms found within their edit distance; ``total_hits`` counts before paging."""
    terms = [t.lower() for t in re.findall(r"[^\W_]+", query)]
    hits = sum((fuzzy_match(F.col(text_col), t).cast("int") for t in terms), F.lit(0))
    found = docs.select(F.col(id_col).alias("doc_id"), hits.alias("matched")).where("matched > 0")
    total = found.agg(F.count("*").alias("total_hits"))
    return found.orderBy(F.desc("matched"), "doc_id").offset(page * size).limit(size).join(F.broadcast(total))


def best_fields_search(docs: DataFrame, query: str, fields: dict[str, float], id_col: str = "doc_id", page: int = 0, size: int = 20, tag: str = "em") -> DataFrame:
    """Fuzzy search over several fields: a document's score is its best field's, matched terms times the field's boost.

    Returns ``doc_id, score, field, highlighted, total_hits``: ties between fields go to the one named first; the best field's
    exact terms are marked; ``total_hits`` counts before paging.
    """
    terms = [t.lower() for t in re.findall(r"[^\W_]+", query)]
    scored = [(sum((fuzzy_match(F.col(f), t).cast("int") for t in terms), F.lit(0)) * boost, f) for f, boost in fields.items()]
    best = F.greatest(*(s for s, _ in scored), F.lit(0.0)).cast("double")
    field, marked = F.lit(None).cast("string"), F.lit(None).cast("string")
    for s, f in reversed(scored):
        text = F.coalesce(F.col(f), F.lit(""))
        for t in dict.fromkeys(terms):
            text = F.regexp_replace(text, rf"(?iu)\b({re.escape(t)})\b", f"<{tag}>$1</{tag}>")
        hit = s.cast("double") == best
        field, marked = F.when(hit, F.lit(f)).otherwise(field), F.when(hit, text).otherwise(marked)
    found = docs.select(F.col(id_col).alias("doc_id"), best.alias("score"), field.alias("field"), marked.alias("highlighted")).where("score > 0")
    total = found.agg(F.count("*").alias("total_hits"))
    return found.orderBy(F.desc("score"), "doc_id").offset(page * size).limit(size).join(F.broadcast(total))


def collapse(rows: DataFrame, key: str, score: str = "score", id_col: str = "doc_id", top_k: int = 10) -> DataFrame:
    """Best row of each key, then the best ``top_k`` of those."""
    order = W.partitionBy(key).orderBy(F.desc(score), id_col)
    best = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return best.orderBy(F.desc(score), id_col).limit(top_k)


def ocr_search(ocr: DataFrame, query: str, top_k: int = 10, min_score: float = 0.3, id_col: str = "ocr_id", image_col: str = "image_id") -> DataFrame:
    """BM25 twice (any terms; boost 2 if the phrase stands there), 3 for the exact text; best row an image, then top-k."""
    base = bm25(ocr, query, id_col, "text")
    rows = ocr.join(base, F.col(id_col) == F.col("doc_id"), "left").withColumn("s", F.coalesce("score", F.lit(0.0)))
    total = F.col("s") + F.when(phrase_match(F.col("text"), query), 2 * F.col("s")).otherwise(0.0) + F.when(F.col("text") == query, 3.0).otherwise(0.0)
    scored = rows.drop("score", "doc_id").withColumn("score", total).where((F.col("score") > 0) & (F.col("score") >= min_score)).drop("s")
    return collapse(scored, image_col, "score", id_col, top_k)


def highlight(text: Column, term: str) -> Column:
    return F.regexp_replace(text, rf"(?iu)\b({re.escape(term)})\b", "<em>$1</em>")
