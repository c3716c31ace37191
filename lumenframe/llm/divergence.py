"""How far the sources of a language diverge, in words: between sources, and from the language as a whole.

Words are found by bytes. The texts of a batch stand in one UTF-8 buffer; a table of 256 entries tells word bytes from
others, and the changes are the borders. Slices with equal XXH3 hashes are one word once their bytes have been compared
with those of the first; those that differ form words of their own. Counts of (language, source, word) are added up in
the worker, then on both sides of one shuffle.

Kept are the words of a language in at least ``min_docs`` of its documents, V in number. A source gives a kept word that
it has ``count`` times, of N in all, p = 1 + floor(1e9 (count + 1) / (N + V)), and f = floor((p - q)^2 / q) is how far p is from q.

* ``pair``: the sum of f over all kept words, for each other source (q) of the language.
* ``term``: the words that a source has more of than its language (q), the ``top`` first by f.

Sums over pairs are taken where words are few: (language, two blocks of sources, block of words) is one group of at most
2 ``SOURCES`` rows of a sparse (CSR) matrix with about ``TERMS`` columns. Words that one or both of two sources lack need no
rows: f over a row's own words comes from ``reduceat`` over the CSR data, and the rest from the sources' p for absent words.
All numbers are integers; p is computed with decimals, so that no count of a corpus overflows.

Defined results: null text, lang and source are empty strings; a source without words, and a language without kept words,
still has its pairs (value 0 without kept words); repeated rows count as documents; an empty table gives no row; further columns are
ignored. A worker needs a few times its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.plans.storage import broadcast_if_small, fits_broadcast, materialize

SCALE = 1_000_000_000
#: Text that is looked at together, and bytes compared at once.
SLICE_BYTES, COMPARE_BYTES = 4 << 20, 1 << 20
#: Counts that a worker adds up before it passes them on.
TALLY = 500_000
#: Sources and words of a block, and the parts of a hot source where its table isn't broadcast.
SOURCES, TERMS, SALT = 64, 1024, 32

#: Bytes of words, and A-Z as a-z.
WORD = np.zeros(256, bool)
WORD[0x41:0x5B] = WORD[0x61:0x7B] = WORD[0x80:] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(texts: list[bytes], hashed=xxhash.xxh3_64_intdigest) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """``(distinct words, word of each slice, text of each slice)``."""
    joined = b"\0".join(texts).translate(LOWER)
    buffer = np.frombuffer(joined, np.uint8)
    steps = np.diff(np.concatenate([[False], WORD[buffer], [False]]).view(np.int8))
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    heads = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    of_text = np.searchsorted(heads, starts, side="right") - 1
    hashes = np.fromiter((hashed(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    size, like = ends - starts, first[code]
    same = size == size[like]
    until = np.cumsum(size)
    at = 0
    while at < len(starts):  # slices of about COMPARE_BYTES, compared byte by byte with the first of their hash
        to = max(at + 1, int(np.searchsorted(until, (until[at - 1] if at else 0) + COMPARE_BYTES)))
        mine = np.arange(at, to)[same[at:to]]
        if len(mine):
            n = size[mine]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            equal = buffer[np.repeat(starts[mine], n) + inside] == buffer[np.repeat(starts[like[mine]], n) + inside]
            same[mine] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        at = to
    found = [joined[starts[i] : ends[i]] for i in first]
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():  # one hash, other bytes
        word = joined[starts[i] : ends[i]]
        if word not in others:
            others[word] = len(found)
            found.append(word)
        code[i] = others[word]
    return found, code, of_text


class Tally:
    """Counts and documents of (group, word), added up over many batches."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.words: dict[bytes, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, groups: list[tuple[str, str]], texts: list[bytes]) -> None:
        of_text = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.int64)
        found, code, text = words(texts)
        ids = np.array([self.words.setdefault(w, len(self.words)) for w in found], np.int64)
        if not len(code):
            return
        seen, n = np.unique(text << 32 | ids[code], return_counts=True)  # one entry for a document's word
        keys = of_text[seen >> 32] << 32 | seen & 0xFFFFFFFF
        self.parts.append((keys, n, np.ones(len(n), np.int64)))
        self.held += len(n)
        if self.held > TALLY:
            self.combine()

    def combine(self) -> None:
        if self.parts:
            keys, n, docs = (np.concatenate(x) for x in zip(*self.parts))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts = [(keys[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first))]
            self.held = len(first)

    def batch(self) -> pa.RecordBatch:
        """What was added so far, and a row without a word for each group."""
        self.combine()
        keys, n, docs = self.parts[0] if self.parts else (np.zeros(0, np.int64),) * 3
        every = len(self.groups)
        group = np.concatenate([keys >> 32, np.arange(every)])
        nothing = np.zeros(every, np.int64)
        langs, sources = (pa.array([g[i] for g in self.groups], pa.string()).take(pa.array(group)) for i in (0, 1))
        word = pa.array(list(self.words), pa.binary()).cast(pa.string()).take(pa.array(np.concatenate([keys & 0xFFFFFFFF, nothing]), mask=np.arange(len(group)) >= len(keys)))
        return pa.RecordBatch.from_arrays([langs, sources, word, pa.array(np.concatenate([n, nothing])), pa.array(np.concatenate([docs, nothing]))], ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = Tally()
    for batch in batches:
        texts, groups, held = [], [], 0
        for lang, source, text in zip(*batch.columns):
            raw = text.as_buffer().to_pybytes()
            texts.append(raw)
            groups.append((lang.as_py(), source.as_py()))
            held += len(raw)
            if held >= SLICE_BYTES:
                tally.add(groups, texts)
                texts, groups, held = [], [], 0
        if texts:
            tally.add(groups, texts)
        if tally.held > TALLY:
            yield tally.batch()
            tally.clear()
    yield tally.batch()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences of each word in each source, documents that have it, and a row without ``term`` for each source."""
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a word: 1 + floor(1e9 (count + 1) / (total + kept)), exactly; null without kept words."""
    over = (F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")).cast("decimal(38,0)")
    under = F.when(kept > 0, (total + kept)).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", over, under)).cast("long")


def surprise(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("long")


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their (lang, source); a hot source is dealt to ``SALT`` parts where the table is too large to broadcast."""
    if fits_broadcast(groups):
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash("term"), F.lit(SALT))).join(salted, ["lang", "source", "_salt"]).drop("_salt")


def pair_sums(group: pa.Table) -> pa.Table:
    """Sums of f for all ordered pairs of sources in a group of two blocks of sources and one block of words.

    Rows without ``term`` are the sources: ``p`` for absent words, ``size`` (kept words it has) and ``kept``.
    """
    lang, low, high, block = (group.column(c)[0].as_py() for c in ("lang", "low", "high", "words"))
    terms = group.column("term").combine_chunks()
    head = np.array(terms.is_null())
    p, size, kept, part = (group.column(c).to_numpy() for c in ("p", "size", "kept", "part"))
    names = group.column("source").to_pylist()
    sources = [names[i] for i in np.flatnonzero(head)]
    number = {s: i for i, s in enumerate(sources)}
    absent, own, side = p[head], size[head], part[head]
    v = int(kept[head][0])
    row = np.array([number[names[i]] for i in np.flatnonzero(~head)], np.int64)
    column = terms.filter(pa.array(~head)).dictionary_encode().indices.to_numpy().astype(np.int64)
    order = np.lexsort((column, row))
    row, column, data = row[order], column[order], p[~head][order]
    n, wide = len(sources), int(column.max()) + 1 if len(column) else 0
    pointer = np.searchsorted(row, np.arange(n + 1))
    full = np.flatnonzero(np.diff(pointer))

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n, np.int64)
        if len(full):
            out[full] = np.add.reduceat(values, pointer[full])
        return out

    far = lambda a, b: (a - b) * (a - b) // b
    lefts, rights, values = [], [], []
    for s in range(n):
        others = np.flatnonzero(side != side[s]) if low != high else np.delete(np.arange(n), s)
        if v and len(others):
            mine = slice(pointer[s], pointer[s + 1])
            dense, has = np.full(wide, absent[s]), np.zeros(wide, bool)
            dense[column[mine]], has[column[mine]] = data[mine], True
            both = has[column]
            sums = by_row(far(dense[column], data))  # the other's words
            sums += far(data[mine][:, None], absent[None, :]).sum(axis=0)  # this one's words, as if the other had none of them
            sums -= by_row(np.where(both, far(dense[column], absent[row]), 0))  # but those it has were counted above
            neither = by_row(both.astype(np.int64)) + (v - own[s] - own if block == 0 else 0)  # over all blocks: words of neither
            sums += neither * far(absent[s], absent)
        else:
            sums = np.zeros(n, np.int64)
        lefts += [sources[s]] * len(others)
        rights += [sources[t] for t in others]
        values.append(sums[others])
    found = pa.array(np.concatenate(values).astype(np.int64) if values else np.zeros(0, np.int64))
    return pa.table({"lang": pa.array([lang] * len(lefts), pa.string()), "source": pa.array(lefts, pa.string()), "item": pa.array(rights, pa.string()), "value": found})


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, **columns: str) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` of every source of every language."""
    counts = materialize(term_counts(docs, **columns), "terms")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    rows = materialize(counts.where("term is not null").select("lang", "source", "term", "n").join(kept.select("lang", "term", "of_lang"), ["lang", "term"]), "kept-terms")
    of_lang = rows.select("lang", "term", "of_lang").distinct().groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"))
    of_source = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    groups = counts.where("term is null").select("lang", "source").join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["total", "size", "kept", "lang_total"])
    sources = materialize(counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources")), "langs")
    parts = F.ceil(F.col("sources") / SOURCES).cast("int")
    groups = groups.join(broadcast_if_small(sources), "lang")
    groups = groups.select(
        "lang", "source", "total", "size", "kept", "lang_total", parts.alias("parts"), F.pmod(F.xxhash64("source"), parts).cast("int").alias("part"),
        F.greatest(F.ceil(F.col("kept") / TERMS), F.lit(1)).cast("int").alias("blocks"), share(F.lit(0), F.col("total"), F.col("kept")).alias("absent"),
    )
    groups = materialize(groups, "sources")
    known = _joined(rows, groups).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))

    q = share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))
    terms = known.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), surprise(F.col("p"), F.col("q")).alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    layout = ["lang", "source", "term", "p", "size", "kept", "part", "parts", "words"]
    cells = known.withColumn("words", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")).select(*layout)
    heads = groups.withColumn("words", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("term", F.lit(None).cast("string"))
    heads = heads.withColumn("p", F.coalesce("absent", F.lit(1))).select(*layout)
    met = cells.unionByName(heads).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other", "parts")
    sums = met.groupBy("lang", "low", "high", "words").applyInArrow(pair_sums, "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)


SQL = r"""
with d as (
  select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as row_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
), t as (
  select lang, source, row_id, unnest(w) as term from d
), c as (
  select lang, source, term, count(*) as n, count(distinct row_id) as docs from t group by all
), kept as (
  select lang, term, sum(n) as of_lang from c group by all having sum(docs) >= 3
), l as (
  select g.lang, count(k.term) as v, coalesce(sum(k.of_lang), 0) as lang_total from (select distinct lang from d) g left join kept k using (lang) group by all
), g as (
  select s.lang, s.source, l.v, l.lang_total, coalesce(x.total, 0) as total
  from (select distinct lang, source from d) s join l using (lang) left join (select lang, source, sum(n) as total from c join kept using (lang, term) group by all) x using (lang, source)
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + g.v) as p, 1 + (1000000000::hugeint * (k.of_lang + 1)) // (g.lang_total + g.v) as q
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), pair as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
), r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source
  union all select lang, source, 'term', term, (((p - q) * (p - q)) // q)::bigint from p where n > 0 and p > q
)
select lang, source, part, item, value, rank from (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r) where part = 'pair' or rank <= 200
"""
