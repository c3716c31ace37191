"""Language identification with hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs, drawn from its code point. A trigram is the product of its letters'
vectors, the first rotated twice and the second once; a text is the sum of its trigrams, each weighted by the root of its
count. A language prototype is the sum of unit-length training texts, less the mean of all prototypes, which takes away
what languages share. Texts go to the prototype with the largest cosine.

Text is lower-cased; a run of other characters is one word border. Training takes at most ``TRAIN_PER_LANG`` rows of a
language (a random share of each language's rows); prototypes are the only thing that reaches the driver.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled row all is ``und``;
repeated rows get equal answers; further columns are ignored. The score is the softmax of the cosines at ``TEMPERATURE``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches

DIM = 1024
TRAIN_PER_LANG = 4000
TEMPERATURE = 0.05
UNKNOWN = "und"
#: A text of at least so many different trigrams whose best cosine is below this is in none of the learnt languages. Shorter
#: texts can't be told from chance: the cosine of unrelated texts has spread 1 / 32.
MIN_COSINE, MIN_TRIGRAMS = 0.1, 60
#: A prediction with at least this score replaces another label.
RELABEL = 0.95
#: Trigram vectors a worker keeps (4 KB each).
CACHE_TRIGRAMS = 20_000
TRAIN_TASKS = 24


class Encoder:
    """Trigram vectors of texts, with a bounded cache."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        self.signs: dict[int, np.ndarray] = {}
        self.clear()

    def clear(self) -> None:
        self.rows: dict[int, int] = {}
        self.table = np.zeros((256, self.dim), np.float32)

    def sign(self, point: int) -> np.ndarray:
        if point not in self.signs:
            if len(self.signs) > CACHE_TRIGRAMS:
                self.signs.clear()
            self.signs[point] = np.random.default_rng(point).choice(np.array([-1, 1], np.float32), self.dim)
        return self.signs[point]

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Distinct trigram codes and their counts; None without a letter."""
        if not text:
            return None
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        letters = self.letter[points]
        if not letters.any():
            return None
        points[~letters] = 32
        keep = letters.copy()
        keep[1:] |= letters[:-1]
        points = np.concatenate([[32], points[keep], [32]])
        if points[-2] == 32:
            points = points[:-1]
        return np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)

    def bundle(self, codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weighted sum of trigram vectors."""
        if len(self.rows) + len(codes) > CACHE_TRIGRAMS:
            self.clear()
        out = np.zeros(self.dim, np.float32)
        for at in range(0, len(codes), CACHE_TRIGRAMS // 2):
            out += self._part(codes[at : at + CACHE_TRIGRAMS // 2].tolist(), weights[at : at + CACHE_TRIGRAMS // 2])
            if len(self.rows) > CACHE_TRIGRAMS:
                self.clear()
        return out

    def _part(self, codes: list[int], weights: np.ndarray) -> np.ndarray:
        rows = self.rows
        for c in codes:
            if c not in rows:
                if len(rows) == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[len(rows)] = np.roll(self.sign(c >> 42), 2) * np.roll(self.sign(c >> 21 & 0x1FFFFF), 1) * self.sign(c & 0x1FFFFF)
                rows[c] = len(rows)
        return weights @ self.table[[rows[c] for c in codes]]

    def text_vector(self, text: str | None) -> np.ndarray | None:
        grams = self.trigrams(text)
        return None if grams is None else self.vector(*grams)

    def vector(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of trigrams with counts."""
        v = self.bundle(codes, np.sqrt(counts).astype(np.float32))
        n = np.linalg.norm(v)
        return v / n if n else v


@lru_cache(maxsize=1)
def shared_encoder() -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder()


def _bundle_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder, sums = shared_encoder(), {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            v = encoder.text_vector(text.as_py())
            if v is not None:
                sums[lang] = sums.get(lang, 0) + v.astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])


def train_prototypes(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_lang: int = TRAIN_PER_LANG) -> dict[str, np.ndarray]:
    """Unit prototypes of the languages in ``labelled``; null languages and texts are left out."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    picked = rows.sampleBy("lang", {k: min(1.0, per_lang / n) for k, n in counts.items()}, seed=11)
    parts = picked.repartition(TRAIN_TASKS).mapInArrow(small_batches(_bundle_languages), "lang string, vector array<double>").collect()
    sums: dict[str, np.ndarray] = {}
    for r in sorted(parts, key=lambda r: (r.lang, r.vector[:4])):
        sums[r.lang] = sums.get(r.lang, 0) + np.array(r.vector)
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sums.items()}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else 0
    return {k: ((v - mean) / max(np.linalg.norm(v - mean), 1e-12)).astype(np.float32) for k, v in unit.items()}


def _predict(names: list[str], matrix: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder()
        for batch in batches:
            langs, scores, cosines, sizes = [], [], [], []
            for text in batch.column(batch.num_columns - 1):
                grams = encoder.trigrams(text.as_py()) if names else None
                if grams is None:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    cosines.append(0.0)
                    sizes.append(0)
                    continue
                v = encoder.vector(*grams)
                cos = matrix @ v
                best = int(np.argmax(cos))
                langs.append(names[best])
                scores.append(float(1 / np.exp((cos - cos[best]) / TEMPERATURE).sum()))
                cosines.append(float(cos[best]))
                sizes.append(len(grams[0]))
            new = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "lang_pred", "score", "cosine", "trigrams"])
        encoder.clear()  # the worker lives on for other stages

    return run


def predict_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all) with ``lang_pred``, ``score``, ``cosine`` and ``trigrams``; one pass, no shuffle.

    Kept columns travel as one struct, so names that clash with the result's replace nothing inside.
    """
    names = sorted(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIM), np.float32)
    keep = docs.columns if keep is None else keep
    fields = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
    rows = docs.select(*fields, F.col(text_col).cast("string").alias("the_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    out = rows.mapInArrow(small_batches(_predict(names, matrix)), f"{schema}, lang_pred string, score double, cosine double, trigrams long")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "cosine", "trigrams")


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows whose crc32(id) mod 4 is not 2, then predict all: ``doc_id, held_out, lang_pred, score``."""
    held = F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False))
    prototypes = train_prototypes(docs.where(~held), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return predict_language(rows, prototypes, keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """``docs`` in one of the learnt languages (of ``languages``, if given); a null ``lang`` becomes the predicted one.

    A ``lang`` that contradicts a confident prediction becomes the predicted one too: of a text of ``MIN_TRIGRAMS`` and more,
    with a score of at least ``RELABEL``. The document itself stays.

    Dropped are texts without a letter, texts predicted to be in another language, and texts of ``MIN_TRIGRAMS`` and more
    whose cosine with every prototype is below ``MIN_COSINE``. Without a labelled row to train on no language can be told,
    and only the letters decide.
    """
    held = F.coalesce(fold(F.col(id_col), 4) == 2, F.lit(False))
    prototypes = train_prototypes(docs.where(~held), text_col, lang_col)
    if not prototypes:
        return docs.where(F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)))
    safe = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(docs.columns)))  # own columns may be named like the result's
    named = predict_language(safe, prototypes, f"k{docs.columns.index(text_col)}")
    named = named.where((F.col("lang_pred") != UNKNOWN) & ((F.col("trigrams") < MIN_TRIGRAMS) | (F.col("cosine") >= MIN_COSINE)))
    if languages is not None:
        named = named.where(F.col("lang_pred").isin(languages))
    kept = {c: F.col(f"k{i}") for i, c in enumerate(docs.columns)}
    predicted = F.col("lang_pred").cast(docs.schema[lang_col].dataType)
    sure = (F.col("trigrams") >= MIN_TRIGRAMS) & (F.col("score") >= RELABEL)
    kept[lang_col] = F.when(kept[lang_col].isNull() | sure, predicted).otherwise(kept[lang_col])
    return named.select(*(x.alias(c) for c, x in kept.items()))
