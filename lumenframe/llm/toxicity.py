"""Toxic spans by a linear-chain conditional random field, aggregated to document scores.

A token's state is toxic or clean. Its features are its own and its neighbours': the word, its first three to seven and
last three characters, its shape, and the words beside it, hashed to ``2^BITS`` weights. Only documents carry labels, so
the tokens' states are latent: a document is toxic if any of its tokens is, and a share ``NOISE`` of the documents
without a toxic token is labelled toxic all the same. The chain is fitted by the gradient of that likelihood: with P0 the
probability that all tokens are clean, which is the inverse of the partition functions of its sentences, a clean
document's features count by their expectation, and a toxic one's by what they gain over it if not all tokens are clean.
Both come from forward-backward.

Marginals of the toxic state give the offending offsets. 1 - P0, the largest marginal, their sum and the document's
length give the document's probability by a logistic curve, which is fitted on documents that the chain wasn't.

One bound: the model is fitted on at most ``FIT_DOCS`` labelled documents of at most ``FIT_TOKENS`` tokens (half of them toxic
at most, at random, with weights that undo the choice). Those texts and the weights are all that the driver sees. Every
document is scored whole, in chains of a sentence, or of ``CHAIN`` tokens where a sentence is longer.

Defined results: null or empty text has no token and gets the score of its length, zero; labels other than 0 and 1 and
null labels are left out of training; without both labels in training every score is 0; if a document has several
labels the largest counts once; repeated rows get equal scores; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.langid import fold
from lumenframe.llm.tables import small_batches
from lumenframe.plans.storage import broadcast_if_small, materialize

#: Bound on the labelled documents that the model is fitted on, and on their length.
FIT_DOCS, FIT_TOKENS = 4000, 3000
#: Hashed weights, and the fitted documents a feature needs.
BITS, LEAST_DOCS = 19, 4
PREFIXES = (3, 4, 5, 6, 7)
NOISE = 0.03
STEPS, RATE, RIDGE = 40, 0.35, 0.15
#: Longest chain in tokens.
CHAIN = 256
CACHE_WORDS = 300_000

_EDGE = re.compile(r"^\W+|\W+$")
_END = tuple(".!?")


def _word(token: str) -> str:
    if not (token[0].isalnum() and token[-1].isalnum()):
        token = _EDGE.sub("", token)
    return token.lower()


def _shape(token: str) -> str:
    marks = "!" if token[-1] in "!?" else ""
    if token.isupper() and len(token) > 1:
        return "S" + "A" + marks
    return "S" + ("9" if any(c.isdigit() for c in token) else "a" if token[0].islower() else "T") + marks


def features(token: str) -> list[int]:
    """Hashed features of a token itself."""
    word = _word(token)
    keys = ["w" + word, "s" + word[-3:], _shape(token), *["p" + word[:n] for n in PREFIXES if len(word) > n]] if word else [_shape(token)]
    return [crc32(k.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for k in keys]


def beside(token: str) -> tuple[int, int]:
    """Hashed features that a token lends to the one after it, and to the one before it."""
    word = _word(token).encode("utf-8", "surrogatepass")
    return crc32(b"<" + word) & ((1 << BITS) - 1), crc32(b">" + word) & ((1 << BITS) - 1)


@dataclass
class Model:
    """Hashed weights, bias of the toxic state, transitions[2, 2] (clean to clean scores 0) and the document curve; no weights: nothing learnt."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    curve: np.ndarray


def forward_backward(unary: np.ndarray, lengths: np.ndarray, trans: np.ndarray, each: bool | None = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """(marginals of state 1, transition expectations, log partitions) of chains; expectations are summed, of ``each`` chain, or left out (None).

    ``unary[chains, steps]`` is the score of state 1 (state 0 scores 0); ``trans[from, to]``. The recursions run on the ratios
    of the two states' sums, which need no logarithms.
    """
    (e00, e01), (e10, e11) = np.exp(np.clip(trans, -30, 30))
    x = np.exp(np.clip(np.ascontiguousarray(unary.T), -30, 30))
    steps, n = x.shape
    r, q, grown = np.empty_like(x), np.ones_like(x), np.zeros(n)
    r[0] = x[0]
    for i in range(1, steps):
        under = e00 + r[i - 1] * e10
        r[i] = x[i] * (e01 + r[i - 1] * e11) / under
        grown += np.where(i < lengths, np.log(under), 0.0)
    for i in range(steps - 2, -1, -1):
        ahead = x[i + 1] * q[i + 1]
        q[i] = np.where(i + 1 < lengths, (e10 + e11 * ahead) / (e00 + e01 * ahead), 1.0)
    z = grown + np.log1p(r[lengths - 1, np.arange(n)])
    inside = np.arange(steps)[:, None] < lengths
    odds = r * q
    marginal = np.where(inside, odds / (1 + odds), 0.0).T
    if each is None:
        return marginal, None, z
    ahead = x[1:] * q[1:]
    parts = [np.full_like(ahead, e00), e01 * ahead, r[:-1] * e10, r[:-1] * e11 * ahead]
    share = np.where(inside[1:], 1 / sum(parts), 0.0)
    pair = np.stack([(p * share).sum(axis=0) for p in parts], axis=-1).reshape(n, 2, 2)
    return marginal, pair if each else pair.sum(axis=0), z


def _chunks(lengths: np.ndarray, cells: int = 200_000) -> Iterator[np.ndarray]:
    """Places of chains, alike lengths together, so many that padded they have about ``cells`` cells."""
    order = np.argsort(lengths, kind="stable")
    ordered, start = lengths[order], 0
    for most in (4, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, CHAIN):
        end = int(np.searchsorted(ordered, most, side="right"))
        for at in range(start, end, cells // most):
            yield order[at : min(end, at + cells // most)]
        start = end


def sentences(ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and documents of the chains: a sentence ends where ``ends`` says and with its document; longer ones are cut every ``CHAIN`` tokens."""
    last = ends.copy()
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    stops = np.flatnonzero(last) + 1
    starts = np.append(0, stops[:-1]) if len(stops) else stops
    pieces = -(-(stops - starts) // CHAIN)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = np.repeat(starts, pieces) + CHAIN * nth
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return cut, np.minimum(np.repeat(stops, pieces) - cut, CHAIN), owner[cut] if len(owner) else cut


def unary_scores(ids: np.ndarray, starts: np.ndarray, own: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Scores of the toxic state by token: its word's own, and what its neighbours in the chain lend it."""
    out = own[ids]
    inside = np.ones(len(ids), bool)
    inside[starts] = False
    out[1:] += np.where(inside[1:], left[ids[:-1]], 0.0)
    out[:-1] += np.where(inside[1:], right[ids[1:]], 0.0)
    return out


def run_chains(starts: np.ndarray, lengths: np.ndarray, unary: np.ndarray, trans: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(marginals by token, expected transitions by chain, log partitions by chain)."""
    marginal, z, moved = np.zeros(len(unary)), np.zeros(len(starts)), np.zeros((len(starts) if moves else 0, 2, 2))
    for at in _chunks(lengths):
        grid = starts[at, None] + np.arange(lengths[at].max())
        inside = np.arange(grid.shape[1]) < lengths[at, None]
        padded = np.where(inside, unary[np.minimum(grid, len(unary) - 1)], 0.0)
        m, pair, z[at] = forward_backward(padded, lengths[at], trans, True if moves else None)
        if moves:
            moved[at] = pair
        marginal[grid[inside]] = m[inside]
    return marginal, moved, z


class Sample:
    """Fitted documents as word numbers and sentences, with the hashed features of each word."""

    def __init__(self, documents: list[list[str]]):
        words: dict[str, int] = {}
        self.tokens = np.array([words.setdefault(t, len(words)) for d in documents for t in d], np.int64)
        sizes = np.array([len(d) for d in documents], np.int64)
        self.document = np.repeat(np.arange(len(documents)), sizes)
        ends = np.array([w.endswith(_END) for w in words], bool)
        self.starts, self.lengths, self.owner = sentences(ends[self.tokens], sizes)
        own = [features(w) for w in words]
        self.of_word = np.repeat(np.arange(len(own)), [len(x) for x in own])
        self.own = np.array([f for x in own for f in x], np.int64)
        self.near = np.array([beside(w) for w in words], np.int64).reshape(-1, 2)
        self.has_left = np.ones(len(self.tokens), bool)
        self.has_left[self.starts] = False
        self.n = len(documents)

    def unary(self, weights: np.ndarray, bias: float) -> np.ndarray:
        word = np.bincount(self.of_word, weights[self.own], len(self.near)) + bias
        return unary_scores(self.tokens, self.starts, word, weights[self.near[:, 0]], weights[self.near[:, 1]])

    def gradient(self, per_token: np.ndarray) -> np.ndarray:
        """What a gradient by token is for each hashed weight."""
        n = len(self.near)
        word = np.bincount(self.tokens, per_token, n)
        left = np.bincount(self.tokens[:-1], per_token[1:] * self.has_left[1:], n)
        right = np.bincount(self.tokens[1:], per_token[:-1] * self.has_left[1:], n)
        size = 1 << BITS
        return np.bincount(self.own, word[self.of_word], size) + np.bincount(self.near[:, 0], left, size) + np.bincount(self.near[:, 1], right, size)

    def frequent(self, least: int = LEAST_DOCS) -> np.ndarray:
        """Which hashed weights have features in at least ``least`` documents."""
        pairs = np.unique(self.document << 32 | self.tokens)
        count = np.bincount(pairs & 0xFFFFFFFF, minlength=len(self.near))  # documents a word
        size = 1 << BITS
        return (np.bincount(self.own, count[self.of_word], size) + np.bincount(self.near.ravel(), np.repeat(count, 2), size)) >= least

    def run(self, unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return run_chains(self.starts, self.lengths, unary, trans)

    def summary(self, marginal: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Curve features of the documents."""
        top, sums = np.zeros(self.n), np.bincount(self.document, marginal, self.n)
        np.maximum.at(top, self.document, marginal)
        return curve_features(np.bincount(self.owner, z, self.n), top, sums, np.bincount(self.document, minlength=self.n))


def curve_features(z: np.ndarray, top: np.ndarray, sums: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Log-odds that any token is toxic, the largest marginal, and the logs of their sum and of the length."""
    odds = np.log(np.maximum(np.expm1(np.minimum(z, 50.0)), 1e-9))
    return np.stack([np.clip(odds, -12, 12) / 4, top, np.log1p(sums), np.log1p(tokens), np.ones_like(top)], axis=-1)


def document_gradients(z: np.ndarray, labels: np.ndarray, noise: float = NOISE) -> np.ndarray:
    """How much a document's expected features count in the gradient of its label's log likelihood; ``z`` = -log P0."""
    p0 = np.exp(-z)
    return np.where(labels == 1, (1 - noise) * p0 / (1 - (1 - noise) * p0), -1.0)


def fit_chain(sample: Sample, labels: np.ndarray, weight: np.ndarray, steps: int = STEPS, rate: float = RATE, ridge: float = RIDGE) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximum likelihood of the documents' labels by full-batch adaptive gradient steps: weights, bias, transitions."""
    size = 1 << BITS
    live = sample.frequent()
    theta = np.zeros(size + 4)
    theta[size] = -6.0
    square = np.full(size + 4, 1e-6)
    for _ in range(steps):
        trans = np.append(0.0, theta[size + 1 :]).reshape(2, 2)
        marginal, moves, z = sample.run(sample.unary(theta[:size], theta[size]), trans)
        pull = document_gradients(np.bincount(sample.owner, z, sample.n), labels) * weight
        by_token = marginal * pull[sample.document]
        grad = np.empty(size + 4)
        grad[:size] = sample.gradient(by_token) * live
        grad[size] = by_token.sum()
        grad[size + 1 :] = (moves * pull[sample.owner][:, None, None]).sum(axis=0).ravel()[1:]
        grad -= ridge * np.append(theta[:size], [0.0, *theta[size + 1 :]])
        square += grad**2
        theta += rate * grad / np.sqrt(square)
    return theta[:size] * live, float(theta[size]), np.append(0.0, theta[size + 1 :]).reshape(2, 2)


class _Rows(dict):
    """Row numbers of words in a table of their scores: own, lent to the next, lent to the one before, whether a sentence ends."""

    def __init__(self, model: Model):
        super().__init__()
        self.weights, self.bias, self.table = array("d", model.weights), model.bias, np.zeros((1024, 4))

    def __missing__(self, token: str) -> int:
        n, w = len(self), self.weights
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        after, before = beside(token)
        self.table[n] = sum([w[f] for f in features(token)], self.bias), w[after], w[before], token.endswith(_END)
        self[token] = n
        return n


class Tagger:
    """Scores texts with a model; scores of words are cached."""

    def __init__(self, model: Model):
        self.model, self.rows = model, _Rows(model)

    def score_all(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int]]]]:
        """Document probability and the offsets (code points) of toxic tokens, for each text; chains of all texts run together."""
        if not len(self.model.weights):
            return [(0.0, []) for _ in texts]
        if len(self.rows) > CACHE_WORDS:
            self.rows = _Rows(self.model)
        documents = [(t or "").split() for t in texts]
        sizes = np.array([len(d) for d in documents], np.int64)
        ids = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(documents)), np.int64, int(sizes.sum()))
        own, left, right, ends = self.rows.table.T
        starts, lengths, owner = sentences(ends[ids] > 0, sizes)
        marginal, _, z = run_chains(starts, lengths, unary_scores(ids, starts, own, left, right), self.model.transitions, False)
        document, firsts = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
        top = np.zeros(len(texts))
        if len(ids):
            top[sizes > 0] = np.maximum.reduceat(marginal, firsts[sizes > 0])
        x = curve_features(np.bincount(owner, z, len(texts)), top, np.bincount(document, marginal, len(texts)), sizes)
        scores = 1 / (1 + np.exp(-np.clip(x @ self.model.curve, -30, 30)))
        found: dict[int, list[int]] = {}
        for i in np.flatnonzero(marginal >= 0.5).tolist():
            found.setdefault(int(document[i]), []).append(i)
        out = []
        for d, text in enumerate(texts):
            spans = []
            if d in found:
                at = [m.span() for m in re.finditer(r"\S+", text)]
                spans = [at[i - firsts[d]] for i in found[d]] if len(at) == sizes[d] else []
            out.append((float(scores[d]), spans))
        return out


@lru_cache(maxsize=1)
def _kept_tagger(raw: bytes) -> Tagger:
    """The tagger of a model, kept with its cache between the tasks of a Python worker."""
    return Tagger(pickle.loads(raw))


def _fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", docs: int = FIT_DOCS, tokens: int = FIT_TOKENS, id_col: str = "doc_id") -> Model:
    """Fit on at most ``docs`` documents of ``labelled`` with at most ``tokens`` tokens each.

    Documents are drawn and ordered by a hash of their id and text, so that the model depends on the rows alone, not on
    their order or files; rows with the same id and text are equal, whichever comes first.
    """
    rows = labelled.select(F.col(label_col).cast("int").alias("toxic"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("id")).where("toxic in (0, 1) and text is not null")
    rows = rows.where(F.size(F.split("text", r"\s+")) <= tokens)
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(np.zeros(0), 0.0, np.zeros((2, 2)), np.zeros(5))
    take1 = min(n1, docs // 2)
    take0 = min(n0, docs - take1)
    drawn = rows.withColumn("draw", F.xxhash64("id", "text", F.lit(3)))  # copies have ids of their own: they are drawn one by one
    picked = []
    for label, k, n in ((1, take1, n1), (0, take0, n0)):
        share = min(1.0, (1.2 * k + 50) / n)  # a few more than wanted reach the driver, whatever the table's size
        some = drawn.where((F.col("toxic") == label) & (F.pmod("draw", F.lit(1 << 30)) < int(share * (1 << 30))))
        picked += sorted((r.toxic, r.draw, r.text) for r in some.select("toxic", "draw", "text").collect())[:k]
    take1, take0 = sum(r[0] == 1 for r in picked), sum(r[0] == 0 for r in picked)
    labels = np.array([r[0] for r in picked], float)
    documents = [r[2].split() for r in picked]
    weight = np.where(labels == 1, n1 / take1, n0 / take0)
    weight *= len(labels) / weight.sum()
    part = np.random.default_rng(0).permutation(len(labels))
    fitted, held = (part, part) if len(labels) < 40 else (part[len(part) // 4 :], part[: len(part) // 4])
    if len({*labels[fitted]}) < 2 or len({*labels[held]}) < 2:
        fitted = held = part
    sample = Sample([documents[i] for i in fitted])
    weights, bias, transitions = fit_chain(sample, labels[fitted], weight[fitted])
    sample = Sample([documents[i] for i in held])
    marginal, _, z = sample.run(sample.unary(weights, bias), transitions)
    return Model(weights, bias, transitions, _fit_curve(sample.summary(marginal, z), labels[held], weight[held]))


def _score(model: Model):
    raw = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _kept_tagger(raw)
        for batch in batches:
            got = tagger.score_all(batch.column(2).to_pylist())
            spans = [",".join(f"{a}:{b}" for a, b in s) for _, s in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([round(p, 9) for p, _ in got], pa.float64()), pa.array(spans, pa.string())], ["doc_id", "held_out", "score", "spans"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """``doc_id, held_out, score, predicted, spans``: learnt from labelled rows whose crc32(id) mod 5 is not 0, applied to all."""
    held = F.coalesce(fold(F.col(id_col), 5) == 0, F.lit(False))
    marks = labels.select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and label_id is not null")
    marks = marks.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    marks = broadcast_if_small(materialize(marks, "labels"))
    labelled = rows.where(~F.col("held_out")).join(marks, F.col("doc_id") == F.col("label_id")).select("toxic", "text", "doc_id")
    model = train(materialize(labelled, "labelled"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(small_batches(_score(model), 500), f"doc_id {kind}, held_out boolean, score double, spans string")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
