"""Personal data and secrets: base patterns, and more identifiers by bootstrapped contextual extraction.

Seeds are the base entities (e-mail, IP address, payment card, phone) and tokens that look drawn at random (``_SEED``: 16
characters and more of letters and digits that change places often; kind ``secret``). Every mention of a seed, and of any
other token that looks like an identifier (``_LIKE``), has lexical patterns: the three tokens before it, the two before
it, the ones on either side, and for longer tokens that begin with four characters of which one is no hex digit, those
(``AKIA...``). Punctuation marks are tokens of their own, so ``token = "`` and ``password=`` are patterns.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence is the believed share of all its slots
in the corpus, slots that hold plain words included; it is accepted with ``MIN_SEEDS`` different believed instances and
``MIN_CONFIDENCE``. An instance that is no seed is believed by the noisy-or of its accepted patterns, and believed ones
are seeds of further patterns in the next round. What stands in the slot of an accepted pattern and is shaped like an
identifier is a span of the pattern's kind. The floors are absolute: they don't move with the corpus.

Two passes over the texts: one for base entities, mentions and their patterns, stored once; one that counts the slots of
patterns with enough instances. The second is sent only which of 2^20 hash classes hold such a pattern, so its size is
bounded; the counts meet their patterns in a join. The same goes for accepted patterns: they are joined to the mentions.

Defined results: null text is empty (no spans); ties and repeated rows count as mentions; contexts don't cross lines;
further columns are ignored. Offsets are code points, ends exclusive. A tie between kinds goes to the lower one.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.tables import small_batches
from lumenframe.plans.storage import broadcast_if_small, materialize

KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.6
ROUNDS = 3
#: Hash classes of patterns, as bits.
CLASS_BITS = 20
CACHE_TOKENS = 300_000

# The base patterns of the contract.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")  # possessive: linear in long digit runs, same matches
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Punctuation marks and line ends are tokens of their own.
_TOKEN = re.compile(r"""[^\s"'`=:;,!?()<>\[\]{}|]+|["'`=:;,!?()<>\[\]{}|\n]""")
_MARKED = re.compile(r"[0-9@]")
#: What an identifier looks like: three digits among four characters, a digit among 16, or an at sign between word characters.
_LIKE = re.compile(r"(?=(?:[^0-9]*[0-9]){3})[\w+#][\w./+#%-]{3,}|(?=[^0-9]*[0-9])[\w+/-]{16,}|\w[\w.+-]*@\w[\w.-]*")
#: What looks drawn at random: letters and digits that change places three times and more.
_SEED = re.compile(r"(?=(?:[A-Za-z_+/-]*[0-9]){3})(?=(?:[^A-Za-z]*[A-Za-z]){3})(?=[A-Za-z]*[0-9]+[A-Za-z]+[0-9]|[0-9]*[A-Za-z]+[0-9]+[A-Za-z])[A-Za-z0-9_+/-]{16,}")
_PREFIX = re.compile(r"(?=[^\W_]{0,3}[G-Zg-z])[A-Za-z0-9_-]{4}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _ip_parts(text: str) -> bool:
    return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in text.split("."))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base entities, sorted by start, then kind."""
    out = []
    if not text:
        return out
    if "@" in text:
        for at in _email_spans(text):
            out.append((at[0], 0, at[1]))
    for m in _IP.finditer(text):
        if _ip_parts(m[0]):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _email_spans(text: str) -> Iterator[tuple[int, int]]:
    """The matches of ``_EMAIL``, found from each at sign backwards; linear in texts with long runs of local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def _code(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") or 1


class _Codes(dict):
    """64-bit codes of tokens, lower-cased and without closing dots; a line end is 0."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_TOKENS:
            self.clear()
        out = self[token] = 0 if token == "\n" else _code(token.lower().rstrip(".") or ".")
        return out


class _Prefixes(dict):
    """Codes of the first four characters of long tokens, 0 for others."""

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_TOKENS:
            self.clear()
        out = self[token] = _code(token[:4]) if len(token) >= 12 and _PREFIX.match(token) else 0
        return out


# Odd multipliers and kinds of patterns; a pattern's hash is a sum of products, modulo 2^64.
_A, _B, _C, _D, _E, _F = (np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def pattern_hashes(codes: np.ndarray, prefixes: np.ndarray) -> list[np.ndarray]:
    """For every token the hashes of its four patterns, 0 where it has none: three before, two before, either side, prefix."""
    n = len(codes)
    c = np.concatenate([np.zeros(3, np.uint64), codes, np.zeros(1, np.uint64)])
    x3, x2, x1, y = c[:n], c[1 : n + 1], c[2 : n + 2], c[4 : n + 4]
    none = np.uint64(0)
    before3 = np.where((x3 > 0) & (x2 > 0) & (x1 > 0), x3 * _A + x2 * _B + x1 * _C + np.uint64(3), none)
    before2 = np.where((x2 > 0) & (x1 > 0), x2 * _B + x1 * _C + np.uint64(2), none)
    beside = np.where((x1 > 0) & (y > 0), x1 * _D + y * _E + np.uint64(5), none)
    return [np.where(codes > 0, h, none) for h in (before3, before2, beside, np.where(prefixes > 0, prefixes * _F + np.uint64(7), none))]


def _mentions(text: str, base: list[tuple[int, int, int]], codes: _Codes, prefixes: _Prefixes) -> list[dict]:
    """Mentions of seeds and of other tokens like identifiers, with their patterns' hashes and words."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text)]
    starts, words = [t[0] for t in tokens], [t[2] for t in tokens]
    spans = [(s, e) for s, _, e in base]
    wanted = []  # token index, start, end, kind, seed
    for s, k, e in base:
        i = bisect_left(starts, s)
        if i < len(starts) and starts[i] == s:
            wanted.append((i, s, e, k, True))
    firsts = [s for s, _ in spans]
    longest = max((e - s for s, e in spans), default=0)
    for i, (s, e, word) in enumerate(tokens):
        if not _MARKED.search(word):
            continue
        bare = word.rstrip(".")
        e = s + len(bare)
        if not _LIKE.fullmatch(bare):
            continue
        near = spans[bisect_left(firsts, s - longest) : bisect_right(firsts, e)]
        if any(a < e and s < b for a, b in near):
            continue
        seed = bool(_SEED.fullmatch(bare))
        wanted.append((i, s, e, SECRET if seed else -1, seed))
    if not wanted:
        return []
    hashes = pattern_hashes(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), np.fromiter(map(prefixes.__getitem__, words), np.uint64, len(words)))
    out = []
    for i, s, e, kind, seed in wanted:
        whole = e >= tokens[i][1] - 1  # one token alone
        names = (" ".join(words[i - 3 : i]), " ".join(words[i - 2 : i]), f"{words[i - 1]} _ {words[i + 1]}" if whole and 0 < i < len(words) - 1 else "", f"{words[i][:4]}*")
        found = [(int(h[i].astype(np.int64)), n.lower() if j < 3 else n) for j, (h, n) in enumerate(zip(hashes, names)) if h[i] and (j < 2 or whole and (j == 2 or kind in (SECRET, -1)))]
        instance = int(np.uint64(_code(text[s:e])).astype(np.int64))
        out.append({"start": s, "end": e, "kind": kind, "seed": seed, "instance": instance, "patterns": [{"h": h, "name": n} for h, n in found]})
    return out


_MENTION = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.struct([("h", pa.int64()), ("name", pa.string())])))])
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])


def _written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes, prefixes = _Codes(), _Prefixes()
    for batch in batches:
        counts, digests, spans, mentions = [[], [], [], []], [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            marked = _MARKED.search(text) is not None
            base = base_spans(text) if marked else []
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in base))
            digests.append(hashlib.sha256(_written(base).encode()).hexdigest())
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            mentions.append(_mentions(text, base, codes, prefixes) if marked else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(mentions, pa.list_(_MENTION))],
            ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions"],
        )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stored table with a row a document: its base counts, digest and spans, and its mentions with their patterns."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    mention = "array<struct<start: int, end: int, kind: int, seed: boolean, instance: bigint, patterns: array<struct<h: bigint, name: string>>>>"
    out = rows.mapInArrow(small_batches(_scan), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start: int, kind: int, end: int>>, mentions {mention}")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "pii-scan")


def pattern_graph(scanned: DataFrame, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Stored edges ``(h, instance, name, kind, seed, n)`` of patterns with at least ``min_seeds`` different instances."""
    mentions = scanned.select(F.inline("mentions")).select("kind", "seed", "instance", F.inline("patterns"))
    edges = mentions.groupBy("h", "instance").agg(F.min("name").alias("name"), F.max("kind").alias("kind"), F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    enough = edges.groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= min_seeds).select("h")
    return materialize(edges.join(enough, "h", "left_semi"), "pii-graph")


def _slot_batches(classes: np.ndarray):
    held = np.zeros(1 << CLASS_BITS, bool)
    held[classes] = True
    bits = np.packbits(held)  # 128 KB to send

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often each pattern of the wanted classes stands before, around or at the head of any token."""
        wanted, codes, prefixes = np.unpackbits(bits).astype(bool), _Codes(), _Prefixes()
        for batch in batches:
            words = [w for value in batch.column(0) for w in (*_TOKEN.findall(value.as_py()), "\n")]
            hashes = pattern_hashes(np.fromiter(map(codes.__getitem__, words), np.uint64, len(words)), np.fromiter(map(prefixes.__getitem__, words), np.uint64, len(words)))
            every = np.concatenate([h[(h > 0) & wanted[(h >> np.uint64(64 - CLASS_BITS)).astype(np.int64)]] for h in hashes])
            keys, n = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], ["h", "slots"])

    return run


def slot_totals(docs: DataFrame, graph: DataFrame, text_col: str = "text") -> DataFrame:
    """Stored ``(h, slots)``: how many slots each pattern of the graph has in all texts."""
    classes = np.array([r.c for r in graph.select(F.shiftrightunsigned("h", 64 - CLASS_BITS).cast("int").alias("c")).distinct().collect()], np.int64)  # 2^20 at most
    text = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    found = text.mapInArrow(small_batches(_slot_batches(classes)), "h long, slots long").groupBy("h").agg(F.sum("slots").alias("slots"))
    return materialize(found.join(graph.select("h").distinct(), "h", "left_semi"), "pii-slots")


def accepted_patterns(graph: DataFrame, totals: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Stored ``(h, name, kind, confidence)`` of the patterns accepted after ``rounds`` rounds."""
    beliefs = None
    for turn in range(rounds):
        edges = graph
        if beliefs is not None:
            edges = graph.join(beliefs, "instance", "left").withColumn("kind", F.when(F.col("seed"), F.col("kind")).otherwise(F.coalesce("new_kind", F.lit(-1))))
        believed = F.when(F.col("seed"), 1.0).otherwise(F.lit(0.0) if beliefs is None else F.coalesce("belief", F.lit(0.0)))
        by_kind = edges.withColumn("b", believed).groupBy("h", "kind").agg(F.min("name").alias("name"), F.sum(F.col("n") * F.col("b")).alias("weight"), F.sum("n").alias("n"), F.count_if(F.col("b") >= min_confidence).alias("seeds"))
        scores = by_kind.groupBy("h").agg(F.min("name").alias("name"), F.max_by(F.col("kind"), F.struct("weight", -F.col("kind"))).alias("kind"), F.sum("weight").alias("weight"), F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
        scores = scores.join(totals, "h", "left").withColumn("confidence", F.col("weight") / F.greatest(F.col("n"), F.coalesce("slots", F.lit(0))))
        good = materialize(scores.where((F.col("seeds") >= min_seeds) & (F.col("confidence") >= min_confidence)).select("h", "name", "kind", "confidence"), "pii-accepted")
        if turn < rounds - 1:
            reached = graph.where(~F.col("seed")).select("h", "instance").join(good.select("h", F.col("kind").alias("new_kind"), "confidence"), "h")
            noisy_or = 1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))
            beliefs = materialize(reached.groupBy("instance").agg(noisy_or.alias("belief"), F.max_by(F.col("new_kind"), F.struct("confidence", -F.col("new_kind"))).alias("new_kind")), "pii-beliefs")
    return good


def learn_patterns(docs: DataFrame, text_col: str = "text", scanned: DataFrame | None = None, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, rounds: int = ROUNDS) -> DataFrame:
    """Accepted patterns ``(h, name, kind, confidence)`` of a corpus."""
    if scanned is None:
        scanned = scan(docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text")))
    graph = pattern_graph(scanned, min_seeds)
    return accepted_patterns(graph, slot_totals(docs, graph, text_col), min_seeds, min_confidence, rounds)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_found`` for every row; the last counts what patterns add."""
    scanned = scan(docs, id_col, text_col)
    good = broadcast_if_small(learn_patterns(docs, text_col, scanned))
    open_ = scanned.select("row", F.inline("mentions")).where("kind in (-1, 4)").select("row", "start", "end", F.inline("patterns"))
    hit = open_.join(good.select("h", "kind", "confidence"), "h").groupBy("row", "start", "end").agg(F.max_by(F.col("kind"), F.struct("confidence", -F.col("kind"))).alias("kind"))
    found = materialize(hit.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("found")), "pii-found")
    rows = scanned.drop("mentions").join(broadcast_if_small(found), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("found", F.array().cast("array<struct<start: int, kind: int, end: int>>"))))
    named = F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")))
    return rows.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(named, ",").alias("spans"), F.size(spans).cast("long").alias("n_spans"),
        F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_found"),
    )
