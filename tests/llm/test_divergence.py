import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lumenframe.llm import divergence as dv

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def found(text: str) -> list[str]:
    return [w.translate(UPPER) for w in PATTERN.findall(text)]


def plainly(rows):
    """The contract, with Python's integers."""
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source, w = lang or "", source or "", found(text or "")
        langs[lang].add(source)
        counts[lang, source].update(w)
        docs[lang].update(set(w))
    out = set()
    for lang, sources in langs.items():
        kept = [w for w, n in docs[lang].items() if n >= 3]
        v = len(kept)

        def ps(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (count[w] + 1) // (total + v) for w in kept}

        q_all = ps(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: ps(counts[lang, s]) for s in sources}
        far = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            ranked = {
                "pair": [(t, sum(far(p[s][w], p[t][w]) for w in kept)) for t in sources if t != s],
                "term": [(w, far(p[s][w], q_all[w])) for w in kept if counts[lang, s][w] and p[s][w] > q_all[w]],
            }
            for part, items in ranked.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[: 200 if part == "term" else None], 1)}
    return out


def corpus(seed: int, n: int, sources: int):
    draw = random.Random(seed)
    pool = ["a", "B", "the", "The", "é", "ÉA", "日本", "x" * 30, "ß", "İ"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    rows = []
    for i in range(n):
        text = "".join(draw.choice(pool) + draw.choice([" ", ".", "\n", "0", "_", "\x7f"]) for _ in range(draw.randint(0, 30)))
        rows.append((i if draw.random() < 0.9 else None, draw.choice([text, text, text, None, ""]), draw.choice(["en", "de", None, "rare"] if i % 50 == 0 else ["en", "de"]), draw.choice([None, *[f"s{k}" for k in range(sources)]])))
    return rows


@pytest.mark.parametrize("sources,block,terms,broadcast", [(4, 64, 1024, True), (9, 2, 7, True), (9, 3, 1000, False)])
def test_equals_plain_integers(spark, monkeypatch, sources, block, terms, broadcast):
    monkeypatch.setattr(dv, "SOURCES", block)
    monkeypatch.setattr(dv, "TERMS", terms)
    if not broadcast:
        monkeypatch.setattr(dv, "fits_broadcast", lambda df: False)
    rows = corpus(7, 300, sources) + [(1, "only here", "xx", "s1"), (2, None, "yy", "s1"), (3, "", "yy", "s2")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, lang string, source string, n long, p long, words long")
    got = dv.audit(docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(r) for r in got.collect()} == plainly(rows)
    assert dv.audit(docs.limit(0)).collect() == []


@pytest.mark.parametrize("hashed", [lambda b: 1, lambda b: len(b) % 3, lambda b: b[0]])
def test_slices_of_one_hash_are_told_apart(monkeypatch, hashed):
    monkeypatch.setattr(dv, "COMPARE_BYTES", 5)
    texts = ["ab abc AB", "", "é è ab", "abc", "zz zz é"]
    words, code, of_text = dv.words([t.encode() for t in texts], hashed)
    assert [(k, words[c].decode()) for k, c in zip(of_text, code)] == [(k, w) for k, t in enumerate(texts) for w in found(t)]
    assert len(set(words)) == len(words)


def test_words_of_nothing():
    for texts in ([b""], [b"", b"12 3"], [b"\x00"]):
        words, code, of_text = dv.words(texts)
        assert words == [] and len(code) == len(of_text) == 0


def test_tally_flushes(monkeypatch):
    monkeypatch.setattr(dv, "TALLY", 3)
    tally, want = dv.Tally(), Counter()
    for k in range(20):
        texts = [f"a b{chr(97 + k % 5)} a", "c"]
        tally.add([("en", f"s{k % 3}"), ("de", "s")], [t.encode() for t in texts])
        want.update(("en", f"s{k % 3}", w) for w in found(texts[0]))
        want.update([("de", "s", "c")])
    batch = tally.batch().to_pylist()
    assert {(r["lang"], r["source"], r["term"]): r["n"] for r in batch if r["term"]} == want
    assert sorted((r["lang"], r["source"]) for r in batch if r["term"] is None) == [("de", "s"), ("en", "s0"), ("en", "s1"), ("en", "s2")]


def test_counts_beyond_long_products(spark):
    """1e9 times a count of 1e13 doesn't fit a long."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(10**13, 3 * 10**13, 10**6)], "n long, total long, kept long")
    assert df.select(dv.share(F.col("n"), F.col("total"), F.col("kept"))).first()[0] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 10**6)
    far = lambda a, b: (a - b) * (a - b) // b
    assert spark.createDataFrame([(10**9, 1)], "p long, q long").select(dv.surprise(F.col("p"), F.col("q"))).first()[0] == far(10**9, 1) == far(np.int64(10**9), np.int64(1))
