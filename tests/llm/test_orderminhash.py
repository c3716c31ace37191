import hashlib
import random
import re
import struct

import xxhash

from lumenframe.llm import orderminhash as omh


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    return {r.doc_id: r for r in omh.fingerprints(df).collect()}


def test_edits_and_order_of_documents(spark):
    rows = [(5, "héllo wörld"), (1, "abc"), (9, None), (7, "z"), (3, "😀😀ab")]
    got = run(spark, rows)
    order = sorted(i for i, _ in rows)
    text = {i: t or "" for i, t in rows}
    for k, i in enumerate(order):
        t, nxt = text[i], text[order[(k + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert got[9].fingerprint == "0" * 256


def test_equal_texts_and_single_document(spark):
    got = run(spark, [(1, "same text here and more"), (2, "same text here and more"), (3, "unlike words entirely different")])
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0 and got[2].near_next == 0.0
    one = run(spark, [(4, "only one document")])
    assert one[4].near_next == 1.0
    assert run(spark, []) == {}


def brute_sketch_inputs(tokens):
    """Occurrence-numbered k-mers of a token list."""
    seen, out = {}, []
    for i in range(len(tokens) - omh.K + 1):
        k = tuple(tokens[i : i + omh.K])
        seen[k] = seen.get(k, 0) + 1
        out.append((k, seen[k]))
    return out


def test_occurrence_numbers_follow_the_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(2)
    tokens = rng.choices("ab", k=60)
    df = spark.createDataFrame([(" ".join(tokens),)], "text string").withColumn("t", omh.token_hashes(F.col("text")))
    df = df.select(omh.kmers(F.col("t")).alias("k")).withColumn("o", omh.occurrences(F.col("k")))
    r = df.first()
    by_pos = {x & omh._LOW: (x >> omh._POS, o) for x, o in zip(r.k, r.o)}
    want = brute_sketch_inputs(tokens)
    assert [by_pos[i][1] for i in range(len(want))] == [o for _, o in want]
    ids = {}
    assert all(ids.setdefault(by_pos[i][0], k) == k for i, (k, _) in enumerate(want))


def test_likeness_falls_with_edits_and_with_reordering(spark):
    rng = random.Random(8)
    words = [f"word{rng.randrange(5000)}" for _ in range(400)]
    few, many, turned = list(words), list(words), words[200:] + words[:200]
    for i in rng.sample(range(400), 8):
        few[i] = "edit"
    for i in rng.sample(range(400), 150):
        many[i] = f"edit{i}"
    texts = [words, few, many, turned, rng.sample(words, 400)]
    rows = [(2 * i, " ".join(t)) for i, t in enumerate(texts)]
    got = run(spark, rows)
    base = got[0].fingerprint
    like = [sum(base[8 * k : 8 * k + 8] == got[2 * i].fingerprint[8 * k : 8 * k + 8] for k in range(32)) / 32 for i in range(5)]
    assert like[0] == 1 > like[1] > like[2] and like[1] > 0.5 and like[4] < 0.1
    assert 0 < like[3] < 1  # the same k-mers but for two, in another order


def test_repeated_ids_null_ids_and_long_text(spark):
    rows = [(None, "first"), (1, "b"), (1, "a"), (2, "long " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = omh.fingerprints(df).collect()
    assert len(got) == 4
    edit = {r.n_chars: r.edited_sha256 for r in got}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert edit[5] == sha("fir" + "a") and edit[250_000] == sha(("long " * 50_000)[:125_000] + "first")


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def longs(*values):
    """Spark's xxhash64 of longs in turn: each hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return signed(seed)


def plain_sketch(text):
    """The fingerprint by loops: k-mers, occurrence numbers, two minimal of each bin, in their text order."""
    low, pos = (1 << 27) - 1, 27
    tokens = [signed(xxhash.xxh64_intdigest(t.encode(), seed=42)) for t in re.findall(r"[^ \t\n\x0b\f\r]{1,16}", text)]
    if not tokens:
        return "0" * 256
    grams = [tokens[i : i + omh.K] for i in range(len(tokens) - omh.K + 1)] or [tokens]
    seen, numbered = {}, []
    for at, gram in enumerate(grams):
        h = longs(*gram) >> pos
        seen[h] = seen.get(h, 0) + 1
        mixed = signed(xxhash.xxh64_intdigest(struct.pack("<i", seen[h]), seed=xxhash.xxh64_intdigest(struct.pack("<q", h), seed=42)))
        numbered.append((mixed & ~low | at))
    numbered.sort()
    bins = {}
    for x in numbered:
        bins.setdefault(x >> 59, []).append(x)
    chosen = [x for b in sorted(bins) for x in bins[b][:2]]
    out = []
    for b in range(-16, 16):
        at = next((i for i, x in enumerate(chosen) if x >> 59 >= b), 0)
        x, y = sorted((chosen[at], chosen[(at + 1) % len(chosen)]), key=lambda v: v & low)
        out.append(longs(x >> pos, y >> pos) & 0xFFFFFFFF)
    return "".join(f"{v:08x}" for v in out)


def test_sketch_equals_plain_loops(spark):
    rng = random.Random(11)
    texts = ["", "one", "one two", "a b c", "a b c d", "x " * 300, "tok " * 3 + "y" * 50]
    texts += [" ".join(rng.choices(["a", "b", "cc", "dédé", "日本語", f"w{rng.randrange(500)}", "z" * 40], k=rng.randrange(1, 200))) for _ in range(120)]
    got = run(spark, list(enumerate(texts)))
    assert {i: got[i].fingerprint for i in got} == {i: plain_sketch(t) for i, t in enumerate(texts)}
