import random

import numpy as np
import xxhash

from lumenframe.llm import simhash


def brute_print(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[i] != comp[j]:
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    changed = True
    return comp


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for text in (None, "", " \t\n", "One", "one TWO", "Élan é É x", "a b c d a b c d", "x " * 500):
        assert simhash.simhash64(text) == brute_print(text)


def test_every_near_pair_meets_at_a_home_anchor():
    rng = random.Random(7)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        keys, used = simhash.anchors(np.array([x, y], dtype="<u8"))
        homes = {int(keys[0, 0]), int(keys[0, 17])}
        assert homes & {int(k) for k, u in zip(keys[1], used[1]) if u}


def near_copies(rng, n):
    """Fingerprint-like rows: clusters within few bits, copies and strangers."""
    out = []
    for _ in range(n // 6):
        centre = rng.getrandbits(64)
        out += [centre, centre]
        for _ in range(4):
            y = centre
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            out.append(y)
    return out


def test_links_equal_brute_force_also_when_anchors_are_split(spark):
    rng = random.Random(3)
    prints = near_copies(rng, 120)
    signed = [p - (1 << 64) if p >> 63 else p for p in set(prints)]
    truth = brute_components({i: p for i, p in enumerate(sorted(set(prints)))})
    order = {p: i for i, p in enumerate(sorted(set(prints)))}
    for chunk in (20_000, 2):
        df = spark.createDataFrame([(s,) for s in signed], "fp long")
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(df, chunk=chunk).collect()]
        assert all((a ^ b).bit_count() <= 3 or truth[order[a]] == truth[order[b]] for a, b in links)
        comp = {i: i for i in truth}
        for _ in range(20):
            for a, b in links:
                m = min(comp[order[a]], comp[order[b]])
                comp[order[a]] = comp[order[b]] = m
        assert {frozenset(i for i in comp if comp[i] == c) for c in comp.values()} == {frozenset(i for i in truth if truth[i] == c) for c in truth.values()}


def test_components_of_texts(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=150)) for _ in range(6)]
    texts = [None, "", "   ", "short text"]
    for b in base:
        w = b.split()
        w[10] = "changed"
        texts += [b, b, " ".join(w), b.upper()]
    texts.append("long " * 60_000)
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    rows.append((3, "short text", "clash"))  # a repeated row
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.simhash_components(df).collect()
    prints = {i: brute_print(t) for i, t, _ in rows}
    want = brute_components(prints)
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    kept = simhash.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()} == {(None, 5), (5, 5)}
