import hashlib
import random
import re

from lumenframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


CASES = [
    None, "", "a@b.c", "x..y@h-1.co.uk, next@", "a@b@c.de f", "@x.y a@.b a@b. c@d.e.", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0004", "1.2.3.45.6", "4111 1111 1111 1111", "4111-1111-1111-1112 4072584564057915",
    "+1 (554) 555-7926 +12 +1234567890123456 ++123 456 7890", "é+49 30 123456 78é", "1" * 40, "a" * 1000 + "@", "+" + "1 " * 30, "tel +1.2.3.4.5.6.7.8.9.0 ok", "12345678901234567890 12",
]


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    noise = ["".join(rng.choices("a1@.+-() 5é%", k=60)) for _ in range(500)]
    for t in CASES + noise:
        assert pii.base_spans(t) == brute(t), t


def test_long_runs_are_linear():
    import time

    start = time.time()
    for t in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 100_000, "+1" * 100_000):
        pii.base_spans(t)
    assert time.time() - start < 20


def test_patterns_find_unseen_identifiers_and_leave_clean_text(spark):
    rng = random.Random(1)
    docs = [(i, f"Hello there. my phone: +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} thanks") for i in range(30)]
    docs += [(100, "please note my phone: 555-0199-22 or write"), (101, "the number of the 1234567 things"), (102, None), (103, "my phone: rings"), (104, "word " * 40_000 + "my phone: 555-0100-33")]
    docs += [(200 + i, f"of the 70.34.215.{i} rest of the day of the year") for i in range(20)]
    docs.append((100, docs[30][1]))
    df = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert got[100].spans == "phone:22:33" and got[104].spans.startswith("phone:")
    assert got[101].spans == got[102].spans == got[103].spans == ""
    for i, t in docs:
        base = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base).encode()).hexdigest()
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(k == x[1] for x in base) for k in range(4))


def graph_of(texts):
    """Edges and slot totals of texts by plain loops over their tokens."""
    edges, totals = {}, {}
    for t in texts:
        base = brute(t)
        words = [m[0] for m in pii._TOKEN.finditer(t or "")] + ["\n"]
        codes, prefixes = pii._Codes(), pii._Prefixes()
        clean = [0 if w == "\n" else codes[w] for w in words]
        for i, w in enumerate(words):
            if w == "\n":
                continue
            left = clean[max(0, i - 3) : i]
            for key in {("3", *left) if len(left) == 3 and 0 not in left else None, ("2", *left[-2:]) if len(left) > 1 and 0 not in left[-2:] else None,
                        ("5", left[-1], clean[i + 1]) if left and left[-1] and clean[i + 1] else None, ("7", prefixes[w]) if prefixes[w] else None} - {None}:
                totals[key] = totals.get(key, 0) + 1
        for m in pii._mentions(t or "", base, codes, prefixes):
            for p in m["patterns"]:
                e = edges.setdefault((p["h"], m["instance"]), [m["kind"], m["seed"], 0])
                e[2] += 1
    return edges, totals


def brute_accepted(edges, totals, least, confidence, rounds):
    belief, kinds, good = {}, {}, {}
    for _ in range(rounds):
        score = {}
        for (h, x), (kind, seed, n) in edges.items():
            b = 1.0 if seed else belief.get(x, 0.0)
            s = score.setdefault(h, [0.0, 0, 0, {}])
            s[0] += n * b
            s[1] += n
            s[2] += b >= confidence
            k = kind if seed else kinds.get(x, -1)
            s[3][k] = s[3].get(k, 0.0) + n * b
        good = {}
        for h, (w, n, seeds, by) in score.items():
            c = w / max(n, totals.get(h, 0))
            if seeds >= least and c >= confidence:
                good[h] = (max(by, key=lambda k: (by[k], -k)), c)
        belief, kinds = {}, {}
        reached = {}
        for (h, x), (_, seed, _) in edges.items():
            if not seed and h in good:
                reached.setdefault(x, []).append(good[h])
        for x, found in reached.items():
            rest = 1.0
            for _, c in found:
                rest *= 1 - min(c, 0.999)
            belief[x], kinds[x] = 1 - rest, max(found, key=lambda f: (f[1], -f[0]))[0]
    return good


def secrets(rng):
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    word = lambda: rng.choice(["lorem", "ipsum", "dolor", "sit", "amet"])
    docs = [f"{word()} {word()} token = \"{hexes(40)}\" {word()}" for _ in range(30)]
    docs += [f"{word()} password={hexes(18)} {word()}" for _ in range(30)]
    docs += [f"{word()} {word()} AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))} {word()}" for _ in range(30)]
    docs += [f"{word()} password=letmein{n} ok" for n in (123, 4567)]
    docs += [f"{word()} code {rng.randint(1000, 9999)} {word()} {word()}" for _ in range(40)] + ["", None, "password=", "token = \"\""]
    return docs


def test_secrets_are_found_by_their_contexts(spark):
    docs = secrets(random.Random(5))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert len(got) == len(docs)
    for i, t in enumerate(docs):
        planted = bool(t) and re.search("token = .[0-9a-f]|password=.|AKIA", t) is not None
        assert (got[i].n_found == 1 and got[i].spans.startswith("secret:")) if planted else got[i].spans == "", t
        assert got[i].n_spans == got[i].n_found + got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone


def test_pattern_scores_equal_brute_force(spark):
    docs = secrets(random.Random(7)) + [f"mail me at {n}x@y.zz or phone: +1 555 {n}00 1234 today" for n in range(100, 130)] + ["phone: 555-12-34 x"] * 3 + ["and phone: rings"] * 5
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    graph = pii.pattern_graph(pii.scan(df), 3)
    totals = {r.h: r.slots for r in pii.slot_totals(df, graph).collect()}
    edges, by_words = graph_of(docs)
    kept = {}
    for (h, x), e in edges.items():
        kept.setdefault(h, {})[x] = e
    kept = {(h, x): e for h, xs in kept.items() if len(xs) >= 3 for x, e in xs.items()}
    assert {(r.h, r.instance): [r.kind, r.seed, r.n] for r in graph.collect()} == kept
    assert sorted(totals.values()) == sorted(n for k, n in by_words.items() if n and hashed(k) in {h for h, _ in kept})
    for least, confidence, rounds in ((3, 0.6, 3), (5, 0.3, 1), (4, 0.8, 2)):
        want = brute_accepted(kept, totals, least, confidence, rounds)
        got = {r.h: (r.kind, r.confidence) for r in pii.accepted_patterns(graph, spark.createDataFrame(list(totals.items()), "h long, slots long"), least, confidence, rounds).collect()}
        assert got.keys() == want.keys() and want
        assert all(got[h][0] == want[h][0] and abs(got[h][1] - want[h][1]) < 1e-9 for h in want)


def hashed(key):
    kind, codes = key[0], [int(c) for c in key[1:]]
    by = {"3": (pii._A, pii._B, pii._C), "2": (pii._B, pii._C), "5": (pii._D, pii._E), "7": (pii._F,)}[kind]
    h = (sum(int(m) * c for m, c in zip(by, codes)) + int(kind)) % 2**64
    return h - 2**64 if h >= 2**63 else h


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).collect() == []
