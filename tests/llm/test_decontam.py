import random
import re

from lumenframe.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            n = min(13, len(x))
            for s in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in df.collect()), key=str)


def cases():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)] + ["the"] * 30
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, text(rng.choice([5, 13, 20, 40]))) for i in range(8)] + [(20, None), (21, " -- "), (22, "Rare"), (23, "the the the the"), (10, "dup One two"), (11, "dup one TWO")]
    docs = [(i, text(rng.choice([0, 3, 30, 200]))) for i in range(12)]
    for k, (i, x) in enumerate(items[:8]):
        docs += [(100 + k, f"{text(10)} {x.upper()}! {text(30)}"), (200 + k, x), (300 + k, " ".join(words(x)[:-1] + ["other"]))]
    docs += [(400, None), (401, ""), (402, "É rare é"), (403, "x dup, one; two y"), (404, "the " * 3000), (200, items[0][1]), (200, "same id other text"), (None, "rare"), (None, "nothing")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = cases()
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, start int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert got(decontam.contamination(d, b)) == brute(docs, items)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontam, "broadcast_if_small", lambda df: df)
    assert got(decontam.contamination(d, b)) == brute(docs, items)


def test_empty_tables_and_the_filter(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r[1:] for r in got(decontam.contamination(docs, none))] == [(2, 0, "", False)] * 2
    assert decontam.contamination(docs.limit(0), spark.createDataFrame([(1, "a b")], none.schema)).collect() == []
    kept = decontam.decontaminated(docs, spark.createDataFrame([(1, "A, b")], none.schema))
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [2]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x beta gamma"), (2, "alpha x x x x beta gamma"), (3, "beta alpha gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    assert {r.row.doc_id for r in decontam.contamination(docs, items, slop=2).where("n_hit > 0").collect()} == {1, 3}


def test_rows_without_id_keep_their_candidates_apart(spark):
    docs = spark.createDataFrame([(None, f"alpha beta gamma n{i}", i) for i in range(40)] + [(7, f"x{i} alpha beta gamma", i) for i in range(40)], "doc_id long, text string, own_id int")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    windows = decontam.item_windows(items)
    anchors = decontam.rarest_terms(docs, windows)
    found = decontam.candidates(decontam.postings(docs, anchors.select("term").distinct()), anchors)
    assert max(r["count"] for r in found.groupBy("doc_id").count().collect()) == 1
    assert all(r.n_hit == 3 for r in decontam.contamination(docs, items).collect())
