import random
import re

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import text, textindex
from lumenframe.plans import storage

WORDS = ["the", "of", "idiot", "worthless", "é", "日本", "ab", "abc", "abd", "xyz", "1", "22"] + [f"w{i}" for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choices(WORDS, weights=[30, 20] + [1] * (len(WORDS) - 2), k=draw.randint(0, 40)))) for i in range(250)]
    return spark.createDataFrame([*rows, (900, None), (901, ""), (None, "the idiot")], "doc_id long, text string")


@pytest.fixture(scope="module")
def index(spark, docs, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index"))
    textindex.build(docs.limit(3), root)
    textindex.build(docs, root, range_docs=16)  # replaces the first
    return textindex.Index(spark, root)


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_search_equals_scoring_every_document(spark, docs, index):
    queries = ["the idiot", "of", "Worthless W3 w3", "nothing-known here", "", "日本 é", "w1 w2 w5 w6 w7", None]
    assert index.stats.ranges > 10
    found, read = index.search(asked(spark, *queries), 7, first=1)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    for i, q in enumerate(queries):
        want = [(r.doc_id, round(r.score, 9)) for r in text.bm25(docs.where("doc_id is not null"), q or "").collect()]
        assert got.get(i, []) == sorted(want, key=lambda x: (-x[1], x[0]))[:7], q
    assert read.count() < index.stats.ranges * 6  # rare terms leave ranges unread


def test_phrases_equal_a_scan(spark, docs, index):
    queries = ["the of", "the the", "idiot", "W1 the", "unknown the", "", "the of the"]
    got = {(r.query_id, r.doc_id): r.n for r in index.phrases(asked(spark, *queries)).collect()}
    want = {}
    for r in docs.where("doc_id is not null").collect():
        w = re.findall(r"[^\W_]+", (r.text or "").lower())
        for i, q in enumerate(queries):
            p = re.findall(r"[^\W_]+", q.lower())
            n = sum(w[k : k + len(p)] == p for k in range(len(w))) if p else 0
            if n:
                want[i, r.doc_id] = n
    assert got == want and {i for i, _ in want} == {0, 1, 2, 3, 6}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_terms_equal_a_scan(spark, docs, index):
    queries = ["idiit wrthles", "ab abx", "日本 w10", "é zz", "the the"]
    got = {(r.query_id, r.doc_id): r.matched for r in index.fuzzy(asked(spark, *queries)).collect()}
    want = {}
    for r in docs.where("doc_id is not null").collect():
        w = set(re.findall(r"[^\W_]+", (r.text or "").lower()))
        for i, q in enumerate(queries):
            n = sum(any(edits(t, x) <= text.auto_fuzziness(t) for x in w) for t in re.findall(r"[^\W_]+", q))
            if n:
                want[i, r.doc_id] = n
    assert got == want and len({i for i, _ in want}) == 5
    one = docs.where("doc_id is not null").select("doc_id", F.col("text"))
    assert {(r.doc_id, r.matched) for r in text.fuzzy_search(one, queries[0], size=1000).collect()} == {(d, n) for (q, d), n in want.items() if q == 0}


def test_an_empty_index(spark, docs, tmp_path):
    textindex.build(docs.limit(0), str(tmp_path / "i"))
    index = textindex.Index(spark, str(tmp_path / "i"))
    assert index.search(asked(spark, "the"))[0].collect() == [] and index.phrases(asked(spark, "the")).collect() == []


def test_words_are_not_shuffled_one_by_one(spark, docs, tmp_path, monkeypatch):
    """Phrases with frequent words: texts go to their ranges whole, and a range is searched where its postings lie."""
    monkeypatch.setattr(textindex, "RANGE_WORDS", 500)
    monkeypatch.setattr(textindex, "POSTINGS_BATCH", 50)
    root = str(tmp_path / "i")
    textindex.build(docs, root)
    index = textindex.Index(spark, root)
    assert index.stats.ranges > 4  # by words: there are fewer documents than one range takes
    blocks = index.blocks.collect()
    assert len(blocks) == len({(b.term, b.range) for b in blocks}) and all(b.n == len(b.docs) and b.top == max(x.share for x in b.docs) for b in blocks)
    w = {r.doc_id: re.findall(r"[^\W_]+", (r.text or "").lower()) for r in docs.where("doc_id is not null").collect()}
    assert {(b.term, x.doc_id): x.positions for b in blocks for x in b.docs} == {(t, i): [k for k, y in enumerate(words) if y == t] for i, words in w.items() for t in words}
    phrases = index.phrases(asked(spark, "the of", "the the the", "nothing"))
    plan = phrases._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Generate" not in plan
    assert {r.doc_id: r.n for r in phrases.where("query_id = 1").collect()} == {i: n for i, x in w.items() if (n := sum(x[k : k + 3] == ["the"] * 3 for k in range(len(x))))}


def test_scores_are_added_up_by_range(spark, docs, index, monkeypatch):
    """Only what can be among the k best leaves a range; equal scores are told apart by id; blocks of queries don't change a thing."""
    monkeypatch.setattr(textindex, "QUERY_BLOCK", 2)
    queries = ["the of", "the", "w3 w4 the", "of of", "idiot"]
    found, _ = index.search(asked(spark, *queries), 3, first=1)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    for i, q in enumerate(queries):
        want = sorted(((r.doc_id, round(r.score, 9)) for r in text.bm25(docs.where("doc_id is not null"), q).collect()), key=lambda x: (-x[1], x[0]))[:3]
        assert [(r.doc_id, r.score) for r in sorted(found.where(F.col("query_id") == i).collect(), key=lambda r: r["rank"])] == want
    copies = spark.createDataFrame([(n, "the same text") for n in range(40)], "doc_id long, text string")
    root = storage.scratch_path(spark, "copies")
    textindex.build(copies, root, range_docs=16)
    assert [(r.doc_id, r["rank"]) for r in textindex.Index(spark, root).search(asked(spark, "same"), 4)[0].orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3), (3, 4)]
