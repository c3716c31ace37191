import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenframe.llm import langid, toxicity

ALPHABETS = {"xx": "abcdef", "yy": "efghij", "zz": "éèàçôû"}


def texts(rng, lang, n):
    return [" ".join("".join(rng.choices(ALPHABETS[lang], k=rng.randint(2, 6))) for _ in range(rng.randint(8, 30))) for _ in range(n)]


def test_languages_are_told_apart_and_folds_hold(spark):
    rng = random.Random(1)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in ALPHABETS for t in texts(rng, lang, 60))]
    rows += [(900, None, "xx"), (901, "", "xx"), (902, "123 !? 😀", "yy"), (903, "abc " * 40_000, None), (904, "ÉÈÀ çôû", "zz"), (904, "ÉÈÀ çôû", "zz"), (None, "abcabc", "xx")]
    df = spark.createDataFrame([(i, t, lang, "c") for i, t, lang in rows], "doc_id long, text string, lang string, score string")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    truth = {i: lang for i, _, lang in rows}
    right = [r.lang_pred == truth[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 900 and r.held_out]
    assert sum(right) >= 0.95 * len(right) > 0
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902)) and by[904].lang_pred == "zz"
    assert all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    kept = langid.known_language(df)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows) - 3


def test_predictions_equal_cosines_by_hand(spark):
    """Prototypes and predictions again, with plain loops over trigrams."""
    import numpy as np

    rng = random.Random(5)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in ALPHABETS for t in texts(rng, lang, 12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    letter = langid.Encoder()

    def vector(text):
        chars = " " + "".join(c if c.isalpha() else " " for c in text.lower()).strip() + " "
        while "  " in chars:
            chars = chars.replace("  ", " ")
        count = {}
        for i in range(len(chars) - 2):
            count[chars[i : i + 3]] = count.get(chars[i : i + 3], 0) + 1
        v = sum(n**0.5 * np.roll(letter.sign(ord(g[0])), 2) * np.roll(letter.sign(ord(g[1])), 1) * letter.sign(ord(g[2])) for g, n in count.items())
        return v / np.linalg.norm(v)

    sums = {}
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 4 != 2:
            sums[lang] = sums.get(lang, 0) + vector(t)
    unit = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    mean = sum(unit.values()) / len(unit)
    protos = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in unit.items()}
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    for i, t, _ in rows:
        cos = {k: float(p @ vector(t)) for k, p in protos.items()}
        best = max(cos, key=cos.get)
        score = 1 / sum(np.exp((c - cos[best]) / langid.TEMPERATURE) for c in cos.values())
        assert got[i].lang_pred == best and abs(got[i].score - score) < 1e-3


def test_known_language_rejects_other_languages_and_fills_labels(spark):
    rng = random.Random(6)
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang in ALPHABETS for t in texts(rng, lang, 40))]
    other = " ".join("".join(rng.choices("бвгдёжзийклмноп", k=rng.randint(3, 9))) for _ in range(80))
    rows += [(900, other, None), (901, texts(rng, "xx", 1)[0], None), (902, "б", None), (903, None, "xx"), (903, None, "xx")]
    df = spark.createDataFrame([(i, t, lang, "c", 1.0) for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string, cosine double")
    got = {r.doc_id: r for r in langid.known_language(df).collect()}
    assert got.keys() == {i for i, _, _ in rows} - {900, 903} and got[901].lang == "xx" and got[0].lang_pred == "c"
    assert {r.lang for r in langid.known_language(df, languages=["yy"]).collect()} == {"yy"}


def test_no_labels_and_empty_table(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first().lang_pred == "und"
    assert langid.identify(df.limit(0)).collect() == []


def test_stage_keeps_texts_when_no_row_can_train(spark):
    import corpus_pipeline

    rows = [(i, t, None) for i, t in enumerate(["abc", "çà", "", "12 !?", None, "12 b"])]
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 4 == 2)
    for docs, want in ((rows, [0, 1, 5]), ([(held, "abc", "xx")], [held])):  # no label; the only label held out
        df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
        got = corpus_pipeline.language_id(spark, df, "")
        assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want


def test_trigram_vectors_are_bound_and_bundled():
    import numpy as np

    e = langid.Encoder(64)
    a, b, c = (e.sign(ord(x)) for x in "abc")
    codes, counts = e.trigrams("abc")
    want = sum(np.roll(x, 2) * np.roll(y, 1) * z for x, y, z in ((e.sign(32), a, b), (a, b, c), (b, c, e.sign(32))))
    assert np.allclose(e.bundle(codes, counts.astype(np.float32)), want)


def test_forward_backward_equals_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    unary = rng.normal(size=(2, 5))
    lengths = np.array([5, 3])
    m, pair, z = toxicity.forward_backward(unary, lengths, trans)
    total = np.zeros((2, 2))
    for row, n in enumerate(lengths):
        weight, sums = 0.0, np.zeros(n)
        pairs = np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(unary[row, i] * y for i, y in enumerate(ys)) + sum(trans[a, b] for a, b in zip(ys, ys[1:])))
            weight += w
            sums += w * np.array(ys)
            for a, b in zip(ys, ys[1:]):
                pairs[a, b] += w
        assert np.allclose(m[row, :n], sums / weight) and np.isclose(z[row], np.log(weight))
        total += pairs / weight
    assert np.allclose(pair, total)


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Vile,", "rotten", "foulmouth", "foulest"])
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "you vile person " + "w1 " * 50_000), (903, "w1 w2"), (903, "w1 w2")]
    labels += [(0, None), (1, 0), (2, 7), (None, 1)]
    d = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, toxic string")
    out = toxicity.toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    return {r.doc_id: r for r in out}, dict(rows), len(rows), len(out)


def test_toxic_documents_are_found(scored):
    got, text, n, m = scored
    assert n == m
    held = [r for r in got.values() if r.held_out and r.doc_id < 400]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    assert got[900].predicted == got[901].predicted == 0 and got[900].score == got[901].score
    a, b = map(int, got[902].spans.split(",")[0].split(":"))
    assert "vile" in text[902][a:b].lower()


def test_one_label_only_and_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(d, labels).first().score == 0.0
    assert toxicity.toxicity(d.limit(0), labels.limit(0)).collect() == []


def test_chain_gradient_is_the_likelihoods(monkeypatch):
    """Finite differences of the documents' log likelihood, with P0 by enumeration in a small chain."""
    import numpy as np

    monkeypatch.setattr(toxicity, "BITS", 6)
    documents = [["a", "Vile", "b."], ["c", "d."], ["b", "a.", "c", "Vile"], ["d"]]
    labels = np.array([1.0, 0.0, 1.0, 0.0])
    sample = toxicity.Sample(documents)
    rng = np.random.default_rng(2)
    w, bias, trans = rng.normal(size=64), -0.5, np.array([[0.0, 0.3], [-0.2, 0.7]])

    def likelihood(w, bias, trans):
        u = sample.unary(w, bias)
        out = 0.0
        for d, y in enumerate(labels):
            z = 0.0
            for s, n in zip(sample.starts[sample.owner == d], sample.lengths[sample.owner == d]):
                paths = [[(k >> i) & 1 for i in range(n)] for k in range(2**n)]
                z += np.log(sum(np.exp(sum(u[s + i] * v for i, v in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:]))) for p in paths))
            out += np.log(1 - (1 - toxicity.NOISE) * np.exp(-z)) if y else np.log(1 - toxicity.NOISE) - z
        return out

    marginal, moves, z = sample.run(sample.unary(w, bias), trans)
    pull = toxicity.document_gradients(np.bincount(sample.owner, z, sample.n), labels)
    grad = sample.gradient(marginal * pull[sample.document])
    for k in np.flatnonzero(grad)[:12]:
        step = np.zeros(64)
        step[k] = 1e-5
        assert np.isclose(grad[k], (likelihood(w + step, bias, trans) - likelihood(w - step, bias, trans)) / 2e-5, atol=1e-5)
    assert np.isclose((marginal * pull[sample.document]).sum(), (likelihood(w, bias + 1e-5, trans) - likelihood(w, bias - 1e-5, trans)) / 2e-5, atol=1e-5)
    step = np.array([[0, 0], [0, 1e-5]])
    assert np.isclose((moves * pull[sample.owner][:, None, None]).sum(axis=0)[1, 1], (likelihood(w, bias, trans + step) - likelihood(w, bias, trans - step)) / 2e-5, atol=1e-5)


def test_batch_scores_equal_single_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS), -2.0, np.array([[0.0, 0.1], [0.2, 0.5]]), rng.normal(size=5))
    texts = [" ".join(rng.choice(list("abcdef"), n)) + "." for n in (1, 3, 40, 700)] + [None, "", " a  b. c! "]
    tagger = toxicity.Tagger(model)
    every = tagger.score_all(texts)
    for t, (score, spans) in zip(texts, every):
        (one, own), = toxicity.Tagger(model).score_all([t])
        assert np.isclose(one, score) and own == spans and all(not any(c.isspace() for c in t[a:b]) for a, b in spans)


def test_held_out_auc_is_over_a_lexicons(spark):
    """0.951 is what the largest log-odds of a document's words reaches on these held-out rows."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg({"toxic": "max"}).toDF("doc_id", "y")
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("held_out").join(labels, "doc_id").toPandas()
    ranks, n = got.score.rank(), got.y.sum()
    assert (ranks[got.y == 1].sum() - n * (n + 1) / 2) / (n * (len(got) - n)) > 0.97
    assert got.predicted[got.y == 1].mean() > 0.85 and got.predicted[got.y == 0].mean() < 0.01


def test_prediction_keeps_no_trigram_vectors_after_a_task():
    names, batch = ["a"], pa.RecordBatch.from_arrays([pa.array(["some words of a text"])], ["the_text"])
    out = list(langid._predict(names, np.ones((1, langid.DIM), np.float32))(iter([batch])))
    assert out[0].num_rows == 1 and not langid.shared_encoder().rows


def test_a_confident_prediction_replaces_a_wrong_label(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wrong = F.when(F.col("doc_id") % 50 == 0, F.when(F.col("lang") == "en", "de").otherwise("en")).otherwise(F.col("lang"))
    kept = langid.known_language(docs.select("doc_id", "text", wrong.alias("lang"), F.col("lang").alias("right"), F.length("text").alias("n"))).toPandas()
    swapped = kept[kept.doc_id % 50 == 0]
    long = swapped[swapped.n > 600]
    assert len(long) > 5 and (long.lang == long.right).mean() > 0.9
    assert (kept[kept.doc_id % 50 != 0].lang == kept[kept.doc_id % 50 != 0].right).all()


def test_toxicity_does_not_depend_on_the_files(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.where("doc_id < 40"))  # repeated rows too
    one = toxicity.toxicity(docs.coalesce(1).sortWithinPartitions("text"), labels)
    two = toxicity.toxicity(docs.repartition(7), labels.repartition(3))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
