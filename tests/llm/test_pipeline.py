import functools
import re
from pathlib import Path

import corpus_pipeline
from lumenframe.llm import linededup, simhash
from lumenframe.llm.tokens import shared_encoder

SF = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@functools.cache
def windows(items):
    words = [WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in items]
    return {tuple(w[i : i + 13]) for w in words for i in range(max(1, len(w) - 12)) if w}


def contaminated(text, items):
    """The contract's rule by plain loops."""
    wanted = windows(tuple(items))
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit = set()
    for n in {len(x) for x in wanted}:
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in wanted:
                hit.update(range(i, i + n))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages_keep_columns_and_decisions_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in seen.collect()}
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns
        after = {r.doc_id: r.text for r in seen.collect()}
        assert after.keys() <= before.keys()
        if name == "language_id":
            assert after.keys() == {i for i, t in before.items() if t and any(c.isalpha() for c in t)}  # all in a learnt language
            assert after == {i: before[i] for i in after}
        if name == "line_dedup":
            assert after.keys() == before.keys()
        if name == "near_dedup":
            prints = {i: simhash.simhash64(t) for i, t in before.items()}
            comp = {i: i for i in prints}
            changed = True
            while changed:
                changed = False
                for i in prints:
                    for j in prints:
                        if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[i] != comp[j]:
                            comp[i] = comp[j] = min(comp[i], comp[j])
                            changed = True
            assert after.keys() == set(comp.values())
        if name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert after.keys() == before.keys() - {i for i, t in before.items() if contaminated(t, [r.text for r in bench.collect()])}
    encoder = shared_encoder("word_bpe_49k.json")
    total = sum(len(encoder.encode(t)) + 1 for t in after.values())
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert sum(r.length for r in pieces) == total and {r.doc_id for r in pieces} == after.keys()


def made_columns():
    """Every name that a module of the subpackage gives to a column."""
    names = set()
    for file in Path(linededup.__file__).parent.glob("*.py"):
        code = file.read_text()
        names |= {x for found in re.findall(r'(?:alias|withColumn|withColumnRenamed)\("(\w+)"|, "(\w+)"\)', code) for x in found if x}
        names |= set(re.findall(r"\b(\w+) (?:string|long|double|int|boolean|binary)\b", code))
    return sorted(names - {"doc_id", "text", "lang", "source", "n_chars"})


CLASHES = made_columns()


def test_stages_handle_odd_rows(spark):
    """Null ids, texts and sources, empty and repeated rows, clashing columns: only letterless texts and copies go."""
    assert {"n_lines", "n_dropped", "gone_id", "row", "lang_pred"} <= set(CLASHES)
    words = [f"alpha{i} beta gamma delta number{i} words go on here and end{i}" for i in range(12)]
    rows = [(i, t, "en", "s") for i, t in enumerate(words)] + [(20, None, "en", "s"), (21, "", None, None), (22, "  \n ", "en", "s"), (23, "123 !", "en", None)]
    rows += [(None, "a text of no id at all, but with words", "en", None), (3, words[3], "en", "s"), (30, words[4], None, None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["c"] * len(CLASHES)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF)
        assert seen.columns == docs.columns, name
        assert all(getattr(r, c) == "c" for r in seen.collect() for c in CLASHES), name
    kept = [(r.doc_id, r.text) for r in seen.collect()]
    assert sorted(t for _, t in kept) == sorted({t for _, t, _, _ in rows if t and any(c.isalpha() for c in t)})
    pieces = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert len({r.doc_id for r in pieces}) == len({i for i, _ in kept})
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF) if empty.columns == docs.columns else empty
    assert empty.collect() == []


def test_run_equals_the_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))
