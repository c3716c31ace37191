import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import fillmiddle as fim

POOL = ["a", "b ", "\n", "é", "ß", "日本", "🙂", "́", "<", "<P", "S>", "\x00", "x" * 40]


def made(seed: int, most: int = 60) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(POOL, k=draw.randint(0, most))) for _ in range(300)]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_runs_find_every_unit(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    for text in made(1, 20):
        raw = text.encode()
        runs = fim.Runs(np.frombuffer(raw, np.uint8))
        assert len(runs) == len(text)
        assert [runs.byte_of(u) for u in range(len(text) + 1)] == [len(text[:u].encode()) for u in range(len(text) + 1)]
        assert (np.diff(runs.width) != 0).all()  # maximal


def plainly(text: str, key: str):
    """The contract by code points."""
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    if n == 0 or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_equals_slicing_by_code_points(spark):
    texts = [None, "", *made(2), "<P>", "x<M>y", "z" * 300_000 + "日"]
    docs = spark.createDataFrame([(i - 3 if i else None, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, output string")
    forms = set()
    for row in fim.fill_in_middle(docs).collect():
        text = texts[(row.doc_id + 3) if row.doc_id is not None else 0] or ""
        key = "null" if row.doc_id is None else str(row.doc_id)
        assert tuple(row)[1:] == plainly(text, key)
        assert fim.restore(row.output.encode(), row.form) == text.encode()
        forms.add(row.form)
    assert forms == {"plain", "psm", "spm"}


def test_digest_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(7, "aé"), (7, "aé"), (8, None)], "doc_id long, text string")
    rows = fim.fill_digest(docs).collect()
    assert len(rows) == 3 and len({r.output_sha256 for r in rows if r.doc_id == 7}) == 1
    assert {r.doc_id: r.restored_sha256 for r in rows} == {7: hashlib.sha256("aé".encode()).hexdigest(), 8: hashlib.sha256(b"").hexdigest()}
    assert fim.fill_digest(docs.limit(0)).collect() == []


def test_stored_runs(spark):
    docs = spark.createDataFrame([("k", "abé日日c"), (None, None)], "doc_id string, text string")
    rows = {r.doc_id: (r.widths, r.starts, r.until) for r in fim.class_runs(docs).collect()}
    assert rows == {"k": ([1, 2, 3, 1], [0, 2, 4, 10], [2, 3, 5, 6]), None: ([], [], [])}


def test_restore_refuses_other_forms():
    with pytest.raises(ValueError):
        fim.restore(b"<S>a<P>b<M>c", "psm")
