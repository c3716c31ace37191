import random

import pytest

from lumenframe.llm import piecebpe
from lumenframe.llm.piecebpe import shared_merger

POOL = ["a", "b", "th", "e", " ", "  ", "\n", "\t", "▁", "1", "23", "é", "ß", "日", "本", "🙂", "́", "\x00", "﻿", "<s>", "</s>", "<0x0A>", "<unk>", "'s", "://", '("', "　", "\xa0", "ы", "аб", "ة", "‍", "ing", "."]


def made(seed: int, n: int = 400, most: int = 40) -> list[str]:
    draw = random.Random(seed)
    return ["".join(draw.choices(POOL, k=draw.randint(0, most))) for _ in range(n)]


def test_equals_the_library():
    encoder = shared_merger(piecebpe.MODEL)
    texts = [*made(1, 4000), *made(2, 5, 4000), "x" * 5000, "日" * 3000, "a b " * 2000, " ", "▁"]
    found, agrees = encoder.encode_many(texts)
    assert [x.tolist() for x in found] == [encoder.library.encode(t) for t in texts]
    assert all(agrees)


def test_heap_and_list_agendas_agree(monkeypatch):
    encoder = shared_merger(piecebpe.MODEL)
    texts = ["▁" + t.replace(" ", "▁") for t in made(3) if t]
    short = [encoder.merge(t) for t in texts]
    monkeypatch.setattr(piecebpe, "SHORT", 0)
    assert [encoder.merge(t) for t in texts] == short


def test_the_check_sees_a_wrong_segment(monkeypatch):
    encoder = piecebpe.MergeEncoder(piecebpe.public_path(piecebpe.MODEL))
    right = encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda s: [5] if s == "▁bad" else right(s))
    assert encoder.encode_many(["good", "so bad", "good", "so bad"])[1] == [True, False, True, False]
    assert encoder.encode_many(["so bad"])[1] == [False]  # a wrong segment is never kept


def test_turning_the_cache_over(monkeypatch):
    monkeypatch.setattr(piecebpe, "CACHE_SEGMENTS", 20)
    encoder = piecebpe.MergeEncoder(piecebpe.public_path(piecebpe.MODEL))
    texts = made(4, 300)
    for at in range(0, 300, 10):
        found, agrees = encoder.encode_many(texts[at : at + 10])
        assert all(agrees) and [x.tolist() for x in found] == [encoder.library.encode(t) for t in texts[at : at + 10]]


def test_other_models(tmp_path):
    """A model whose pieces reach over spaces, with symbols of its own, unused pieces and no bytes."""
    sp = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as layout

    model = layout.ModelProto()
    model.trainer_spec.model_type = layout.TrainerSpec.BPE
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix = "identity", True
    model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = False, True
    kinds = layout.ModelProto.SentencePiece
    rows = [("<unk>", 0, kinds.UNKNOWN), ("<s>", 0, kinds.CONTROL), ("</s>", 0, kinds.CONTROL), ("<own>", 0, kinds.USER_DEFINED)]
    rows += [(p, -float(k), kinds.UNUSED if p in ("ab", "abc") else kinds.NORMAL) for k, p in enumerate(["▁a", "ab", "a▁b", "abc", "cc", "ca", "▁", "a", "b", "c"])]
    for piece, score, kind in rows:
        entry = model.pieces.add()
        entry.piece, entry.score, entry.type = piece, score, kind
    path = str(tmp_path / "own.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    encoder, library = piecebpe.MergeEncoder(path), sp.SentencePieceProcessor(model_file=path)
    draw = random.Random(5)
    texts = ["".join(draw.choices(["a", "b", "c", " ", "<own>", "zz", "é"], k=draw.randint(0, 12))) for _ in range(2000)]
    found, agrees = encoder.encode_many(texts)
    assert [x.tolist() for x in found] == [library.encode(t) for t in texts] and all(agrees)
    model.trainer_spec.model_type = layout.TrainerSpec.UNIGRAM
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    with pytest.raises(ValueError):
        piecebpe.MergeEncoder(path)


def test_frames(spark):
    import hashlib

    texts = [None, "", *made(6, 60), "dup", "dup"]
    docs = spark.createDataFrame([(None if i == 5 else f"d{i}", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, ids int")
    library = shared_merger(piecebpe.MODEL).library
    encoded = piecebpe.encode(docs)
    rows = {r.doc_id: r for r in encoded.collect()}
    assert all(rows[f"d{i}" if i != 5 else None].ids == library.encode(t or "") + [2] for i, t in enumerate(texts)) and all(r.agrees for r in rows.values())
    back = {r.doc_id: r.text for r in piecebpe.decode(encoded).collect()}
    for r in piecebpe.round_trip(docs).collect():
        ids = rows[r.doc_id].ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest() and back[r.doc_id] == library.decode(ids) and r.agrees
    assert piecebpe.round_trip(docs.limit(0)).collect() == [] and piecebpe.decode(encoded.limit(0)).collect() == []


