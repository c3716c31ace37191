import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import packing, tokenfile
from lumenframe.llm.tokens import PieceEncoder, public_path

ODD = ["a\x1cb .\x1c. x  y   z  ", "İstanbul ΣΑΣ ΟΔΟΣ Σ", "it's I'LL we’ve '' 's", "日本語 テスト", "é café", "<|endoftext|> a<|endoftext|>b", "hello <|endoftext|> there", "end <|endoftext|>", "<|startoftext|>x y<|startoftext|> \n<|ENDOFTEXT|>", "é<|endoftext|>日 <|endof text|>", " \n\n x\n", "١٢٣ ½ ² ªº", "́ a ́b", "a,b. c;d!e?f:g", " lead", "", None]


def texts():
    rng = random.Random(1)
    syl = ["tion", "er", "é", "an", "Th", "ö", "ing", "7"]
    return ODD + [" ".join("".join(rng.choices(syl, k=rng.randint(1, 4))) + rng.choice(["", ",", ".", "\n"]) for _ in range(rng.choice([1, 20, 400]))) for _ in range(30)] + ["word " * 20_000]


def reference(name):
    t = Tokenizer.from_file(public_path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_the_library(name):
    encode, ours = reference(name), PieceEncoder(public_path(name))
    assert ours.pieces is not None
    for t in texts():
        assert ours.encode(t).tolist() == encode(t)


def test_random_unicode_equals_the_library():
    rng = random.Random(3)
    pools = ["abc XYZ.,'\n\t", "éßÄöñç àù", "日本語テスト한국어", "\u0301\u0308\u200d\ufe0f", "😀👩🏽‍🚀", "０１２ⅣⅫ½²", "אבגעربي", "<|endoftext|>"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encode, ours = reference(name), PieceEncoder(public_path(name))
        for _ in range(400):
            pool = "".join(rng.sample(pools, 3))
            t = "".join(rng.choices([*pool, "<|endoftext|>", " "], k=rng.randint(1, 60)))
            assert ours.encode(t).tolist() == encode(t), t


def test_borders_even_out_tokens():
    rng = random.Random(2)
    sample = [(rng.randrange(1 << 40), rng.choice([1, 10, 1000])) for _ in range(3000)]
    borders = packing.even_borders(sample, 10)
    sums = [0] * 10
    for k, n in sample:
        sums[int(np.searchsorted(borders, k, side="right"))] += n
    assert len(borders) == 9 and max(sums) < 1.1 * sum(sums) / 10
    assert packing.even_borders([], 4).tolist() == [] and packing.even_borders([(5, 1)], 4).tolist() == [5]


def test_variable_length_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        v = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype("<u4")
        control, data = tokenfile.encode_values(v)
        assert len(control) == -(-n // 4) and (tokenfile.decode_values(control, data, n) == v).all()
    docs, lengths, values = tokenfile.read_block(tokenfile.write_block([3, None, -5], [2, 0, 1], np.array([1, 70000, 5], "<u4")))
    assert docs == [3, None, -5] and lengths.tolist() == [2, 0, 1] and values.tolist() == [1, 70000, 5]


def rows_of(spark):
    rows = [(7 * i % 1000, t) for i, t in enumerate(texts())] + [(None, "no id"), (3, "twice"), (3, "twice")]
    return rows, spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")


def test_token_file_round_trip(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 500)
    rows, df = rows_of(spark)
    encode = reference("byte_bpe_50k.json")
    got = sorted(tokenfile.token_digest(df).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    want = {}
    for i, t in rows:
        ids = np.array(encode(t) + [2], "<u4")
        want.setdefault(i, set()).add((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert tokenfile.token_digest(df.limit(0)).collect() == []


def test_frequent_ids_get_small_ranks(spark, tmp_path):
    df = spark.createDataFrame([(i, "the the the cat") for i in range(5)], "doc_id long, text string")
    tokenfile.write_token_file(df, str(tmp_path / "t"))
    first = spark.read.parquet(str(tmp_path / "t/dictionary")).orderBy("rank").first()
    assert first.id == reference("byte_bpe_50k.json")(" the")[0]


def test_packing_covers_every_id_once(spark):
    rows, df = rows_of(spark)
    encode = reference("word_bpe_49k.json")
    got = packing.pack(df, length=256).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if i in (3, None):
            continue
        ids, at = np.array(encode(t) + [2], "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(df.limit(0)).collect() == []


def test_hilbert_keys_are_a_bijection_with_neighbouring_steps():
    bits = 3
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(cells, bits)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_cut_points_are_powers_of_two():
    assert packing.cut_points(4096 * 2 + 13, 4096).tolist() == [8192, 8200, 8204]
    assert packing.cut_points(4096, 4096).tolist() == []
