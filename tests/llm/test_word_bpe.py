import hashlib
import random

from quillgraph.llm import word_bpe
from quillgraph.llm.byte_bpe import library


def want(text):
    t = library(word_bpe.VOCABULARY)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


ODD = [
    "Hello, WORLD! it's 123 don't", "", None, " \t\n", "a\x1cb\x1dc d", "x\x85y\xa0z　w", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>",
    "Ünïcödé é ﬁ Å İstanbul ΣΑΣ ß", "日本語のテキスト 中文", "👍🏽 family 👨‍👩‍👧", "z" * 3000, "‎ltr​zero﻿bom", "퟿",
]


def test_same_as_the_library(spark, monkeypatch):
    monkeypatch.setattr(word_bpe, "CHUNK_BYTES", 300)
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["the", "Cat,", "sat", "on", "naïve", "42nd", "mats."]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in word_bpe.encode(df).collect()}
    dig = {r.doc_id: r for r in word_bpe.encode(df, full=False).collect()}
    for i, t in enumerate(texts):
        ids, text = want(t)
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, text, len(ids)), t
        assert dig[i].ids == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert dig[i].decoded == hashlib.sha256(text.encode()).hexdigest()


def test_repeats_nulls_and_empty(spark):
    schema = "doc_id long, text string, chunk int, ids string"
    rows = [(1, "a b", 1, ""), (1, "a b", 1, ""), (None, "a", 2, None), (2, None, None, None)]
    got = word_bpe.encode(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0)]
    assert word_bpe.encode(spark.createDataFrame([], schema)).collect() == []


def test_a_chunk_without_answers_encodes_its_own_words():
    import pyarrow as pa

    texts = ["a cat, a mat", "", "naïve \x1c cat"]
    left = pa.table({"blob": [word_bpe._pack([b"\1" + bytes(7), b"", b"\2" + bytes(7)] + [t.encode() for t in texts])]})
    right = pa.table({"words": pa.array([], pa.binary()), "answer": pa.array([], pa.binary())})
    got = word_bpe._join_back(word_bpe.VOCABULARY, True)(None, left, right).to_pylist()
    assert [r["doc_id"] for r in got] == [1, None, 2]
    assert [(r["ids"], r["decoded"]) for r in got] == [want(t) for t in texts]


def test_very_long_text_and_no_empty_packets(spark):
    rng = random.Random(4)
    text = " ".join(f"w{rng.randrange(10**5)}" for _ in range(200_000))  # over 1 MB
    got = word_bpe.encode(spark.createDataFrame([(1, text), (2, "w1")], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in got} == {1: want(text), 2: want("w1")}
    sent = list(word_bpe._chunks(64)([__import__("pyarrow").RecordBatch.from_arrays([[1], ["one two"]], ["doc_id", "text"])]))
    assert [b.num_rows for b in sent] == [2]
