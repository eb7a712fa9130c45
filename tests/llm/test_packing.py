import random

import numpy as np

from quillgraph.llm import byte_bpe, packing, token_counts

from .test_pipeline import check_pieces

ODD = [
    "", None, "<|endoftext|>", "a <|endoftext|> b", "日本語 テキスト ไทย العربية עברית", "👍🏽👨‍👩‍👧", " " * 5000, "x" * 5000, "\x00\x1c\x85​﻿", "ꙮ𐍈𝔘𞤀", "it's we'll 'Tis",
    "tab\t\tnew\r\n\r\nline  two", "Ünï ςσΣ İı ŉ ﬁ", "१२३ ٣٤ ⅷ ²³ ½",
]


def test_quick_ids_same_as_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab cÄé\n\t'sß1 ,.!中ж") for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        assert byte_bpe.encode(t or "").tolist() == byte_bpe.library().encode(t or "", add_special_tokens=False).ids, t


def test_pieces_and_little_padding(spark):
    rng = random.Random(3)
    texts = dict(enumerate(ODD + [" ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([3, 40, 400, 4000]))) for _ in range(120)]))
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(4)
    used = check_pieces(packing.pack(df).collect(), texts)
    assert sum(n < 2048 for n in used.values()) <= 1
    got = packing.pack(df, window=64, open_windows=3, keep_ids=True).collect()
    check_pieces(got, texts, 64)
    assert all(len(r.ids) == 4 * r.length for r in got)


def test_packer_prefers_the_best_fit():
    p = packing.Packer(10, 2)
    for doc, n in enumerate((6, 5, 4, 3, 3)):
        p.add(doc, 0, np.arange(n, dtype=np.uint32), n)
    # 4 goes to 6 (full); 3 to 5 (8); 3 opens a window
    assert [[x[0] for x in s] for s in p.take_full()] == [[0, 2]]
    assert [[x[0] for x in w[1]] for w in p.open] == [[1, 3], [4]]


def test_packing_odd_tables(spark):
    schema = "doc_id long, text string, start string, sequence_id int"
    assert packing.pack(spark.createDataFrame([], schema)).collect() == []
    got = packing.pack(spark.createDataFrame([(1, "a", "", 1), (1, "a", "", 1), (None, None, None, None)], schema)).collect()
    assert sorted((r.doc_id or 0, r.length) for r in got) == [(0, 1), (1, 2), (1, 2)]


def test_token_counts(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(30))) for _ in range(100)] + ["long " * 3000]
    lens = sorted(len(byte_bpe.library().encode(t or "", add_special_tokens=False).ids) for t in texts)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    sums = token_counts.suffix_sums(token_counts.histogram(df)).cache()
    rows = {r.n_tokens: r for r in sums.collect()}
    assert set(rows) == set(lens)
    for n, r in rows.items():
        assert r.n_docs == lens.count(n) and r.docs_at_least == sum(x >= n for x in lens) and r.tokens_at_least == sum(x for x in lens if x >= n)
        assert r.truncated_total == sum(min(x, n) for x in lens) and r.total_tokens == sum(lens)
        assert abs(r.quantile - sum(x <= n for x in lens) / len(lens)) < 1e-12
    for limit in (0, 1, 7, 50, 10**6):
        r = token_counts.at_limit(sums, limit).first()
        assert (r.docs_over, r.truncated_total) == (sum(x > limit for x in lens), sum(min(x, limit) for x in lens))
    assert token_counts.length_at_quantile(sums, 0.5).first().n_tokens == lens[(len(lens) + 1) // 2 - 1]
    assert token_counts.suffix_sums(token_counts.histogram(df.limit(0))).collect() == []


def test_counts_and_pieces_of_repeats_and_long_texts(spark):
    long = " ".join(f"word{i % 977}" for i in range(170_000))  # over 1 MB
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "a b"), (2, None), (3, ""), (4, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    n = lambda t: len(byte_bpe.library().encode(t or "", add_special_tokens=False).ids)
    want = {}
    for _, t in rows:
        want[n(t)] = want.get(n(t), 0) + 1
    assert {r.n_tokens: r.n_docs for r in token_counts.histogram(docs).collect()} == want
    pieces = packing.pack(docs).collect()
    assert sum(p.length for p in pieces) == sum(n(t) + 1 for _, t in rows) and max(p.offset + p.length for p in pieces) <= 2048
    assert sum(p.length for p in pieces if p.doc_id == 4) == n(long) + 1
