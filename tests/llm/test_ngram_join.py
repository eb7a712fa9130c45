import random

import pytest

from quillgraph.llm import ngram_join


def shingles(text, k=5):
    w = [x for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                r, q = sorted((root(a), root(b)))
                up[q] = r
    return {d: (len(sets[d]), root(d)) for d in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("seed, longest, split", [(1, 8, 200_000), (2, 8, 200_000), (3, 2, 200_000), (4, 10**6, 200_000), (5, 2, 3), (6, 8, 20)])
def test_same_as_brute_force(spark, monkeypatch, seed, longest, split):
    """Long columns from 2 rows on or never, and dealt over several tasks from 3 on or hardly."""
    monkeypatch.setattr(ngram_join, "LIST", longest)
    monkeypatch.setattr(ngram_join, "SPLIT", split)
    monkeypatch.setattr(ngram_join, "SUMMED", 2 if seed % 2 else 512)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 30, 80, 200]))] for _ in range(60)]
    shared = [rng.choice(vocab) for _ in range(30)]
    rows = []
    for i, b in enumerate(base):
        rows.append(" ".join(b))
        for _ in range(rng.choice([0, 1, 3, 60 if i % 20 == 0 else 2])):  # groups beyond LIST too
            c = list(b)
            for _ in range(rng.randrange(0, 5)):
                c[rng.randrange(len(c))] = rng.choice(vocab)
            rows.append(" ".join(c).upper() if rng.random() < 0.3 else "  ".join(c))
        rows.append(" ".join(shared + b[:20]))
    rows += ["", None, " \t\n", "a", "A", "x y z", "X\vY z", "same " * 500, "same " * 700]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    rows = list(zip(ids, rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(ngram_join.join(df)) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(df).collect() == []
    rows = [(1, "a b c d e f", 9, "k"), (2, "a b c d e f", 8, None), (None, "A b c d e f", 1, "z"), (3, None, 1, "q"), (2, "a b c d e f", 8, None)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string, n long, component string")).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got) == [(0, 2, 1), (1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_versions_of_a_document_keep_their_own_links(spark):
    """Of rows with one doc_id every text counts, whichever stands first."""
    words = lambda mark: [f"{mark}{i}" for i in range(40)]
    like = lambda w: " ".join([*w[:-1], "other"])
    a, b, c, e = words("a"), words("b"), words("c"), words("e")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (2, " ".join(a)), (9, like(b)), (7, like(a)), (11, " ".join(c)), (12, " ".join(e)), (12, like(c)), (30, " ".join(e))]
    for order in (rows, rows[::-1]):
        got = ngram_join.join(spark.createDataFrame(order * 3, "doc_id long, text string").repartition(4)).collect()
        assert len(got) == 27 and {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (9, 2), (7, 2), (11, 11), (12, 11), (30, 11)}


def test_very_long_and_unlike_rows_of_common_columns(spark):
    rng = random.Random(11)
    lines = [" ".join(f"l{k}w{i}" for i in range(9)) for k in range(12)]
    rows = [" ".join(rng.sample(lines, rng.randrange(1, 5))) for _ in range(300)]
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(160_000))  # over 1 MB
    rows += [long, long + " tail", long[: len(long) // 2]]
    rows = list(enumerate(rows))
    assert result(ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute(rows)
