import math
import random

import numpy as np

from quillgraph.llm import threshold_topk as tk


def brute(rows, k=5):
    low, high = -(2**63), 2**63 - 1
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            best = {}
            for i, b in ok:
                if i != q and len(a) == len(b):
                    s = sum(x * y for x, y in zip(a, b))
                    best[i] = max(s, best.get(i, s))
            out += [(q, r, i, max(low, min(high, s))) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def run(spark, rows, kind="float"):
    v = tk.quantised(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in tk.search(v, v.filter("vec_id % 50 = 0")).collect())


def test_same_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tk, "BLOCK_ROWS", 64)
    monkeypatch.setattr(tk, "QUERY_GROUP", 3)
    rng = random.Random(4)
    f32 = lambda: float(np.float32(rng.gauss(0, 0.3)))
    rows = [(i, [f32() for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [1.0, None]), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (600, [0.0] * 8), (650, [1.0, 2.0]), (651, [0.5, -1.0]), (700, []), (701, [])]
    assert run(spark, rows) == brute(rows)


def test_stops_early_where_the_bound_allows():
    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (4096, 4))
    x[17] = 1000
    block = tk.Block(np.arange(4096), x)
    best, depth = block.search(-1, np.array([3, 2, 1, 4]), [], 1)
    assert best == [(10_000, 17)] and depth < 100


def test_empty_and_fewer_than_k(spark):
    assert run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (None, [1.0, 1.0])]) == [(0, 1, 1, 256 * 128)]
    assert run(spark, []) == []


def test_one_vec_id_repeated_on_top_hides_no_other():
    """Thirty rows of one vec_id score best; the 2nd to 5th results are read in the same step."""
    rng = np.random.default_rng(5)
    q = np.full(8, 200)
    good = np.full((8, 8), 240) + np.diag(np.arange(60, 68))
    x = np.vstack([np.full((30, 8), 250), good, rng.integers(-200, 200, (400, 8))])
    ids = np.array([7] * 30 + list(range(1000, 1408)))
    want = sorted({i: s for i, s in sorted(zip(ids.tolist(), (x @ q).tolist()), key=lambda r: r[1])}.items(), key=lambda r: (-r[1], r[0]))[:5]
    best, _ = tk.Block(ids, x).search(-1, q, [], 5)
    assert [(i, s) for s, i in best] == want


def test_large_components_and_repeated_ids(spark, monkeypatch):
    """Sums beyond 2^53 and 2^63 rank exactly; rows of one vec_id never push out others."""
    monkeypatch.setattr(tk, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) * 10.0 ** rng.choice([0, 3, 8, 8, 12, 20, 200]) for _ in range(4)]) for i in range(120)]
    rows += [(101, [1e8] * 4)] * 40 + [(i, [1e8 - i] * 4) for i in range(200, 260)] + [(300, [1e306] * 4), (350, [1e306, 1.0, 0.0, 0.0])]
    want = brute([r for r in rows if max(abs(256 * x) for x in r[1]) < math.inf])
    assert run(spark, rows, "double") == want and any(r[3] == 2**63 - 1 for r in want)
    for a, b in [(0, 1), (-1, 0), (255, 256), (-256, -255), (10**30, 10**31), (-(10**31), -(10**30))]:
        assert tk._sortable(a) < tk._sortable(b)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(0, [1.0], 5, "x", 1), (1, [2.0], 6, "y", 2)], "vec_id long, embedding array<float>, score int, rank string, v int")
    v = tk.quantised(df)
    assert [tuple(r) for r in tk.search(v, v.filter("vec_id % 50 = 0")).collect()] == [(0, 1, 1, 256 * 512)]


def test_very_long_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 50 % 101, [float(x) for x in rng.normal(size=140_000).astype(np.float32)]) for i in range(3)]
    assert run(spark, rows) == brute(rows)
