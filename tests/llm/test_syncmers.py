import hashlib
import random
from collections import Counter

import regex
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import syncmers


def test_edited_texts_follow_the_descending_order(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 7)
    texts = {i * i: " ".join(f"w{(i * 7 + j) % 211}" for j in range(i % 40)) for i in range(60)}
    texts[10_000_000] = "日本語の文章" * 50
    texts[10_000_001] = "x" * 5000
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    ids = sorted(texts, reverse=True)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        t, m = texts[a], len(texts[a]) // 3
        assert got[a].edited_sha256 == hashlib.sha256((t[: len(t) - m] + texts[b][:m]).encode()).hexdigest()
        assert got[a].n_chars == len(t)
    assert got[10_000_000].near_edited > 0


def test_closed_syncmers_and_likeness(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t")], "doc_id long, text string")
    h = syncmers._hashes(df, "text").first().h
    k = syncmers.K
    want = [i for i in range(len(h) - k + 1) if min(h[i : i + k]) in (h[i], h[i + k - 1])]
    found = syncmers.anchors(df, "text", "an").first().an
    assert [a.place for a in found] == want
    sk = syncmers.sketch(df, "text", "sk").first().sk
    assert sk == sorted({a.hash for a in found})[: syncmers.KEPT]
    x = spark.createDataFrame([([1, 2, 3], [2, 3, 4], []), ([], [], [5])], "a array<long>, b array<long>, c array<long>")
    got = syncmers.likeness(syncmers.likeness(x, "a", "b", "ab"), "a", "c", "ac").select("ab", "ac").collect()
    assert [tuple(r) for r in got] == [(0.5, 0.0), (1.0, 0.0)]


def test_moved_passages_match_by_place(spark):
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(" ".join(words), "new start " + " ".join(words))], "a string, b string")
    df = syncmers.anchors(syncmers.anchors(df, "a", "x"), "b", "y").select(syncmers.matches(F.col("x"), F.col("y")).alias("m"))
    shifts = {m.other - m.place for m in df.first().m}
    assert shifts == {2}


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    schema = "doc_id long, text string, copy int, bucket string, sk string, head long"
    rows = [(1, None, 1, "", "", 1), (1, "a b", 1, "", "", 1), (1, "a b", 1, "", "", 1), (None, "", 1, "", "", None), (2, "\t\n", 1, "", "", 1)]
    got = syncmers.fingerprints(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and {r.near_edited for r in got} <= {0.0, 1 / 3, 0.5, 1.0}
    assert {r.fingerprint for r in got if not r.n_chars} == {""}
    assert syncmers.fingerprints(spark.createDataFrame([], schema)).collect() == []
    one = syncmers.fingerprints(spark.createDataFrame([(5, "a b c d e f g")], "doc_id long, text string")).first()
    assert one.near_next == 1.0


def naive(texts):
    """Anchors of a text from the definition, without Spark: (the KEPT smallest, all)."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    alone = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
    token = regex.compile(rf"[{alone}]|[^ \t\n\x0b\f\r{alone}]{{1,16}}+")
    out = []
    for t in texts:
        h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in token.findall(t)]
        found = {(x & (1 << 64) - 1) >> 24 for x in h} if len(h) < syncmers.K else set()
        for i in range(len(h) - syncmers.K + 1):
            part = h[i : i + syncmers.K]
            if min(part) in (part[0], part[-1]):
                seed = 42
                for x in part:
                    seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
                found.add(seed >> 24)
        out.append(sorted(found)[: syncmers.KEPT])
    return out


def alike(a, b):
    least = sorted({*a, *b})[: syncmers.KEPT]
    return sum(x in a and x in b for x in least) / len(least) if least else 1.0


def same_as_naive(spark, rows, parts=3):
    """Every row's fingerprints, edited text and likenesses; of rows with one doc_id as sets."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = syncmers.fingerprints(df).collect()
    signed = {t: x - (1 << 64) if (x := xxhash.xxh64_intdigest(t.encode(), 42)) >> 63 else x for _, t in [(i, t or "") for i, t in rows]}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), -(signed[r[1]] >> 20)))
    want = Counter()
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        m = len(t) // 3
        e = t[: len(t) - m] + u[:m]
        a, b, c = naive([t, e, u])
        hexes = lambda xs: "".join(f"{x:010x}" for x in xs)
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), hexes(a), hexes(b), round(alike(a, b), 9), round(alike(a, c), 9))] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want


def test_whole_query_same_as_naive(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 9)
    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "ζήτα", "語", "x" * 40]) + str(rng.randrange(9)) for _ in range(n))
    rows = [(rng.choice([i, i * i, -i, 2**62 - i]), words(rng.randrange(0, 60))) for i in range(150)]
    rows += [(2**63 - 1, words(20)), (-(2**63), words(20)), (5, None), (6, ""), (7, " ".join(f"v{i}" for i in range(150_000)))]  # the last over 1 MB
    rows += [(77, words(12)) for _ in range(60)] + [(None, words(9)) for _ in range(50)] + [(None, None)]
    rows += [(78, "one text many times over")] * 70
    same_as_naive(spark, list(dict.fromkeys(rows)) + [(78, "one text many times over")] * 69)


def test_ranges_hold_about_as_many_rows_however_ids_lie(spark, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 500)
    for ids in ("id", "IF(id = 0, 4611686018427387904, id)", "IF(id % 3 = 0, 7, id)", "IF(id % 3 = 0, NULL, id * id * id)"):
        df = spark.range(0, 20_000, numPartitions=4).selectExpr(f"{ids} AS doc_id", "IF(id % 2 = 0, 'same', concat('t', id)) AS text")
        dealt = syncmers.dealt_by_range(df, "doc_id")
        sizes = [r["count"] for r in dealt.filter("copy = 0").groupBy("bucket").count().collect()]
        assert sum(sizes) == 20_000 and max(sizes) <= 1500 and len(sizes) >= 30, (ids, sorted(sizes)[-5:])
        assert dealt.filter("copy = 1").count() == len(sizes)


def places_of(text):
    """All distinct anchors of a text with their first places, from the definition."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    h = [signed(xxhash.xxh64_intdigest(x.encode(), 42)) for x in regex.findall(r"[^ ]{1,16}+", text)]
    if len(h) < syncmers.K:
        found = [((x & (1 << 64) - 1) >> 24, i) for i, x in enumerate(h)]
    else:
        found = []
        for i in range(len(h) - syncmers.K + 1):
            part = h[i : i + syncmers.K]
            if min(part) in (part[0], part[-1]):
                seed = 42
                for x in part:
                    seed = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
                found.append((seed >> 24, i))
    first = {}
    for x, i in found:
        first.setdefault(x, i)
    return first


def sampled(found):
    return sorted(found)[: max(syncmers.KEPT, sum(x < (1 << 40) // syncmers.PART for x in found))]


def agreed(x, y):
    """Agreement of two texts' anchors from the definition."""
    a, b = places_of(x), places_of(y)
    least = sampled({*a, *b})
    apart = Counter(abs(a[h] - b[h]) for h in least if h in a and h in b)
    return sum(n for d, n in apart.items() if d == 0 or n > 1) / len(least) if least else 1.0


def test_agreement_by_places_same_as_naive(spark):
    rng = random.Random(3)
    words = lambda n, of=40: [f"w{rng.randrange(of)}" for _ in range(n)]
    pairs = [("", ""), ("", "a"), ("a", "a"), ("a b", "b a"), ("a b c d e", "a b c d e")]
    for n in (3, 7, 30, 200, 3000):
        x, y = words(n, 40 + 5 * n), words(n)
        pairs += [(" ".join(x), " ".join(y)), (" ".join(x), " ".join([*words(9), *x])), (" ".join(x), " ".join([*x[: n // 2], *words(5), *x[n // 2 :]])), (" ".join(x), " ".join([*x[: -(n // 3)], *y[: n // 3]]))]
    long = words(30_000, 10**6)
    pairs.append((" ".join(long), " ".join([*long[:15_000], *words(20), *long[15_100:]])))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x string, y string")
    df = syncmers.placed(syncmers.placed(df, "x", "a"), "y", "b")
    for i, size, got, other in syncmers.agreement(syncmers.agreement(df, "a", "b", "ab"), "b", "a", "ba").select("i", F.size("a"), "ab", "ba").collect():
        x, y = pairs[i]
        assert (size, got, other) == (len(sampled(places_of(x))), agreed(x, y), agreed(x, y)), i
    assert len(sampled(places_of(" ".join(long)))) > 4 * syncmers.KEPT  # the sample grows with the text


def test_agreement_leaves_chance_matches_out(spark):
    a, b = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    for n, at in enumerate((20, 70, 130)):  # one phrase, at three unlike distances
        a[at : at + 4], b[at + 7 * n + 5 : at + 7 * n + 9] = [[f"p{n}{i}" for i in range(4)]] * 2
    rows = [(2, " ".join(a)), (1, " ".join(b))]
    got = {r.doc_id: r for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2].placed_next == 0 and got[2].placed_edited > 0.3
    same = syncmers.fingerprints(spark.createDataFrame([(1, "x y z"), (2, "x y z"), (3, None), (4, "")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.placed_next for r in same} == {4: 1.0, 3: 0.0, 2: 1.0, 1: 0.0}
