import random
import zlib

import corpus_pipeline as cp
import numpy as np
from quillgraph.llm import byte_bpe, chunk_dedup, toxicity
from quillgraph.llm._shared import table

from .test_chunk_dedup import brute as brute_cut
from .test_ngram_join import brute as brute_groups
from .test_toxicity import naive_score


def write(spark, folder, rng):
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(800)]
    words = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = words(70), words(120)
    docs, labels = [], []
    for i in range(260):
        toxic = i % 5 == 0
        text = ". ".join(words(12) for _ in range(rng.randrange(1, 9)))
        if toxic:
            text += ". you utter grubly snorfish here"
        if i % 20 == 3:
            text += f". {passage} " + words(9)
        if i % 25 == 4:
            w = base.split()
            w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, docs[8][1], "en", "s", 1), (903, words(5000), "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_same_as_brute_force(spark, tmp_path):
    write(spark, str(tmp_path), random.Random(9))
    docs = table(spark, str(tmp_path), "documents")
    before = {r.doc_id: r.text for r in docs.collect()}
    (_, tox), (_, near), (_, cut), (_, pack) = cp.STAGES

    a = tox(spark, docs, str(tmp_path))
    assert a.columns == docs.columns
    model = toxicity.fit(docs, table(spark, str(tmp_path), "labels"))
    chance = {i: naive_score(t, model) for i, t in before.items()}
    kept = {r.doc_id: r.text for r in a.collect()}
    assert kept == {i: t for i, t in before.items() if chance[i] < 0.7}
    toxic = {i for i, t in before.items() if t and "grubly" in t}
    assert len(toxic & set(kept)) <= 0.1 * len(toxic) and len(set(before) - toxic - set(kept)) <= 2

    a.write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    b = near(spark, a, str(tmp_path))
    assert b.columns == docs.columns
    groups = brute_groups(list(kept.items()))
    left = {r.doc_id: r.text for r in b.collect()}
    assert left == {i: t for i, t in kept.items() if groups[i][1] == i} and len(left) < len(kept) - 4

    b.write.parquet(f"{tmp_path}/b")
    b = spark.read.parquet(f"{tmp_path}/b")
    c = cut(spark, b, str(tmp_path))
    assert c.columns == docs.columns
    want = {i: t for i, t in brute_cut(sorted(left.items())).items() if t == left[i] or (t or "").strip()}
    got = {r.doc_id: (r.text, r.n_chars) for r in c.collect()}
    assert {i: t for i, (t, _) in got.items()} == want and any(want[i] != left[i] for i in want)
    assert all(n == (None if t is None else len(t)) for t, n in got.values())

    c.write.parquet(f"{tmp_path}/c")
    check_pieces(pack(spark, spark.read.parquet(f"{tmp_path}/c"), str(tmp_path)).collect(), {i: t for i, (t, _) in got.items()})
    whole = cp.run(spark, str(tmp_path))
    check_pieces(whole.collect(), want)


def check_pieces(rows, texts, size=2048):
    ids = {i: np.append(byte_bpe.library().encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for i, t in texts.items()}
    at = {i: 0 for i in ids}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        at[r.doc_id] += r.length
    assert at == {i: len(x) for i, x in ids.items()}
    full = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == full.get(r.sequence_id, 0)
        full[r.sequence_id] = r.offset + r.length
    assert max(full.values()) <= size
    return full


def test_odd_tables_go_through_all_stages(spark, tmp_path):
    """Null and repeated ids, empty and long texts, clashing columns; then an empty table."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    same, long = words(80), words(200_000)  # the latter over 1 MB
    rows = [(i, words(60)) for i in range(30)] + [(7, words(50)), (7, words(50)), (100, same), (101, same), (101, same), (None, same), (None, words(40)), (None, None), (102, ""), (103, None), (104, long)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__n` int, r string, maybe boolean, `group` long, rows int, k long, spans int, score double"
    more = (1, "x", None, 3, 4, 5, 6, 0.5)
    for part in ("documents", "empty"):
        folder = tmp_path / part
        docs = [(i, t, "en", "s", len(t or ""), *more) for i, t in rows] if part == "documents" else []
        spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    at = table(spark, str(tmp_path / "documents"), "documents")
    for n, (name, stage) in enumerate(cp.STAGES[:3]):
        out = stage(spark, at, str(tmp_path / "documents"))
        assert out.columns == at.columns
        out.write.parquet(f"{tmp_path}/out{n}")
        at = spark.read.parquet(f"{tmp_path}/out{n}")
        left = [(r.doc_id, r.text) for r in at.collect()]
        if name == "ngram_jaccard_join":
            ids = [i for i, _ in left if i is not None]
            assert len(ids) == len(set(ids)) and set(ids) == {i for i, _ in rows if i is not None} - {101} and sum(i is None for i, _ in left) == 3
    assert dict(left)[104] == long and dict(left)[100] == same and (None, None) in left
    check = {}
    for r in cp.run(spark, str(tmp_path / "documents")).collect():
        check.setdefault(r.sequence_id, []).append(r.offset + r.length)
    assert check and max(map(max, check.values())) <= 2048
    assert cp.run(spark, str(tmp_path / "empty")).collect() == []


def test_kept_tables_can_be_cleared(spark, tmp_path):
    import os

    from quillgraph import llm
    from quillgraph.llm import _shared

    llm.clean_up(spark)
    write(spark, str(tmp_path), random.Random(3))
    cp.run(spark, str(tmp_path)).count()
    paths = [p.removeprefix("file:") for p in _shared._kept]
    assert paths and all(os.path.exists(p) for p in paths)
    assert llm.clean_up(spark) == len(paths) and not any(os.path.exists(p) for p in paths)
