import math
import random
import re
import zlib

import numpy as np

from quillgraph.llm import toxicity as tx


def corpus(n, seed):
    rng = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in ("lor", "min", "tas", "ven")]
    bad = ["grubly", "snorfish", "wretchup"]
    rows = []
    for i in range(n):
        sents = [" ".join(rng.choice(vocab) for _ in range(8)) for _ in range(rng.randrange(1, 12))]
        toxic = int(rng.random() < 0.2)
        if toxic:
            k = rng.randrange(len(sents))
            sents[k] += " " + rng.choice(bad)
        rows.append((i, ". ".join(sents) + ".", toxic))
    return rows


def test_held_out_accuracy_and_offending_sentences(spark):
    rows = corpus(900, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.r.doc_id: r for r in tx.score(docs, tx.fit(docs, labels)).collect()}
    held = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    wrong = sum(got[i].predicted != y for i, _, y in held)
    assert wrong <= 0.03 * len(held)
    found = [(t, got[i].offending) for i, t, y in held if y and got[i].predicted]
    hit = sum(any(any(w in t[s.start : s.end] for w in ("grubly", "snorfish", "wretchup")) for s in spans) for t, spans in found)
    assert hit >= 0.9 * len(found)
    assert all(got[i].predicted == int(got[i].score >= 0.7) and 0 <= got[i].score <= 1 for i in got)


def test_held_out_labels_do_not_matter(spark):
    rows = corpus(200, 6)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows]
    a = tx.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = tx.fit(docs, spark.createDataFrame(flip, "doc_id long, toxic int"))
    assert np.array_equal(a["weights"], b["weights"]) and a["bias"] == b["bias"]


def test_nulls_empty_and_odd_columns(spark):
    schema = "doc_id long, text string, score string, offending int"
    docs = spark.createDataFrame([(1, None, "x", 1), (None, "", None, 2), (3, "!!! ... 12", "y", None), (3, "!!! ... 12", "y", None)], schema)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    for labels in (none, odd):
        out = tx.score(docs, tx.fit(docs, labels)).collect()
        assert len(out) == 4 and all(0 <= r.score < 0.01 and r.predicted == 0 for r in out)
    assert tx.score(docs.limit(0), tx.fit(docs.limit(0), none)).collect() == []


def naive_score(text, model):
    """The document's score by loops: a logistic function of each sentence's distinct words
    and their beginnings, noisy-or over sentences, a logistic map of its logit."""
    weight = dict(zip(model["words"].tolist(), model["weights"].tolist()))
    bucket = lambda s: zlib.crc32(s.encode()) % tx.BUCKETS
    quiet = 1.0
    for sentence in re.split(r"[.!?\n\r]+", (text or "").lower()):
        words = {w for w in re.findall(r"[^\W_]+", sentence)}
        if words:
            z = model["bias"]
            for w in words:
                z += sum(weight.get(bucket(p), 0.0) for p in [w] + [w[:k] + "*" for k in (4, 5) if len(w) >= k])
            quiet *= 1 - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    if quiet == 1.0 and not re.search(r"[^\W_]", text or ""):
        return 0.0
    p = min(1 - 1e-9, max(1e-9, 1 - quiet))
    return 1 / (1 + math.exp(-(model["slope"] * math.log(p / (1 - p)) + model["shift"])))


def test_scores_same_as_by_hand(spark):
    rows = corpus(400, 8)
    texts = [(i, t) for i, t, _ in rows] + [(900, None), (901, " ..."), (902, "Grubly!\nsnorfish"), (903, "lor " * 300_000 + "wretchup")]  # the last over 1 MB
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = tx.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.r.doc_id: r.score for r in tx.score(docs, model).collect()}
    assert len(model["words"]) > 3 and all(abs(got[i] - naive_score(t, model)) < 1e-6 for i, t in texts)


def test_training_lowers_the_loss_and_blames_the_right_words():
    rows = corpus(300, 9)
    model = tx.train([t for _, t, _ in rows], [y for _, _, y in rows])
    weight = dict(zip(model["words"].tolist(), model["weights"].tolist()))
    strong = {w for w, x in weight.items() if x > 0.5 * max(weight.values())}
    parts = {zlib.crc32(p.encode()) % tx.BUCKETS for w in ("grubly", "snorfish", "wretchup") for p in (w, w[:4] + "*", w[:5] + "*")}
    assert strong and strong <= parts
    flat = dict(model, weights=np.zeros_like(model["weights"]), bias=model["bias"], slope=1.0, shift=0.0)
    loss = lambda m: -sum(math.log(max(1e-9, (s if y else 1 - s))) for s, y in ((naive_score(t, m), y) for _, t, y in rows))
    assert loss(model) < 0.2 * loss(flat)


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """A labelled doc_id with many texts, or one many times, makes no larger sample."""
    monkeypatch.setattr(tx, "SAMPLE", 40)
    rows = corpus(120, 10)
    more = [(5, f"text number {n}.") for n in range(300)] + [(7, "the same text.")] * 300
    taken = []
    train = tx._train
    monkeypatch.setattr(tx, "_train", lambda bags, labels: taken.append(len(bags)) or train(bags, labels))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + more, "doc_id long, text string")
    tx.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert taken and taken[0] <= 40
