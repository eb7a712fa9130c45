"""Toxicity by multiple-instance learning.

A document is a bag of sentences (runs between . ! ? and line ends). A sentence's score is
a logistic function of its distinct words, each with the weights of the word and of its
beginnings of 4 and 5 letters (hashed into BUCKETS weights); a document's is the noisy-or of its sentences: one offending sentence
is enough. Only documents carry labels; the likelihood of their labels under the noisy-or
trains the sentence weights by gradient steps, so blame settles on the sentences that tell
toxic documents from others. Only what
at least MIN_DOCS training documents have, and toxic ones more often than the others by
MIN_Z standard deviations, gets a weight. A fifth of the sample is kept from this training
and maps the noisy-or to a calibrated chance (logistic in its logit). The same weights then locate offending sentences.

Training uses at most SAMPLE labelled documents, those with the smallest hashes of doc_id
(a documented bound, which also holds where a doc_id has several texts; labelled documents
with held_out or a null label are never used). Their bags of buckets are all that the driver
keeps of them.
Inputs of a score are the text alone. Null, empty and wordless texts score 0. Repeated rows each get their row and train
once; a doc_id with several labels or texts trains with each, a null doc_id with none. Without labels of both kinds
every score is 0. An empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches

BUCKETS, SAMPLE, MIN_DOCS, MIN_Z, THRESHOLD = 1 << 20, 12_000, 4, 2.5, 0.7
STEPS, RATE, RIDGE = 200, 0.1, 0.02
_SENTENCE = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"[^\W_]+")


def _buckets(word: str) -> list[int]:
    parts = [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) >= k)]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


class Memory(dict):
    """What a function gives for a word, for a bounded number of words."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        out = self[word] = self.of(word)
        return out


def bag(text: str | None, buckets: Memory) -> tuple[np.ndarray, list[int]]:
    """Buckets of the distinct words of every sentence that has words, one after another,
    and how many each sentence has."""
    flat, lens = [], []
    for sentence in _SENTENCE.split((text or "").lower()):
        words = set(_WORD.findall(sentence))
        if words:
            before = len(flat)
            for w in words:
                flat.extend(buckets[w])
            lens.append(len(flat) - before)
    return np.array(flat, np.int32), lens


def train(texts: list[str], labels: list[int]) -> dict:
    """Weights of the sentence score, by full-batch Adam on the noisy-or likelihood."""
    buckets = Memory(_buckets)
    return _train([bag(t, buckets) for t in texts], labels)


def _train(bags: list[tuple[np.ndarray, list[int]]], labels: list[int]) -> dict:
    y = np.array([label for label, (_, lens) in zip(labels, bags) if lens], float)
    bags = [b for b in bags if b[1]]
    if not len(y) or y.min() == y.max():
        return {"words": np.empty(0, np.int64), "weights": np.empty(0), "bias": -50.0, "slope": 1.0, "shift": 0.0}
    apart = np.arange(len(bags)) % 5 == 4
    seen, toxic = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for (flat, _), label, a in zip(bags, y, apart):
        if not a:
            own = np.unique(flat)
            seen[own] += 1
            toxic[own] += label
    base = y[~apart].mean()
    z = (toxic - seen * base) / np.sqrt(np.maximum(seen, 1) * max(base * (1 - base), 1e-9))
    kept = np.flatnonzero((seen >= MIN_DOCS) & (z >= MIN_Z))
    place = np.full(BUCKETS, -1, np.int32)
    place[kept] = np.arange(len(kept))
    sent_doc = np.repeat(np.arange(len(bags)), [len(lens) for _, lens in bags])
    lens = np.array([n for _, ns in bags for n in ns])
    feat = place[np.concatenate([flat for flat, _ in bags])]
    row = np.repeat(np.arange(len(lens)), lens)
    row, feat = row[feat >= 0], feat[feat >= 0]
    n_s, n_d, n_f = len(lens), len(bags), len(kept)
    fit_on = ~apart
    share = fit_on / fit_on.sum()
    w, bias = np.zeros(n_f), -6.0
    m, v, mb, vb = np.zeros(n_f), np.zeros(n_f), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = np.clip(np.bincount(row, w[feat], n_s) + bias, -30, 30)
        p = 1 / (1 + np.exp(-z))
        quiet = np.bincount(sent_doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n_d)  # log of no sentence offending
        some = -np.expm1(quiet)
        # d(-loglik)/dz of a sentence: p for clean documents, -p (1 - P) / P for toxic ones
        g = p * np.where(y == 1, -np.exp(quiet) / np.maximum(some, 1e-9), 1.0)[sent_doc] * share[sent_doc]
        gw = np.bincount(feat, g[row], n_f) + RIDGE / fit_on.sum() * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= RATE * (m / c1) / (np.sqrt(v / c2) + 1e-10)
        bias -= RATE * (mb / c1) / (np.sqrt(vb / c2) + 1e-10)
    z = np.clip(np.bincount(row, w[feat], n_s) + bias, -30, 30)
    logit = _logit(-np.expm1(np.bincount(sent_doc, np.log1p(-np.minimum(1 / (1 + np.exp(-z)), 1 - 1e-12)), n_d)))
    slope, shift = _calibrate(logit[apart], y[apart])
    return {"words": kept, "weights": w, "bias": float(bias), "slope": slope, "shift": shift}


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic map by Newton's steps; as it is without both kinds."""
    if len(y) < 20 or y.min() == y.max():
        return 1.0, 0.0
    # Platt's targets: never quite 0 or 1
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    a, b = np.zeros(2), np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(b @ a, -30, 30)))
        step = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + 1e-3 * np.eye(2), b.T @ (target - p) - 1e-3 * a)
        a += np.clip(step, -2, 2)
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights from labelled documents (doc_id, toxic) whose crc32(doc_id) mod 3 isn't 1."""
    by_id = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    by_id = by_id.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    chosen = by_id.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(SAMPLE)
    with Scratch(docs.sparkSession, "toxicity") as s:
        chosen = s.write(chosen, "sample")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        got = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic", F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"))  # SAMPLE rows at most were broadcast
        got = s.write(got, "texts")
        first = got.select("doc_id", "toxic", "h").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic", "h").limit(SAMPLE)
        buckets = Memory(_buckets)
        rows = got.join(F.broadcast(first), ["doc_id", "toxic", "h"]).toLocalIterator()
        rows = sorted(((r["doc_id"], r["toxic"], r["h"], bag(r["text"], buckets)) for r in rows), key=lambda r: r[:3])
    return _train([r[3] for r in rows], [r[1] for r in rows])


def _scorer(model):
    full = np.zeros(BUCKETS)
    full[model["words"]] = model["weights"]
    weight = Memory(lambda w: float(full[_buckets(w)].sum()))

    def sentences(text):
        """(start, end, chance) of each sentence with words."""
        at, out = 0, []
        for m in [*_SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            words = set(_WORD.findall(text[at:end].lower()))
            if words:
                z = sum([weight[w] for w in words]) + model["bias"]
                out.append((at, end, 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))))
            at = m.end() if m else end
        return out

    return sentences


def _noisy_or(chances, model) -> float:
    if not chances:
        return 0.0
    p = -math.expm1(sum(math.log1p(-min(c, 1 - 1e-12)) for c in chances))
    p = min(1 - 1e-9, max(1e-9, p))
    z = model["slope"] * math.log(p / (1 - p)) + model["shift"]
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and offending: (start, end, chance) of the sentences whose own
    chance reaches half, in characters."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS weights at most

    def run(batches):
        sentences = _scorer(sent.value)
        for b in batches:
            scores, spans = [], []
            for text in b.column(1).to_pylist():
                found = sentences(text or "")
                scores.append(_noisy_or([c for _, _, c in found], sent.value))
                spans.append([{"start": s, "end": e, "chance": c} for s, e, c in found if c >= 0.5])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("chance", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(spans, span)], ["r", "score", "predicted", "offending"]
            )

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["r"].dataType.simpleString()
    return rows.mapInArrow(run, f"r {kind}, score double, predicted int, offending array<struct<start: long, end: long, chance: double>>")
