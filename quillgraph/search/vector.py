"""Exact cosine search, several bindings, and filters after it."""

from __future__ import annotations

import base64
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import BudgetExceeded, StaleCursor
from ..functions import values as V
from ..operators.versions import latest

#: Results of a search, and candidates of one that goes page by page.
TOP, MOST = 10, 10_000


def fresh_records(records: DataFrame, keys: list[str], created: str = "created", tombstone: str = "tombstone") -> DataFrame:
    """The newest record per (index, node, mode), without tombstones."""
    return latest(records, keys, created, tombstone)


def scores(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) for vectors of the query's own dimension: sums run in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    fits = vectors.filter(F.size(vector) == len(query))
    dbl = F.transform(vector, lambda x: x.cast("double"))
    d = fits.select(F.col(key), dbl.alias("__v"))
    dot = F.aggregate(F.zip_with("__v", q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    return d.select(key, F.when((own == 0) | F.lit(norm == 0), F.lit(0.0)).otherwise(dot / (own * F.lit(norm))).alias("score"))


def top_k(vectors: DataFrame, query: list[float], k: int = TOP, min_score: float | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score, rank): the k best by (score descending, key). The cut is a distributed
    top-k; the rank then numbers k rows."""
    s = scores(vectors, query, key, vector)
    if min_score is not None:
        s = s.filter(F.col("score") >= min_score)
    best = s.orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def merge_bindings(found: list[DataFrame], key: str = "vec_id", k: int = TOP) -> DataFrame:
    """Several bindings' hits (key, score, binding): the best per node, then ranked."""
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    one = every.groupBy(key).agg(F.max(F.struct("score", F.col("binding"))).alias("x")).select(key, "x.score", "x.binding")
    return one.orderBy(F.desc("score"), key).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def current(hits: DataFrame, bindings: dict[str, tuple[int, str]]) -> tuple[DataFrame, DataFrame]:
    """(hits whose vectors were made as their binding is configured now, bindings with stale
    ones). ``bindings``: binding -> (generation, configuration); hits: binding, generation,
    configuration. Hits of bindings that aren't there any more are stale too."""
    good = F.lit(False)
    for b, (generation, configuration) in bindings.items():
        good = good | ((F.col("binding") == b) & (F.col("generation") == generation) & (F.col("configuration") == configuration))
    good = F.coalesce(good, F.lit(False))
    return hits.filter(good), hits.filter(~good).select("binding").distinct()


def hits_page(hits: DataFrame, size: int = TOP, token: str | None = None, key: str = "vec_id"):
    """(rows, next token) of a bounded ranking (key, score, rank). A token holds the digest of
    the whole ranking: once that has changed the token is no good."""
    found = hits.orderBy("rank").limit(MOST + 1).collect()  # MOST candidates at most
    if len(found) > MOST:
        raise BudgetExceeded(f"a ranking has at most {MOST} candidates")
    mark, at = hashlib.sha256(repr([(r[key], r["score"]) for r in found]).encode()).hexdigest(), 0
    if token is not None:
        try:
            held, start = base64.urlsafe_b64decode(token).decode().split(":")
            at = int(start)
        except ValueError as e:
            raise StaleCursor("the token can't be read") from e
        if held != mark or not 0 <= at <= len(found):
            raise StaleCursor("the ranking has changed")
    end = at + size
    return found[at:end], base64.urlsafe_b64encode(f"{mark}:{end}".encode()).decode() if end < len(found) else None


def eligible(hits: DataFrame, nodes: DataFrame, key: str, condition: Column, min_score: float | None = None) -> DataFrame:
    """Hits whose nodes pass; with a filter the score's test comes after it."""
    out = hits.join(nodes.filter(condition), key, "left_semi")
    return out if min_score is None else out.filter(F.col("score") >= min_score)


def payload_test(col: Column, op: str, value=None) -> Column:
    """EQUAL, NOT_EQUAL (needs a value there), EXISTS, MISSING; typed equality."""
    return {
        "EXISTS": lambda: col.isNotNull(),
        "MISSING": lambda: col.isNull(),
        "EQUAL": lambda: F.coalesce(col == F.lit(value), F.lit(False)),
        "NOT_EQUAL": lambda: F.coalesce(col != F.lit(value), F.lit(False)),
    }[op]()


def select_targets(nodes: DataFrame, labels: list[str] | None = None, ids: list[str] | None = None, key: str = "node", label_col: str = "labels") -> DataFrame:
    """Nodes to embed: any of the labels, or the ids named."""
    out = nodes
    if labels:
        out = out.filter(F.arrays_overlap(label_col, F.array(*[F.lit(x) for x in labels])))
    if ids:
        out = out.filter(F.col(key).isin(ids))
    return out


def embed(text: Column, dims: int = 64) -> Column:
    """A local embedding without a provider: signed counts of hashed tokens."""
    hashes = F.transform(V.tokens(text), lambda t: F.xxhash64(t))
    cell = lambda i: F.aggregate(
        hashes, F.lit(0.0), lambda s, h: s + F.when(F.pmod(h, F.lit(dims)) == i, F.when(h > 0, 1.0).otherwise(-1.0)).otherwise(0.0)
    )
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), cell)


class VectorIndex:
    """Vectors of embedding rules in a folder, one part a rule: a search reads its rule's."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, vectors: DataFrame, rule: str, key: str = "node", vector: str = "vector") -> VectorIndex:
        """Replaces a rule's vectors; those of other rules stay."""
        rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("node"), F.col(vector).alias("vector"))
        rows.write.mode("overwrite").parquet(f"{self.path}/rule={rule}")
        return self

    def search(self, rule: str, query: list[float], k: int = 10, min_score: float | None = None) -> DataFrame:
        """The rule's k nearest, as ``top_k`` gives them."""
        return top_k(self.spark.read.parquet(f"{self.path}/rule={rule}"), query, k, min_score, "node", "vector")
