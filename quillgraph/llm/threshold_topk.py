"""Exact top-k by inner product: Fagin's threshold algorithm over sorted lists.

A block of vectors keeps, for every dimension, its rows sorted by that component. For a
query, each list is read from the end that the query's sign prefers, a step of rows at a
time in all lists; rows met for the first time are scored in full. What no list has shown
yet can score at most the sum of query component times the last value read: once that
bound is below the k-th best score so far, the block holds nothing more and the search
stops. (It goes on while the bound equals that score, as a smaller id could still tie.)

Every task works through its own rows in blocks and carries each query's k best from one
block to the next, so later blocks stop sooner; the tasks' k best are merged per query by
partial aggregation. Queries are a stated set; they go out in groups of QUERY_GROUP, each
group small enough to broadcast.

Components are floor(256 * x); scores are exact whatever their size: in float64 while no sum
can pass 2^53, else in 64-bit integers while none can pass 2^63, else in whole numbers of any
length. They rank by exact score; a score beyond the range of a long is returned as the
nearest long. Vectors that are null or
have a null or non-finite component (256 * x included) take no part; a query pairs only with vectors of its own
length. Repeated vectors are separate candidates; a query's own row is left out, that is
every row with its vec_id, and of rows with one vec_id the best enters once. A null vec_id
takes no part. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import Scratch

K, EVERY, SCALE = 5, 50, 256
#: Vectors per block; rows read from each list at a time; queries sent out at a time.
BLOCK_ROWS, STEP, QUERY_GROUP = 8192, 16, 16_384


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers that floats hold, as Python's."""
    return np.array([int(v) for v in x.ravel().tolist()], object).reshape(x.shape)


class Block:
    """Vectors of one length (float64, whole numbers) with their sorted lists."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, np.asarray(x, np.float64)
        self.most = float(np.abs(self.x).max(initial=0))
        self.kinds: dict = {}
        x = self.x
        self.order = np.argsort(x, axis=0, kind="stable")  # ascending, list by list
        self.values = np.take_along_axis(x, self.order, axis=0)
        self.repeats = len(np.unique(ids)) < len(ids)

    def _exact(self, q: np.ndarray):
        """The rows, the lists' values and the query in a type whose sums are exact."""
        bound = self.most * float(np.abs(q).max(initial=0)) * max(1, len(q)) * 1.001
        kind = np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object
        if kind not in self.kinds:
            self.kinds[kind] = tuple(_whole(a) if kind is object else a.astype(kind, copy=False) for a in (self.x, self.values))
        return *self.kinds[kind], _whole(q) if kind is object else q.astype(kind, copy=False)

    def search(self, own: int, q: np.ndarray, best: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best of ``best`` and the block, as (score, vec_id); rows read per list."""
        n, dims = self.x.shape
        x, values, q = self._exact(np.asarray(q, np.float64))
        up = q < 0
        use = np.flatnonzero(q)
        seen = np.zeros(n, bool)
        depth = 0
        while depth < n:
            step = min(max(STEP, depth), n - depth)  # doubling
            rows = slice(depth, depth + step)
            back = slice(n - depth - step, n - depth)
            met = np.concatenate([self.order[rows][:, use[up[use]]].ravel(), self.order[back][:, use[~up[use]]].ravel()]) if len(use) else np.arange(n)
            mark = np.zeros(n, bool)
            mark[met] = True
            new = np.flatnonzero(mark & ~seen)
            seen[new] = True
            depth += step
            if len(new):
                score, ids = (x if len(new) == n else x[new]) @ q, self.ids[new]
                if len(best) == k:
                    ok = score >= best[-1][0]
                    score, ids = score[ok], ids[ok]
                keep = ids != own
                score, ids = score[keep], ids[keep]
                if self.repeats and len(score) > 4 * k:  # rows of one vec_id count once in the cut
                    order = np.lexsort((-score, ids))
                    score, ids = score[order], ids[order]
                    first = np.append(True, ids[1:] != ids[:-1])
                    score, ids = score[first], ids[first]
                if len(score) > 4 * k:
                    cut = (np.sort if score.dtype == object else lambda a: np.partition(a, len(a) - k))(score)[len(score) - k]
                    ties = score >= cut
                    score, ids = score[ties], ids[ties]
                best = _best([*best, *zip(map(int, score.tolist()), ids.tolist())], k)
            if not len(use) or depth >= n:
                break
            last = np.where(up, values[depth - 1], values[n - depth])
            if len(best) == k and int(last @ q) < best[-1][0]:
                break
        return best, depth


def _best(found: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    by_id: dict[int, int] = {}
    for s, i in found:
        if i not in by_id or by_id[i] < s:
            by_id[i] = s
    return sorted(((s, i) for i, s in by_id.items()), key=lambda x: (-x[0], x[1]))[:k]


def _sortable(n: int) -> bytes:
    """A whole number as bytes that sort as it does."""
    size = (abs(n).bit_length() + 7) // 8
    raw = size.to_bytes(2, "big") + abs(n).to_bytes(size, "big")
    return b"\1" + raw if n >= 0 else b"\0" + bytes(255 - x for x in raw)


def _search(queries, k: int):
    def run(batches):
        groups: dict[int, list] = {}
        for qid, raw in queries.value:
            q = np.frombuffer(raw, "<f8")
            groups.setdefault(len(q), []).append((qid, q))
        best: dict[tuple, list] = {}
        held: dict[int, list] = {}

        def flush(dims):
            parts = held.pop(dims)
            ids, rows = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            for c in range(0, len(ids), BLOCK_ROWS):
                block = Block(ids[c : c + BLOCK_ROWS], rows[c : c + BLOCK_ROWS])
                for at, (qid, q) in enumerate(groups[dims]):
                    best[(dims, at)] = block.search(qid, q, best.get((dims, at), []), k)[0]

        for b in batches:
            ids, v = b.column(0).to_numpy(), b.column(1)
            lens, flat = pc.list_value_length(v).to_numpy(), v.flatten().to_numpy()
            starts = np.cumsum(lens) - lens
            for dims in np.unique(lens).tolist():
                if dims in groups:
                    own = lens == dims
                    held.setdefault(dims, []).append((ids[own], flat[starts[own][:, None] + np.arange(dims)]))
                    if sum([len(p[0]) for p in held[dims]]) >= BLOCK_ROWS:
                        flush(dims)
        for dims in list(held):
            flush(dims)
        out = [(groups[d][at][0], i, max(-(1 << 63), min((1 << 63) - 1, s)), _sortable(s)) for (d, at), found in best.items() for s, i in found]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kinds[c]) for c in range(4)], ["query_id", "vec_id", "score", "exact"])

    return run


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole components floor(scale * x) of the vectors that take part."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))  # noqa: E731  beyond, doubles are whole
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(scaled(x)) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    return rows.select("vec_id", F.transform("embedding", whole).alias("v"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best. Both frames: (vec_id, v)."""
    spark = vectors.sparkSession
    n = queries.count()
    groups = max(1, -(-n // QUERY_GROUP))
    with Scratch(spark, "topk") as s:
        found = None
        for g in range(groups):
            some = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(groups)) == g) if groups > 1 else queries
            sent = spark.sparkContext.broadcast([(r["vec_id"], np.array(r["v"], "<f8").tobytes()) for r in some.collect()])  # about QUERY_GROUP of the stated set
            part = s.write(vectors.select("vec_id", "v").mapInArrow(_search(sent, k), "query_id long, vec_id long, score long, exact binary"), "best")
            found = part if found is None else found.unionByName(part)
        w = Window.partitionBy("query_id").orderBy(F.desc("exact"), "vec_id")
        top = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"), F.max("exact").alias("exact")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        return s.keep(s.write(top.select("query_id", "rank", "vec_id", "score"), "result"))
