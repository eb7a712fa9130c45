"""Lexical and semantic ranks fused by weighted reciprocal ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
RANK_CONSTANT, LEAST, TIMES, MOST = 60, 50, 5, 1000


def weights(lexical: float, semantic: float) -> tuple[float, float]:
    if lexical < 0 or semantic < 0:
        raise ValueError("weights are not negative")
    both = lexical + semantic
    return (0.5, 0.5) if both == 0 else (lexical / both, semantic / both)


def candidate_count(page: int, filtered: bool = False) -> int:
    return MOST if filtered else min(MOST, max(LEAST, TIMES * page))


def _best(side: DataFrame, key: str) -> DataFrame:
    """A node's best rank on one side, of equal ranks the higher score."""
    score = F.col("score") if "score" in side.columns else F.lit(0.0)
    return side.groupBy(key).agg(F.min(F.struct(F.col("rank"), (-score).alias("s"))).alias("x")).select(key, "x.rank")


def fuse(lexical: DataFrame, semantic: DataFrame, w: tuple[float, float] = (0.5, 0.5), constant: float = RANK_CONSTANT, require_both: bool = False, key: str = "node") -> DataFrame:
    """(key, lexical_rank, semantic_rank, score, rank), best first: score, then found by
    both, then the better rank, then the key. A side of weight 0 still shows its nodes. Each
    side counts to its MOST best nodes, so the ranks' window sees twice as many at most."""
    c = constant or RANK_CONSTANT
    if c < 0:
        raise ValueError("the rank constant is not negative")
    wl, ws = weights(*w)
    a, b = (_best(side, key).orderBy("rank", key).limit(MOST).withColumnRenamed("rank", name) for side, name in ((lexical, "lexical_rank"), (semantic, "semantic_rank")))
    both = a.join(b, key, "inner" if require_both else "full_outer")
    part = lambda weight, col: F.coalesce(F.lit(weight) * (F.lit(1.0) / (F.lit(float(c)) + F.col(col))), F.lit(0.0))
    rows = both.withColumn("score", part(wl, "lexical_rank") + part(ws, "semantic_rank"))
    order = [F.desc("score"), F.desc(F.col("lexical_rank").isNotNull() & F.col("semantic_rank").isNotNull()), F.least("lexical_rank", "semantic_rank"), F.col(key)]
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def search(lexical: DataFrame, semantic: DataFrame | None, nodes: DataFrame | None = None, condition=None, page: int = 20, key: str = "node", **options):
    """(rows, warnings): both sides cut to their candidates, fused, filtered, paged. Without
    a semantic side the lexical one answers alone, with a warning."""
    n = candidate_count(page, condition is not None)
    cut = lambda side: side.filter(F.col("rank") <= n)
    warnings = []
    if semantic is None:
        warnings.append("semantic search is unavailable")
        semantic = cut(lexical).limit(0)
        options["w"] = (1.0, 0.0)
    out = fuse(cut(lexical), cut(semantic), key=key, **options)
    if condition is not None:
        out = out.join(nodes.filter(condition).select(key), key, "left_semi")
    return out.orderBy("rank").limit(page), warnings
