"""The dealt operators as queries over the driver's tables, with SQL twins where SQL can."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunk_dedup, ngram_join, packing, syncmers, threshold_topk, token_counts, toxicity, url_rules, warc, word_bpe
from ._shared import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_token_counts(spark, sf_dir):
    return token_counts.suffix_sums(token_counts.histogram(table(spark, sf_dir, "documents")))


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join(table(spark, sf_dir, "documents"))


ORACLES["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w
), c AS (SELECT g, min(doc_id) AS id, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY 1),
e AS (SELECT id, n, unnest(g) AS t FROM c),
p AS (SELECT a.id AS a, b.id AS b FROM e a JOIN e b ON a.t = b.t AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(node, low) USING KEY (node) AS (
  SELECT id, id FROM c UNION
  SELECT u.a, min(r.low) FROM r JOIN u ON u.b = r.node JOIN recurring.r AS o ON o.node = u.a GROUP BY u.a, o.low HAVING min(r.low) < o.low
)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, c.id AS class_id, coalesce(r.low, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.g) > 0 AND list_sort(s.g) = c.g LEFT JOIN r ON r.node = c.id
"""


@query
def op9_substring_dedup(spark, sf_dir):
    """Per document: the text that stays, what was cut and whom it repeats."""
    cut = chunk_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select(
        "r.doc_id",
        "r.text",
        F.length("r.text").cast("long").alias("n_chars"),
        (F.coalesce(F.col("r.n_chars"), F.lit(0)) - F.coalesce(F.length("r.text"), F.lit(0))).cast("long").alias("cut_chars"),
        F.size("spans").alias("n_spans"),
        F.col("spans").alias("cut_byte_spans"),
        F.col("sources").alias("repeats_doc_ids"),
    )


@query
def op2_fingerprints(spark, sf_dir):
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("r.doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))  # a null doc_id is not held out, and trains nothing
    return scored.select("r.doc_id", held_out.alias("held_out"), "score", "predicted", "offending")


@query
def op5_word_bpe(spark, sf_dir):
    return word_bpe.encode(table(spark, sf_dir, "documents"), full=False).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


@query
def op6_threshold_topk(spark, sf_dir):
    vectors = threshold_topk.quantised(table(spark, sf_dir, "embeddings"))
    return threshold_topk.search(vectors, vectors.filter(f"vec_id % {threshold_topk.EVERY} = 0"))


ORACLES["op6_threshold_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op7_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"))


@query
def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
), b AS (
  SELECT *, array_to_string(list_transform(string_split(h, ''), lambda c:
    list_extract(['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
                 CAST(strpos('0123456789abcdef', c) AS INTEGER))), '') AS bits
  FROM d
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INTEGER) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INTEGER)
        + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INTEGER) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INTEGER)
        + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM b
"""
