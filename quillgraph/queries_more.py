"""Search, hierarchies, mutations, versions, streams and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import places
from .catalog import Graph
from .driver_graph import build, lineitems, read
from .engine import Engine
from .functions import values as V
from .operators import catalogs, hierarchy, mutate, versions
from .registry import query
from .schema import language, violations
from .search import hybrid, vector
from .search.lexical import StoredIndex, filtered, page, ranked
from .streaming import changes as C
from .streaming import timing

# ---- lexical -------------------------------------------------------------------------------

_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')"


def _bm25_sql(terms, where, phrases=()):
    score = " + ".join(f"coalesce(ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * (t{i} * 2.2) / (t{i} + 1.2 * (0.25 + 0.75 * len / mean)), 0.0)" for i in range(len(terms)))
    boost = "".join(f" * CASE WHEN {p} THEN 1.25 ELSE 1.0 END" for p in phrases)
    counts = ", ".join(f"nullif(len(list_filter(w, lambda x: x = '{t}')), 0) AS t{i}" for i, t in enumerate(terms))
    dfs = ", ".join(f"count(t{i}) AS d{i}" for i in range(len(terms)))
    return f"""WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents), c AS (SELECT doc_id, w, len(w) AS len, {counts} FROM d),
    s AS (SELECT count(*) AS n, avg(len) AS mean, {dfs} FROM c),
    r AS (SELECT doc_id, ({score}){boost} AS score FROM c, s WHERE {where})
    SELECT doc_id AS doc, round(score, 6) AS score FROM r WHERE score > 0"""


def _phrase_sql(a, b):
    return f"len(list_filter(range(1, len(w)), lambda i: w[i] = '{a}' AND w[i + 1] = '{b}')) > 0"


_STORED: dict[tuple, tuple] = {}


def stored(spark, sf_dir) -> StoredIndex:
    """The index over documents, kept in the shared folder; built anew only where the table's
    files are others than those it was built from."""
    docs = read(spark, sf_dir, "documents")
    now = places.stamp(spark, docs.inputFiles())
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or _STORED[key][0] != now:
        _STORED[key] = now, StoredIndex(spark, places.new_folder(spark, "lexical")).add(docs, "doc_id", "text")
    return _STORED[key][1]


def _search(spark, sf_dir, text):
    return stored(spark, sf_dir).search(text).select("doc", F.round("score", 6).alias("score"))


for _name, _text, _sql in (
    ("bm25_term", "scum", _bm25_sql(["scum"], "t0 IS NOT NULL")),
    ("bm25_and", "Idiot clown", _bm25_sql(["idiot", "clown"], "t0 IS NOT NULL AND t1 IS NOT NULL")),
    ("bm25_or", "trash OR (loser AND NOT idiot)", _bm25_sql(["trash", "loser"], "t0 IS NOT NULL OR (t1 IS NOT NULL AND NOT list_contains(w, 'idiot'))")),
    ("bm25_not", "the -with", _bm25_sql(["the"], "t0 IS NOT NULL AND NOT list_contains(w, 'with')")),
    ("bm25_phrase", '"of the"', _bm25_sql(["of", "the"], _phrase_sql("of", "the"), [_phrase_sql("of", "the")])),
):

    @query(_name, _sql)
    def _run(spark, sf_dir, text=_text):
        return _search(spark, sf_dir, text)


@query("bm25_only_not", "SELECT 0 AS scored, count(*) AS documents FROM documents")
def bm25_only_not(spark, sf_dir):
    """Nothing but NOT scores nothing: none of all documents is returned."""
    index = stored(spark, sf_dir)
    return index.search("NOT the").agg(F.count(F.lit(1)).cast("int").alias("scored")).crossJoin(index.living.agg(F.count(F.lit(1)).alias("documents")))  # two one-row tables


@query("bm25_top", f"SELECT doc, score, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank FROM ({_bm25_sql(['scum', 'trash'], 't0 IS NOT NULL OR t1 IS NOT NULL')}) ORDER BY score DESC, doc LIMIT 12")
def bm25_top(spark, sf_dir):
    found = stored(spark, sf_dir).search("scum OR trash").withColumn("score", F.round("score", 6))
    return ranked(page(found, size=12), [F.desc("score"), F.col("doc")]).select("doc", "score", "rank")


@query("stored_segments", f"SELECT doc, score FROM ({_bm25_sql(['scum'], 't0 IS NOT NULL').replace('FROM documents)', 'FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN lower(lang) || chr(32) || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3))')})")
def stored_segments(spark, sf_dir):
    """Three segments: all documents, new versions of a fifth, deletions of a seventh; what
    lives is searched, before and after they are made one."""
    docs = read(spark, sf_dir, "documents")
    index = StoredIndex(spark, places.new_folder(spark, "segments")).add(docs, "doc_id", "text", revision=1)
    index.add(docs.filter("doc_id % 5 = 1").withColumn("text", F.concat(F.lower("lang"), F.lit(" "), "text")), "doc_id", "text", revision=2)
    index.add(docs.filter("doc_id % 7 = 3").withColumn("gone", F.lit(True)), "doc_id", "text", deleted="gone", revision=3)
    before, after = index.search("scum"), index.compact().search("scum")
    return before.join(after.select("doc", F.round("score", 6).alias("again")), "doc", "full_outer").filter("round(score, 6) = again").select("doc", F.round("score", 6).alias("score"))


@query("lexical_index", f"SELECT doc_id AS doc, term, count(*) AS tf, list_sort(list(CAST(p - 1 AS INTEGER))) AS positions FROM (SELECT doc_id, unnest({_TOKENS}) AS term, generate_subscripts({_TOKENS}, 1) AS p FROM documents) GROUP BY 1, 2")
def lexical_index(spark, sf_dir):
    return stored(spark, sf_dir).postings.select("doc", "term", "tf", "positions")


@query("filtered_lexical", f"SELECT doc FROM ({_bm25_sql(['scum'], 't0 IS NOT NULL')}) JOIN documents ON doc_id = doc WHERE lang = 'en' ORDER BY score DESC, doc LIMIT 10")
def filtered_lexical(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    found = stored(spark, sf_dir).search("scum").withColumn("score", F.round("score", 6))
    return filtered(found, docs, "doc_id", F.col("lang") == "en", 10).select("doc")


@query("lexical_page", f"SELECT doc FROM ({_bm25_sql(['scum'], 't0 IS NOT NULL')}) ORDER BY score DESC, doc LIMIT 5 OFFSET 5")
def lexical_page(spark, sf_dir):
    found = stored(spark, sf_dir).search("scum").withColumn("score", F.round("score", 6))
    return page(found, size=5, offset=5).select("doc")


# ---- vector and hybrid ------------------------------------------------------------------------

_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


def _query_vector(spark, sf_dir):
    return [float(x) for x in read(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]]


@query("vector_topk", f"SELECT vec_id, round(c, 6) AS score, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, {_COS} AS c FROM embeddings) ORDER BY c DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return vector.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_min_score", f"SELECT vec_id FROM (SELECT vec_id, {_COS} AS c FROM embeddings) WHERE c >= 0.3 ORDER BY c DESC, vec_id LIMIT 20")
def vector_min_score(spark, sf_dir):
    return vector.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 20, 0.3).select("vec_id")


@query("semantic_filter", f"SELECT vec_id FROM (SELECT vec_id, label, {_COS} AS c FROM embeddings ORDER BY c DESC, vec_id LIMIT 50) WHERE label <> 3 AND c >= 0.1")
def semantic_filter(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    hits = vector.top_k(e, _query_vector(spark, sf_dir), 50)
    return vector.eligible(hits, e, "vec_id", vector.payload_test(F.col("label"), "NOT_EQUAL", 3), 0.1).select("vec_id")


@query(
    "merge_best_binding",
    f"""WITH s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings), a AS (SELECT vec_id, c FROM s WHERE label < 5 ORDER BY c DESC, vec_id LIMIT 10),
    b AS (SELECT vec_id, c FROM s WHERE label >= 3 ORDER BY c DESC, vec_id LIMIT 10)
    SELECT vec_id, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM (SELECT vec_id, max(c) AS c FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1) ORDER BY c DESC, vec_id LIMIT 10""",
)
def merge_best_binding(spark, sf_dir):
    e, q = read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    sides = [vector.top_k(e.filter(c), q).select("vec_id", "score", F.lit(n).alias("binding")) for n, c in (("a", "label < 5"), ("b", "label >= 3"))]
    return vector.merge_bindings(sides).select("vec_id", "rank")


@query("semantic_candidates", f"SELECT vec_id, label FROM embeddings ORDER BY {_COS} DESC, vec_id LIMIT 7")
def semantic_candidates(spark, sf_dir):
    """SEMANTIC_SIMILAR in the text language, with the query's vector given by the host."""
    e, q = read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    near = lambda _, top: vector.top_k(e, q, top).select(F.concat(F.lit("Vector:"), F.col("vec_id").cast("string")).alias("node_id"), "rank", "score")
    return Engine(build(spark, sf_dir), vectors=near).rows("MATCH (v:Vector) WHERE SEMANTIC_SIMILAR(v, 'first', TOP 7) RETURN v.vec_id AS vec_id, v.label AS label")


_WORDS = "scum OR trash OR idiot"
_SIDES = f"""WITH l AS (SELECT doc AS node, row_number() OVER (ORDER BY score DESC, doc) AS r FROM ({_bm25_sql(["scum", "trash", "idiot"], "t0 IS NOT NULL OR t1 IS NOT NULL OR t2 IS NOT NULL")}) QUALIFY r <= 50),
s AS (SELECT vec_id AS node, row_number() OVER (ORDER BY round(c, 6) DESC, vec_id) AS r FROM (SELECT vec_id, {_COS} AS c FROM embeddings) QUALIFY r <= 50),
f AS (SELECT coalesce(l.node, s.node) AS node, l.r AS lr, s.r AS sr, coalesce(0.6 * (1.0 / (60.0 + l.r)), 0.0) + coalesce(0.4 * (1.0 / (60.0 + s.r)), 0.0) AS score FROM l {{join}} JOIN s ON l.node = s.node)
SELECT node, lr AS lexical_rank, sr AS semantic_rank, round(score, 9) AS score FROM f"""


def _sides(spark, sf_dir):
    """The 50 best documents by BM25, and by the likeness of their vectors to the first."""
    a = page(stored(spark, sf_dir).search(_WORDS).withColumn("score", F.round("score", 6)), size=50)
    b = vector.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 200).select(F.col("vec_id").alias("doc"), F.round("score", 6).alias("score"))
    order = [F.desc("score"), F.col("doc")]
    return tuple(ranked(page(side, size=50), order).select(F.col("doc").alias("node"), F.col("rank").cast("long")) for side in (a, b))


@query("hybrid_rrf", _SIDES.replace("{join}", "FULL"))
def hybrid_rrf(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), (0.6, 0.4)).select("node", F.col("lexical_rank").cast("long"), F.col("semantic_rank").cast("long"), F.round("score", 9).alias("score"))


@query("hybrid_require_both", _SIDES.replace("{join}", "INNER"))
def hybrid_require_both(spark, sf_dir):
    return hybrid.fuse(*_sides(spark, sf_dir), (0.6, 0.4), require_both=True).select("node", F.col("lexical_rank").cast("long"), F.col("semantic_rank").cast("long"), F.round("score", 9).alias("score"))


@query("hybrid_filtered_page", _SIDES.replace("{join}", "FULL").replace("SELECT node, lr AS lexical_rank, sr AS semantic_rank, round(score, 9) AS score FROM f", "SELECT node FROM f JOIN documents ON doc_id = node WHERE lang = 'en' ORDER BY score DESC, (lr IS NOT NULL AND sr IS NOT NULL) DESC, least(lr, sr), node LIMIT 10"))
def hybrid_filtered_page(spark, sf_dir):
    nodes = read(spark, sf_dir, "documents").withColumnRenamed("doc_id", "node")
    rows, _ = hybrid.search(*_sides(spark, sf_dir), nodes, F.col("lang") == "en", 10, w=(0.6, 0.4))
    return rows.select("node")


# ---- hierarchies ----------------------------------------------------------------------------

_GEO = [("Region", "Nation"), ("Nation", "Customer")]


def _geo(spark, sf_dir):
    return hierarchy.edge_frame(build(spark, sf_dir), "contains", _GEO)


_TREE = """SELECT 'Region:' || r_regionkey AS root, 'Region:' || r_regionkey AS node, 0 AS depth FROM region
UNION ALL SELECT 'Region:' || n_regionkey, 'Nation:' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'Region:' || n_regionkey, 'Customer:' || c_custkey, 2 FROM nation JOIN customer ON c_nationkey = n_nationkey"""


@query("subtree_flat", _TREE)
def subtree_flat(spark, sf_dir):
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("Region:"), F.col("r_regionkey").cast("string")).alias("root"))
    return hierarchy.subtree(roots, _geo(spark, sf_dir), 0, 2).select("root", "node", "depth")


@query("subtree_unbounded", _TREE)
def subtree_unbounded(spark, sf_dir):
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("Region:"), F.col("r_regionkey").cast("string")).alias("root"))
    places.checkpoints(spark)
    return hierarchy.subtree(roots, _geo(spark, sf_dir)).select("root", "node", "depth")


@query("tree_members", "SELECT 'Nation:' || c_nationkey AS root, count(*) + 1 AS members FROM customer GROUP BY 1")
def tree_members(spark, sf_dir):
    roots = read(spark, sf_dir, "customer").select(F.concat(F.lit("Nation:"), F.col("c_nationkey").cast("string")).alias("root")).distinct()
    return hierarchy.trees(hierarchy.subtree(roots, _geo(spark, sf_dir), 0, 1)).select("root", F.size("members").cast("long").alias("members"))


@query(
    "children_ordered",
    "SELECT 'Nation:' || c_nationkey AS parent, 'Customer:' || c_custkey AS child, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS INTEGER) AS place FROM customer",
)
def children_ordered(spark, sf_dir):
    return hierarchy.children(hierarchy.edge_frame(build(spark, sf_dir), "contains", [("Nation", "Customer")]))


@query("parent_of", "SELECT 'Customer:' || c_custkey AS child, 'Nation:' || c_nationkey AS parent FROM customer")
def parent_of(spark, sf_dir):
    return hierarchy.parents(hierarchy.edge_frame(build(spark, sf_dir), "contains", [("Nation", "Customer")]))


@query(
    "remove_nested",
    "SELECT 'Nation:' || n_nationkey AS node FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'Customer:' || c_custkey FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey % 2 <> 0",
)
def remove_nested(spark, sf_dir):
    n = read(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("node"))
    c = read(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return hierarchy.remove_nested(n.unionByName(c), _geo(spark, sf_dir), 3)


@query("nearest_ancestor", "SELECT 'Customer:' || c_custkey AS node, 'Region:' || n_regionkey AS ancestor, 2 AS depth FROM customer JOIN nation ON n_nationkey = c_nationkey")
def nearest_ancestor(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("node"))
    return hierarchy.nearest_ancestor(c, _geo(spark, sf_dir), ["Region"], 3)


@query("source_assembly", "SELECT 'Nation:' || n_nationkey AS root, n_name || coalesce(string_agg(chr(10) || '- ' || c_name, '' ORDER BY c_custkey), '') AS text FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def source_assembly(spark, sf_dir):
    n, c = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    texts = n.select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("node"), F.col("n_name").alias("text"))
    texts = texts.unionByName(c.select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("node"), F.col("c_name").alias("text")))
    roots = n.select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("root"))
    return hierarchy.source_text(hierarchy.subtree(roots, _geo(spark, sf_dir), 0, 1), texts).select("root", "text")


@query("hierarchy_violations", "SELECT 'single_parent' AS rule, 'Part:' || l_partkey AS node FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1")
def hierarchy_violations(spark, sf_dir):
    places.checkpoints(spark)
    e = read(spark, sf_dir, "lineitem").select(F.concat(F.lit("Supplier:"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("Part:"), F.col("l_partkey").cast("string")).alias("dst")).distinct()
    return hierarchy.violations(e)


@query("delete_recursively", "SELECT 'Customer:' || c_custkey AS node FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT 'Nation:' || n_nationkey FROM nation WHERE n_nationkey <> 3")
def delete_recursively(spark, sf_dir):
    places.checkpoints(spark)
    g = build(spark, sf_dir)
    nodes = g.node("Customer").df.select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("node"))
    nodes = nodes.unionByName(g.node("Nation").df.select(F.concat(F.lit("Nation:"), F.col("n_nationkey").cast("string")).alias("node")))
    return hierarchy.delete_recursively(nodes, hierarchy.edge_frame(g, "contains", [("Nation", "Customer")]), spark.createDataFrame([("Nation:3",)], "root string"))[0]


@query("move_subtree", "SELECT CASE WHEN n_nationkey = 4 THEN 'Region:2' ELSE 'Region:' || n_regionkey END AS src, 'Nation:' || n_nationkey AS dst FROM nation")
def move_subtree(spark, sf_dir):
    places.checkpoints(spark)
    return hierarchy.move(hierarchy.edge_frame(build(spark, sf_dir), "contains", [("Region", "Nation")]), "Nation:4", "Region:2").select("src", "dst")


# ---- mutations ------------------------------------------------------------------------------


def _after(spark, sf_dir, *statements):
    e = Engine(build(spark, sf_dir))
    for s in statements:
        e.execute(s)
    return e


@query("insert_node", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 99, 'NEWLAND'")
def insert_node(spark, sf_dir):
    return _after(spark, sf_dir, "INSERT (:Nation {n_nationkey: 99, n_name: 'NEWLAND', n_regionkey: 1})").rows("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


@query("merge_node", "SELECT n_name AS name, count(*) AS n FROM (SELECT n_name FROM nation UNION ALL SELECT 'MERGED') GROUP BY 1")
def merge_node(spark, sf_dir):
    e = _after(spark, sf_dir, *["MERGE (n:Nation {n_nationkey: 98, n_name: 'MERGED'}) RETURN n.n_name AS name"] * 2, "MERGE (n:Nation {n_nationkey: 3}) RETURN n.n_name AS name")
    return e.rows("MATCH (n:Nation) RETURN n.n_name AS name, COUNT(*) AS n")


@query("match_set", "SELECT c_custkey AS k, CASE WHEN c_nationkey = 7 THEN 'MOVED' ELSE c_mktsegment END AS seg FROM customer")
def match_set(spark, sf_dir):
    e = _after(spark, sf_dir, "MATCH (c:Customer)-[:IN_NATION]->(n:Nation {n_nationkey: 7}) SET c.c_mktsegment = 'MOVED' RETURN c.c_custkey AS k")
    return e.rows("MATCH (c:Customer) RETURN c.c_custkey AS k, c.c_mktsegment AS seg")


@query("match_delete", "SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) OR p_size >= 3")
def match_delete(spark, sf_dir):
    g = build(spark, sf_dir)
    used = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()
    lone = g.node("Part").df.join(used, "p_partkey", "left_anti").withColumn("lone", F.lit(True))
    parts = g.node("Part").df.join(lone.select("p_partkey", "lone"), "p_partkey", "left")
    e = Engine(Graph(dict(g.nodes), g.edges).add_node("Part", parts, "p_partkey"))
    e.execute("MATCH (p:Part) WHERE p.lone = TRUE AND p.p_size < 3 DELETE p RETURN p.p_partkey AS k")
    return e.rows("MATCH (p:Part) RETURN p.p_partkey AS k")


@query("create_edge", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a, nation b WHERE a.n_regionkey = 1 AND b.n_nationkey = 5 AND a.n_nationkey <> 5")
def create_edge(spark, sf_dir):
    e = _after(spark, sf_dir, "MATCH (a:Nation {n_regionkey: 1}), (b:Nation {n_nationkey: 5}) CREATE (a)-[:ALLY {since: 2001}]->(b)")
    return e.rows("MATCH (a:Nation)-[x:ALLY {since: 2001}]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b")


@query("merge_edge", "SELECT 3 AS a, 5 AS b, 1 AS n")
def merge_edge(spark, sf_dir):
    e = _after(spark, sf_dir, *["MATCH (a:Nation {n_nationkey: 3}), (b:Nation {n_nationkey: 5}) MERGE (a)-[:ALLY]->(b) RETURN a"] * 2)
    return e.rows("MATCH (a:Nation)-[:ALLY]->(b:Nation) RETURN a.n_nationkey AS a, b.n_nationkey AS b, COUNT(*) AS n").withColumn("n", F.col("n").cast("int"))


@query("script", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 2 THEN 'a;b' ELSE n_name END AS name FROM nation UNION ALL SELECT 90, 'X'")
def script(spark, sf_dir):
    e = Engine(build(spark, sf_dir))
    return e.script("INSERT (:Nation {n_nationkey: 90, n_name: 'X'}); MATCH (n:Nation {n_nationkey: 2}) SET n.n_name = 'a;b' RETURN n.n_name AS x; MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")[-1].rows


@query(
    "replace_refs",
    "SELECT o_custkey AS src, o_orderkey % 50 AS dst FROM orders WHERE o_custkey % 2 = 1 GROUP BY 1, 2 UNION SELECT DISTINCT o_custkey, 7 FROM orders WHERE o_custkey % 2 = 0",
)
def replace_refs(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("dst"), F.col("o_orderkey").cast("string").alias("edge_id"))
    wanted = o.filter("o_custkey % 2 = 0").select(F.col("o_custkey").alias("src"), F.lit(7).cast("long").alias("dst"))
    return mutate.replace_references(edges, wanted).select("src", "dst")


@query("overlay_read", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 1 THEN 'PUT' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 10 <> 0")
def overlay_read(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return mutate.overlay(c, "c_custkey", c.filter("c_custkey % 10 = 0"), c.filter("c_custkey % 10 = 1").withColumn("c_mktsegment", F.lit("PUT")))


@query("incident_edges", "SELECT 'IN_NATION' AS label, 'IN_NATION|' || s_suppkey || '|' || s_nationkey AS edge_id FROM supplier WHERE s_suppkey <= 3 UNION SELECT 'SUPPLIED_BY', 'SUPPLIED_BY|' || md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'))) || '|' || l_suppkey FROM lineitem WHERE l_suppkey <= 3")
def incident_edges(spark, sf_dir):
    """The guard of a delete: edges at nodes."""
    keys = read(spark, sf_dir, "supplier").filter("s_suppkey <= 3").select(F.col("s_suppkey").alias("k"))
    return mutate.incident(build(spark, sf_dir), "Supplier", keys)


@query("import_upsert", "SELECT c_custkey, CASE WHEN c_custkey <= 20 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def import_upsert(spark, sf_dir):
    from .sources.domains import merge_rows

    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    new = c.filter("c_custkey <= 20").select("c_custkey").unionByName(spark.createDataFrame([(-1,)], "c_custkey long")).withColumn("c_mktsegment", F.lit("NEW"))
    return merge_rows(c, new, "c_custkey")


# ---- versions, catalogs, checks -----------------------------------------------------------


def _versions(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_id").alias("revision"), "event_type", "value", (F.col("event_type") == "error").alias("gone"))


@query("latest_version", "SELECT user_id, revision, event_type, value FROM (SELECT user_id, event_id AS revision, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def latest_version(spark, sf_dir):
    return versions.latest(_versions(spark, sf_dir), ["user_id"], tombstone="gone").drop("gone")


@query("asof_revision", "SELECT user_id, revision, event_type FROM (SELECT user_id, event_id AS revision, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_id <= 500) WHERE n = 1 AND event_type <> 'error'")
def asof_revision(spark, sf_dir):
    return versions.as_of(_versions(spark, sf_dir), ["user_id"], 500, tombstone="gone").select("user_id", "revision", "event_type")


@query("journal_compact", "SELECT event_id FROM events e JOIN (SELECT user_id, max(event_id) // 2 AS fence FROM events WHERE user_id % 2 = 0 GROUP BY 1) f ON e.user_id = f.user_id WHERE event_id >= fence UNION ALL SELECT event_id FROM events WHERE user_id % 2 <> 0")
def journal_compact(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("scope"), F.col("event_id").alias("revision"))
    fences = e.filter("scope % 2 = 0").groupBy("scope").agg(F.floor(F.max("revision") / 2).alias("fence"))
    return versions.compact(e, fences).select("event_id")


@query("journal_days", "SELECT o_orderkey AS k FROM orders WHERE CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) BETWEEN 19950101 AND 19950331")
def journal_days(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("journal_day", F.date_format("o_orderdate", "yyyyMMdd").cast("int"))
    return versions.journal_days(o, "journal_day", 19950101, 19950331).select(F.col("o_orderkey").alias("k"))


@query("tag_catalog", "SELECT tag, count(*) AS n FROM (SELECT event_type AS tag FROM events UNION ALL SELECT 'user ' || user_id % 3 FROM events) GROUP BY 1")
def tag_catalog(spark, sf_dir):
    return catalogs.tag_catalog(build(spark, sf_dir).node("Event").df)


@query("property_catalog", "SELECT 'amount' AS property, count(*) FILTER (event_type <> 'error') AS n FROM events UNION ALL SELECT 'value', count(value) FROM events UNION ALL SELECT 'event_type', count(event_type) FROM events")
def property_catalog(spark, sf_dir):
    return catalogs.property_catalog(build(spark, sf_dir).node("Event").df.select("amount", "value", "event_type"))


@query("tags_any", "SELECT event_id AS id FROM events WHERE event_type IN ('view', 'click')")
def tags_any(spark, sf_dir):
    return catalogs.find_by_tags(build(spark, sf_dir).node("Event").df, ["#VIEW", "click"]).select(F.col("event_id").alias("id"))


@query("tags_all", "SELECT event_id AS id FROM events WHERE event_type = 'view' AND user_id % 3 = 2")
def tags_all(spark, sf_dir):
    return catalogs.find_by_tags(build(spark, sf_dir).node("Event").df, ["view", "User 2"], every=True).select(F.col("event_id").alias("id"))


@query("find_by_property", "SELECT event_id AS id FROM events WHERE event_type = 'view'")
def find_by_property(spark, sf_dir):
    return catalogs.find_by_property(build(spark, sf_dir).node("Event").df, "event_type", "view").select(F.col("event_id").alias("id"))


@query("activity_summary", "SELECT count(*) AS total, count(*) FILTER (event_type = 'click') AS warnings, count(*) FILTER (event_type = 'error') AS errors FROM events")
def activity_summary(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "warning").otherwise("info")
    return catalogs.activity_summary(catalogs.activity(e.withColumn("severity", kind), severities=["info", "warning", "error"]))


@query("usage_by_group", "SELECT event_type, round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY 1")
def usage_by_group(spark, sf_dir):
    return catalogs.usage(read(spark, sf_dir, "events"), ["event_type"], ["value"]).withColumn("value", F.round("value", 2))


@query("context_topn_per_key", "SELECT o_custkey AS c, o_orderkey AS o FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def context_topn_per_key(spark, sf_dir):
    return catalogs.per_key(read(spark, sf_dir, "orders"), "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")], 3).select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"))


@query("json_path", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), catalogs.json_path(F.col("props"), "k").alias("k"))


@query("for_each_explode", "SELECT vec_id, unnest(embedding) AS item FROM embeddings")
def for_each_explode(spark, sf_dir):
    return catalogs.fan_out(read(spark, sf_dir, "embeddings"), F.col("embedding")).select("vec_id", "item")


@query("workflow_ready", "SELECT 'o' || o_orderkey AS step FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus <> 'F')")
def workflow_ready(spark, sf_dir):
    li, o = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    key = F.concat_ws("/", F.lit("l"), "l_orderkey", "l_linestatus")
    needs = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("step"), key.alias("needs")).distinct()
    done = li.filter("l_linestatus = 'F'").select(key.alias("step")).distinct()
    return catalogs.ready_steps(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("step")), needs, done)


@query(
    "index_diff",
    """WITH o AS (SELECT o_orderpriority AS name, CASE WHEN max(o_totalprice) > 400000 THEN 'ordered' ELSE 'equality' END AS kind FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT' GROUP BY 1),
    n AS (SELECT o_orderpriority AS name, CASE WHEN max(o_totalprice) > 450000 THEN 'ordered' ELSE 'equality' END AS kind FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM o FULL JOIN n ON o.name = n.name WHERE o.name IS NULL OR n.name IS NULL OR o.kind <> n.kind""",
)
def index_diff(spark, sf_dir):
    """Two declared sets, read off the orders: a set's kind depends on their prices."""
    o = read(spark, sf_dir, "orders")
    kind = lambda most: F.when(F.max("o_totalprice") > most, "ordered").otherwise("equality").alias("kind")
    side = lambda rows, most: rows.groupBy(F.col("o_orderpriority").alias("name")).agg(kind(most))
    return catalogs.index_diff(side(o.filter("o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT'"), 400000), side(o.filter("o_orderstatus <> 'F' AND o_orderpriority <> '5-LOW'"), 450000))


_ORDERS_SCHEMA = """schema shop mode strict
node Orders {
  o_custkey: int
  o_orderstatus: enum F,O
  o_totalprice: float
  o_orderdate: datetime
  o_note: string
}"""


@query(
    "schema_violations",
    """SELECT 'Orders' AS type, CAST(o_orderkey AS VARCHAR) AS id, 'o_orderstatus' AS field, 'mistyped' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'Orders', CAST(o_orderkey AS VARCHAR), 'o_note', 'missing' FROM orders UNION ALL SELECT 'Orders', CAST(o_orderkey AS VARCHAR), 'o_orderpriority', 'unknown' FROM orders""",
)
def schema_violations(spark, sf_dir):
    return violations.of_fields(read(spark, sf_dir, "orders"), language.parse(_ORDERS_SCHEMA).nodes[0], "o_orderkey")


@query("endpoint_violations", "SELECT 'PLACED' AS type, CAST(o_orderkey AS VARCHAR) AS id, 'src' AS field, 'from' AS rule FROM orders WHERE o_custkey % 5 = 0")
def endpoint_violations(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    ends = read(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_custkey") % 5 == 0, "Other").otherwise("Customer").alias("label"))
    ends = ends.unionByName(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("Orders").alias("label")))
    e = o.select(F.col("o_orderkey").alias("edge_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    return violations.of_ends(e, ends, language.EdgeType("PLACED", source=["Customer"], target=["Orders"]))


@query("node_set_union", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_acctbal > 9000")
def node_set_union(spark, sf_dir):
    return Engine(build(spark, sf_dir)).rows("MATCH (c:Customer) WHERE c.c_nationkey = 3 OR c.c_acctbal > 9000 RETURN c.c_custkey AS k")


@query("node_set_intersection", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 1000")
def node_set_intersection(spark, sf_dir):
    return Engine(build(spark, sf_dir)).rows("MATCH (c:Customer) WHERE c.c_nationkey = 3 AND c.c_acctbal > 1000 RETURN c.c_custkey AS k")


@query("edge_ordered_scan", "SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_linenumber <= 3")
def edge_ordered_scan(spark, sf_dir):
    """Edges by a range of their ordered property, in order of (property, edge id). The range
    stands on the edge part's own column, so it reaches the scan."""
    (part,) = [p for p in build(spark, sf_dir).parts("contains") if p.source == "Orders"]
    e = part.df.filter(F.col(part.order) <= 3).select(F.col(part.src).alias("o"), F.col(part.order).cast("int").alias("n"), part.id_column().alias("edge_id"))
    return e.orderBy("n", "edge_id").drop("edge_id")


@query("content_ids", "SELECT doc_id, sha256(text) AS blob_id FROM documents")
def content_ids(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", V.content_id(F.col("text")).alias("blob_id"))


@query("hydrated_filter", "SELECT doc_id FROM documents WHERE contains(text, 'The') AND lang IN ('en', 'de') AND source <> 'src3'")
def hydrated_filter(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    t = lambda c, op, v: V.path_test(F.col(c), "string", op, v)
    return d.filter(t("text", "contains", "The") & t("lang", "in", ["en", "de"]) & t("source", "not_equals", "src3")).select("doc_id")


@query("export_import", "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def export_import(spark, sf_dir):
    """A domain written and read again answers as before."""
    from .sources.domains import export_domain, import_domain

    g = build(spark, sf_dir)
    path = places.new_folder(spark, "export")
    export_domain(g, path)
    return Engine(import_domain(spark, path)).rows("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.n_name AS nation, r.r_name AS region")


# ---- change stream --------------------------------------------------------------------------


def change_rows(events):
    """The events table as changes of user nodes."""
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "node.deleted").otherwise("node.update")
    s = lambda name: F.lit(None).cast("string").alias(name)
    return events.select(
        F.col("event_id").alias("revision"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("commit_id"), F.lit("space").alias("space_id"),
        F.concat(F.lit("d"), (F.col("user_id") % 4).cast("string")).alias("domain_id"), F.col("ts").alias("committed_at"), kind.alias("type"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("node_id"),
        s("edge_id"), F.array(F.initcap("event_type")).alias("labels"), F.array(F.lit("value")).alias("changed_fields"), F.array(F.concat(F.lit("u"), (F.col("user_id") + 1).cast("string"))).alias("affected_node_ids"),
        F.array().cast("array<string>").alias("affected_edge_ids"), s("origin"),
    )


def _changes(spark, sf_dir):
    return C.normalise(change_rows(read(spark, sf_dir, "events")))


@query("change_filter", "SELECT event_id AS revision FROM events WHERE user_id % 4 = 1 AND event_type NOT IN ('signup', 'error') AND event_type IN ('view', 'purchase')")
def change_filter(spark, sf_dir):
    return C.matching(_changes(spark, sf_dir), domains=["d1"], types=["updated"], labels=["View", "Purchase"], fields=["value", "x"]).select("revision")


@query("change_node_scope", "SELECT event_id AS revision FROM events WHERE user_id IN (4, 5)")
def change_node_scope(spark, sf_dir):
    return C.matching(_changes(spark, sf_dir), node_ids=["u5"]).select("revision")


@query("change_sets", "SELECT event_id AS revision, CASE WHEN event_type = 'signup' THEN ['u' || user_id] ELSE [] END AS created, ['u' || user_id, 'u' || (user_id + 1)] AS touched FROM events")
def change_sets(spark, sf_dir):
    return _changes(spark, sf_dir).select("revision", "created", F.col("affected_node_ids").alias("touched"))


@query("change_replay", "SELECT event_id AS revision, event_type <> 'error' AND event_type <> 'signup' AS updated FROM events WHERE event_id > 400")
def change_replay(spark, sf_dir):
    both = _changes(spark, sf_dir).unionByName(_changes(spark, sf_dir).filter("revision % 3 = 0"))
    return C.replay(both, 400).select("revision", (F.col("type") == "node.updated").alias("updated"))


@query("change_gap", "SELECT min(event_id) AS first_revision, min(event_id) - 1 > 100 AS gap FROM events WHERE event_id > 300")
def change_gap(spark, sf_dir):
    return C.gap(_changes(spark, sf_dir).filter("revision > 300"), 100)


@query(
    "retention",
    """WITH y AS (SELECT event_id, user_id % 4 AS d, ts, max(ts) OVER (PARTITION BY user_id % 4) AS top FROM events),
    n AS (SELECT event_id, row_number() OVER (PARTITION BY d ORDER BY event_id DESC) AS n FROM y WHERE ts >= top - INTERVAL 720 HOURS) SELECT event_id AS revision FROM n WHERE n <= 40""",
)
def retention(spark, sf_dir):
    return C.retained(_changes(spark, sf_dir), events=40, hours=720).select("revision")


@query("dirty_targets", "SELECT target, CASE WHEN max(p) = 1 THEN 'refresh' ELSE 'delete' END AS action FROM (SELECT 'u' || user_id AS target, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS p FROM events UNION ALL SELECT 'u' || (user_id + 1), 1 FROM events) GROUP BY 1")
def dirty_targets(spark, sf_dir):
    return C.dirty_targets(_changes(spark, sf_dir))


@query("rule_matches", "SELECT event_id AS revision FROM events WHERE event_type = 'error' OR event_type = 'signup'")
def rule_matches(spark, sf_dir):
    return C.rule_matches(_changes(spark, sf_dir), ["node.created", "node.deleted"], ["Signup"]).select("revision")


@query("automation_dispatch", "SELECT event_id AS revision, 'r' || r AS rule FROM events, (SELECT 1 AS r, 'purchase' AS t UNION ALL SELECT 2, 'view') WHERE event_type = t AND event_id >= 0")
def automation_dispatch(spark, sf_dir):
    rules = spark.sql("SELECT * FROM VALUES ('r1', array('Purchase'), timestamp'1970-01-01'), ('r2', array('View'), timestamp'1970-01-01'), ('r3', array('View'), timestamp'2999-01-01') AS t(rule_id, labels, bound_at)")
    return C.triggered(_changes(spark, sf_dir), rules).select("revision", F.col("rule_id").alias("rule"))


@query("invocation_ids", "SELECT sha256('r1|' || event_id) AS id FROM events")
def invocation_ids(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    return e.unionByName(e).select(C.invocation_id(F.lit("r1"), F.col("event_id")).alias("id")).dropDuplicates(["id"])


@query(
    "debounce_coalesce",
    """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM s)
    SELECT user_id, min(ts) AS burst_start, count(*) AS n, arg_max(event_id, (ts, event_id)) AS kept FROM b GROUP BY user_id, g""",
)
def debounce_coalesce(spark, sf_dir):
    return timing.debounce(read(spark, sf_dir, "events"), "user_id", "ts", "1 HOUR", "event_id").select("user_id", "burst_start", "n", "kept")


@query("schedule_buckets", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS tick, count(*) AS n FROM events GROUP BY 1")
def schedule_buckets(spark, sf_dir):
    return timing.schedule(read(spark, sf_dir, "events"), "ts", "6 hours", F.count(F.lit(1)).alias("n"))


@query("dirty_work", "SELECT user_id, max(event_id) AS revision, max(ts) + INTERVAL 10 MINUTE AS run_at FROM events WHERE event_id > 250 GROUP BY 1")
def dirty_work(spark, sf_dir):
    return timing.dirty_work(read(spark, sf_dir, "events"), "user_id", "event_id", "ts", "10 MINUTES", 250)


@query("index_lineitems", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS o FROM lineitem")
def index_lineitems(spark, sf_dir):
    return lineitems(spark, sf_dir).agg(F.countDistinct("l_id").alias("n"), F.countDistinct("l_orderkey").alias("o"))


@query(
    "explain_plan",
    """SELECT * FROM (VALUES ('access', 'equality_scan'), ('start', '{''alias'': ''c'', ''label'': ''Customer''}'), ('steps', '[{''label'': ''PLACED'', ''direction'': ''out'', ''depth'': [1, 1]}]'),
    ('distinct', 'False'), ('order', '[(''c.c_custkey'', ''asc'')]'), ('limit', '5')) AS t(part, value)""",
)
def explain_plan(spark, sf_dir):
    e = Engine(build(spark, sf_dir))
    plan = e.execute("MATCH (c:Customer {c_mktsegment: 'BUILDING'})-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 10 RETURN c.c_custkey AS k ORDER BY c.c_custkey FETCH FIRST 5 ROWS ONLY").explain
    return spark.createDataFrame([(k, str(v)) for k, v in plan.items() if k in ("access", "start", "steps", "distinct", "order", "limit")], "part string, value string")


@query("render_template", "SELECT 'User ' || user_id || ': ' || event_type || ' (' || CASE WHEN event_type = 'error' THEN 'none' ELSE 'v' END || ')' AS line FROM events")
def render_template(spark, sf_dir):
    from .operators.actions import render

    e = read(spark, sf_dir, "events").select(F.struct("user_id", "event_type").alias("changed"), F.when(F.col("event_type") != "error", "v").alias("old.mark"))
    return e.select(render("User {{changed.user_id}}: {{ changed.event_type }} ({{old.mark}})", e, "none").alias("line"))


@query("update_changed", "SELECT o_orderkey AS k FROM orders WHERE o_custkey % 4 = 0 AND o_orderstatus <> 'F'")
def update_changed(spark, sf_dir):
    from .operators.actions import update_changed as update

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return update(o, o.filter("o_custkey % 4 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus")), "o_orderkey")[1].select(F.col("o_orderkey").alias("k"))


@query("upsert_edges", "SELECT o_custkey AS src, o_orderkey AS dst, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS w FROM orders UNION ALL SELECT 0, 0, 2")
def upsert_edges(spark, sf_dir):
    from .operators.actions import upsert_edges as upsert

    o = read(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.lit("PLACED").alias("label"), F.col("o_orderkey").cast("string").alias("edge_id"), F.lit(1).alias("w"))
    want = e.filter("dst % 2 = 0").select("src", "dst", "label", F.lit(2).alias("w")).unionByName(spark.sql("SELECT 0L AS src, 0L AS dst, 'PLACED' AS label, 2 AS w"))
    return upsert(e, want).select("src", "dst", "w")
