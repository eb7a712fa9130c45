"""What services ask of the engine, over the driver's tables: context reads, shapes of answers,
replay by pages, budgets that many roots share, imports by mode, pages of searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import errors
from .driver_graph import build, read
from .engine import Engine
from .operators import actions, catalogs, hierarchy
from .queries_more import _COS, _bm25_sql, _changes, _query_vector, stored
from .registry import query
from .search import vector
from .search.lexical import LexicalIndex, fields_of
from .sources.domains import export_space, import_space, merge_rows
from .streaming import timing


@query("context_query", "SELECT 'Customer:' || c_custkey AS bound, o_orderkey AS o, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def context_query(spark, sf_dir):
    """The two dearest orders of every customer that changed."""
    changed = read(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("Customer:"), F.col("c_custkey").cast("string")).alias("node"))
    text = "MATCH (changed:Customer)-[:PLACED]->(o:Orders) RETURN o.o_orderkey AS o, o.o_totalprice AS price ORDER BY o.o_totalprice DESC, o.o_orderkey FETCH FIRST 2 ROWS ONLY"
    return actions.context_query(Engine(build(spark, sf_dir), strict_order=False), text, "changed", changed)


@query(
    "shape_check",
    """WITH t AS (SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '[' || props || ']' WHEN 2 THEN '{"k": null}' ELSE 'oops' || props END AS j FROM events)
    SELECT id, CASE WHEN NOT json_valid(j) THEN 'not JSON' WHEN json_type(j) <> 'OBJECT' THEN 'not of type object' WHEN coalesce(json_type(j, '$.k'), 'NULL') = 'NULL' THEN 'without k' END AS problem FROM t""",
)
def shape_check(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("["), "props", F.lit("]"))).when(k == 2, F.lit('{"k": null}')).otherwise(F.concat(F.lit("oops"), "props"))
    return e.select(F.col("event_id").alias("id"), catalogs.shape_problem(text, {"type": "object", "required": ["k"]}).alias("problem"))


@query("paged_replay", "SELECT event_id AS revision, CAST((row_number() OVER (ORDER BY event_id) - 1) // CAST(ceil((SELECT count(*) FROM events) / 4) AS BIGINT) AS INTEGER) AS page FROM events")
def paged_replay(spark, sf_dir):
    """All changes after an empty snapshot, in four pages, each applied once."""
    changes, found = _changes(spark, sf_dir).select("revision"), []
    size = -(-changes.count() // 4)
    timing.paged_replay(timing.pages_of(changes, "d"), "d", -1, size, lambda p: found.append(p.rows.withColumn("page", F.lit(len(found)))))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("consumers_work", "SELECT consumer, user_id, max(event_id) AS revision, max_by(ts, event_id) + INTERVAL 10 MINUTE AS run_at FROM events, (VALUES ('embedder', 100), ('indexer', 400)) AS c(consumer, seen) GROUP BY 1, 2, seen HAVING max(event_id) > seen")
def consumers_work(spark, sf_dir):
    """Users with changes that a consumer hasn't seen, each consumer from its own checkpoint."""
    seen = timing.advanced({"embedder": 100, "indexer": 250}, {"indexer": 400, "embedder": 50})
    return timing.consumers_work(read(spark, sf_dir, "events"), "user_id", "event_id", "ts", "10 MINUTES", seen)


@query("subtree_budgets", "SELECT * FROM (VALUES ('edges', 'resource_exhausted'), ('none', NULL), ('nodes', 'resource_exhausted')) AS t(budget, code)")
def subtree_budgets(spark, sf_dir):
    """All regions' trees under budgets of what they hold together, and of one less."""
    e = hierarchy.edge_frame(build(spark, sf_dir), "contains", [("Region", "Nation"), ("Nation", "Customer")])
    roots = read(spark, sf_dir, "region").select(F.concat(F.lit("Region:"), F.col("r_regionkey").cast("string")).alias("root"))
    n, m = hierarchy.subtree(roots, e).count(), e.count()
    found = []
    for what, most in (("none", {"max_nodes": n, "max_edges": m}), ("nodes", {"max_nodes": n - 1}), ("edges", {"max_edges": m - 1})):
        try:
            hierarchy.subtree(roots, e, **most)
            found.append((what, None))
        except errors.QueryError as x:
            found.append((what, x.code))
    return spark.createDataFrame(found, "budget string, code string")


@query("masked_update", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 4 THEN 'MASKED' ELSE n_name END AS name, CASE WHEN n_nationkey <> 4 THEN 'said' END AS comment, n_regionkey AS region FROM nation")
def masked_update(spark, sf_dir):
    """A mask of two fields: one is written, one cleared; a third is given and ignored."""
    from .plans.compiler import Compiler

    g = build(spark, sf_dir)
    n = read(spark, sf_dir, "nation").withColumn("said", F.lit("said"))
    g.add_node("Nation", n, "n_nationkey")
    op = {"op": "update_node", "label": "Nation", "match": {"n_nationkey": 4}, "fields": {"n_name": "MASKED", "n_regionkey": 99}, "mask": ["n_name", "said"]}
    return Engine(actions.batch(g, [op], Compiler)).rows("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name, n.said AS comment, n.n_regionkey AS region")


@query("import_modes", "SELECT * FROM (SELECT 'replace' AS mode, count(*) AS created, 0 AS updated FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'create', 0, count(*) FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'upsert', 1, count(*) FROM customer WHERE c_nationkey = 3)")
def import_modes(spark, sf_dir):
    """What each mode of an import does: rows that replace all others, a create that meets
    keys that are there, an upsert of one new row and of others that are there."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    some = read(spark, sf_dir, "customer").filter("c_nationkey = 3").select("c_custkey", F.lit("NEW").alias("c_mktsegment"))
    replaced = merge_rows(c, some, "c_custkey", "replace").count()
    created = merge_rows(c, some, "c_custkey", "create", dry_run=True)
    upserted = merge_rows(c, some.unionByName(spark.createDataFrame([(-1, "NEW")], "c_custkey long, c_mktsegment string")), "c_custkey", "upsert", dry_run=True)
    rows = [("replace", replaced, 0), ("create", created["created"] - created["conflicts"], created["conflicts"]), ("upsert", upserted["created"], upserted["updated"])]
    return spark.createDataFrame(rows, "mode string, created long, updated long")


@query("space_round_trip", "SELECT 'all' AS domain, count(*) AS nations FROM nation UNION ALL SELECT 'first', count(*) FROM nation WHERE n_regionkey = 0")
def space_round_trip(spark, sf_dir):
    """Two domains of a space, written and read back."""
    from . import places
    from .catalog import Graph

    n = read(spark, sf_dir, "nation")
    graphs = {"all": Graph().add_node("Nation", n, "n_nationkey"), "first": Graph().add_node("Nation", n.filter("n_regionkey = 0"), "n_nationkey")}
    path = places.new_folder(spark, "space")
    export_space(graphs, path)
    return spark.createDataFrame([(name, Engine(g).rows("MATCH (n:Nation) RETURN n.n_name AS name").count()) for name, g in import_space(spark, path).items()], "domain string, nations long")


@query(
    "current_bindings",
    f"""WITH s AS (SELECT vec_id, label, {_COS} AS c FROM embeddings QUALIFY row_number() OVER (PARTITION BY label % 2 ORDER BY c DESC, vec_id) <= 20)
    SELECT vec_id, CAST(row_number() OVER (ORDER BY c DESC, vec_id) AS INTEGER) AS rank FROM s WHERE label <> 2 ORDER BY c DESC, vec_id LIMIT 10""",
)
def current_bindings(spark, sf_dir):
    """Two bindings' hits; those whose vectors are of an older generation are dropped."""
    e, q = read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)
    hits = []
    for b, of in (("even", 0), ("odd", 1)):
        top = vector.top_k(e.filter(F.col("label") % 2 == of), q, 20).join(e.select("vec_id", "label"), "vec_id")
        top = top.select("vec_id", "score", F.lit(b).alias("binding"), F.when(F.col("label") == 2, 1).otherwise(2).alias("generation"), F.lit("c").alias("configuration"))
        hits.append(vector.current(top, {"even": (2, "c"), "odd": (2, "c")})[0].select("vec_id", "score", "binding"))
    return vector.merge_bindings(hits).select("vec_id", "rank")


@query("semantic_pages", f"SELECT vec_id, CAST(row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS INTEGER) AS rank FROM embeddings ORDER BY rank LIMIT 25")
def semantic_pages(spark, sf_dir):
    """25 candidates by pages of 10, by the token of the page before."""
    hits, rows, token = vector.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 25), [], None
    while True:
        some, token = vector.hits_page(hits, 10, token)
        rows += [(r["vec_id"], r["rank"]) for r in some]
        if token is None:
            return spark.createDataFrame(rows, "vec_id long, rank int")


_FOUND = _bm25_sql(["scum", "trash"], "t0 IS NOT NULL OR t1 IS NOT NULL")


@query("lexical_tokens", f"SELECT doc, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank, (SELECT count(*) FROM ({_FOUND})) AS candidates FROM ({_FOUND}) ORDER BY rank LIMIT 40")
def lexical_tokens(spark, sf_dir):
    """Two pages of 20, the second by the token of the first, with how many candidates there were."""
    index = stored(spark, sf_dir)
    first, seen, token = index.paged("scum OR trash")
    rows = first
    if token is not None:
        rows = rows.unionByName(index.paged("scum OR trash", token=token)[0])
    return rows.select("doc", "rank", F.lit(seen["candidates"]).cast("long").alias("candidates"))


@query("matched_fields", "SELECT doc_id AS doc, CASE WHEN lang = 'en' AND source = 'web' THEN [0, 1] WHEN lang = 'en' THEN [0] ELSE [1] END AS matched_fields FROM documents WHERE lang = 'en' OR source = 'web'")
def matched_fields(spark, sf_dir):
    """The fields (lang, source) in which each match has its terms."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    index = LexicalIndex.build(d.withColumn("fields", fields_of(d, ["doc_id"])), "doc_id", fields="fields")
    return index.matched_fields(index.search("en OR web")).select("doc", "matched_fields")


@query("search_snapshot", f"SELECT doc FROM ({_bm25_sql(['scum'], 't0 IS NOT NULL')}) ORDER BY score DESC, doc LIMIT 20")
def search_snapshot(spark, sf_dir):
    """A search that first makes sure that its index is as new as the table."""
    index = stored(spark, sf_dir)
    return index.answer("scum", index.revision).select("doc")


@query("service_errors", "SELECT * FROM (VALUES ('context without a limit', 'resource_exhausted'), ('context that writes', 'unsupported'), ('context without a label', 'unsupported'), ('context without the alias', 'unknown_binding'), ('gap in the pages', 'conflict'), ('other scope', 'conflict'), ('other ranking', 'stale_cursor'), ('create what is there', 'conflict')) AS t(what, code)")
def service_errors(spark, sf_dir):
    """Wrong calls of services and the kind of their errors."""
    e = Engine(build(spark, sf_dir))
    n = read(spark, sf_dir, "nation")
    node = spark.createDataFrame([("Nation:1",)], "node string")
    ask = lambda text: lambda: actions.context_query(e, text, "changed", node)
    c = _changes(spark, sf_dir).select("revision")
    hits = vector.top_k(read(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 25)
    calls = {
        "context without a limit": ask("MATCH (changed:Nation) RETURN changed.n_name AS n"),
        "context that writes": ask("MATCH (changed:Nation) SET changed.n_name = 'x' RETURN changed.n_name AS n"),
        "context without a label": ask("MATCH (changed:Nation)-[]->(r:Region) RETURN r.r_name AS n FETCH FIRST 3 ROWS ONLY"),
        "context without the alias": ask("MATCH (n:Nation) RETURN n.n_name AS n FETCH FIRST 3 ROWS ONLY"),
        "gap in the pages": lambda: timing.paged_replay(timing.pages_of(c, "d", compacted=50), "d", 10, 100, lambda p: None),
        "other scope": lambda: timing.paged_replay(timing.pages_of(c, "d"), "e", 10, 100, lambda p: None),
        "other ranking": lambda: vector.hits_page(hits.filter("rank > 1"), 10, vector.hits_page(hits, 10)[1]),
        "create what is there": lambda: merge_rows(n, n.limit(1), "n_nationkey", "create"),
    }
    found = []
    for what, call in calls.items():
        try:
            call()
        except errors.QueryError as x:
            found.append((what, x.code))
    return spark.createDataFrame(found, "what string, code string")
