"""More of the language over the driver's graph: whole results, parameters, values as text,
mutations' own rows, trees, pages, errors and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import errors
from .builder import Pattern, field, today
from .catalog import Graph
from .driver_graph import build, read
from .engine import Engine
from .functions import values as V
from .queries_more import _bm25_sql, stored
from .registry import query
from .search import hybrid, vector
from .search.lexical import LexicalIndex, fields_of, page, ranked
from .streaming import changes as C
from .streaming import timing


def _engine(spark, sf_dir, **options) -> Engine:
    return Engine(build(spark, sf_dir), **options)


@query("node_scan", "SELECT 'Region:' || r_regionkey AS id FROM region UNION ALL SELECT 'Nation:' || n_nationkey FROM nation UNION ALL SELECT 'Supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'Part:' || p_partkey FROM part")
def node_scan(spark, sf_dir):
    """A pattern without a label scans the nodes of every label that the graph has."""
    g = build(spark, sf_dir)
    some = Graph({k: g.nodes[k] for k in ("Region", "Nation", "Supplier", "Part")})
    return Engine(some).rows("MATCH (n) RETURN n.node_id AS id")


@query("whole_node", "SELECT 'Nation:' || n_nationkey AS node_id, n_nationkey, n_name, n_regionkey FROM nation")
def whole_node(spark, sf_dir):
    return _engine(spark, sf_dir).rows("MATCH (n:Nation) RETURN n").select("n.node_id", "n.n_nationkey", "n.n_name", "n.n_regionkey")


@query("return_edge", "SELECT 'contains' AS label, 'Orders:' || l_orderkey AS from_node_id, l_linenumber, l_quantity, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_totalprice > 200000")
def return_edge(spark, sf_dir):
    """A whole edge: its ids, label and properties."""
    rows = _engine(spark, sf_dir).rows("MATCH (o:Orders)-[e:contains]->(l:LineItem) WHERE o.o_totalprice > 200000 RETURN e")
    return rows.select("e.label", "e.from_node_id", "e.l_linenumber", "e.l_quantity", "e.l_returnflag")


@query("output_names", 'SELECT c_mktsegment AS "c.c_mktsegment", count(*) AS "count", max(c_name) AS "max" FROM customer GROUP BY 1')
def output_names(spark, sf_dir):
    return _engine(spark, sf_dir).rows("MATCH (c:Customer) RETURN c.c_mktsegment, COUNT(*), MAX(c.c_name)")


@query("all_pages", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey <> 2")
def all_pages(spark, sf_dir):
    """Page after page, each by the token of the one before."""
    e, rows, token = _engine(spark, sf_dir), [], None
    while True:
        some, token = e.page("MATCH (n:Nation) WHERE n.n_regionkey <> 2 RETURN n.n_nationkey AS k, n.n_name AS name ORDER BY n.n_name", 6, token)
        rows += some
        if token is None:
            return spark.createDataFrame(rows)


@query("exists_pred", "SELECT event_id AS id FROM events WHERE event_type <> 'error'")
def exists_pred(spark, sf_dir):
    return _engine(spark, sf_dir).rows(Pattern().node("e", "Event").where(field("e.amount").exists()).returns(id="e.event_id"))


@query("list_compare", "SELECT event_id AS id FROM events WHERE event_type = 'view' AND user_id % 3 = 1")
def list_compare(spark, sf_dir):
    """A list field against a list, by their canonical JSON."""
    return _engine(spark, sf_dir).rows(Pattern().node("e", "Event").where(field("e.tags") == ["#view", " User 1"]).returns(id="e.event_id"))


@query("param_filter", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000.5 AND o_orderstatus = 'O'")
def param_filter(spark, sf_dir):
    e = _engine(spark, sf_dir)
    return e.rows("MATCH (o:Orders {o_orderstatus: $s}) WHERE o.o_totalprice > $p RETURN o.o_orderkey AS k", {"s": "O", "p": 150000.5})


@query("today_filter", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < current_date - INTERVAL 9000 DAY")
def today_filter(spark, sf_dir):
    return _engine(spark, sf_dir).rows(Pattern().node("o", "Orders").where(field("o.o_orderdate") < today(-9000)).returns(k="o.o_orderkey"))


@query(
    "float_text",
    """SELECT o_orderkey AS k, 'million' AS kind FROM orders WHERE o_totalprice * 10 >= 1e6 AND o_totalprice * 10 < 1e7
    UNION ALL SELECT o_orderkey, 'huge' FROM orders WHERE o_totalprice * 1e20 >= 1e25 AND o_totalprice * 1e20 < 1e26
    UNION ALL SELECT o_orderkey, 'tiny' FROM orders WHERE o_totalprice * 1e-12 >= 1e-07 AND o_totalprice * 1e-12 < 1e-06
    UNION ALL SELECT o_orderkey, 'plain' FROM orders WHERE o_totalprice < 1e6 AND floor(o_totalprice) % 100 = 7""",
)
def float_text(spark, sf_dir):
    """Floats as text: exponents from 1e+06 on and below 1e-4, at least two digits of them."""
    o = read(spark, sf_dir, "orders")
    o = o.withColumns({"ten": F.col("o_totalprice") * 10, "huge": F.col("o_totalprice") * 1e20, "tiny": F.col("o_totalprice") * 1e-12, "plain": F.when(F.col("o_totalprice") < 1e6, F.floor("o_totalprice").cast("double"))})
    e = Engine(Graph().add_node("Orders", o, "o_orderkey"))
    find = lambda kind, where: e.rows(f"MATCH (o:Orders) WHERE {where} RETURN o.o_orderkey AS k").withColumn("kind", F.lit(kind))
    rows = find("million", "o.ten ENDS WITH 'e+06'").unionByName(find("huge", "o.huge ENDS WITH 'e+25'")).unionByName(find("tiny", "o.tiny ENDS WITH 'e-07'"))
    return rows.unionByName(find("plain", "o.plain ENDS WITH '07'"))


@query("uuid_check", "SELECT event_id AS id, event_id % 3 = 0 AS good FROM events")
def uuid_check(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    cut = lambda a, n: F.substring(h, a, n)
    whole = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    text = F.when(F.col("event_id") % 3 == 0, F.upper(whole)).when(F.col("event_id") % 3 == 1, h).otherwise(F.concat(whole, F.lit("0")))
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), V.is_uuid(text).alias("good"))


_FIELD_TOKENS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{Nd}}]+')"


@query(
    "document_build",
    f"""WITH f AS (SELECT doc_id, 0 AS n, {_FIELD_TOKENS.format('lang')} AS w FROM documents UNION ALL SELECT doc_id, 1, {_FIELD_TOKENS.format('source')} FROM documents)
    SELECT doc_id AS doc, term, count(*) AS tf, list_sort(list(CAST(p AS INTEGER))) AS positions FROM (SELECT doc_id, unnest(w) AS term, CASE WHEN n = 0 THEN 0 ELSE (SELECT len(g.w) + 100 FROM f g WHERE g.doc_id = f.doc_id AND g.n = 0) END + generate_subscripts(w, 1) - 1 AS p FROM f) GROUP BY 1, 2""",
)
def document_build(spark, sf_dir):
    """A document of two fields: positions of the second begin past a gap after the first."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    d = d.withColumn("fields", fields_of(d, ["doc_id"]))
    return LexicalIndex.build(d, "doc_id", fields="fields").postings.select("doc", "term", "tf", "positions")


_LEXICAL = _bm25_sql(["scum", "trash"], "t0 IS NOT NULL OR t1 IS NOT NULL")


@query("hybrid_degraded", f"SELECT doc AS node, CAST(row_number() OVER (ORDER BY score DESC, doc) AS INTEGER) AS rank, 1 AS warnings FROM ({_LEXICAL}) ORDER BY score DESC, doc LIMIT 10")
def hybrid_degraded(spark, sf_dir):
    """Without a semantic side the lexical one answers, with a warning."""
    side = ranked(page(stored(spark, sf_dir).search("scum OR trash").withColumn("score", F.round("score", 6)), size=50), [F.desc("score"), F.col("doc")])
    rows, warnings = hybrid.search(side.select(F.col("doc").alias("node"), F.col("rank").cast("long")), None, page=10)
    return rows.select("node", F.col("rank").cast("int"), F.lit(len(warnings)).alias("warnings"))


@query("script_keeps_snapshot", "SELECT n_name AS name FROM nation UNION ALL SELECT 'FIRST'")
def script_keeps_snapshot(spark, sf_dir):
    """Of three statements the second fails: it changes nothing, the others stand."""
    e = _engine(spark, sf_dir)
    e.script("INSERT (:Nation {n_nationkey: 70, n_name: 'FIRST'}); MATCH (n:Nation {n_nationkey: 1}) DELETE n RETURN n.n_name; MATCH (n:Nation {n_nationkey: 70}) RETURN n.n_name", stop_on_error=False)
    return e.rows("MATCH (n:Nation) RETURN n.n_name AS name")


@query("graph_api_batch", "SELECT n_nationkey AS k, CASE WHEN n_nationkey = 4 THEN 'RENAMED' ELSE n_name END AS name FROM nation UNION ALL SELECT 71, 'PUT' UNION ALL SELECT 72, 'MADE'")
def graph_api_batch(spark, sf_dir):
    from .operators.actions import batch
    from .plans.compiler import Compiler

    ops = [
        {"op": "create_node", "label": "Nation", "fields": {"n_nationkey": 72, "n_name": "MADE"}},
        {"op": "upsert_node", "label": "Nation", "match": {"n_nationkey": 71}, "fields": {"n_name": "PUT"}},
        {"op": "update_node", "label": "Nation", "match": {"n_nationkey": 4}, "fields": {"n_name": "RENAMED"}},
    ]
    return Engine(batch(build(spark, sf_dir), ops, Compiler)).rows("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")


@query("embedding_targets", "SELECT vec_id FROM embeddings WHERE label IN (1, 4)")
def embedding_targets(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").withColumn("labels", F.array(F.concat(F.lit("L"), F.col("label").cast("string"))))
    return vector.select_targets(e, ["L1", "L4"], key="vec_id").select("vec_id")


@query("change_projection", "SELECT event_id AS revision, CASE WHEN event_type = 'signup' THEN 'node.created' WHEN event_type = 'error' THEN 'node.deleted' ELSE 'node.updated' END AS type, 'u' || user_id AS node_id, 'd' || (user_id % 4) AS domain_id FROM events")
def change_projection(spark, sf_dir):
    from .queries_more import _changes

    return C.projected(_changes(spark, sf_dir), revision=True).select("revision", "type", "node_id", "domain_id")


@query("observed_rows", "SELECT count(*) AS rows FROM orders WHERE o_orderstatus = 'F'")
def observed_rows(spark, sf_dir):
    """Diagnostics: rows counted while they are read."""
    rows, seen = _engine(spark, sf_dir).observed("MATCH (o:Orders {o_orderstatus: 'F'}) RETURN o.o_orderkey AS k")
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["rows"],)], "rows long")


_WRONG = {
    "MATCH (a:Nowhere) RETURN a": "unknown_binding",
    "MATCH (a:Nation RETURN a": "invalid_query",
    "MATCH (a:Nation)-[]->(b:Region) RETURN a": "unavailable_access_path",
    "MATCH (a:Nation) RETURN SUM(a.n_name) AS x": "unknown_binding",
    "MATCH (a:Nation) RETURN a.n_name AS x, a.n_regionkey AS x": "unknown_binding",
    "MATCH (a:Nation {n_nationkey: 1}) DELETE a RETURN a.n_name": "conflict",
    "MATCH (a:Nation) SET a.n_nationkey = 5 RETURN a.n_name": "unsupported",
    "MATCH (a:Customer), (b:Customer) CREATE (a)-[:MET]->(b)": "resource_exhausted",
    "MATCH (a:Customer) RETURN a.c_custkey": "resource_exhausted",
}


@query("typed_errors", "SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in _WRONG.items()) + ") AS t(statement, code)")
def typed_errors(spark, sf_dir):
    """Each wrong statement and the kind of its error, budgets of rows and pairs included."""
    found = []
    for statement in _WRONG:
        try:
            _engine(spark, sf_dir, row_budget=20, pair_budget=20).execute(statement)
        except errors.QueryError as e:
            found.append((statement, e.code))
    return spark.createDataFrame(found, "statement string, code string")


@query("retry_backoff", "SELECT DISTINCT event_id % 12 + 1 AS attempt, CAST(least(pow(2, event_id % 12), 300) AS BIGINT) AS seconds FROM events")
def retry_backoff(spark, sf_dir):
    tries = read(spark, sf_dir, "events").select((F.col("event_id") % 12 + 1).alias("attempt")).distinct()
    waits = spark.createDataFrame([(n, int(timing.backoff(n))) for n in range(1, 13)], "attempt long, seconds long")
    return tries.join(waits, "attempt")


@query("set_returns_matched", "SELECT c_custkey AS c, o_orderkey AS o, 'BIG' AS seg, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 150000")
def set_returns_matched(spark, sf_dir):
    """SET returns the rows that matched, with what it wrote."""
    return _engine(spark, sf_dir).rows("MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 150000 SET c.c_mktsegment = 'BIG' RETURN c.c_custkey AS c, o.o_orderkey AS o, c.c_mktsegment AS seg, o.o_totalprice AS price")


@query("set_edge", "SELECT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_quantity > 40 AND o_orderstatus = 'F' THEN 0.5 ELSE l_discount END AS discount, CASE WHEN l_quantity > 40 AND o_orderstatus = 'F' THEN 'bulk' END AS mark FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def set_edge(spark, sf_dir):
    e = _engine(spark, sf_dir)
    e.execute("MATCH (o:Orders {o_orderstatus: 'F'})-[x:contains]->(l:LineItem) WHERE x.l_quantity > 40 SET x.l_discount = 0.5, x.mark = 'bulk' RETURN x.l_linenumber AS n")
    return e.rows("MATCH (o:Orders)-[x:contains]->(l:LineItem) RETURN o.o_orderkey AS o, x.l_linenumber AS n, x.l_discount AS discount, x.mark AS mark")


@query("collect_filtered", "SELECT c_custkey AS c, coalesce(list_sort(list('Orders:' || o_orderkey) FILTER (o_totalprice > 150000)), []) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1")
def collect_filtered(spark, sf_dir):
    """One row a root; only targets that pass their filter are gathered."""
    p = Pattern().node("c", "Customer").out("PLACED").node("o", "Orders").where(field("c.c_acctbal") > 0, field("o.o_totalprice") > 150000)
    return _engine(spark, sf_dir).rows(p.per_root().returns(c="c.c_custkey"))


@query(
    "ordered_root_trees",
    """WITH top AS (SELECT r_regionkey, CAST(row_number() OVER (ORDER BY r_name DESC) AS INTEGER) AS root FROM region QUALIFY root <= 3)
    SELECT root, 0 AS depth, 'Region:' || r_regionkey AS node, CAST(NULL AS VARCHAR) AS parent FROM top
    UNION ALL SELECT root, 1, 'Nation:' || n_nationkey, 'Region:' || n_regionkey FROM top JOIN nation ON n_regionkey = r_regionkey
    UNION ALL SELECT root, 2, 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM top JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey""",
)
def ordered_root_trees(spark, sf_dir):
    """RETURN GRAPH in an order: the first three regions by name, each with its tree."""
    out = _engine(spark, sf_dir).execute("MATCH (r:Region)-[:contains*0..2]->(n) RETURN GRAPH r, n ORDER BY r.r_name DESC FETCH FIRST 3 ROWS ONLY").rows
    rows = out.select(F.row_number().over(_by_name()).alias("root"), "graph").select("root", F.explode("graph").alias("m"))
    return rows.select("root", "m.depth", "m.node", "m.parent")


def _by_name():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("r.r_name"))  # a page of roots


@query("result_graph_edges", "SELECT DISTINCT 'IN_REGION|' || n_nationkey || '|' || n_regionkey AS edge_id FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION SELECT DISTINCT 'IN_NATION|' || s_suppkey || '|' || s_nationkey FROM supplier")
def result_graph_edges(spark, sf_dir):
    return _engine(spark, sf_dir).execute("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN GRAPH r.r_name AS r").edges


@query("condition_pattern", """WITH t AS (SELECT concat_ws('/', conv_id, turn) AS id, conv_id, turn, role FROM conversations),
    e AS (SELECT a.id AS s, b.id AS d FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1), w AS (SELECT s AS n FROM e UNION ALL SELECT d FROM e)
    SELECT id AS node, (SELECT count(*) FROM w WHERE n = id) >= 2 AS holds FROM t WHERE role = 'user'""")
def condition_pattern(spark, sf_dir):
    """A rule's condition: at least two undirected neighbours of each node that changed."""
    from .operators import conditions

    t = read(spark, sf_dir, "conversations")
    e = build(spark, sf_dir).parts("NEXT")[0].df.select("src", "dst", F.concat_ws("|", "src", "dst").alias("edge_id"), F.lit("NEXT").alias("label"))
    bound = t.filter("role = 'user'").select(F.concat_ws("/", "conv_id", "turn").alias("node"))
    return conditions.holds(bound, conditions.pattern(e, "both", "NEXT", bound), "count", ">=", 2)


@query("condition_aggregate", "SELECT c_custkey AS node, coalesce(sum(o_totalprice), 0) > 500000 AS holds FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def condition_aggregate(spark, sf_dir):
    from .operators import conditions

    o = read(spark, sf_dir, "orders")
    e = o.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"), F.col("o_orderkey").alias("edge_id"), F.lit("PLACED").alias("label"), "o_totalprice")
    bound = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    return conditions.holds(bound, conditions.pattern(e, "out", "PLACED", bound), "sum", ">", 500000, F.col("o_totalprice"))


@query("heartbeats", """WITH s AS (SELECT date_trunc('second', min(ts)) AS lo, max(ts) AS hi FROM events), b AS (SELECT DISTINCT CAST(floor((epoch_us(ts) - epoch_us(lo)) / 1e6 / 60) AS BIGINT) AS n FROM events, s),
    k AS (SELECT lo + n * INTERVAL 60 SECOND AS tick, n - 1 AS n FROM s, range(1, (SELECT CAST(greatest(floor((epoch_us(hi) - epoch_us(lo)) / 1e6 / 60), 1) AS BIGINT) FROM s) + 1) AS r(n))
    SELECT tick FROM k WHERE n NOT IN (SELECT n FROM b)""")
def heartbeats(spark, sf_dir):
    """Beats of a watch over the events, one for every quiet minute."""
    from .streaming.delivery import heartbeats as beats

    return beats(read(spark, sf_dir, "events"), "ts", 60)


@query("vector_index_topk", f"SELECT vec_id AS node, round(c, 6) AS score FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS c FROM embeddings WHERE label = 2) ORDER BY c DESC, vec_id LIMIT 15")
def vector_index_topk(spark, sf_dir):
    """A search of one rule's part of a stored vector index."""
    from . import places

    e = read(spark, sf_dir, "embeddings")
    index = vector.VectorIndex(spark, places.new_folder(spark, "vectors"))
    for n in (1, 2):
        index.write(e.filter(F.col("label") == n), f"label{n}", "vec_id", "embedding")
    q = [float(x) for x in e.filter("vec_id = 0").first()["embedding"]]
    return index.search("label2", q, 15).select("node", F.round("score", 6).alias("score"))


@query("date_truncation", "SELECT event_id AS id, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS hour FROM events")
def date_truncation(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), V.truncated(F.col("ts"), "month").alias("month"), V.truncated(F.col("ts"), "hour").alias("hour"))


@query("blob_round_trip", "SELECT DISTINCT sha256(text) AS blob_id, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL")
def blob_round_trip(spark, sf_dir):
    """Texts stored by content, twice, and read back: each is there once."""
    from . import places
    from .sources.domains import get_blobs, put_blobs

    path, d = places.new_folder(spark, "blobs"), read(spark, sf_dir, "documents")
    put_blobs(d.filter("doc_id % 2 = 0"), path, "text")
    ids = put_blobs(d, path, "text")
    return get_blobs(spark, path, ids).select("blob_id", F.octet_length("content").cast("long").alias("length"))


@query("transaction_merge", "SELECT n_nationkey AS k, CASE n_nationkey WHEN 1 THEN 'MINE' WHEN 2 THEN 'THEIRS' ELSE n_name END AS name FROM nation")
def transaction_merge(spark, sf_dir):
    """Two writers of different nodes both stand; a third, of a node written since, is refused."""
    e = _engine(spark, sf_dir)
    mine, late = e.transaction(), e.transaction()
    mine.execute("MATCH (n:Nation {n_nationkey: 1}) SET n.n_name = 'MINE' RETURN n.n_name")
    late.execute("MATCH (n:Nation {n_nationkey: 2}) SET n.n_name = 'LATE' RETURN n.n_name")
    e.execute("MATCH (n:Nation {n_nationkey: 2}) SET n.n_name = 'THEIRS' RETURN n.n_name")
    mine.commit()
    try:
        late.commit()
    except errors.Conflict:
        return e.rows("MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name")
    raise AssertionError("the late writer was not refused")
