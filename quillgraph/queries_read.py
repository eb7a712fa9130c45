"""Reads in the text language over the driver's graph, with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from .builder import Pattern, any_of, field
from .driver_graph import build
from .engine import Engine
from .registry import query

_TEXT = {
    # name: (statement, SQL)
    "label_scan": ("MATCH (n:Nation) RETURN n.n_name AS name", "SELECT n_name AS name FROM nation"),
    "eq_filter": ("MATCH (o:Orders {o_orderstatus: 'F'}) RETURN o.o_orderkey AS k, o.o_totalprice AS price", "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'"),
    "range_filter": ("MATCH (o:Orders) WHERE o.o_totalprice >= 100000.5 AND o.o_totalprice < 300000 RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice >= 100000.5 AND o_totalprice < 300000"),
    "between_filter": ("MATCH (p:Part) WHERE p.p_size BETWEEN 5 AND 9 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size BETWEEN 5 AND 9"),
    "date_filter": ("MATCH (o:Orders) WHERE o.o_orderdate >= '1996-01-01' RETURN o.o_orderkey AS k", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate >= DATE '1996-01-01'"),
    "neq_missing": ("MATCH (e:Event) WHERE e.amount <> 5 RETURN e.event_id AS id", "SELECT event_id AS id FROM events WHERE event_type <> 'error' AND value <> 5"),
    "mixed_type_compare": ("MATCH (p:Part) WHERE p.p_size = '7' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE CAST(p_size AS VARCHAR) = '7'"),
    "fraction_compare": ("MATCH (p:Part) WHERE p.p_size > 6.5 RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE p_size > 6.5"),
    "null_pred": ("MATCH (e:Event) WHERE e.amount IS NULL RETURN e.event_id AS id", "SELECT event_id AS id FROM events WHERE event_type = 'error'"),
    "not_null_pred": ("MATCH (e:Event) WHERE e.amount IS NOT NULL RETURN e.event_id AS id", "SELECT event_id AS id FROM events WHERE event_type <> 'error'"),
    "string_contains": ("MATCH (p:Part) WHERE p.p_type CONTAINS 'a' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE contains(lower(p_type), 'a')"),
    "string_starts": ("MATCH (c:Customer) WHERE c.c_mktsegment STARTS WITH 'bu' RETURN c.c_custkey AS k", "SELECT c_custkey AS k FROM customer WHERE starts_with(lower(c_mktsegment), 'bu')"),
    "string_ends": ("MATCH (p:Part) WHERE p.p_brand ENDS WITH '3' RETURN p.p_partkey AS k", "SELECT p_partkey AS k FROM part WHERE ends_with(lower(p_brand), '3')"),
    "contains_missing": ("MATCH (e:Event) WHERE e.amount CONTAINS 'nil' RETURN e.event_id AS id", "SELECT event_id AS id FROM events WHERE event_type = 'error'"),
    "text_contains": ("MATCH (d:Document) WHERE TEXT_CONTAINS(d.text, 'The ') RETURN d.doc_id AS id", "SELECT doc_id AS id FROM documents WHERE contains(lower(text), 'the ')"),
    "or_tree": (
        "MATCH (o:Orders) WHERE (o.o_orderstatus = 'F' OR o.o_totalprice > 200000) AND (o.o_orderpriority STARTS WITH '1' OR o.o_orderpriority STARTS WITH '2') RETURN o.o_orderkey AS k",
        "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000) AND (starts_with(o_orderpriority, '1') OR starts_with(o_orderpriority, '2'))",
    ),
    "distinct_rows": ("MATCH (o:Orders) RETURN DISTINCT o.o_orderstatus AS s, o.o_orderpriority AS p", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "distinct_then_order": (
        "MATCH (c:Customer) RETURN DISTINCT c.c_mktsegment AS seg ORDER BY c.c_acctbal DESC FETCH FIRST 3 ROWS ONLY",
        "SELECT c_mktsegment AS seg FROM (SELECT c_mktsegment, arg_min(c_acctbal, c_custkey) AS b FROM customer GROUP BY 1) ORDER BY b DESC LIMIT 3",
    ),
    "topn": ("MATCH (o:Orders) RETURN o.o_orderkey AS k, o.o_totalprice AS p ORDER BY o.o_totalprice DESC FETCH FIRST 20 ROWS ONLY", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "order_offset_fetch": (
        "MATCH (c:Customer) RETURN c.c_custkey AS k ORDER BY c.c_mktsegment ASC, c.c_acctbal DESC OFFSET 10 ROWS FETCH FIRST 15 ROWS ONLY",
        "SELECT c_custkey AS k FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS FIRST, c_custkey LIMIT 15 OFFSET 10",
    ),
    "order_nulls": ("MATCH (e:Event) RETURN e.event_id AS id ORDER BY e.amount DESC FETCH FIRST 50 ROWS ONLY", "SELECT event_id AS id FROM events ORDER BY CASE WHEN event_type <> 'error' THEN value END DESC NULLS FIRST, event_id LIMIT 50"),
    "agg_global": (
        "MATCH (o:Orders) RETURN COUNT(*) AS n, SUM(o.o_totalprice) AS total, AVG(o.o_totalprice) AS mean, MIN(o.o_totalprice) AS low, MAX(o.o_totalprice) AS high",
        "SELECT count(*) AS n, sum(o_totalprice) AS total, avg(o_totalprice) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders",
    ),
    "agg_empty": (
        "MATCH (o:Orders) WHERE o.o_totalprice < 0 RETURN COUNT(*) AS n, SUM(o.o_totalprice) AS total, AVG(o.o_totalprice) AS mean",
        "SELECT count(*) AS n, coalesce(sum(o_totalprice), 0.0) AS total, avg(o_totalprice) AS mean FROM orders WHERE o_totalprice < 0",
    ),
    "agg_group": (
        "MATCH (e:Event) RETURN e.event_type AS kind, COUNT(*) AS n, COUNT(e.amount) AS present, SUM(e.amount) AS total",
        "SELECT event_type AS kind, count(*) AS n, count(CASE WHEN event_type <> 'error' THEN value END) AS present, coalesce(sum(CASE WHEN event_type <> 'error' THEN value END), 0.0) AS total FROM events GROUP BY 1",
    ),
    "agg_minmax_string": ("MATCH (c:Customer) RETURN c.c_mktsegment AS seg, MIN(c.c_name) AS lo, MAX(c.c_name) AS hi", "SELECT c_mktsegment AS seg, min(c_name) AS lo, max(c_name) AS hi FROM customer GROUP BY 1"),
    "agg_order_by_group": (
        "MATCH (c:Customer) RETURN c.c_mktsegment AS seg, COUNT(*) AS n ORDER BY c.c_mktsegment DESC FETCH FIRST 3 ROWS ONLY",
        "SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY 1 ORDER BY 1 DESC LIMIT 3",
    ),
    "count_alias": ("MATCH (c:Customer)-[:PLACED]->(o:Orders) RETURN c.c_mktsegment AS seg, COUNT(o) AS n", "SELECT c_mktsegment AS seg, count(o_orderkey) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1"),
    "hop_out": (
        "MATCH (c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 100000 RETURN c.c_mktsegment AS seg, COUNT(*) AS n, SUM(o.o_totalprice) AS total",
        "SELECT c_mktsegment AS seg, count(*) AS n, sum(o_totalprice) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY 1",
    ),
    "hop_in": ("MATCH (n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.n_name AS nation, s.s_name AS supplier", "SELECT n_name AS nation, s_name AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey"),
    "hop_undirected": (
        "MATCH (a:Turn)-[:NEXT]-(b:Turn) RETURN a.turn_id AS a, b.turn_id AS b",
        """WITH t AS (SELECT conv_id, turn FROM conversations),
        e AS (SELECT concat_ws('/', x.conv_id, x.turn) AS s, concat_ws('/', y.conv_id, y.turn) AS d FROM t x JOIN t y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)
        SELECT s AS a, d AS b FROM e UNION ALL SELECT d, s FROM e WHERE s <> d""",
    ),
    "hop_edge_props": (
        "MATCH (o:Orders)-[e:contains {l_linenumber: 2}]->(l:LineItem) RETURN o.o_orderkey AS k, e.l_quantity AS q, e.from_node_id AS f",
        "SELECT o_orderkey AS k, l_quantity AS q, 'Orders:' || o_orderkey AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2",
    ),
    "chain_3": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders) RETURN r.r_name AS region, COUNT(*) AS n",
        "SELECT r_name AS region, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    ),
    "revenue_by_region": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders) WHERE o.o_totalprice > 1000 RETURN r.r_name AS region, n.n_name AS nation, COUNT(*) AS orders, SUM(o.o_totalprice) AS total",
        "SELECT r_name AS region, n_name AS nation, count(*) AS orders, sum(o_totalprice) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1, 2",
    ),
    "five_hops": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Orders)-[:contains]->(l:LineItem)-[:OF_PART]->(p:Part) WHERE r.r_regionkey = 1 RETURN p.p_brand AS brand, COUNT(*) AS n, SUM(l.l_quantity) AS q",
        "SELECT p_brand AS brand, count(*) AS n, sum(l_quantity) AS q FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE n_regionkey = 1 GROUP BY 1",
    ),
    "colleagues_distinct": (
        "MATCH (a:Supplier)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(b:Supplier) RETURN a.s_suppkey AS a, b.s_suppkey AS b",
        "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN nation ON a.s_nationkey = n_nationkey JOIN supplier b ON b.s_nationkey = n_nationkey WHERE a.s_suppkey <> b.s_suppkey",
    ),
    "varlen_next_1_3": (
        "MATCH (a:Turn)-[:NEXT*1..3]->(b:Turn) WHERE a.role = 'user' RETURN a.turn_id AS a, b.turn_id AS b, b.role AS role",
        """WITH RECURSIVE t AS (SELECT conv_id, turn, role FROM conversations),
        w(conv_id, turn0, turn, d) AS (SELECT conv_id, turn, turn, 0 FROM t WHERE role = 'user'
          UNION ALL SELECT w.conv_id, w.turn0, t.turn, w.d + 1 FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn + 1 WHERE w.d < 3)
        SELECT concat_ws('/', w.conv_id, turn0) AS a, concat_ws('/', w.conv_id, w.turn) AS b, t.role AS role FROM w JOIN t ON t.conv_id = w.conv_id AND t.turn = w.turn WHERE d >= 1""",
    ),
    "varlen_exact": (
        "MATCH (r:Region)-[:contains*2]->(c:Customer) RETURN r.r_name AS region, c.c_custkey AS k",
        "SELECT r_name AS region, c_custkey AS k FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey",
    ),
    "synthetic_ids": ("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN n.node_id AS n, e.to_node_id AS t", "SELECT 'Nation:' || n_nationkey AS n, 'Region:' || n_regionkey AS t FROM nation"),
    "payload_text": ("MATCH (d:Document) RETURN d.doc_id AS id, d.content AS body", "SELECT doc_id AS id, text AS body FROM documents"),
    "unknown_field_missing": ("MATCH (n:Nation) WHERE n.nothing IS NULL RETURN n.n_nationkey AS k, n.nothing AS x", "SELECT n_nationkey AS k, CAST(NULL AS VARCHAR) AS x FROM nation"),
}


#: Sums and means of doubles depend on the order of addition; they are rounded on both sides.
_ROUNDED = {"agg_global": ("total", "mean"), "agg_group": ("total",), "hop_out": ("total",), "revenue_by_region": ("total",), "five_hops": ("q",)}


def _add(name, text, sql):
    rounded = _ROUNDED.get(name, ())
    if rounded:
        sql = f"SELECT * REPLACE ({', '.join(f'round({c}, 2) AS {c}' for c in rounded)}) FROM ({sql})"

    @query(name, sql)
    def run(spark, sf_dir):
        rows = Engine(build(spark, sf_dir)).rows(text)
        return rows.withColumns({c: F.round(c, 2) for c in rounded}) if rounded else rows


for _name, (_text, _sql) in _TEXT.items():
    _add(_name, _text, _sql)


@query("id_lookup", "SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey IN (1, 7, 33, 99999999)")
def id_lookup(spark, sf_dir):
    p = Pattern().node("o", "Orders", ids=["Orders:1", "Orders:7", "Orders:33", "Orders:99999999", "Part:2"]).returns(k="o.o_orderkey", p="o.o_totalprice")
    return Engine(build(spark, sf_dir)).rows(p)


@query("adjacency_of_ids", "SELECT c_custkey AS c, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey IN (1, 2, 4)")
def adjacency_of_ids(spark, sf_dir):
    p = Pattern().node("c", "Customer", ids=["Customer:1", "Customer:2", "Customer:4"]).out("PLACED", "e").node("o", "Orders").returns(c="c.c_custkey", o="o.o_orderkey")
    return Engine(build(spark, sf_dir)).rows(p)


@query("builder_same_as_text", _TEXT["or_tree"][1])
def builder_same_as_text(spark, sf_dir):
    p = Pattern().node("o", "Orders").where(any_of(field("o.o_orderstatus") == "F", field("o.o_totalprice") > 200000), any_of(field("o.o_orderpriority").starts_with("1"), field("o.o_orderpriority").starts_with("2")))
    return Engine(build(spark, sf_dir)).rows(p.returns(k="o.o_orderkey"))


@query("ordered_index_scan", "SELECT event_id AS id, value AS amount FROM events WHERE event_type <> 'error' ORDER BY value DESC, event_id DESC LIMIT 40")
def ordered_index_scan(spark, sf_dir):
    """An ordered read over a declared index: rows without the field aren't in it."""
    return Engine(build(spark, sf_dir), index_semantics=True).rows("MATCH (e:Event) RETURN e.event_id AS id, e.amount AS amount ORDER BY e.amount DESC FETCH FIRST 40 ROWS ONLY")


@query(
    "path_ids",
    """WITH t AS (SELECT conv_id, turn, 'Turn:' || conv_id || '/' || turn AS id FROM conversations)
    SELECT [a.id, b.id, c.id] AS nodes FROM t a JOIN t b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 JOIN t c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2""",
)
def path_ids(spark, sf_dir):
    return Engine(build(spark, sf_dir)).rows("MATCH p = (a:Turn)-[:NEXT*2]->(b:Turn) RETURN p").select("p.nodes")


@query(
    "edge_rows_cycle",
    "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey",
)
def edge_rows_cycle(spark, sf_dir):
    """Edge rows: a walk may come back to where it started."""
    p = Pattern().node("a", "Supplier").out("IN_NATION", "x").node("n", "Nation").into("IN_NATION", "y").node("b", "Supplier").edge_rows()
    return Engine(build(spark, sf_dir)).rows(p.returns(a="a.s_suppkey", b="b.s_suppkey"))


@query(
    "collect_per_root",
    "SELECT c_custkey AS c, coalesce(list_sort(list('Orders:' || o_orderkey) FILTER (o_orderkey IS NOT NULL)), []) AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
)
def collect_per_root(spark, sf_dir):
    return Engine(build(spark, sf_dir)).rows(Pattern().node("c", "Customer").out("PLACED").node("o", "Orders").per_root().returns(c="c.c_custkey"))


@query(
    "result_graph_nodes",
    "SELECT DISTINCT unnest(['Region:' || n_regionkey, 'Nation:' || n_nationkey, 'Supplier:' || s_suppkey]) AS node_id FROM nation JOIN supplier ON s_nationkey = n_nationkey",
)
def result_graph_nodes(spark, sf_dir):
    return Engine(build(spark, sf_dir)).execute("MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN GRAPH r.r_name AS r").nodes


@query("has_tag", "SELECT event_id AS id FROM events WHERE event_type = 'purchase' AND user_id % 3 = 1")
def has_tag_query(spark, sf_dir):
    from .builder import has_tag

    p = Pattern().node("e", "Event").where(has_tag("e", "#Purchase"), has_tag("e", "user  1")).returns(id="e.event_id")
    return Engine(build(spark, sf_dir)).rows(p)


@query("response_page", "SELECT n_nationkey AS k, n_name AS name FROM nation ORDER BY n_nationkey LIMIT 10 OFFSET 10")
def response_page(spark, sf_dir):
    """Second page of ten rows by a plan-bound token."""
    e = Engine(build(spark, sf_dir))
    text = "MATCH (n:Nation) RETURN n.n_nationkey AS k, n.n_name AS name ORDER BY n.n_nationkey"
    _, token = e.page(text, 10)
    rows, _ = e.page(text, 10, token)
    return spark.createDataFrame(rows)
