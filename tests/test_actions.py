import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillgraph import errors
from quillgraph.catalog import Graph
from quillgraph.engine import Engine
from quillgraph.operators import actions
from quillgraph.plans.compiler import Compiler


def graph(spark):
    n = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    e = spark.createDataFrame([(1, 2, "x", 1.0), (1, 3, "y", 2.0)], "s long, d long, id string, o double")
    return Graph().add_node("N", n, "id").add_edge("contains", "N", "N", e, "s", "d", edge_id=F.col("id"), order="o")


def pairs(g):
    return sorted(tuple(r) for r in Engine(g).rows("MATCH (a:N)-[:contains]->(b:N) RETURN a.id AS a, b.id AS b").collect())


def test_batch(spark):
    out = actions.batch(
        graph(spark),
        [
            {"op": "create_node", "label": "N", "fields": {"id": 4, "name": "d"}},
            {"op": "upsert_node", "label": "N", "match": {"id": 5}, "fields": {"name": "e"}},
            {"op": "upsert_node", "label": "N", "match": {"id": 5}, "fields": {"name": "f"}},
            {"op": "update_node", "label": "N", "match": {"id": 4}, "fields": {"name": "g"}},
            {"op": "create_edge", "edge": "contains", "from": ("N", {"id": 1}), "to": ("N", {"id": 4})},
            {"op": "delete_edge", "edge": "contains", "from": ("N", {"id": 1}), "to": ("N", {"id": 3})},
            {"op": "delete_node", "label": "N", "match": {"id": 3}},
            {"op": "update_edge", "edge": "contains", "edge_id": "x", "fields": {"w": 9}},
        ],
        Compiler,
    )
    assert sorted(tuple(r) for r in Engine(out).rows("MATCH (a:N) RETURN a.id AS i, a.name AS n").collect()) == [(1, "a"), (2, "b"), (4, "g"), (5, "f")]
    assert pairs(out) == [(1, 2), (1, 4)]
    assert Engine(out).rows("MATCH (a:N)-[e:contains]->(b:N {id: 2}) RETURN e.w AS w").first().w == 9
    out = actions.batch(out, [{"op": "move_subtree", "edge": "contains", "node": "N:4", "parent": "N:2"}, {"op": "reorder_children", "edge": "contains", "parent": "N:2", "children": ["N:4"]}], Compiler)
    assert pairs(out) == [(1, 2), (2, 4)]
    out = actions.batch(out, [{"op": "replace_references", "edge": "contains", "source": "N:1", "targets": ["N:5"]}], Compiler)
    assert pairs(out) == [(1, 5), (2, 4)]
    with pytest.raises(errors.Unsupported):
        actions.batch(out, [{"op": "odd"}], Compiler)


def test_snapshot_and_context(spark):
    actions.same_snapshot({"r": 1}, {"r": 1})
    with pytest.raises(errors.Conflict):
        actions.same_snapshot({"r": 1}, {"r": 2})
    assert actions.context(spark.range(5)).count() == 5
    with pytest.raises(errors.BudgetExceeded):
        actions.context(spark.range(6), 5)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_export_import_holds_the_whole_graph(spark, monkeypatch):
    from quillgraph import registry
    from quillgraph.queries_more import build
    from quillgraph.sources import domains

    read, sf_dir = [], "/root/testdata/sf0.001"
    take = domains.import_domain
    monkeypatch.setattr(domains, "import_domain", lambda *a: read.append(take(*a)) or read[0])
    assert registry.QUERIES["export_import"](spark, sf_dir).count()
    g = build(spark, sf_dir)
    assert {k: t.df.count() for k, t in read[0].nodes.items()} == {k: t.df.count() for k, t in g.nodes.items()}
    held = lambda g: {k: [(p.source, p.target, p.df.filter(F.col(p.src).isNotNull() & F.col(p.dst).isNotNull()).count()) for p in parts] for k, parts in g.edges.items()}
    assert held(read[0]) == held(g)
