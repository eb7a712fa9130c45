"""Delivery modes, conditions, transactions, hierarchies on create, spaces, references by label."""

import datetime

import pytest

from quillgraph import errors
from quillgraph.catalog import Graph
from quillgraph.engine import Engine
from quillgraph.operators import conditions, mutate
from quillgraph.schema import language
from quillgraph.search import vector
from quillgraph.sources.domains import export_space, import_space
from quillgraph.streaming import delivery

ROW = "revision long, type string, node_id string, committed_at timestamp"


def changes(spark, revisions):
    t = datetime.datetime(2025, 5, 1)
    return spark.createDataFrame([(r, "node.updated", f"n{r}", t + datetime.timedelta(seconds=r)) for r in revisions], ROW)


def stream(spark, tmp_path, revisions):
    changes(spark, revisions).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(ROW).parquet(f"{tmp_path}/in")


def test_retries_wait_longer_up_to_a_bound():
    waits, calls = [], []

    def flaky(df, epoch):
        calls.append(epoch)
        if len(calls) < 7:
            raise OSError("busy")
        return "done"

    assert delivery.retried(flaky, tries=9, first=0.02, sleep=waits.append)(None, 4) == "done"
    assert waits == [0.02, 0.04, 0.08, 0.16, 0.25, 0.25] and calls == [4] * 7
    with pytest.raises(OSError):
        delivery.retried(lambda df, e: (_ for _ in ()).throw(OSError()), tries=2, sleep=waits.append)(None, 0)


def test_lossless_and_lossy_streams(spark, tmp_path):
    s, got, failed = stream(spark, tmp_path, [3, 1, 2]), [], []

    def once_down(df, epoch):
        if not failed:
            failed.append(epoch)
            raise OSError("down")
        got.extend(r.revision for r in df.collect())

    delivery.lossless(s, once_down, f"{tmp_path}/a").awaitTermination()
    assert got == [1, 2, 3] and failed
    got.clear()
    delivery.lossy(s, lambda df, e: got.extend((r.revision, r.type) for r in df.collect()), f"{tmp_path}/b", 2).awaitTermination()
    assert got == [(1, "node.updated"), (2, "node.updated"), (3, "gap")]
    delivery.lossy(s, lambda df, e: (_ for _ in ()).throw(OSError()), f"{tmp_path}/c", 9).awaitTermination()  # dropped, not raised
    assert [(r.revision, r.type) for r in delivery.bounded(changes(spark, [5, 6]), 9).collect()] == [(5, "node.updated"), (6, "node.updated")]


def test_heartbeats_fill_quiet_spans(spark, tmp_path):
    t = datetime.datetime(2025, 5, 1)
    df = changes(spark, [0, 10, 95, 200])
    assert sorted(r.tick for r in delivery.heartbeats(df, "committed_at", 30).collect()) == [t + datetime.timedelta(seconds=n) for n in (60, 90, 150, 180)]
    assert delivery.heartbeats(df.limit(0), "committed_at").collect() == []
    seen = []
    q = delivery.watch(spark, stream(spark, tmp_path, [7]), lambda d, e: seen.extend(r.type for r in d.collect()), f"{tmp_path}/w", 1)
    try:
        for _ in range(60):
            if {"node.updated", "heartbeat"} <= set(seen):
                break
            q.awaitTermination(0.5)
    finally:
        q.stop()
    assert {"node.updated", "heartbeat"} <= set(seen)


def test_conditions(spark):
    e = spark.createDataFrame([("a", "b", "1", "T", 4.0), ("a", "a", "2", "T", 6.0), ("c", "a", "3", "U", 1.0)], "src string, dst string, edge_id string, label string, w double")
    both = sorted((r.node, r.other, r.edge_id) for r in conditions.pattern(e, "both", "T").collect())
    assert both == [("a", "a", "2"), ("a", "a", "2"), ("a", "b", "1"), ("b", "a", "1")]  # a loop is seen twice
    bound = spark.createDataFrame([("a",), ("z",)], "node string")
    rows = conditions.pattern(e, "out", "T", bound)
    ask = lambda *x: {r.node: r.holds for r in conditions.holds(bound, rows, *x).collect()}
    assert ask("count", "=", 2) == {"a": True, "z": False} and ask("count", "<", 1) == {"a": False, "z": True}
    assert ask("sum", ">=", 10, rows.w) == {"a": True, "z": False} and ask("max", "!=", 0, rows.w) == {"a": True, "z": False}
    hit = spark.createDataFrame([("a", 1), ("z", 2)], "node_id string, revision int")
    assert [r.revision for r in conditions.dispatched(hit, conditions.holds(bound, rows, "avg", ">", 4, rows.w)).collect()] == [1]


@pytest.fixture
def rooms(spark):
    g = Graph().add_node("Room", spark.createDataFrame([(n, f"room {n}") for n in range(4)], "id int, title string"), "id")
    return g.add_edge("within", "Room", "Room", spark.createDataFrame([(0, 1)], "s int, d int"), "s", "d")


def test_transactions(rooms):
    e = Engine(rooms)
    a, b, c = e.transaction(), e.transaction(), e.transaction()
    a.execute("MATCH (r:Room {id: 1}) SET r.title = 'one' RETURN r.id")
    b.execute("MATCH (r:Room {id: 2}) SET r.title = 'two' RETURN r.id")
    b.execute("MATCH (x:Room {id: 2}), (y:Room {id: 3}) CREATE (x)-[:within]->(y)")
    c.execute("MATCH (r:Room) SET r.title = 'all' RETURN r.id")
    titles = lambda x: {r.i: r.t for r in x.rows("MATCH (r:Room) RETURN r.id AS i, r.title AS t").collect()}
    assert titles(a)[1] == "one" and titles(e)[1] == "room 1"
    a.commit()
    b.commit()
    assert titles(e) == {0: "room 0", 1: "one", 2: "two", 3: "room 3"}
    assert e.rows("MATCH (x:Room)-[:within]->(y:Room) RETURN x.id AS x").count() == 2
    with pytest.raises(errors.Conflict):
        c.commit()
    d = e.transaction()
    d.execute("MATCH (x:Room {id: 0}), (y:Room {id: 2}) CREATE (x)-[:within]->(y)")
    e.execute("MATCH (x:Room {id: 0}), (y:Room {id: 3}) CREATE (x)-[:within]->(y)")
    with pytest.raises(errors.Conflict):
        d.commit()


def test_a_hierarchy_is_kept_on_create(rooms):
    doc = language.parse("node Room {\n  title: string\n}\nedge within from Room to Room hierarchy")
    e = Engine(rooms, schema=doc)
    e.execute("MATCH (x:Room {id: 1}), (y:Room {id: 2}) CREATE (x)-[:within]->(y)")
    for s, d in ((3, 2), (2, 0)):  # a second parent, a cycle
        with pytest.raises(errors.Conflict):
            e.execute(f"MATCH (x:Room {{id: {s}}}), (y:Room {{id: {d}}}) CREATE (x)-[:within]->(y)")
    assert e.rows("MATCH (x:Room)-[:within]->(y:Room) RETURN x.id AS x").count() == 2


def test_references_of_one_label(spark):
    e = spark.createDataFrame([(1, 2, "a", "refs"), (1, 2, "b", "likes"), (1, 5, "c", "refs")], "src int, dst int, edge_id string, label string")
    out = mutate.replace_references(e, spark.createDataFrame([(1, 7)], "src int, dst int"), label="refs")
    assert sorted((r.src, r.dst, r.label) for r in out.collect()) == [(1, 2, "likes"), (1, 7, "refs")]


def test_spaces_and_stored_vectors(spark, rooms, tmp_path):
    export_space({"home": rooms, "away": rooms}, f"{tmp_path}/space", "s1")
    back = import_space(spark, f"{tmp_path}/space")
    assert set(back) == {"home", "away"} and Engine(back["away"]).rows("MATCH (x:Room)-[:within]->(y:Room) RETURN y.title AS t").first().t == "room 1"
    index = vector.VectorIndex(spark, f"{tmp_path}/vec")
    rows = lambda *xs: spark.createDataFrame(xs, "node string, vector array<float>")
    index.write(rows(("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("n", None)), "r1").write(rows(("c", [1.0, 0.0])), "r2").write(rows(("d", [1.0, 1.0])), "r2")
    assert [r.node for r in index.search("r1", [1.0, 0.1], 5).orderBy("rank").collect()] == ["a", "b"] and [r.node for r in index.search("r2", [1.0, 0.0]).collect()] == ["d"]
