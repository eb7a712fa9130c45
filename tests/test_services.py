"""Reads, replays, searches and updates that services ask for, on small own tables."""

import pytest
from pyspark.sql import functions as F

from quillgraph import errors, places
from quillgraph.catalog import Graph
from quillgraph.engine import Engine
from quillgraph.operators import actions, catalogs, hierarchy
from quillgraph.plans.compiler import Compiler
from quillgraph.search import vector
from quillgraph.search.lexical import LexicalIndex, StoredIndex
from quillgraph.streaming import timing


@pytest.fixture(scope="module")
def graph(spark):
    boats = spark.createDataFrame([(1, "Gull"), (2, "Heron"), (3, "Ibis")], "id long, name string")
    trips = spark.createDataFrame([(10, 1, 5.0), (11, 1, 9.0), (12, 1, 7.0), (13, 2, 4.0)], "id long, boat long, miles double")
    g = Graph().add_node("Boat", boats, "id").add_node("Trip", trips, "id")
    return g.add_edge("SAILED", "Boat", "Trip", trips, "boat", "id")


ASK = "MATCH (b:Boat)-[:SAILED]->(t:Trip) RETURN t.id AS trip ORDER BY t.miles DESC FETCH FIRST 2 ROWS ONLY"


def test_a_context_query_reads_some_rows_of_each_bound_node(spark, graph):
    node = spark.createDataFrame([("Boat:1",), ("Boat:1",), ("Boat:2",), ("Boat:9",)], "node string")
    e = Engine(graph)
    got = [tuple(r) for r in actions.context_query(e, ASK, "b", node).orderBy("bound", "trip").collect()]
    assert got == [("Boat:1", 11), ("Boat:1", 12), ("Boat:2", 13)]
    with pytest.raises(errors.BudgetExceeded):
        actions.context_query(e, ASK, "b", node, most=1)
    assert actions.context_query(e, ASK, "b", node.filter("node = 'Boat:2'"), most=1).count() == 1
    for text, kind in (
        ("MATCH (b:Boat) RETURN b.name AS n", errors.BudgetExceeded),
        ("MATCH (b:Boat) RETURN b.name AS n FETCH FIRST 501 ROWS ONLY", errors.BudgetExceeded),
        ("MATCH (b:Boat)-[]->(t:Trip) RETURN t.id AS n FETCH FIRST 2 ROWS ONLY", errors.Unsupported),
        ("MATCH (x:Boat) RETURN x.name AS n FETCH FIRST 2 ROWS ONLY", errors.BindingProblem),
        ("MATCH (b:Boat) SET b.name = 'x' RETURN b.name", errors.Unsupported),
    ):
        with pytest.raises(kind):
            actions.context_query(e, text, "b", node)


def test_a_mask_clears_what_the_fields_lack(spark, graph):
    op = {"op": "update_node", "label": "Trip", "match": {"id": 11}, "fields": {"boat": 2}, "mask": ["miles"]}
    rows = Engine(actions.batch(graph, [op], Compiler)).rows("MATCH (t:Trip) RETURN t.id AS id, t.boat AS boat, t.miles AS miles")
    assert {tuple(r) for r in rows.filter("id IN (11, 12)").collect()} == {(11, 1, None), (12, 1, 7.0)}


@pytest.mark.parametrize(
    ("text", "shape", "problem"),
    [
        ('{"a": 1}', {"type": "object", "required": ["a"]}, None),
        ('{"a": 1}', {"type": "object", "required": ["a", "b c"]}, "without b c"),
        ('{"a": null}', {"required": ["a"]}, "without a"),
        ("[1]", {"required": ["a"]}, "not an object"),
        ("[1]", {"type": "array"}, None),
        ("1.5", {"type": "number"}, None),
        ("true", {"type": "number"}, "not of type number"),
        ('"x"', {"type": "string"}, None),
        ("{", {"type": "object"}, "not JSON"),
        (None, {"type": "object"}, "not JSON"),
        ("3", {"type": "date"}, None),
    ],
)
def test_shapes(spark, text, shape, problem):
    df = spark.createDataFrame([(text,)], "x string")
    assert df.select(catalogs.shape_problem(F.col("x"), shape).alias("p")).first().p == problem


def test_pages_are_applied_once_and_in_order(spark):
    rows = [(r, n) for r in range(1, 8) for n in range(1 + 4 * (r == 5))]
    changes, seen = spark.createDataFrame(rows, "revision long, n int"), []
    end = timing.paged_replay(timing.pages_of(changes, "s"), "s", 2, 2, lambda p: seen.append(sorted(tuple(r) for r in p.rows.collect())))
    assert end == 7 and [x for p in seen for x in p] == [x for x in rows if x[0] > 2]
    assert timing.paged_replay(timing.pages_of(changes, "s"), "s", 7, 2, seen.append) == 7
    assert timing.paged_replay(timing.pages_of(changes.limit(0), "s"), "s", 3, 2, lambda p: None) == 3
    with pytest.raises(ValueError):
        timing.paged_replay(timing.pages_of(changes, "s"), "s", 0, 0, seen.append)

    def stuck(scope, after, size):
        return timing.SourcePage(scope, after, after, changes, True)

    for read, scope in ((timing.pages_of(changes, "s"), "t"), (timing.pages_of(changes, "s", compacted=4), "s"), (stuck, "s")):
        with pytest.raises(errors.Conflict):
            timing.paged_replay(read, scope, 2, 2, lambda p: None)


def test_a_failed_page_leaves_the_later_ones(spark):
    changes, seen = spark.range(1, 7).withColumnRenamed("id", "revision"), []

    def apply(page):
        if page.after == 4:
            raise RuntimeError("full")
        seen.append(page.end)

    with pytest.raises(RuntimeError):
        timing.paged_replay(timing.pages_of(changes, "s"), "s", 0, 2, apply)
    assert seen == [2, 4]


def test_each_consumer_has_its_own_work(spark):
    c = spark.createDataFrame([("a", 1, "2024-01-01"), ("a", 5, "2024-01-02"), ("b", 3, "2024-01-03")], "t string, r long, at string").withColumn("at", F.col("at").cast("timestamp"))
    got = {(r.consumer, r.t, r.revision) for r in timing.consumers_work(c, "t", "r", "at", "1 HOUR", {"x": 0, "y": 3, "z": 5}).collect()}
    assert got == {("x", "a", 5), ("x", "b", 3), ("y", "a", 5)}
    assert timing.advanced({"x": 4, "y": 1}, {"x": 2, "y": 3, "w": 9}) == {"x": 4, "y": 3}


def test_trees_share_their_budgets(spark):
    e = spark.createDataFrame([(f"p{p}", f"c{p}{i}", f"e{p}{i}", float(i)) for p in range(2) for i in range(3)], "src string, dst string, edge_id string, ord double")
    roots = spark.createDataFrame([("p0",), ("p1",)], "root string")
    assert hierarchy.subtree(roots, e, max_nodes=8, max_edges=6).count() == 8
    assert hierarchy.subtree(roots, e, max_depth=1, max_nodes=8).count() == 8
    for budget in ({"max_nodes": 7}, {"max_edges": 5}, {"max_nodes": 1}):
        with pytest.raises(errors.BudgetExceeded):
            hierarchy.subtree(roots, e, **budget)


def test_pages_of_rankings(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(7)], "vec_id long, embedding array<double>")
    hits, ids, token = vector.top_k(v, [1.0, 0.0], 5), [], None
    while True:
        rows, token = vector.hits_page(hits, 2, token)
        ids += [r.vec_id for r in rows]
        if token is None:
            break
    assert ids == [0, 1, 2, 3, 4]
    _, token = vector.hits_page(hits, 2)
    for other, held in ((vector.top_k(v, [0.0, 1.0], 5), token), (hits, "?"), (hits, "YTpi")):
        with pytest.raises(errors.StaleCursor):
            vector.hits_page(other, 2, held)
    old = spark.createDataFrame([(1, "a", 1, "c"), (2, "a", 2, "c"), (3, "gone", 2, "c"), (4, "a", 2, None)], "vec_id long, binding string, generation int, configuration string")
    good, stale = vector.current(old, {"a": (2, "c")})
    assert [r.vec_id for r in good.collect()] == [2] and {r.binding for r in stale.collect()} == {"a", "gone"}


def test_pages_and_fields_of_lexical_matches(spark):
    docs = spark.createDataFrame([(i, "kelp " * (i + 1), "reef" if i % 2 else "sand") for i in range(5)], "doc long, body string, head string")
    docs = docs.withColumn("fields", F.array(F.struct(F.lit("body").alias("path"), F.col("body").alias("text")), F.struct(F.lit("head").alias("path"), F.col("head").alias("text"))))
    index = LexicalIndex.build(docs, "doc", fields="fields")
    first, seen, token = index.paged("kelp OR reef", 2)
    assert seen == {"segments": 1, "postings_lists": 2, "candidates": 5, "truncated": True}
    again = index.paged("kelp OR reef", 2, offset=2)[0].collect()
    assert again == index.paged("kelp OR reef", 2, token=token)[0].collect() and [r["rank"] for r in again] == [3, 4]
    last, seen, end = index.paged("kelp OR reef", 2, offset=4)
    assert last.count() == 1 and not seen["truncated"] and end is None
    with pytest.raises(errors.Unsupported):
        index.paged("kelp", 2, offset=1, token=token)
    with pytest.raises(errors.StaleCursor):
        index.paged("kelp", 2, token="?")
    got = {r.doc: r.matched_fields for r in index.matched_fields(index.search("kelp OR reef")).collect()}
    assert got == {0: [0], 1: [0, 1], 2: [0], 3: [0, 1], 4: [0]}


def test_a_stored_index_without_its_statistics_still_answers(spark, tmp_path):
    index = StoredIndex(spark, str(tmp_path / "i")).add(spark.createDataFrame([(1, "kelp reef"), (2, "reef")], "doc long, text string"), "doc", "text")
    want = index.search("reef").orderBy("doc").collect()
    places.delete(spark, str(tmp_path / "i/segment-0/statistics"))
    assert StoredIndex(spark, str(tmp_path / "i")).search("reef").orderBy("doc").collect() == want
