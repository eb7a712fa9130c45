import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph import errors
from quillgraph.operators import catalogs, hierarchy, mutate, versions
from quillgraph.schema import language, violations
from quillgraph.search import expression as X
from quillgraph.search import hybrid, vector
from quillgraph.search.lexical import LexicalIndex, StoredIndex, fields_of, fresh, live
from quillgraph.sources.domains import blobs, merge_rows
from quillgraph.streaming import changes as C
from quillgraph.streaming import timing


def test_expressions():
    assert X.parse('a OR b c -d') == X.Either((X.Term("a"), X.Both((X.Term("b"), X.Term("c"), X.Without(X.Term("d"))))))
    assert X.parse("foo-bar") == X.Both((X.Term("foo"), X.Term("bar")))
    assert X.parse('"Vector  database" not (x AND y)').items[0] == X.Phrase(("vector", "database"))
    assert X.positive(X.parse('a -(b "c d") NOT NOT e'))[0] == ["a", "e"]
    for bad in ("", "a AND", "(a", "a)", '"a', "te*", "f:x", "a~", "[a", '"!"', "!", "OR a"):
        with pytest.raises(errors.SyntaxProblem):
            X.parse(bad)


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc string, revision int, text string, gone boolean")


def bm25(texts, terms, k1=1.2, b=0.75):
    """Scores by the formula, over lists of words."""
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    out = {}
    for doc, words in texts.items():
        for t in terms:
            df, tf = sum(t in w for w in texts.values()), words.count(t)
            if tf:
                out[doc] = out.get(doc, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
    return out


HARBOUR = {"log1": "Fog over the north quay, fog signal sounded", "log2": "North wind; quay closed", "log3": "Ferry late. Signal lamp broken", "log4": "The quay north of the lamp", "log5": "nothing to report"}


def test_lexical_scores_follow_the_formula(spark):
    d = docs(spark, [(k, 1, t, False) for k, t in HARBOUR.items()])
    i = LexicalIndex.build(d, "doc", "text")
    texts = {k: re.findall("[a-z0-9]+", t.lower()) for k, t in HARBOUR.items()}
    for text, terms, keep in (("fog OR lamp", ["fog", "lamp"], None), ("quay signal", ["quay", "signal"], {"log1"}), ("north -closed", ["north"], {"log1", "log4"})):
        want = {k: v for k, v in bm25(texts, terms).items() if keep is None or k in keep}
        got = {r.doc: r.score for r in i.search(text).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    one = i.top('"north quay"', 3).collect()
    assert [(r.doc, r.rank, r.matched) for r in one] == [("log1", 1, ["north", "quay"])] and abs(one[0].score - 1.25 * bm25(texts, ["north", "quay"])["log1"]) < 1e-12
    both = sorted(bm25(texts, ["north", "quay"]).items(), key=lambda x: (-x[1], x[0]))
    assert [r.doc for r in i.top("north OR quay", 2).collect()] == [k for k, _ in both[:2]]
    assert i.search("NOT quay").collect() == []
    again = docs(spark, [(k, 1, t, False) for k, t in HARBOUR.items()] + [("log2", 4, "calm", False), ("log4", 3, None, True), ("log4", 2, "quay quay", False)])
    assert {r.doc for r in LexicalIndex.build(live(again, "doc", "revision", "gone"), "doc", "text").search("quay").collect()} == {"log1"}


def test_stored_segments(spark, tmp_path):
    """Versions and deletions over segments score as one index over what lives."""
    frame = lambda rows: spark.createDataFrame(rows, "doc string, text string, gone boolean")
    index = StoredIndex(spark, f"{tmp_path}/ix").add(frame([(k, t, False) for k, t in HARBOUR.items()]), "doc", "text", revision=1)
    assert index.revision == 1 and fresh(index.revision, 1) and not fresh(index.revision, 2)
    index.add(frame([("log2", "Quay open, quay dry", False), ("log6", "fog again", False)]), "doc", "text", revision=2)
    index.add(frame([("log1", None, True), ("log6", None, True)]), "doc", "text", deleted="gone", revision=3)
    now = {k: t for k, t in HARBOUR.items() if k != "log1"} | {"log2": "Quay open, quay dry"}
    plain = LexicalIndex.build(frame([(k, t, False) for k, t in now.items()]), "doc", "text")
    for ix in (index, index.compact(), StoredIndex(spark, f"{tmp_path}/ix")):
        for text in ("quay", "fog OR lamp OR wind", '"the lamp"', "quay -dry"):
            assert {r.doc: round(r.score, 12) for r in ix.search(text).collect()} == {r.doc: round(r.score, 12) for r in plain.search(text).collect()}
        assert ix.revision == 3 or ix.path.endswith("compact-3")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan(index.hits(["quay"]))) and "Window" not in plan(index.search("quay"))


def test_fields_keep_phrases_apart(spark):
    df = spark.createDataFrame([("d", "vector", ("database", ["x y", "z"]))], "id string, title string, body struct<text:string, more:array<string>>")
    df = df.withColumn("fields", fields_of(df, ["id"]))
    assert [(f.path, f.text) for f in df.first().fields] == [("body.more[0]", "x y"), ("body.more[1]", "z"), ("body.text", "database"), ("title", "vector")]
    i = LexicalIndex.build(df, "id", fields="fields")
    assert i.search('"x y"').count() == 1 and i.search('"y z"').count() == 0 and i.search("vector database").count() == 1
    assert i.postings.filter("term = 'vector'").first().positions == [2 + 1 + 1 + 300]


def test_freshness():
    assert fresh(5, 5) and not fresh(4, 5) and fresh(4, 5, True) and not fresh(1, 5, True, 3)


def fused(lex, sem, w=(0.5, 0.5), constant=60, require_both=False):
    """Weighted reciprocal ranks by their definition."""
    best = lambda rows: {k: min(r for x, r in rows if x == k) for k, _ in rows}
    a, b = best(lex), best(sem)
    keys = set(a) & set(b) if require_both else set(a) | set(b)
    part = lambda side, k, weight: weight / sum(w) / (constant + side[k]) if k in side else 0.0
    score = {k: part(a, k, w[0]) + part(b, k, w[1]) for k in keys}
    order = sorted(keys, key=lambda k: (-score[k], not (k in a and k in b), min(a.get(k, 10**9), b.get(k, 10**9)), k))
    return [(k, a.get(k), b.get(k), score[k]) for k in order]


@pytest.mark.parametrize("seed", range(4))
def test_fusion_same_as_its_definition(spark, seed):
    rng = random.Random(seed)
    names = [f"berth{n}" for n in range(14)]
    side = lambda: [(rng.choice(names), rng.randrange(1, 12)) for _ in range(rng.randrange(1, 16))]
    lex, sem = side(), side()
    frame = lambda rows: spark.createDataFrame(rows, "node string, rank long")
    for options in ({}, {"w": (3, 1)}, {"w": (0, 2)}, {"require_both": True, "constant": 5}):
        got = hybrid.fuse(frame(lex), frame(sem), **options).orderBy("rank").collect()
        want = fused(lex, sem, **options)
        assert [(r.node, r.lexical_rank, r.semantic_rank) for r in got] == [x[:3] for x in want]
        assert all(abs(r.score - x[3]) < 1e-15 for r, x in zip(got, want))


def test_fusion_scalars(spark):
    assert hybrid.weights(0, 0) == (0.5, 0.5) and hybrid.weights(3, 1) == (0.75, 0.25)
    assert [hybrid.candidate_count(n) for n in (1, 20, 500)] == [50, 100, 1000] and hybrid.candidate_count(1, True) == 1000
    with pytest.raises(ValueError):
        hybrid.weights(-1, 1)
    rows, warn = hybrid.search(spark.createDataFrame([("a", 1)], "node string, rank long"), None)
    assert rows.count() == 1 and warn


def test_vectors(spark):
    t = datetime.datetime(2024, 1, 1)
    rec = [("i", "a", "self", [1.0, 0.0], t, False), ("i", "a", "self", [0.0, 1.0], t + datetime.timedelta(1), False), ("i", "a", "tree", [1.0, 0.0], t, False), ("i", "b", "self", [1.0, 1.0], t, False), ("i", "b", "self", [1.0, 1.0], t + datetime.timedelta(1), True), ("i", "c", "self", [1.0], t, False), ("i", "z", "self", [0.0, 0.0], t, False)]
    df = spark.createDataFrame(rec, "idx string, node string, mode string, vector array<float>, created timestamp, tombstone boolean")
    new = vector.fresh_records(df, ["idx", "node", "mode"])
    got = vector.top_k(new, [1.0, 0.0], 5, key="node", vector="vector").orderBy("rank").collect()
    assert [(r.node, r.score) for r in got] == [("a", 1.0), ("a", 0.0), ("z", 0.0)]
    assert vector.top_k(new, [1.0, 0.0], 5, 0.5, "node", "vector").count() == 1
    e = spark.createDataFrame([("hello world",), ("hello hello",)], "t string").select(vector.embed(F.col("t"), 8).alias("v")).collect()
    assert len(e[0].v) == 8 and sum(abs(x) for x in e[1].v) == 2


def test_trees(spark):
    spark.sparkContext.setCheckpointDir("/tmp/quillgraph-tests") if spark.sparkContext.getCheckpointDir() is None else None
    e = spark.createDataFrame([("r", "b", "e1", 2.0), ("r", "a", "e2", 1.0), ("a", "a1", "e3", 1.0), ("r", "x", "e0", None)], "src string, dst string, edge_id string, ord double")
    roots = spark.createDataFrame([("r",)], "root string")
    flat = hierarchy.subtree(roots, e)
    assert sorted((r.node, r.depth) for r in flat.collect()) == [("a", 1), ("a1", 2), ("b", 1), ("r", 0), ("x", 1)]
    texts = spark.createDataFrame([("r", "root"), ("a", "first"), ("b", "second"), ("a1", "deep")], "node string, text string")
    two = hierarchy.subtree(roots, e.filter("dst <> 'x'"))
    assert hierarchy.source_text(two, texts).first().text == "root\n- first\n  - deep\n- second"
    assert [r.child for r in hierarchy.children(e).filter("parent = 'r'").orderBy("place").collect()] == ["a", "b", "x"]
    nested = hierarchy.nest(hierarchy.trees(two).first().members)
    assert [c["node"] for c in nested["children"]] == ["a", "b"]
    cyc = e.unionByName(spark.createDataFrame([("a1", "r", "e9", None), ("b", "a1", "e8", None)], e.schema))
    assert {(r.rule, r.node) for r in hierarchy.violations(cyc).collect()} == {("single_parent", "a1"), ("acyclic", "r"), ("acyclic", "a"), ("acyclic", "a1"), ("acyclic", "b")}
    assert hierarchy.subtree(roots, cyc).count() == 5  # cycles end
    with pytest.raises(errors.Conflict):
        hierarchy.move(e, "a", "a1")
    assert hierarchy.move(e, "b", "a1", 4.0).filter("edge_id = 'e1'").first().src == "a1"
    assert [r.ord for r in hierarchy.reorder(e, "r", ["x", "b", "a"], 10).filter("src = 'r'").orderBy("ord").collect()] == [10, 20, 30]
    with pytest.raises(errors.Conflict):
        hierarchy.reorder(e, "r", ["x", "b"])


def test_references(spark):
    e = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "c"), (5, 6, "d")], "src int, dst int, edge_id string")
    want = spark.createDataFrame([(1, 3), (1, 4)], "src int, dst int")
    ids = lambda df: sorted((r.src, r.dst) for r in df.collect())
    assert ids(mutate.replace_references(e, want)) == [(1, 3), (1, 4), (5, 6)]
    assert ids(mutate.replace_references(e, want, "add")) == [(1, 2), (1, 3), (1, 4), (5, 6)]
    assert ids(mutate.replace_references(e, want, "remove")) == [(1, 2), (5, 6)]
    assert ids(mutate.replace_references(e, spark.createDataFrame([(1, None)], "src int, dst int"), "remove")) == [(5, 6)]
    assert mutate.replace_references(e, want, "add").filter("dst = 2").first().edge_id == "a"


def test_imports(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y")], "id long, v string")
    assert sorted(map(tuple, merge_rows(base, new, "id").collect())) == [(1, "a"), (2, "x"), (3, "y")]
    assert merge_rows(base, new, "id", "upsert", dry_run=True) == {"created": 1, "updated": 1, "deleted": 0}
    assert merge_rows(base, new, "id", "replace").count() == 2
    with pytest.raises(errors.Conflict):
        merge_rows(base, new, "id", "create")
    assert merge_rows(base, new, "id", "create", preserve_ids=False).count() == 4
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert blobs(spark, str(tmp_path)).first().blob_id == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


CHANGES = "revision bigint, commit_id string, space_id string, domain_id string, committed_at timestamp, type string, node_id string, edge_id string, labels array<string>, changed_fields array<string>, affected_node_ids array<string>, affected_edge_ids array<string>, origin string"


def change(rev, kind="node.created", node="n", labels=("A",), origin=None, minute=None):
    return (rev, f"c{rev}", "s", "d", datetime.datetime(2024, 1, 1, 0, rev if minute is None else minute), kind, node, None, list(labels), ["f"], None, None, origin)


def test_change_stream_runs(spark, tmp_path):
    rows = [change(3), change(1), change(2, "updated"), change(2, "updated"), change(4, "node.deleted", "m")]
    spark.createDataFrame(rows, CHANGES).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = C.once(C.normalise(C.source(spark, f"{tmp_path}/in")), "1 hour")
    got = []
    q = C.deliver(C.matching(stream, types=["created", "updated"]), lambda df, epoch: got.extend(r.revision for r in df.collect()), f"{tmp_path}/ck")
    q.awaitTermination()
    assert got == [1, 2, 3]
    got.clear()
    C.deliver(C.matching(stream, types=["created", "updated"]), lambda df, epoch: got.extend(df.collect()), f"{tmp_path}/ck").awaitTermination()
    assert got == []  # nothing is delivered again


def test_debounce_stream_and_twin(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    rows = [(u, t + datetime.timedelta(minutes=m), i) for i, (u, m) in enumerate([("a", 0), ("a", 30), ("a", 200), ("b", 5), ("b", 64), ("z", 2000)])]
    df = spark.createDataFrame(rows, "user string, ts timestamp, id long")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    s = timing.debounce_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "user", "ts", "60 minutes", "id")
    q = s.writeStream.format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    streamed = {(r.user, r.n, r.kept) for r in spark.table("bursts").collect()}
    batch = {(r.user, r.n, r.kept) for r in timing.debounce(df, "user", "ts", "60 MINUTES", "id").collect()}
    assert streamed <= batch and batch - streamed <= {("z", 1, 5)} and ("a", 2, 1) in streamed


def test_changes_in_batch(spark):
    df = C.normalise(spark.createDataFrame([change(5), change(6, "updated", origin="automation:r1"), change(7, "node.deleted"), change(8, "node.created", "m", ("A", "B"))], CHANGES))
    assert C.gap(df, 3).first().gap and not C.gap(df, 4).first().gap
    assert [r.revision for r in C.replay(df.unionByName(df), 5).collect()] == [6, 7, 8]
    rules = spark.createDataFrame([("r1", ["A"], datetime.datetime(2024, 1, 1)), ("r2", ["A", "B"], datetime.datetime(2024, 1, 1)), ("r3", [], datetime.datetime(2024, 1, 1, 0, 7))], "rule_id string, labels array<string>, bound_at timestamp")
    assert sorted((r.revision, r.rule_id) for r in C.triggered(df, rules).collect()) == [(5, "r1"), (8, "r1"), (8, "r2"), (8, "r3")]
    assert {(r.target, r.action) for r in C.dirty_targets(df).collect()} == {("n", "refresh"), ("m", "refresh")}
    assert {(r.target, r.action) for r in C.dirty_targets(df.filter("revision = 7")).collect()} == {("n", "delete")}
    assert C.projected(df, revision=True).columns == ["type", "node_id", "edge_id", "domain_id", "revision", "commit_id", "committed_at"]
    with pytest.raises(ValueError):
        timing.bootstrap(df, df, 1, lambda a, b: b)
    assert [timing.backoff(n) for n in (1, 2, 5, 20)] == [1, 2, 16, 300]


SCHEMA = """schema "Port of call" version "2026.1" mode strict domain 11111111-2222-4333-8444-555555555555   # a comment
// vessels and where they lie
node Vessel labels Vessel,Ship {
  title: string required;
  flags: string[] optional
  trade: enum tug,ferry,dredger
}
node Quay labels [Quay]
edge lies from Vessel to Quay {
  metres?: float
}
edge escorts from Ship to Vessel labels escorts,guards hierarchy

index vessels_by_title on node Vessel field properties.title ordered asc unique
index vessels_by_trade on node Vessel field properties.trade required
index lies_by_metres on edge lies field properties.metres ordered desc
"""


def test_schema_language(spark):
    d = language.parse(SCHEMA)
    vessel = d.nodes[0]
    assert (d.name, d.version, d.mode, d.domain) == ("Port of call", "2026.1", "strict", "11111111-2222-4333-8444-555555555555")
    assert vessel.labels == ["Vessel", "Ship"] and d.nodes[1].labels == ["Quay"] and [f.required for f in vessel.properties] == [True, False, True] and vessel.properties[2].values == ["tug", "ferry", "dredger"]
    assert [(e.source, e.target, e.hierarchy, e.labels) for e in d.edges] == [(["Vessel"], ["Quay"], False, ["lies"]), (["Ship"], ["Vessel"], True, ["escorts", "guards"])]
    assert not d.edges[0].properties[0].required and [(i.ordered, i.direction, i.unique, i.required) for i in d.indexes] == [(True, "asc", True, False), (False, "", False, True), (True, "desc", False, False)]
    assert language.problems(d) == [] and language.parse(SCHEMA).hash() == d.hash() != language.parse(SCHEMA.replace("strict", "warn")).hash()
    assert vessel.struct()["flags"].dataType.simpleString() == "array<string>"
    assert language.parse('node A {\n  s: string   # has "quoted # marks" // too\n}').nodes[0].properties[0].name == "s"


@pytest.mark.parametrize(
    "bad, line",
    [
        ("node A {", 1), ("}", 1), ("what x", 1), ("schema a mode odd", 1), ("schema a b", 1), ("schema a domain 12", 1), ('schema "a', 1), ("\n\nindex x on node", 3), ("node A {\n  a string\n}", 2), ("node A {\n  a: blob\n}", 2),
        ("node A\nindex i on node A field properties.x sideways", 2), ("index i on part A field properties.x", 1), ("index i on node A field x", 1), ("edge e from A", 1), ("edge e from A to B upwards", 1), ("node", 1), ("node A {\n a: string maybe\n}", 2), ("node A {\n a: enum enum\n}", 2),
    ],
)
def test_schema_errors_carry_their_line(bad, line):
    with pytest.raises(errors.SchemaProblem, match=f"line {line}:"):
        language.parse(bad)


def test_schema_problems():
    odd = language.parse("node A labels X\nnode B labels X\nnode A {\n t: string[]\n}\nedge E from Q to A\nindex i on node B field properties.z\nindex i on node A field payload.z")
    assert len(language.problems(odd)) == 6


def test_violations(spark):
    d = language.parse(SCHEMA)
    df = spark.createDataFrame([("k1", "Osprey", ["x"], "ferry", None), ("k2", None, None, "raft", 7)], "id string, title string, flags array<string>, trade string, extra int")
    got = {(r.id, r.field, r.rule) for r in violations.of_fields(df, d.nodes[0], "id").collect()}
    assert got == {("k2", "title", "missing"), ("k2", "trade", "mistyped"), ("k2", "extra", "unknown")}
    assert violations.of_fields(df, d.nodes[0], "id", "permissive").count() == 0
    n = spark.createDataFrame([("k1", ["Vessel", "Whale"]), ("k2", ["Ship"])], "id string, labels array<string>")
    assert [(r.id, r.field) for r in violations.of_labels(n, d).collect()] == [("k1", "Whale")]
    e = spark.createDataFrame([("e1", "k1", "k2"), ("e2", "k1", "k9")], "edge_id string, src string, dst string")
    ends = spark.createDataFrame([("k1", "Vessel"), ("k2", "Vessel")], "id string, label string")
    assert {(r.id, r.rule) for r in violations.of_ends(e, ends, d.edges[0]).collect()} == {("e1", "to"), ("e2", "to")}
    u = spark.createDataFrame([("k1", "x"), ("k2", "x"), ("k3", None), ("k4", None)], "id string, title string")
    assert [r.id for r in violations.of_unique(u, d.nodes[0], "title", "id").collect()] == ["k2"]


def test_journal_and_versions(spark):
    j = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "scope string, revision int")
    f = spark.createDataFrame([("a", 2), ("a", 3)], "scope string, fence int")
    assert sorted(map(tuple, versions.compact(j, f).collect())) == [("a", 2), ("a", 3), ("b", 1)]
    assert [r.revision for r in versions.journal_after(j, 1).collect()] == [2, 3]
    steps = spark.createDataFrame([("a",), ("b",), ("c",)], "step string")
    needs = spark.createDataFrame([("b", "a"), ("c", "b")], "step string, needs string")
    assert [r.step for r in catalogs.ready_steps(steps, needs, steps.limit(0).unionByName(spark.createDataFrame([("a",)], "step string"))).collect()] == ["b"]
