"""Traversal, lookup, sets, resolution and injection on small graphs."""

from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gneiss.operators import graph, resolve


def edges_of(spark, *pairs):
    return spark.createDataFrame(list(pairs), "from_id string, to_id string")


def ids(df):
    return sorted(r[0] for r in df.collect())


def walk(pairs, start, depth):
    """Callers by level, as plain Python."""
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    seen, level, out = {start}, {start}, {}
    for d in range(1, depth + 1):
        level = {a for b in level for a in back[b]} - seen
        seen |= level
        out |= dict.fromkeys(level, d)
    return out


def test_bfs_levels_cycles_and_bad_depths(spark):
    edges = edges_of(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"))
    assert {r["id"]: r["depth"] for r in graph.reachable(edges, "c", 2).collect()} == {"b": 1, "a": 2}
    assert {r["id"]: r["depth"] for r in graph.reachable(edges, "c", 9).collect()} == {"b": 1, "a": 2, "d": 3}
    assert ids(graph.reachable(edges, "a", 1, callers=False)) == ["b"]
    assert graph.reachable(edges, "c", 0).count() == graph.reachable(edges, "c", -4).count() == graph.reachable(edges, " ", 3).count() == graph.reachable(edges, "nowhere", 3).count() == 0


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=12), st.integers(1, 4))
def test_bfs_equals_a_plain_walk(spark, pairs, depth):
    assert {r["id"]: r["depth"] for r in graph.reachable(edges_of(spark, *pairs), "a", depth).collect()} == walk(pairs, "a", depth)


def test_lookup_prefers_the_exact_id_then_the_first(spark):
    symbols = spark.createDataFrame([("x.Service.process()", 3), ("x.Service.processAll()", 1), ("x.Service", 5)], "id string, node_seq long")
    assert ids(graph.lookup(symbols, "x.Service")) == ["x.Service"]
    assert ids(graph.lookup(symbols, "Service.process")) == ["x.Service.processAll()"]
    assert ids(graph.lookup(symbols, "missing")) == []


def test_sets_of_nodes_and_edges(spark):
    edges = edges_of(spark, ("a", "b"), ("a", "b"), ("", "b"), ("a", " "), ("b", "c"))
    assert graph.edge_set(edges).count() == 2
    nodes = spark.createDataFrame([("a", 1, "old"), ("b", 2, "x"), ("a", 3, "new")], "id string, node_seq long, v string")
    assert sorted((r["id"], r["node_seq"], r["v"]) for r in graph.node_set(nodes).collect()) == [("a", 1, "new"), ("b", 2, "x")]
    kept, left = graph.remove_nodes(nodes, graph.edge_set(edges), spark.createDataFrame([("c",)], "id string"))
    assert (kept.count(), left.count()) == (3, 1)
    assert graph.remove_edges(graph.edge_set(edges), edges_of(spark, ("a", "b"))).count() == 1


def test_module_dependencies(spark):
    modules = spark.createDataFrame([("app-cli",), ("app-core",)], "name string")
    nodes, edges = graph.module_edges(modules, spark.createDataFrame([("app-cli", "app-core"), ("app-cli", "gone")], "module string, depends_on string"))
    assert edges.count() == 1
    assert sorted((r["module"], r["depends_on"]) for r in graph.module_dependencies(nodes, edges).collect()) == [("module:app-cli", "module:app-core"), ("module:app-core", None)]
    assert graph.module_dependencies(nodes, edges, "app-cli").count() == 1


CALLABLES = "id string, name string, arity int, receiver_type string"
SITES = "site string, caller_id string, op string, name string, arity int, receiver_text string, is_lambda_param boolean, expr string, file_path string, line int"


def site(n, name, arity, op="CALL", receiver="", is_lambda=False):
    return (f"s{n}", "caller", op, name, arity, receiver, is_lambda, name, "F.kt", n)


def test_bind_unique_ambiguous_receiver_lambda_and_operators(spark):
    callables = spark.createDataFrame([("add", "add", 2, ""), ("g1", "greet", 1, ""), ("g2", "greet", 1, ""), ("m", "fmt", 0, "Meter"), ("d", "fmt", 0, "Double"), ("p1", "plus", 1, ""), ("p2", "plus", 1, "")], CALLABLES)
    sites = spark.createDataFrame([site(1, "add", 2), site(2, "greet", 1), site(3, "fmt", 0, receiver="Meter"), site(4, "handler", 1, is_lambda=True), site(5, "plus", 1, "BINARY"), site(6, "minus", 1, "BINARY")], SITES)
    edges, nodes, records = resolve.bind(sites, callables)
    to = sorted(r["to_id"] for r in edges.collect())
    assert to == ["UNRESOLVED:LAMBDA:handler/1@caller#s4", "UNRESOLVED:OP:plus/1@caller#s5", "UNRESOLVED:greet/1@caller#s2", "add", "m"]
    assert nodes.count() == records.count() == 3


def test_cross_language_with_extension_and_shared_placeholder(spark):
    records = spark.createDataFrame([("use", "greet", 1, "P1"), ("a", "shout", 1, "P2"), ("b", "shout", 1, "P2"), ("c", "twice", 1, "P3")], "caller_id string, callee_name string, arity int, unresolved_id string")
    callables = spark.createDataFrame([("K.greet", "greet", 1, ""), ("K.shout", "shout", 0, "String"), ("t1", "twice", 1, ""), ("t2", "twice", 1, "")], CALLABLES)
    resolved = resolve.cross_language(records, callables, True)
    assert {r["caller_id"]: r["match"] for r in resolved.collect()} == {"use": "K.greet", "a": "K.shout", "b": "K.shout", "c": None}
    edges = edges_of(spark, ("use", "P1"), ("a", "P2"), ("b", "P2"), ("c", "P3"))
    nodes = spark.createDataFrame([("P1",), ("P2",), ("P3",)], "id string")
    left, kept = resolve.rewrite(edges, nodes, resolved)
    assert sorted((r["from_id"], r["to_id"]) for r in left.collect()) == [("a", "K.shout"), ("b", "K.shout"), ("c", "P3"), ("use", "K.greet")]
    assert ids(kept) == ["P3"]


def test_injection_unique_ambiguous_missing_and_tests(spark):
    classes = spark.createDataFrame([("Impl", ["One"], "src/main/A.java"), ("T1", ["Two"], "src/main/B.java"), ("T2", ["Two"], "src/main/C.java"), ("Fake", ["Three"], "src/test/java/D.java")], "id string, interfaces array<string>, file_path string")
    points = spark.createDataFrame([("Owner", t, "src/main/O.java") for t in ("One", "Two", "Three")] + [("Test", "One", "src/test/O.java")], "owner_id string, type string, file_path string")
    found = resolve.injection(points, classes)
    assert [(r["from_id"], r["to_id"]) for r in resolve.injection_edges(found).collect()] == [("Owner", "Impl")]
    assert tuple(resolve.injection_counters(found).first()) == (1, 1, 1)
