"""How the queries over sources are dealt out, and that a file's rows come whole from parse()."""

import pytest

from gneiss.plans import project, source_queries

SMALL = "/root/testdata/sf0.001"


def working_tables(spark):
    import os

    return {x for x in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) if x.startswith("gneiss-graph-")}


@pytest.mark.parametrize("files", ["java_files", "kotlin_files"])
def test_files_are_dealt_over_all_cores(spark, files):
    found = getattr(source_queries, files)(spark, SMALL)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", ["java_classes", "java_members", "java_call_sites", "kotlin_symbols", "kotlin_call_sites"])
def test_one_pass_writes_no_working_table(spark, name):
    before = working_tables(spark)
    assert getattr(source_queries, name)(spark, SMALL).count() > 0
    assert working_tables(spark) == before


def test_parse_gives_symbols_and_sites_in_one_order(spark, monkeypatch):
    monkeypatch.setattr(project, "BATCH_ROWS", 3)
    texts = [("A.java", "JAVA", "package p; import q.B; class A { B b; @X(y = 1) int f(int... a) { return b.g(a); } }"), ("k.kt", "KOTLIN", "fun f(a: Int) = g(a)"), ("E.java", "JAVA", "")]
    sources = spark.createDataFrame([(p, k, bytearray(t.encode())) for p, k, t in texts], "path string, language string, content binary").coalesce(1)
    rows = project.parse(sources).collect()
    assert [r["seq"] for r in rows] == [f"JAVA:A.java:{i:08d}" for i in range(4)] + [f"KOTLIN:k.kt:{i:08d}" for i in range(3)]
    assert [(r["symbol"] or r["site"])["line"] for r in rows] == [1] * 7 and all((r["symbol"] is None) != (r["site"] is None) for r in rows)
    f, site = rows[1]["symbol"], rows[3]["site"]
    assert (f["id"], f["many"], f["params"], f["imports"]) == ("p.A#f(int)", True, [("a", "int")], {"B": "q.B"})
    assert f["raw_annotations"] == [("X", [("y", "1")])] and f["super_class"] is None
    assert (site["name"], site["receiver_type"], site["imports"], site["wildcards"]) == ("g", "B", {"B": "q.B"}, [])
    assert project.parse(sources, sites="").columns == ["seq", "symbol"] and project.parse(sources, "", "name string").count() == 2


def test_bindings_leave_the_whole_graph_unwritten(spark):
    before = working_tables(spark)
    assert source_queries.java_bindings(spark, SMALL).count() > 0
    new = working_tables(spark) - before
    where = spark.conf.get("spark.checkpoint.dir")
    assert new and not any("callees" in spark.read.parquet(f"{where}/{x}").columns for x in new)


def test_plain_sources_are_cut_without_a_step_for_each_token(monkeypatch):
    from gneiss.sources import java, kotlin, lexing

    texts = [(java, 'package p; /* a\n* b */ class A { // x\n int f(int a) { return g("}", \'{\', 1.5e3); } }'), (kotlin, 'package p\n/* a */ fun f(a: Int) = g("$a }", \'"\')\n')]
    columns = [lexing.tokens(text, k) for k, (_, text) in enumerate(texts)]
    whole = [(m.parse("src/a", text), m.parse("src/a", text, False)) for m, text in texts]
    monkeypatch.setattr(lexing, "plain", lambda *_: None)
    assert [lexing.tokens(text, k) for k, (_, text) in enumerate(texts)] == columns
    for (symbols, sites), (alone, none) in whole:
        assert len(sites) == 1 and symbols == alone and none == []
    assert [m.parse("src/a", text) for m, text in texts] == [found for found, _ in whole]
    # Scanning step by step, as before, is for what has templates and other marks alone.
    monkeypatch.undo()
    monkeypatch.setattr(lexing, "scan", None)
    assert [lexing.tokens(text, k) for k, (_, text) in enumerate(texts)] == columns
