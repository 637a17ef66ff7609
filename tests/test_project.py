"""From sources to graph, store, sync, snapshots and tools, on one small mixed workspace."""

import io
import json
import subprocess

import pytest

from gneiss import cli
from gneiss.functions import text
from gneiss.operators import chunks, store
from gneiss.plans import answers, index, project
from gneiss.sources import layout
from gneiss.streaming import watch

FILES = {
    "src/main/java/demo/JavaCaller.java": "package demo;\npublic class JavaCaller {\n    private Helper helper;\n    public String invokeKotlin(String name) { return new KotlinTarget().greet(name); }\n    public void own() { invokeKotlin(\"a\"); helper.help(1); helper.base(); \"x\".length(); }\n}\n",
    "src/main/java/demo/Helper.java": "package demo;\n@Singleton public class Helper extends Base implements Svc { void help(int a) { base(); } @Inject Helper(Svc s) { } }\nclass Base { void base() { } }\ninterface Svc { }\n",
    "src/main/kotlin/demo/KotlinTarget.kt": "package demo\nclass KotlinTarget {\n    fun greet(name: String) = \"hi $name\"\n    fun callsJava() = JavaCaller().invokeKotlin(\"Leo\")\n}\n",
}
GREET, INVOKE = "demo.KotlinTarget.greet(String)", "demo.JavaCaller.invokeKotlin(java.lang.String)"


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, content in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.email=a@b", "-c", "user.name=a", "commit", "-qm", "x"]):
        subprocess.run(["git", *args], cwd=root, check=True)
    return root


@pytest.fixture(scope="module")
def built(spark, repo):
    return project.build(spark, layout.resolve(str(repo))[0])


def test_graph(built):
    edges = {(r["from_id"], r["to_id"]) for r in built.edges.collect()}
    own = "demo.JavaCaller.own()"
    assert {(own, INVOKE), (own, "demo.Helper.help(int)"), (own, "demo.Base.base()"), (own, 'UNRESOLVED:"x".length()'), (INVOKE, GREET), ("demo.KotlinTarget.callsJava()", INVOKE), ("demo.Helper", "demo.Helper")} <= edges
    assert built.parsed_files == 3 and built.counters["across"] == 2 and built.counters["added"] == 1
    helper = built.symbols.filter("id = 'demo.Helper'").first()
    assert helper["guice"]["singleton"] and helper["super_class"] == "Base" and helper["file_path"] == "src/main/java/demo/Helper.java"


def test_chunks(spark, built):
    rows = {r["id"]: r for r in chunks.build(built.symbols, built.edges, spark.createDataFrame([("src/main/java", "j"), ("src/main", "m")], "root string, name string")).collect()}
    lines = rows[INVOKE]["text"].splitlines()
    assert lines[:3] == [f"[METHOD] {INVOKE}", "Module: j", "Class: demo.JavaCaller"] and f"Callees: {GREET}" in lines
    meta = json.loads(rows[GREET]["metadata"])
    assert (meta["fqn"], meta["kind"], meta["module"], meta["callers"]) == (GREET, "METHOD", "m", INVOKE)


def test_index_search_and_sync(spark, repo, tmp_path):
    workspace, state = layout.resolve(str(repo))[0], str(tmp_path)
    target = index.Store(spark, str(tmp_path / "store"), "c")
    with pytest.raises(FileNotFoundError):
        index.sync(spark, workspace, state, target)
    done = index.index(spark, workspace, state, target)
    assert done["parsedFiles"] == 3 and done["indexedSymbols"] == target.rows().count() > 8
    assert "greet" in target.search("greet Kotlin target", top=3).first()["content"]
    assert index.sync(spark, workspace, state, target)["indexedSymbols"] == 0
    (repo / "src/main/kotlin/demo/More.kt").write_text("package demo\nfun more() = 1\n")
    assert index.sync(spark, workspace, state, target)["added"] == 1
    assert target.rows().filter("file like '%More.kt'").count() == 2
    (repo / "src/main/kotlin/demo/More.kt").unlink()
    query = watch.watch(spark, workspace, state, target, str(tmp_path / "stream"), once=True)
    query.awaitTermination(300)
    assert target.rows().filter("file like '%More.kt'").count() == 0
    target.remove_matching("file", "src/main/java/demo/Helper.java")
    assert target.rows().filter("file like '%Helper.java'").count() == 0
    target.remove_all()
    assert target.rows().count() == 0


def test_tools_snapshot_and_drift(spark, repo, built, tmp_path):
    workspace, state = layout.resolve(str(repo))[0], str(tmp_path)
    tools = answers.Tools(spark, workspace, built, state)
    assert tools.blast_radius("KotlinTarget.greet")["callers"][0] == INVOKE
    assert "error" in tools.callers("demo.Unknown.missing()")
    assert "error" in tools.ownership()
    answers.analyse_history(spark, str(repo), state, 0, 1)
    assert tools.ownership("Helper") == {"src/main/java/demo/Helper.java": "a@b"}
    assert {h["file"] for h in tools.hotspots(0)} == {f for f in FILES}
    requests = [{"id": 1, "method": "initialize"}, {"method": "notified"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "callees", "arguments": {"symbol": INVOKE}}}, {"id": 4, "method": "nothing"}]
    out = io.StringIO()
    cli.serve(tools, [json.dumps(r) for r in requests], out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, 4] and GREET in replies[2]["result"]["content"][0]["text"] and "error" in replies[3]
    a = answers.save_snapshot(spark, built, workspace, state, "one two")
    assert a.endswith("-one-two.json")
    saved = json.load(open(a))
    assert saved["totalEdges"] == built.edges.count() and saved["schemaVersion"] == 1 and saved["nodesByKind"]["CLASS"] == 5
    same = answers.drift(spark, a, a)
    assert all(r["delta"] == 0 for r in same["counters"].collect()) and same["top"].count() == 0


def test_command_line(spark, repo, tmp_path, capsys):
    state = str(tmp_path / "s")
    assert cli.main(["index", "--repo", str(repo), "--state-dir", state, "--benchmark-json", str(tmp_path / "b/x.json")], spark) == 0
    assert json.load(open(tmp_path / "b/x.json"))["totalParsedFiles"] == 3
    assert cli.main(["query", "greet", "--repo", str(repo), "--state-dir", state], spark) == 0
    assert cli.main(["blast-radius", "greet", "--repo", str(repo)], spark) == 0
    assert INVOKE in capsys.readouterr().out
    assert cli.main(["blast-radius", "nothing-like-it", "--repo", str(repo)], spark) == 1
    assert cli.main(["install", "--project-dir", str(tmp_path)]) == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalar_functions(spark):
    from pyspark.sql import functions as F

    lit = F.lit
    assert [one(spark, text.arity(lit(s))) for s in ("f()", "f(A)", "f(Map<K, V>, (A, B) -> C)", "f", None)] == [0, 1, 2, 0, 0]
    assert one(spark, text.table_name(lit("My-Repo__Module"))) == "embeddings_my_repo_module"
    assert [one(spark, text.table_name(lit(s))) for s in (" ", "9a")] == ["embeddings_collection", "embeddings_c_9a"]
    assert one(spark, text.signed_delta(lit(1), lit(3))) == "1 → 3  (+2)"
    assert [one(spark, text.duration(lit(s))) for s in (-5, 61, 3723)] == ["0m 00s", "1m 01s", "1h 02m 03s"]
    assert one(spark, text.relative_to(lit("/a/b/c"), lit("/a/"))) == "b/c"
    assert [one(spark, store.coerced_number(lit(s))) for s in ("42.0", "3e9", "1.5", "x")] == ["INTEGER:42", "LONG:3000000000", "FLOAT", None]
    assert one(spark, text.gradle_path(lit(":services:pay.ments"))) == "services/pay/ments"


def test_store_rows_from_the_caller(spark, tmp_path):
    from pyspark.sql import functions as F

    from gneiss.functions import vectors

    target = index.Store(spark, str(tmp_path), "c")
    assert target.add_all(["a", "b"], [[1, 0], [0, 1]], ["A", "B"], [{"file": "F", "module": "m"}, {}]) == 2
    assert target.add_all(["b"], [[1, 1]], ["B2"]) == 2
    assert {r["id"]: (r["content"], list(r["vector"])) for r in target.rows().collect()} == {"a": ("A", [1.0, 0.0]), "b": ("B2", [1.0, 1.0])}
    assert target.remove_ids(spark.createDataFrame([("a",)], "id string")) == 1
    with pytest.raises(ValueError, match="length"):
        target.add_all(["a"], [], [])
    assert list(one(spark, vectors.decoded(vectors.encoded(F.array(F.lit(0.5), F.lit(-2.0)))))) == [0.5, -2.0]
    for bad in (b"", b"abc"):
        with pytest.raises(ValueError, match="bytes"):
            vectors.from_bytes(bad)


def test_files_by_module(spark):
    files = spark.createDataFrame([("a/x.java",), ("a/b/y.java",), ("ab/z.java",), (" ",)], "file_path string")
    roots = spark.createDataFrame([("a", "one"), ("a/b", "two")], "root string, name string")
    assert {r["module"]: r["files"] for r in chunks.files_by_module(files, roots).collect()} == {"one": ["a/x.java"], "two": ["a/b/y.java"], "unknown": [" ", "ab/z.java"]}


def test_store_search_fixture(spark):
    rows = spark.createDataFrame([("apple", [1.0, 0.0, 0.0], '{"module":"m1"}'), ("banana", [0.0, 1.0, 0.0], '{"module":"m2","file":"Banana.java"}')], "id string, vector array<float>, metadata string")
    query = [0.98, 0.05, 0.0]
    assert [r["id"] for r in store.search(rows, query, 5).collect()] == ["apple", "banana"]
    assert [r["id"] for r in store.search(rows, query, 0).collect()] == ["apple"]
    assert [r["id"] for r in store.search(rows, query, 5, module="m2").collect()] == ["banana"]
    assert store.delete_matching(rows, "file", "Banana.java").count() == 1 and store.delete_matching(rows).count() == 0
    with pytest.raises(Exception, match="dimension"):
        store.search(rows, [1.0]).collect()
