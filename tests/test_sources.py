"""Parsers, build files, layouts and settings."""

import os

import pytest

from gneiss.plans import config
from gneiss.sources import buildfiles, gitlog, java, kotlin, layout
from gneiss.sources.lexing import SourceError


def kt(source, path="src/main/kotlin/demo/File.kt"):
    symbols, sites = kotlin.parse(path, source)
    return {s["id"]: s for s in symbols}, sites


def test_kotlin_symbols():
    symbols, _ = kt("package demo\n@RestController class Hello(val message: String) { @GetMapping(\"/hello\") fun hello(): String = message }")
    assert set(symbols) == {"demo.Hello", "demo.Hello#Hello(String)", "demo.Hello#message", "demo.Hello.hello()"}
    assert symbols["demo.Hello#message"]["field_type"] == "val String"
    assert symbols["demo.Hello"]["annotations"] == ["@RestController"]
    assert symbols["demo.Hello.hello()"]["raw_annotations"] == [{"name": "GetMapping", "args": [{"name": "", "value": '"/hello"'}]}]


def test_kotlin_data_class_object_facade_and_receiver():
    symbols, _ = kt("package demo\ndata class User(val name: String, var age: Int)\nobject Counter { var value: Int = 0\n fun increment() { value += 1 } }\nfun square(value: Int) = value * value\nfun String.shout() = this", "x/mathUtils.kt")
    assert symbols["demo.User#age"]["field_type"] == "var Int"
    assert {"demo.Counter", "demo.Counter#value", "demo.Counter.increment()", "demo.MathUtilsKt", "demo.MathUtilsKt.square(Int)"} <= set(symbols)
    assert symbols["demo.MathUtilsKt.shout()"]["receiver_type"] == "String"
    assert symbols["demo.MathUtilsKt"]["annotations"] == ["@FileFacade"]


def test_kotlin_supertypes_and_nested_classes():
    symbols, _ = kt("package demo\nclass GreeterModule(x: Int) : AbstractModule(), Greeter<Int>, a.b.C { class Inner { fun f() {} } companion object { fun of() = 1 } }")
    row = symbols["demo.GreeterModule"]
    assert (row["super_class"], row["interfaces"]) == ("AbstractModule", ["Greeter", "C"])
    assert {"demo.GreeterModule.Inner.f()", "demo.GreeterModule.Companion.of()"} <= set(symbols)


@pytest.mark.parametrize(
    ("body", "wanted"),
    [
        ("add(1, 2)", [("CALL", "add", 2, "")]),
        ("this + other", [("BINARY", "plus", 1, "")]),
        ("{ var c = this; return ++c }", [("PREFIX", "inc", 0, "")]),
        ("this[i, i]", [("INDEX_GET", "get", 2, "")]),
        ("{ this[i] = 42 }", [("INDEX_SET", "set", 2, "")]),
        ("s.shout()", [("CALL", "shout", 0, "s")]),
        ("s?.shout()", [("CALL", "shout", 0, "")]),
        ("list.map { it.go() }", [("CALL", "map", 1, "list"), ("CALL", "go", 0, "it")]),
        ('"a ${name(1)} b"', [("CALL", "name", 1, "")]),
        ("{ if (a < b) { run(x) } else { -x } }", [("BINARY", "compareTo", 1, ""), ("CALL", "run", 1, ""), ("PREFIX", "unaryMinus", 0, "")]),
        ("listOf<Map<String, Int>>()", [("CALL", "listOf", 0, "")]),
        ("{ val f = object : Foo(1) { }; when (x) { is Bar -> go() } }", [("CALL", "go", 0, "")]),
        ("{ x++ ; y -= 1 ; a..b }", [("POSTFIX", "inc", 0, ""), ("BINARY", "minusAssign", 1, ""), ("BINARY", "rangeTo", 1, "")]),
    ],
)
def test_kotlin_call_sites(body, wanted):
    _, sites = kt(f"package demo\nclass A {{ fun f(i: Int) {'= ' if not body.startswith('{') else ''}{body} }}")
    assert [(s["op"], s["name"], s["arity"], s["receiver_text"]) for s in sites] == wanted


def test_kotlin_lambda_parameter_is_known():
    _, sites = kt("package demo\nfun process(handler: (String) -> String, input: String) = handler(input)")
    assert [(s["name"], s["is_lambda_param"]) for s in sites] == [("handler", True)]


JAVA = """package demo;
import other.Repo;
@Service
public class Ctl extends Base implements Greeter, Runnable {
    @Inject private Service svc;
    int a, b[] = {1, 2};
    @Inject public Ctl(Service svc, Repo... all) { this.svc = svc; init(); super.foo(); }
    @GetMapping(value = "/x") public List<String> hello(String name) {
        Repo r = all[0];
        r.save(name).flush();
        this.svc.greet(name);
        new Query(2).run();
        for (String s : names) { s.trim(); }
        return Util.help(1, 2);
    }
    interface Nested { default void d() { go(1); } }
    enum Color { RED(1), BLUE; int v() { return w(); } }
}
"""


def test_java_symbols_order_and_details():
    symbols, _ = java.parse("src/main/java/demo/Ctl.java", JAVA)
    assert [s["id"] for s in symbols] == ["demo.Ctl#svc", "demo.Ctl#a", "demo.Ctl#b", "demo.Ctl#Ctl(Service, Repo)", "demo.Ctl#hello(String)", "demo.Nested#d()", "demo.Nested", "demo.Ctl#v()", "demo.Ctl"]
    row = symbols[-1]
    assert (row["super_class"], row["interfaces"], row["annotations"], row["line"]) == ("Base", ["Greeter", "Runnable"], ["@Service"], 3)
    assert symbols[2]["field_type"] == "int[]"


def test_java_call_sites_know_their_receivers():
    _, sites = java.parse("src/main/java/demo/Ctl.java", JAVA)
    found = [(s["name"], s["arity"], s["receiver_kind"], s["receiver_type"]) for s in sites]
    assert found == [("init", 0, "THIS", ""), ("foo", 0, "SUPER", ""), ("save", 1, "TYPE", "Repo"), ("flush", 0, "UNKNOWN", ""), ("greet", 1, "TYPE", "Service"), ("run", 0, "TYPE", "Query"), ("trim", 0, "TYPE", "String"), ("help", 2, "TYPE", "Util"), ("go", 1, "THIS", ""), ("w", 0, "THIS", "")]


@pytest.mark.parametrize(
    "body, wanted",
    [
        ("{ A x = new A(); x.go(); } { B x = new B(); x.go(); } x.go();", ["A", "B", "F"]),
        ("for (A x : as) x.go(); x.go(); for (B x : bs) { if (y) { x.go(); } } x.go();", ["A", "F", "B", "F"]),
        ("try (A x = open()) { x.go(); } catch (B x) { x.go(); } finally { x.go(); }", ["A", "B", "F"]),
        ("A x = a(); run(() -> { x.go(); }); this.x.go(); x.go();", ["A", "F", "A"]),
    ],
)
def test_java_names_hold_in_their_blocks(body, wanted):
    _, sites = java.parse("A.java", "class A { F x; void f() { " + body + " } }")
    assert [s["receiver_type"] for s in sites if s["name"] == "go"] == wanted


@pytest.mark.parametrize(
    "source, symbols, calls",
    [
        ("fun a() { b() }\nfun c() { d( }\nfun e() { f() }", "ace", [("a", "b"), ("c", "d"), ("e", "f")]),
        ("fun a() { b() }\nfun c() { if (x) { d() \n}\nfun e() { f() }", "ace", [("a", "b"), ("c", "d"), ("e", "f")]),
        ("fun a() { b() ) }\n}\nfun e() { f() }", "ae", [("a", "b"), ("e", "f")]),
        ("fun a() = \"abc\nfun e() { f(²) }\nfun `x\nfun g() { h() } }", "aeg", [("e", "f"), ("g", "h")]),
        ("fun a() { b() }\nfun e() { f(\"\"\"never", "ae", [("a", "b"), ("e", "f")]),
    ],
)
def test_kotlin_goes_on_after_errors(source, symbols, calls):
    found, sites = kt(source)
    names = {s.removeprefix("FileKt.").removesuffix("()") for s in found if s.startswith("FileKt.")}
    assert set(symbols) <= names
    assert [(s["caller_id"].removeprefix("FileKt.").removesuffix("()"), s["name"]) for s in sites] == calls


def test_broken_java_is_an_error():
    with pytest.raises(SourceError):
        java.parse("A.java", "class A { void f() { }")


def test_settings_forms_comments_and_paths():
    text = 'include("core", ":services:payments")\n// include("no")\n/* include("never") */\ninclude \'api\', "web"\n'
    assert buildfiles.settings_modules(text) == ["core", "services/payments", "api", "web"]
    assert buildfiles.line_comment_start('x = "a//b"') == -1
    assert buildfiles.line_comment_start("a // b") == 2


def test_build_file_dependencies():
    text = "implementation(project(\":core\"))\napi project(':api')\ntestImplementation(project(\":core\"))\nimplementation(\"org:lib:1\")\n// api(project(\":x\"))"
    assert buildfiles.project_dependencies(text) == ["core", "api"]


def test_pom_modules():
    text = '<project xmlns="http://maven.apache.org/POM/4.0.0"><modules><module> core </module><module>a\\b</module></modules></project>'
    assert buildfiles.pom_modules(text) == ["core", "a/b"]
    with pytest.raises(OSError):
        buildfiles.pom_modules("<project>")


def tree(root, *folders, **texts):
    for f in folders:
        os.makedirs(root / f, exist_ok=True)
    for name, text in texts.items():
        (root / name.replace("__", ".")).write_text(text)
    return str(root)


def test_layouts(tmp_path):
    gradle = tree(tmp_path / "g", "core/src/main/java", "api/src/main/kotlin")
    (tmp_path / "g/settings.gradle.kts").write_text('include("core", "api", "../out")')
    assert [(w.name, [m.name for m in w.modules]) for w in layout.detect(gradle)] == [("g", ["core", "api"])]
    (tmp_path / "g/settings.gradle.kts").write_text("rootProject.name = \"g\"")
    assert [m.name for m in layout.detect(gradle)[0].modules] == ["api", "core"]
    maven = tree(tmp_path / "m", "alpha/src/main/java", "beta/src/main/java")
    (tmp_path / "m/pom.xml").write_text("<project><modules><module>alpha</module><module>beta</module></modules></project>")
    assert len(layout.detect(maven)[0].modules) == 2
    single = tree(tmp_path / "s", "src/main/kotlin")
    found = layout.detect(single)[0].modules[0]
    assert found.java_roots == () and len(found.kotlin_roots) == 1
    parent = tree(tmp_path / "p", "a/src/main/java", "b/src/main/java", "build/src/main/java", ".hidden/src/main/java")
    assert [w.name for w in layout.detect(parent)] == ["a", "b"]


def test_settings_precedence(tmp_path):
    state = str(tmp_path)
    assert config.merge(state, config.Config()).db_timeout_seconds == 300
    config.save(state, config.Config(embedding="x", db_timeout_seconds=7, db_file="/there/store"))
    assert config.merge(state, config.Config(db_file="  ")).db_file == "/there/store"
    assert config.merge(state, config.Config(db_file="/x")).db_file == "/x"
    merged = config.merge(state, config.Config(db=" parquet ", db_timeout_seconds=-1))
    assert (merged.db, merged.embedding, merged.db_timeout_seconds) == ("parquet", "x", 1)
    with pytest.raises(ValueError, match="unsupported"):
        config.merge(state, config.Config(db="mongodb"))


def test_log_blocks():
    lines = ["noise\n", "\x1ea\x1fx\x1f1\n", "\n", " f \n", "\x1eb\x1fy\x1f2\n"]
    assert list(gitlog.blocks(iter(lines))) == [("a\x1fx\x1f1", ["f"]), ("b\x1fy\x1f2", [])]


def test_suffixes_in_any_case_and_nested_roots(spark, tmp_path):
    from gneiss.sources import files

    for name in ("A.jAvA", "b/C.kT", "b/d/E.JAVA", "b/F.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    roots = [str(tmp_path / "b"), str(tmp_path), str(tmp_path) + "/", str(tmp_path / "b" / "d")]
    found = sorted((r["path"], r["language"]) for r in files.read_files(spark, roots, str(tmp_path)).collect())
    assert found == [("A.jAvA", "JAVA"), ("b/C.kT", "KOTLIN"), ("b/d/E.JAVA", "JAVA")]
