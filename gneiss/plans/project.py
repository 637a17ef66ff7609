"""From source files to the call graph: parse, qualify, bind, link."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from gneiss.functions import annotations
from gneiss.operators import graph, resolve
from gneiss.operators.chunks import FIELDS, complete
from gneiss.sources import buildfiles, files
from gneiss.sources import java as java_source
from gneiss.sources import kotlin as kotlin_source
from gneiss.sources.layout import Workspace

ANNOTATION = "struct<name:string,args:array<struct<name:string,value:string>>>"
SYMBOL = ", ".join(
    f"{k} {t}" for k, t in FIELDS.items() if k not in ("spring", "guice", "callers", "callees", "depends_on", "module", "node_seq")
) + f", raw_annotations array<{ANNOTATION}>, supertypes array<string>, parents array<string>, injection string, package string, imports map<string,string>, wildcards array<string>, many boolean"
SITE = "caller_id string, op string, name string, arity int, receiver_text string, receiver_kind string, receiver_type string, class_id string, package string, imports map<string,string>, wildcards array<string>, expr string, is_lambda_param boolean, file_path string, line int, origin string"
# Types that every Java file knows without an import.
JAVA_LANG = "Object String Integer Long Short Byte Double Float Boolean Character Number CharSequence Iterable Runnable Comparable Class Exception RuntimeException Throwable Error Void Enum Record Thread AutoCloseable StringBuilder".split()


@dataclass
class Project:
    """The graph of one workspace."""

    symbols: DataFrame
    edges: DataFrame
    parsed_files: int
    unresolved: int
    counters: dict[str, int]


#: Symbols and sites that go to Spark at once; those of one file stay together.
BATCH_ROWS = 4096


def arrow_column(values: list, kind: pa.DataType) -> pa.Array:
    """Values of a field; structs are taken apart, as one column each is made faster than from row to row."""
    if not any(v is not None for v in values):
        return pa.nulls(len(values), kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays([arrow_column([None if v is None else v.get(f.name) for v in values], f.type) for f in kind], fields=list(kind), mask=pa.array([v is None for v in values]))
    if pa.types.is_map(kind):
        return pa.array([None if v is None else list(v.items()) for v in values], kind)
    return pa.array(values, kind)


def some(fields: str, *names: str) -> str:
    """Those of SYMBOL's or SITE's fields that are named."""
    return ", ".join(f for f in fields.split(", ") if f.split(" ", 1)[0] in names)


def parse(sources: DataFrame, symbols: str = SYMBOL, sites: str = SITE) -> DataFrame:
    """seq, and `symbol` and `site` with the fields wanted, of every file; a Java file that cannot be parsed ends the run.

    A row has a symbol or a site; without fields, there is neither column nor row of that kind. Files are parsed in
    the partitions they come in.
    """
    fields = ["seq string", f"symbol struct<{symbols}>" if symbols else "", f"site struct<{sites}>" if sites else ""]
    schema = StructType.fromDDL(", ".join(x for x in fields if x))
    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple[str, dict | None, dict | None]]) -> pa.RecordBatch:
        seq, symbol, site = map(list, zip(*rows, strict=True))
        held = {"seq": seq, "symbol": symbol, "site": site}
        return pa.RecordBatch.from_arrays([arrow_column(held[f.name], f.type) for f in arrow], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, dict | None, dict | None]] = []
        for batch in batches:
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content")), strict=True):
                found, calls = (java_source if language == "JAVA" else kotlin_source).parse(path, content.decode("utf-8", "replace"), bool(sites))
                if symbols:
                    rows += [(f"{language}:{path}:{i:08d}", s, None) for i, s in enumerate(found)]
                if sites:
                    rows += [(f"{language}:{path}:{i:08d}", None, s) for i, s in enumerate(calls, len(found))]
                if len(rows) >= BATCH_ROWS:
                    yield batch_of(rows)
                    rows = []
        if rows:
            yield batch_of(rows)

    return sources.select("path", "language", "content").mapInArrow(run, schema)


def classified(symbols: DataFrame) -> DataFrame:
    """Symbols with what their annotations say."""
    kotlin = F.col("language") == "KOTLIN"
    target, supers, raw = F.coalesce("injection", F.lit("NONE")), F.coalesce("supertypes", F.array().cast("array<string>")), F.col("raw_annotations")
    return symbols.withColumn("spring", F.when(kotlin, annotations.spring(raw, True)).otherwise(annotations.spring(raw))).withColumn("guice", F.when(kotlin, annotations.guice(raw, target, supers, True)).otherwise(annotations.guice(raw, target, supers)))


def named_classes(references: DataFrame, catalogue: DataFrame, key: str) -> DataFrame:
    """key, fq: the class that `name` means in a file with this package, these imports and wildcards.

    An import goes before the file's package, that before its wildcards; a written-out name is tried as it is.
    """
    simple = F.substring_index(F.substring_index("name", "<", 1), ".", -1)
    candidates = F.concat(F.array(F.substring_index("name", "<", 1), F.col("imports")[simple], F.concat_ws(".", F.nullif("package", F.lit("")), simple)), F.transform("wildcards", lambda w: F.concat(w, F.lit("."), simple)))
    tried = references.select(key, F.posexplode(candidates).alias("rank", "fq")).filter("fq is not null")
    found = tried.join(catalogue.select(F.col("id").alias("fq")).distinct(), "fq", "left_semi")
    return found.groupBy(key).agg(F.min_by("fq", "rank").alias("fq"))


def qualified_ids(callables: DataFrame, catalogue: DataFrame) -> DataFrame:
    """id, final_id of Java methods: `class.name(types with packages)` where every type is known, else the id as it is."""
    methods = callables.filter("kind = 'METHOD' and language = 'JAVA'").select("id", "declaring_class_id", "name", "params", "package", "imports", "wildcards", "many")
    types = F.transform("params", lambda p: p["type"])
    words = F.array_distinct(F.flatten(F.transform(types, lambda t: F.regexp_extract_all(t, F.lit(r"([\w.$]+)")))))
    used = methods.select("id", "package", "imports", "wildcards", F.explode(words).alias("name")).filter(~F.col("name").isin(*java_source.PRIMITIVES, "extends", "super"))
    used = used.withColumn("ref", F.concat_ws("\x1f", "id", "name"))
    known = named_classes(used, catalogue, "ref")
    imported = F.col("imports")[F.col("name")]
    outside = F.when(F.col("name").contains("."), F.col("name")).when(F.col("name").isin(*JAVA_LANG), F.concat(F.lit("java.lang."), "name")).when(F.col("name").rlike("^[A-Z]{1,2}[0-9]?$"), F.col("name"))
    meant = used.join(known, "ref", "left").select("id", "name", F.coalesce("fq", imported, outside).alias("fq"))
    maps = meant.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("name", "fq"))).alias("meant"), F.max(F.col("fq").isNull()).alias("unknown"))

    @F.udf("string", useArrow=True)
    def spelled(owner, name, kinds, meant, many):
        out = [re.sub(r"[\w.$]+", lambda m: (meant or {}).get(m.group()) or m.group(), k) for k in kinds]
        if many and out:
            out[-1] += "..."
        return f"{owner}.{name}({', '.join(out)})"

    joined = methods.join(maps, "id", "left")
    return joined.select("id", F.when(F.coalesce("unknown", F.lit(False)), F.col("id")).otherwise(spelled("declaring_class_id", "name", types, "meant", "many")).alias("final_id"))


def ancestors(classes: DataFrame) -> DataFrame:
    """class_id, ancestor, depth: each class, what it extends and implements, and so on, nearest depth first."""
    parents = classes.select(F.col("id").alias("class_id"), "package", "imports", "wildcards", F.explode("parents").alias("name")).withColumn("ref", F.concat_ws("\x1f", "class_id", "name"))
    direct = graph.scratch(parents.select("ref", "class_id").join(named_classes(parents, classes, "ref"), "ref").select("class_id", F.col("fq").alias("parent")).distinct())
    all_ = frontier = classes.select(F.col("id").alias("class_id"), F.col("id").alias("ancestor"), F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        step = frontier.join(direct.withColumnRenamed("class_id", "ancestor"), "ancestor").select("class_id", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).distinct()
        frontier = graph.scratch(step.join(all_.select("class_id", "ancestor"), ["class_id", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            break
        all_ = all_.unionByName(frontier)
    return all_


def java_bindings(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites with `target`: the one method of that name and arity in the nearest class or ancestor that has any."""
    classes = symbols.filter("kind = 'CLASS' and language = 'JAVA'")
    named = named_classes(sites.filter("receiver_kind = 'TYPE'").select("site", F.col("receiver_type").alias("name"), "package", "imports", "wildcards"), classes, "site")
    start = sites.join(named, "site", "left").withColumn("start", F.when(F.col("receiver_kind").isin("THIS", "SUPER"), F.col("class_id")).otherwise(F.col("fq"))).drop("fq")
    lines = ancestors(classes)
    methods = symbols.filter("kind = 'METHOD' and language = 'JAVA'").select(F.col("declaring_class_id").alias("ancestor"), "name", F.size("params").alias("arity"), F.col("id").alias("method"))
    keyed = methods.groupBy("ancestor", "name", "arity").agg(F.count("*").alias("n"), F.min("method").alias("method"))
    tried = start.filter("start is not null").select("site", "name", "arity", F.col("start").alias("class_id"), F.when(F.col("receiver_kind") == "SUPER", 1).otherwise(0).alias("least"))
    found = tried.join(lines, "class_id").filter("depth >= least").join(keyed, ["ancestor", "name", "arity"])
    nearest = found.groupBy("site").agg(F.min_by(F.struct("n", "method"), F.struct("depth", "ancestor")).alias("m"))
    return sites.join(nearest, "site", "left").withColumn("target", F.when(F.col("m.n") == 1, F.col("m.method"))).drop("m")


def build(spark: SparkSession, workspace: Workspace) -> Project:
    """The graph of a workspace's sources, build files included if it has several modules."""
    java_roots = [r for m in workspace.modules for r in m.java_roots]
    kotlin_roots = [r for m in workspace.modules for r in m.kotlin_roots]
    sources = files.read_files(spark, java_roots, workspace.root, ("JAVA",)).unionByName(files.read_files(spark, kotlin_roots, workspace.root, ("KOTLIN",)))
    modules = None
    if workspace.several:
        rows = [{"name": m.name, "root": m.root} for m in workspace.modules]
        dependencies = spark.createDataFrame(buildfiles.module_dependencies(rows) or [("", "")], "module string, depends_on string").filter("module <> ''")
        modules = graph.module_edges(spark.createDataFrame([(m.name,) for m in workspace.modules], "name string"), dependencies)
    return from_sources(sources, modules)


@dataclass
class Links:
    """What sources hold and how it is bound, as tables that from_sources() sums up."""

    symbols: DataFrame
    edges: DataFrame
    placeholders: DataFrame
    left: tuple[DataFrame, DataFrame]  # records of Java and Kotlin calls that their own language left over
    across: DataFrame
    injected: DataFrame


def linked(sources: DataFrame) -> Links:
    """The symbols of files(path, language, content) and the edges between them; edges may repeat."""
    rows = graph.scratch(parse(sources))
    raw = rows.filter("symbol is not null").select(F.col("seq").alias("node_seq"), "symbol.*")
    sites = rows.filter("site is not null").select(F.col("seq").alias("__seq"), "site.*").withColumnRenamed("__seq", "site")
    raw = graph.scratch(classified(raw))
    final = graph.scratch(qualified_ids(raw, raw.filter("kind = 'CLASS' and language = 'JAVA'")).distinct())

    def renamed(df: DataFrame, column: str) -> DataFrame:
        new = final.select(F.col("id").alias("__old"), "final_id")
        return df.join(new, df[column] == new["__old"], "left").withColumn(column, F.coalesce("final_id", column)).drop("__old", "final_id")

    symbols = graph.scratch(graph.node_set(renamed(raw, "id")))
    sites = graph.scratch(renamed(sites, "caller_id"))
    java = graph.scratch(java_bindings(sites.filter("origin = 'JAVA'"), symbols))
    java_id = F.concat(F.lit("UNRESOLVED:"), "expr")
    left = java.filter("target is null")
    edges = java.select(F.col("caller_id").alias("from_id"), F.coalesce("target", java_id).alias("to_id"))
    nodes = left.select(java_id.alias("id"), F.lit("UNRESOLVED").alias("kind"), F.col("expr").alias("expression"), "file_path", "line")
    java_records = left.select("caller_id", F.col("name").alias("callee_name"), "arity", java_id.alias("unresolved_id"))

    callables = symbols.filter("language = 'KOTLIN' and kind in ('METHOD', 'CONSTRUCTOR')").select("id", "name", F.size("params").alias("arity"), "receiver_type")
    kotlin_edges, kotlin_nodes, kotlin_records = resolve.bind(sites.filter("origin = 'KOTLIN'"), callables)
    edges = edges.unionByName(kotlin_edges)
    nodes = nodes.unionByName(kotlin_nodes.withColumnRenamed("expr", "expression")).dropDuplicates(["id"])
    java_records, kotlin_records = graph.scratch(java_records), graph.scratch(kotlin_records)
    java_methods = symbols.filter("language = 'JAVA' and kind in ('METHOD', 'CONSTRUCTOR')").select("id", "name", F.size("params").alias("arity"), "receiver_type")
    across = resolve.cross_language(java_records, callables, True).unionByName(resolve.cross_language(kotlin_records, java_methods, False))
    across = graph.scratch(across)
    edges, nodes = resolve.rewrite(edges, nodes, across)

    points = injection_points(symbols)
    injected = graph.scratch(resolve.injection(points, symbols.filter("kind = 'CLASS'")))
    edges = edges.unionByName(resolve.injection_edges(injected))
    return Links(symbols, edges, nodes, (java_records, kotlin_records), across, injected)


def from_sources(sources: DataFrame, modules: tuple[DataFrame, DataFrame] | None = None) -> Project:
    """The graph of files(path, language, content); modules are nodes and edges to add."""
    found = linked(sources)
    symbols, edges, nodes, across, injected = found.symbols, found.edges, found.placeholders, found.across, found.injected
    java_records, kotlin_records = found.left
    whole = complete(symbols).select(*FIELDS).unionByName(complete(nodes.withColumn("node_seq", F.concat(F.lit("UNRESOLVED:"), "id"))).select(*FIELDS))
    if modules is not None:
        module_nodes, module_edges = modules
        whole = whole.unionByName(complete(module_nodes.withColumn("node_seq", F.concat(F.lit("~"), "id"))).select(*FIELDS))
        edges = edges.unionByName(module_edges)
    counts = resolve.injection_counters(injected).first().asDict()
    bridged = across.filter("match is not null").count()
    return Project(graph.scratch(whole), graph.scratch(graph.edge_set(edges)), sources.select("path").distinct().count(), max(0, java_records.count() + kotlin_records.count() - bridged), counts | {"across": bridged})


def injection_points(symbols: DataFrame) -> DataFrame:
    """owner_id, type, file_path of what Inject marks: every parameter of a constructor, and fields."""
    marked: Column = F.col("guice.injection_type")
    constructors = symbols.filter(marked == "CONSTRUCTOR").select(F.col("declaring_class_id").alias("owner_id"), F.explode("params").alias("p"), "file_path").select("owner_id", F.col("p.type").alias("type"), "file_path")
    return constructors.unionByName(symbols.filter((marked == "FIELD") & (F.col("kind") == "FIELD")).select(F.col("declaring_class_id").alias("owner_id"), F.col("field_type").alias("type"), "file_path"))
