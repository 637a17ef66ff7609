"""Text and metadata of a symbol's chunk, and the module that owns its file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a symbol row may hold besides what it has; see complete().
FIELDS = {
    "id": "string", "kind": "string", "file_path": "string", "line": "int", "node_seq": "string", "simple_name": "string", "declaring_class_id": "string",
    "name": "string", "signature": "string", "return_type": "string", "field_type": "string", "super_class": "string", "interfaces": "array<string>",
    "params": "array<struct<name:string,type:string>>", "modifiers": "array<string>", "annotations": "array<string>", "receiver_type": "string", "expression": "string",
    "module_name": "string", "language": "string", "field_ids": "array<string>", "method_ids": "array<string>",
    "spring": "struct<stereotype:string,injection_type:string,transactional:boolean,async:boolean,scheduled:boolean,http_mappings:array<struct<method:string,path:string>>>",
    "guice": "struct<stereotype:string,injection_type:string,singleton:boolean,request_scoped:boolean,session_scoped:boolean,named:string>",
    "callers": "array<string>", "callees": "array<string>", "depends_on": "array<string>", "module": "string",
}


def complete(symbols: DataFrame) -> DataFrame:
    """The symbols with every column of FIELDS, null where they had none; other columns stay."""
    missing = {k: F.lit(None).cast(t) for k, t in FIELDS.items() if k not in symbols.columns}
    return symbols.withColumns(missing) if missing else symbols


def listed(name: str, separator: str = ", ") -> Column:
    return F.coalesce(F.array_join(name, separator), F.lit(""))


def shown(value: Column, default: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(default))


def joined_lines(*lines: Column | tuple[str, Column]) -> Column:
    """Lines one below the other; a null line is left out, a pair is `label: value`."""
    return F.concat_ws("\n", *[F.concat(F.lit(f"{x[0]}: "), F.coalesce(x[1].cast("string"), F.lit(""))) if isinstance(x, tuple) else x for x in lines])


def mapping_list(separator: str) -> Column:
    return F.coalesce(F.array_join(F.transform("spring.http_mappings", lambda m: F.concat(m["method"], F.lit(" "), m["path"])), separator), F.lit(""))


def text() -> Column:
    """The chunk text of a complete symbol row with callers, callees and module where they apply."""
    place = ("File", F.concat(F.coalesce("file_path", F.lit("")), F.lit(":"), F.col("line").cast("string")))
    module = F.concat(F.lit("Module: "), F.col("module"))
    none = "NONE"
    head = F.concat(F.lit("["), F.col("kind"), F.lit("] "), F.col("id"))
    params = F.concat(F.lit("["), F.coalesce(F.array_join(F.transform("params", lambda p: F.concat(F.lit("MethodParam[name="), p["name"], F.lit(", type="), p["type"], F.lit("]"))), ", "), F.lit("")), F.lit("]"))
    callable_ = joined_lines(
        head, module, ("Class", F.col("declaring_class_id")), ("Signature", F.col("signature")), ("Return", F.col("return_type")), ("Parameters", params), ("Annotations", listed("annotations")),
        ("Spring Stereotype", shown(F.col("spring.stereotype"), none)), ("Guice Stereotype", shown(F.col("guice.stereotype"), none)), ("Guice Injection", shown(F.col("guice.injection_type"), none)),
        ("Singleton", shown(F.col("guice.singleton"), "false")), ("Named", F.col("guice.named")), ("HTTP Mappings", mapping_list(", ")), ("Transactional", shown(F.col("spring.transactional"), "false")),
        ("Callers", listed("callers")), ("Callees", listed("callees")), place,
    )
    class_ = joined_lines(
        head, module, ("Simple Name", F.col("simple_name")), ("Annotations", listed("annotations")), ("Superclass", F.col("super_class")), ("Interfaces", listed("interfaces")),
        ("Spring Stereotype", shown(F.col("spring.stereotype"), none)), ("Guice Stereotype", shown(F.col("guice.stereotype"), none)), ("Fields", listed("field_ids")), ("Methods", listed("method_ids")),
        ("Outgoing Symbols", listed("callees")), place,
    )
    field = joined_lines(head, module, ("Class", F.col("declaring_class_id")), ("Name", F.col("name")), ("Type", F.col("field_type")), ("Annotations", listed("annotations")), ("Guice Injection", shown(F.col("guice.injection_type"), none)), place)
    kind = F.col("kind")
    return (
        F.when(kind == "MODULE", F.concat(F.lit("[MODULE] "), "module_name", F.lit("\nDepends On: "), listed("depends_on"), F.lit("\n")))
        .when(kind.isin("METHOD", "CONSTRUCTOR"), callable_).when(kind == "CLASS", class_).when(kind == "FIELD", field)
        .when(kind == "UNRESOLVED", joined_lines(head, ("Expression", F.col("expression")), place))
        .otherwise(F.concat(F.lit("[SYMBOL] "), "id"))
    )


def metadata() -> Column:
    """The chunk's metadata as JSON; keys that a kind has not are left out."""
    kind = F.col("kind")
    callable_, class_ = kind.isin("METHOD", "CONSTRUCTOR"), kind == "CLASS"
    pairs = {
        "fqn": F.col("id"), "kind": kind, "file": F.coalesce("file_path", F.lit("")), "line": F.col("line"),
        "spring_stereotype": F.when(callable_ | class_, shown(F.col("spring.stereotype"), "NONE")), "guice_stereotype": F.when(callable_ | class_, shown(F.col("guice.stereotype"), "NONE")),
        "guice_injection": F.when(callable_, shown(F.col("guice.injection_type"), "NONE")), "guice_singleton": F.when(callable_, shown(F.col("guice.singleton"), "false")), "guice_named": F.when(callable_, shown(F.col("guice.named"), "")),
        "callers": F.when(callable_, listed("callers", ",")), "callees": F.when(callable_, listed("callees", ",")), "signature": F.when(callable_, F.col("signature")),
        "http_path": F.when(callable_ & (mapping_list("; ") != ""), mapping_list("; ")), "module": F.col("module"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in pairs.items()]))


def module_tags(files: DataFrame, roots: DataFrame, key: str = "file_path", unknown: str = "unknown") -> DataFrame:
    """files with `module`: the name of roots(root, name) that is the longest prefix of file_path by whole folders.

    Every file is taken apart into its folders, so the prefixes are found by an equal join however many
    roots there are. Of equal roots the first name wins; a blank path or one below no root is `unknown`.
    """
    split = F.split("file_path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(split)), lambda n: F.struct(F.array_join(F.slice(split, 1, n), "/").alias("root"), n.alias("depth")))
    prefixes = files.filter(F.trim("file_path") != "").select(F.col(key).alias("__key"), F.explode(folders).alias("f")).select("__key", "f.*")
    known = roots.groupBy("root").agg(F.min("name").alias("name"))
    best = prefixes.join(known, "root").groupBy("__key").agg(F.max_by("name", "depth").alias("module"))
    return files.join(best, files[key] == best["__key"], "left").drop("__key").withColumn("module", F.coalesce("module", F.lit(unknown)))


def files_by_module(files: DataFrame, roots: DataFrame) -> DataFrame:
    """module, files (sorted) of files(file_path) below the roots."""
    return module_tags(files.select("file_path").distinct(), roots).groupBy("module").agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def build(symbols: DataFrame, edges: DataFrame, roots: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """id, text, metadata, file, module of every symbol, or of those in files(path)."""
    from .graph import callers_and_callees

    rows = complete(symbols).drop("callers", "callees", "depends_on", "module")
    if files is not None:
        rows = rows.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_semi")
    rows = rows.join(callers_and_callees(rows, edges), "id", "left")
    module_part = F.transform(F.filter("callees", lambda c: c.startswith("module:")), lambda c: F.substring_index(c, "module:", -1))
    rows = rows.withColumn("depends_on", module_part)
    rows = module_tags(rows, roots, "id") if roots is not None else rows.withColumn("module", F.lit(None).cast("string"))
    return rows.select("id", text().alias("text"), metadata().alias("metadata"), F.coalesce("file_path", F.lit("")).alias("file"), "module")
