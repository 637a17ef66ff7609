"""Binding call sites to declarations by joins.

`candidates` are callables(id, name, arity, receiver_type); `sites` are calls(site, caller_id, name, arity, …).
A call is bound where one candidate fits; the build side is first summed up to one row for each key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_key(candidates: DataFrame, *keys: str) -> DataFrame:
    """One row for each key: how many candidates it has, and the one where it is one."""
    return candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.min("id").alias("match"))


def match(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """sites with n candidates of the same name and arity, and `match` where n is 1."""
    joined = sites.join(by_key(candidates, "name", "arity"), ["name", "arity"], "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("match", F.when(F.col("n") == 1, F.col("match")))


def narrow_by_receiver(sites: DataFrame, candidates: DataFrame) -> DataFrame:
    """site, match of the ambiguous sites where one candidate's receiver type ends with the receiver's text.

    Candidates are first summed up by name, arity and receiver type, so a pair is made for each type only.
    """
    typed = by_key(candidates.filter(F.coalesce("receiver_type", F.lit("")) != ""), "name", "arity", "receiver_type").withColumnRenamed("n", "types")
    open_sites = sites.filter((F.col("n") > 1) & (F.coalesce("receiver_text", F.lit("")) != "")).select("site", "name", "arity", "receiver_text")
    fits = open_sites.join(typed, ["name", "arity"]).filter(F.col("receiver_type").endswith(F.col("receiver_text")))
    return fits.groupBy("site").agg(F.sum("types").alias("n"), F.min("match").alias("match")).filter("n = 1").select("site", "match")


def placeholder_id(operator: bool) -> F.Column:
    """UNRESOLVED:[LAMBDA:|OP:]name/arity@caller#site."""
    tag = F.lit("UNRESOLVED:OP:") if operator else F.when(F.col("is_lambda_param"), "UNRESOLVED:LAMBDA:").otherwise("UNRESOLVED:")
    return F.concat(tag, "name", F.lit("/"), F.col("arity").cast("string"), F.lit("@"), "caller_id", F.lit("#"), F.col("site").cast("string"))


def bind(sites: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, placeholder nodes and records of sites(site, caller_id, op, name, arity, receiver_text, is_lambda_param, expr, file_path, line).

    Calls that no single candidate fits become placeholders; operators and index accesses only where
    several fit, as without any they are the language's own.
    """
    found = match(sites, candidates)
    narrowed = narrow_by_receiver(found.filter("op = 'CALL'"), candidates).withColumnRenamed("match", "narrowed")
    found = found.join(narrowed, "site", "left").withColumn("target", F.coalesce("match", "narrowed"))
    bound = found.filter("target is not null").select(F.col("caller_id").alias("from_id"), F.col("target").alias("to_id"))
    left = found.filter("target is null and (op = 'CALL' or n > 1)")
    left = left.withColumn("unresolved_id", F.when(F.col("op") == "CALL", placeholder_id(False)).otherwise(placeholder_id(True)))
    nodes = left.select(F.col("unresolved_id").alias("id"), F.lit("UNRESOLVED").alias("kind"), "expr", "file_path", "line")
    edges = bound.unionByName(left.select(F.col("caller_id").alias("from_id"), F.col("unresolved_id").alias("to_id"))).distinct()
    records = left.select("caller_id", F.col("name").alias("callee_name"), "arity", "unresolved_id")
    return edges, nodes, records


def cross_language(records: DataFrame, candidates: DataFrame, extensions: bool) -> DataFrame:
    """Records with `match`, the one callable of the other language with the callee's name and arity.

    With extensions, a record left over is also tried with one argument less against callables that have a
    receiver type; every record of a shared placeholder is resolved.
    """
    keyed = by_key(candidates, "name", "arity").filter("n = 1").select(F.col("name").alias("callee_name"), "arity", "match")
    found = records.join(keyed, ["callee_name", "arity"], "left")
    if not extensions:
        return found
    received = by_key(candidates.filter(F.coalesce("receiver_type", F.lit("")) != ""), "name", "arity").filter("n = 1")
    received = received.select(F.col("name").alias("callee_name"), (F.col("arity") + 1).alias("arity"), F.col("match").alias("extension"))
    return found.join(received, ["callee_name", "arity"], "left").withColumn("match", F.coalesce("match", "extension")).drop("extension")


def rewrite(edges: DataFrame, nodes: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and nodes in which resolved records go straight to their match instead of a placeholder."""
    done = resolved.filter("match is not null")
    old = done.select(F.col("caller_id").alias("from_id"), F.col("unresolved_id").alias("to_id")).distinct()
    new = done.select(F.col("caller_id").alias("from_id"), F.col("match").alias("to_id"))
    left = edges.join(old, ["from_id", "to_id"], "left_anti").unionByName(new).distinct()
    # A placeholder goes with its last caller.
    gone = done.select(F.col("unresolved_id").alias("id")).distinct().join(left.select(F.col("to_id").alias("id")), "id", "left_anti")
    return left, nodes.join(gone, "id", "left_anti")


def is_test_source(path) -> F.Column:
    return F.coalesce(path.contains("/test/") | path.contains("src/test"), F.lit(False))


def injection(points: DataFrame, classes: DataFrame) -> DataFrame:
    """points(owner_id, type, file_path) with n implementors of the type, and `match` where n is 1.

    classes(id, interfaces, file_path); test sources count on neither side. Types are compared as written.
    """
    known = classes.filter(~is_test_source(F.col("file_path"))).select("id", F.explode("interfaces").alias("type"))
    found = points.filter(~is_test_source(F.col("file_path"))).join(by_key(known, "type"), "type", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return found.withColumn("match", F.when(F.col("n") == 1, F.col("match")))


def injection_edges(found: DataFrame) -> DataFrame:
    return found.filter("match is not null").select(F.col("owner_id").alias("from_id"), F.col("match").alias("to_id")).distinct()


def injection_counters(found: DataFrame) -> DataFrame:
    """added, ambiguous, no_match: how many points have one, several and no implementor."""
    return found.agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("added", F.col("n") == 1), ("ambiguous", F.col("n") > 1), ("no_match", F.col("n") == 0))))
