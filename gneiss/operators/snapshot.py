"""Statistics of a graph, and how two of them differ."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.groupBy("kind").agg(F.count("*").alias("n"))


def totals(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """total_nodes, total_edges, total_files (blank ones do not count), module_count."""
    nodes = symbols.agg(F.count("*").alias("total_nodes"), F.countDistinct(F.nullif(F.trim(F.col("file_path").cast("string")), F.lit(""))).alias("total_files"), F.count(F.when(F.col("kind") == "MODULE", 1)).alias("module_count"))
    return nodes.crossJoin(edges.agg(F.count("*").alias("total_edges")))


def in_degrees(edges: DataFrame) -> DataFrame:
    """id, incoming of every called id, known or not."""
    return edges.groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("incoming"))


def top_coupled(edges: DataFrame, top: int = 10) -> DataFrame:
    return in_degrees(edges).orderBy(F.col("incoming").desc(), "id").limit(top)


def snapshot(symbols: DataFrame, edges: DataFrame, parsed_files: int, unresolved: int, label: str | None = None, workspace: str = "") -> DataFrame:
    """One row with everything a snapshot document holds."""
    kinds = kind_counts(symbols).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("nodesByKind"))
    modules = symbols.filter("kind = 'MODULE'").agg(F.array_sort(F.collect_list(F.expr("substring(id, 8)"))).alias("modules"))
    top = top_coupled(edges).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("incoming")).alias("k"), "id"))), lambda x: F.struct(x["id"].alias("id"), (-x["k"]).alias("incomingEdges"))).alias("topCoupledNodes"))
    joined = totals(symbols, edges).crossJoin(kinds).crossJoin(modules).crossJoin(top)
    return joined.select(
        F.lit(1).alias("schemaVersion"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"), F.lit(label).cast("string").alias("label"), F.lit(workspace).alias("repoRoot"),
        F.lit(parsed_files).cast("long").alias("parsedFiles"), F.lit(unresolved).cast("long").alias("unresolvedCalls"), F.col("total_nodes").alias("totalNodes"), F.col("total_edges").alias("totalEdges"), F.col("total_files").alias("totalFiles"), F.col("module_count").alias("moduleCount"),
        "nodesByKind", "modules", "topCoupledNodes",
    )


def counters(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """counter, before, after, delta of two one-row tables."""
    def tall(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.coalesce(F.col(k).cast("long"), F.lit(0)).alias(name)) for k in keys])).alias("r")).select("r.*")

    return tall(a, "before").join(tall(b, "after"), "counter").withColumn("delta", F.col("after") - F.col("before"))


def kind_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """kind, before, after, delta; a kind that one side lacks counts 0 there."""
    joined = a.select("kind", F.col("n").alias("before")).join(b.select("kind", F.col("n").alias("after")), "kind", "full_outer")
    return joined.select("kind", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def module_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """module, change: `added` or `removed`."""
    return b.select("module").subtract(a.select("module")).withColumn("change", F.lit("added")).unionByName(a.select("module").subtract(b.select("module")).withColumn("change", F.lit("removed")))


def top_drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """id, change (entered, disappeared, changed), before, after of two lists of coupled nodes."""
    joined = a.select("id", F.col("incoming").alias("before")).join(b.select("id", F.col("incoming").alias("after")), "id", "full_outer")
    change = F.when(F.col("before").isNull(), "entered").when(F.col("after").isNull(), "disappeared").when(F.col("before") != F.col("after"), "changed")
    return joined.withColumn("change", change).filter("change is not null").select("id", "change", "before", "after")
