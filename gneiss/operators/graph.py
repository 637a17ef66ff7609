"""The call graph as two tables: symbols(id, …, node_seq) and edges(from_id, to_id)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(df: DataFrame) -> DataFrame:
    """df written to the folder that the cluster shares and read back, which ends its lineage."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = named.get() if named.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.gettempdir()
    path = f"{where.rstrip('/')}/gneiss-graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def edge_set(edges: DataFrame) -> DataFrame:
    """Distinct edges between non-blank ends."""
    ends = [F.trim(F.col(c).cast("string")) != "" for c in ("from_id", "to_id")]
    return edges.select("from_id", "to_id").filter(ends[0] & ends[1]).distinct()


def node_set(nodes: DataFrame, order: str = "node_seq") -> DataFrame:
    """One row for each id: the last value at the first place in the order."""
    by = Window.partitionBy("id")
    last = nodes.withColumn("__last", F.row_number().over(by.orderBy(F.col(order).desc()))).withColumn("__first", F.min(order).over(by))
    return last.filter("__last = 1").withColumn(order, F.col("__first")).drop("__last", "__first")


def remove_nodes(symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and edges without the ids of gone(id)."""
    ids = gone.select(F.col("id").alias("__id")).distinct()
    kept = symbols.join(ids, symbols["id"] == ids["__id"], "left_anti")
    left = edges.join(ids, edges["from_id"] == ids["__id"], "left_anti").join(ids, edges["to_id"] == ids["__id"], "left_anti")
    return kept, left


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti")


def in_neighbours(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("to_id") == node).select(F.col("from_id").alias("id")).distinct()


def out_neighbours(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("from_id") == node).select(F.col("to_id").alias("id")).distinct()


def reachable(edges: DataFrame, start, max_depth: int, callers: bool = True) -> DataFrame:
    """id, depth: what is within max_depth steps of start against (callers) or along the edges, start left out.

    Each level joins its frontier with the edges and drops what was met before; the visited set is a table,
    so a level costs one join, whatever the graph's size. A blank start gives nothing, as does a depth of 0
    or less. The start need not be a node.
    """
    spark = edges.sparkSession
    near, far = ("to_id", "from_id") if callers else ("from_id", "to_id")
    kind = edges.schema[far].dataType
    frontier = spark.createDataFrame([(start,)], f"id {kind.simpleString()}").withColumn("depth", F.lit(0))
    blank = start is None or (isinstance(start, str) and not start.strip())
    seen = frontier
    if blank:
        return seen.filter("false")
    steps = edges.select(F.col(near).alias("id"), F.col(far).alias("next"))
    for depth in range(1, max(0, max_depth) + 1):
        nexts = steps.join(frontier.select("id"), "id").select(F.col("next").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = scratch(nexts.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter("depth > 0")


def lookup(symbols: DataFrame, text: str) -> DataFrame:
    """The symbol with this id, else the first in node order whose id holds the text; none gives no row."""
    found = symbols.filter(F.col("id").contains(text))
    return found.orderBy(F.col("id") != text, "node_seq").limit(1)


def callers_and_callees(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, callers, callees of every symbol, each sorted."""
    callers = edges.groupBy(F.col("to_id").alias("id")).agg(F.array_sort(F.collect_set("from_id")).alias("callers"))
    callees = edges.groupBy(F.col("from_id").alias("id")).agg(F.array_sort(F.collect_set("to_id")).alias("callees"))
    none = F.array().cast("array<string>")
    return symbols.select("id").join(callers, "id", "left").join(callees, "id", "left").select("id", F.coalesce("callers", none).alias("callers"), F.coalesce("callees", none).alias("callees"))


def module_edges(modules: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes for every module and edges for each dependency(module, depends_on) between known ones."""
    prefix = F.lit("module:")
    nodes = modules.select(F.concat(prefix, "name").alias("id"), F.lit("MODULE").alias("kind"), F.col("name").alias("module_name"), F.lit("").alias("file_path"), F.lit(0).alias("line"))
    known = modules.select(F.col("name").alias("depends_on"))
    return nodes, dependencies.join(known, "depends_on", "left_semi").select(F.concat(prefix, "module").alias("from_id"), F.concat(prefix, "depends_on").alias("to_id"))


def module_dependencies(modules: DataFrame, edges: DataFrame, part: str | None = None) -> DataFrame:
    """module, depends_on: every module whose id holds `part` with each module it depends on, null for none."""
    ids = modules.select(F.col("id").alias("module"))
    if part and part.strip():
        ids = ids.filter(F.col("module").contains(part))
    targets = edges.join(modules.select(F.col("id").alias("to_id")), "to_id", "left_semi").distinct()
    return ids.join(targets, ids["module"] == targets["from_id"], "left").select("module", F.col("to_id").alias("depends_on"))


def empty_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], "id string, node_seq long"), spark.createDataFrame([], "from_id string, to_id string")
