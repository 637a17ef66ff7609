"""The vector store of a workspace: full index, incremental sync, search.

A store is a folder of versions; a change writes a new version and then moves the pointer, so readers see
the old rows or the new ones. Rows of a database are loaded through Spark's own connector.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.embedding import embedder
from gneiss.functions.vectors import decoded
from gneiss.operators import checksums, chunks, store
from gneiss.plans.project import Project, build
from gneiss.sources import files
from gneiss.sources.layout import Workspace

ROW = "id string, vector array<float>, content string, metadata string, file string, module string"
POINTER = "current.json"
REGISTRY = "checksums.json"


class Store:
    def __init__(self, spark: SparkSession, folder: str, collection: str):
        self.spark, self.folder = spark, os.path.join(folder, collection.replace(os.sep, "_"))

    def rows(self) -> DataFrame:
        path = os.path.join(self.folder, POINTER)
        if not os.path.isfile(path):
            return self.spark.createDataFrame([], ROW)
        with open(path, encoding="utf-8") as f:
            return self.spark.read.schema(ROW).parquet(os.path.join(self.folder, json.load(f)["version"]))

    def replace(self, rows: DataFrame) -> int:
        """Make these the rows; the version before the last is removed."""
        os.makedirs(self.folder, exist_ok=True)
        version = f"{time.time_ns()}-{uuid.uuid4().hex[:8]}"
        rows.select("id", "vector", "content", "metadata", "file", "module").write.parquet(os.path.join(self.folder, version))
        path = os.path.join(self.folder, POINTER)
        old = None
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                old = json.load(f)
        with open(path + ".new", "w", encoding="utf-8") as f:
            json.dump({"version": version, "before": (old or {}).get("version")}, f)
        os.replace(path + ".new", path)
        if old and old.get("before"):
            shutil.rmtree(os.path.join(self.folder, old["before"]), ignore_errors=True)
        return self.rows().count()

    def add(self, rows: DataFrame) -> int:
        """Upsert by id."""
        return self.replace(store.upsert(self.rows().withColumn("seq", F.lit(0)), rows.withColumn("seq", F.lit(0))))

    def add_all(self, ids: list[str], vectors: list[list[float]], texts: list[str], metadata: list[dict] | None = None) -> int:
        """Upsert rows that the caller embedded; the lists must be of one length."""
        metadata = metadata if metadata is not None else [{}] * len(ids)
        if not len(ids) == len(vectors) == len(texts) == len(metadata):
            raise ValueError("ids, vectors, texts and metadata differ in length")
        rows = [(i, list(map(float, v)), t, json.dumps(m), m.get("file", ""), m.get("module")) for i, v, t, m in zip(ids, vectors, texts, metadata, strict=True)]
        return self.add(self.spark.createDataFrame(rows, ROW))

    def load_jdbc(self, url: str, table: str, **options: str) -> int:
        """Upsert the rows of a database table (id, vector as bytes, content, metadata as JSON text)."""
        saved = self.spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
        value = store.metadata_value
        rows = saved.select("id", decoded("vector").alias("vector"), "content", "metadata", F.coalesce(value(F.col("metadata"), "file"), F.lit("")).alias("file"), value(F.col("metadata"), "module").alias("module"))
        return self.add(rows)

    def remove_ids(self, ids: DataFrame) -> int:
        return self.replace(store.delete_ids(self.rows(), ids))

    def remove_matching(self, key: str | None = None, value: str | None = None) -> int:
        """`file` and `module` are columns of their own, which the scan can use; other keys are looked up in the metadata."""
        if key in ("file", "module"):
            return self.replace(self.rows().filter(~F.col(key).eqNullSafe(F.lit(value))))
        return self.replace(store.delete_matching(self.rows(), key, value))

    def remove_files(self, paths: DataFrame) -> int:
        return self.replace(self.rows().join(paths.select(F.col("path").alias("file")).distinct(), "file", "left_anti"))

    def remove_all(self) -> int:
        return self.replace(self.rows().filter("false"))

    def search(self, text: str, embedding: str = "local", top: int = 10, module: str | None = None, min_score: float | None = None) -> DataFrame:
        """score, content, metadata of the nearest rows; a module is filtered for before ranking."""
        probe = self.spark.createDataFrame([(text,)], "t string").select(embedder(embedding)("t").alias("v")).first()["v"]
        rows = self.rows()
        if module and module.strip():
            rows = rows.filter(F.col("module") == module.strip())
        return store.search(rows, list(probe), top, min_score).select("score", "content", "metadata")


def embedded(symbol_chunks: DataFrame, embedding: str) -> DataFrame:
    return symbol_chunks.select("id", embedder(embedding)("text").alias("vector"), F.col("text").alias("content"), "metadata", "file", "module")


def roots_of(spark: SparkSession, workspace: Workspace) -> DataFrame | None:
    """root, name of every source root below the workspace, for workspaces of several modules."""
    if not workspace.several:
        return None
    return spark.createDataFrame([(os.path.relpath(r, workspace.root), m.name) for m in workspace.modules for r in m.roots], "root string, name string")


def current_checksums(spark: SparkSession, workspace: Workspace) -> DataFrame:
    """path, sha256 of every Java and Kotlin file under any root."""
    return checksums.checksums(files.read_files(spark, list(workspace.roots), workspace.root))


def saved_checksums(spark: SparkSession, state_dir: str) -> DataFrame | None:
    path = os.path.join(state_dir, REGISTRY)
    if not os.path.isfile(path):
        return None
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    return spark.createDataFrame(list(saved.items()), "path string, sha256 string")


def save_checksums(sums: DataFrame, state_dir: str) -> None:
    """A file for each source file of one repository, kept as one small document."""
    os.makedirs(state_dir, exist_ok=True)
    with open(os.path.join(state_dir, REGISTRY), "w", encoding="utf-8") as f:
        json.dump({r["path"]: r["sha256"] for r in sums.orderBy("path").toLocalIterator()}, f, indent=2)


def index(spark: SparkSession, workspace: Workspace, state_dir: str, target: Store, embedding: str = "local") -> dict:
    """Clear, parse, index, save checksums; the times of each in nanoseconds, and counts."""
    marks = [time.perf_counter_ns()]
    target.remove_all()
    marks.append(time.perf_counter_ns())
    project = build(spark, workspace)
    marks.append(time.perf_counter_ns())
    count = target.add(embedded(chunks.build(project.symbols, project.edges, roots_of(spark, workspace)), embedding))
    marks.append(time.perf_counter_ns())
    save_checksums(current_checksums(spark, workspace), state_dir)
    marks.append(time.perf_counter_ns())
    names = ("clearNanos", "parseNanos", "indexNanos", "checksumNanos")
    return {"workspace": workspace.name, **{n: b - a for n, a, b in zip(names, marks, marks[1:], strict=False)}, "parsedFiles": project.parsed_files, "unresolvedCalls": project.unresolved, "indexedSymbols": count}


def sync(spark: SparkSession, workspace: Workspace, state_dir: str, target: Store, embedding: str = "local", refresh_neighbours: bool = False) -> dict:
    """Bring the store up to date with what changed since the last index or sync.

    All sources are parsed anew, as calls resolve across files; chunks of changed files are embedded anew.
    With refresh_neighbours those of files that call them or are called are too.
    """
    saved = saved_checksums(spark, state_dir)
    if saved is None:
        raise FileNotFoundError("nothing was indexed yet")
    sums = current_checksums(spark, workspace)
    changed = checksums.changes(sums, saved).cache()
    counts = {r["change"]: r["count"] for r in changed.groupBy("change").count().collect()}
    result = {k: counts.get(k, 0) for k in ("added", "modified", "deleted")}
    if not counts:
        return result | {"indexedSymbols": 0}
    project: Project = build(spark, workspace)
    paths = checksums.to_reindex(changed)
    if refresh_neighbours:
        paths = paths.union(neighbour_files(project, paths)).distinct()
    fresh = embedded(chunks.build(project.symbols, project.edges, roots_of(spark, workspace), paths), embedding)
    left = target.rows().join(checksums.to_remove(changed).union(paths).distinct().withColumnRenamed("path", "file"), "file", "left_anti")
    target.replace(store.upsert(left.withColumn("seq", F.lit(0)), fresh.withColumn("seq", F.lit(0))))
    save_checksums(sums, state_dir)
    changed.unpersist()
    return result | {"indexedSymbols": fresh.count()}


def neighbour_files(project: Project, paths: DataFrame) -> DataFrame:
    own = project.symbols.select("id", F.col("file_path").alias("path"))
    inside = own.join(paths, "path", "left_semi").select("id")
    near = project.edges.join(inside.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id")).union(project.edges.join(inside.withColumnRenamed("id", "from_id"), "from_id", "left_semi").select(F.col("to_id").alias("id")))
    return own.join(near.distinct(), "id", "left_semi").select("path").distinct()
