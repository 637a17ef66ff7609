"""Questions about a project, as tables and as JSON values for tools."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.operators import graph, history, snapshot
from gneiss.plans import index
from gneiss.plans.project import Project
from gneiss.sources import gitlog
from gneiss.sources.layout import Workspace

OWNERSHIP, COCHANGE = "ownership.json", "co-change.json"
OWNERSHIP_DAYS = 90


def touched(spark: SparkSession, repo: str, days: int) -> DataFrame:
    return history.explode_commits(gitlog.commits(spark, repo, days))


def hotspots(spark: SparkSession, project: Project, repo: str, days: int = 365, top: int = 20, zero_scores: bool = True) -> DataFrame:
    coupled = history.coupling(project.edges, project.symbols.select("id", F.col("file_path").alias("file")))
    return history.hotspots(history.churn(touched(spark, repo, days)), coupled, top, zero_scores)


def analyse_history(spark: SparkSession, repo: str, state_dir: str, days: int = 365, threshold: int = 3) -> dict:
    """Write co-change and ownership documents; their owners are those of the last 90 days at most."""
    window = min(days, OWNERSHIP_DAYS)
    pairs = history.cochange_partners(history.cochange_pairs(touched(spark, repo, days), threshold))
    coupled = [{"file": r["file"], "coChanges": [{"file": p["file"], "frequency": p["frequency"]} for p in r["partners"]]} for r in pairs.orderBy(F.col("frequency_sum").desc(), "file").toLocalIterator()]
    owners = [{"file": r["file"], "owner": r["owner"]} for r in history.ownership(touched(spark, repo, window)).orderBy("file").toLocalIterator()]
    os.makedirs(state_dir, exist_ok=True)
    for name, extra, entries in ((COCHANGE, {"sinceDays": days, "threshold": threshold}, coupled), (OWNERSHIP, {"sinceDays": window}, owners)):
        with open(os.path.join(state_dir, name), "w", encoding="utf-8") as f:
            json.dump({"schemaVersion": 1, **extra, "entries": entries}, f, indent=2)
    return {"coChangeFiles": len(coupled), "ownedFiles": len(owners)}


def owners(state_dir: str, part: str | None = None) -> dict:
    """file -> owner from a saved document, flat or in its envelope, of files whose path holds `part`."""
    path = os.path.join(state_dir, OWNERSHIP)
    if not os.path.isfile(path):
        return {"error": "no ownership data; run git-analyze first"}
    with open(path, encoding="utf-8") as f:
        saved = json.load(f)
    flat = {e["file"]: e["owner"] for e in saved["entries"]} if isinstance(saved.get("entries"), list) else saved
    return {k: v for k, v in flat.items() if not (part and part.strip()) or part in k}


def find(project: Project, text: str) -> str | None:
    row = graph.lookup(project.symbols, text).select("id").first()
    return row["id"] if row else None


class Tools:
    """The questions that a long-lived session answers over one parsed workspace."""

    def __init__(self, spark: SparkSession, workspace: Workspace, project: Project, state_dir: str, store: index.Store | None = None, embedding: str = "local"):
        self.spark, self.workspace, self.state_dir, self.store, self.embedding = spark, workspace, state_dir, store, embedding
        self.project = project

    def search(self, query: str, top_k: int = 10, module: str | None = None) -> list[dict]:
        return [{"score": r["score"], "text": r["content"], "metadata": json.loads(r["metadata"])} for r in self.store.search(query, self.embedding, top_k, module).collect()]

    def blast_radius(self, symbol: str, depth: int = 3) -> dict:
        found = find(self.project, symbol)
        if found is None:
            return {"error": f"Symbol not found: {symbol}"}
        rows = graph.reachable(self.project.edges, found, depth).join(self.project.symbols.select("id", "file_path", "line"), "id", "left")
        return {"target": found, "depth": depth, "callers": [r["id"] for r in rows.orderBy("depth", "id").select("id").collect()]}

    def callers(self, symbol: str) -> dict:
        found = find(self.project, symbol)
        return {"error": f"Symbol not found: {symbol}"} if found is None else {"symbol": found, "callers": [r["id"] for r in graph.in_neighbours(self.project.edges, found).orderBy("id").collect()]}

    def callees(self, symbol: str) -> dict:
        found = find(self.project, symbol)
        return {"error": f"Symbol not found: {symbol}"} if found is None else {"symbol": found, "callees": [r["id"] for r in graph.out_neighbours(self.project.edges, found).orderBy("id").collect()]}

    def module_deps(self, module: str | None = None) -> list[dict]:
        rows = graph.module_dependencies(self.project.symbols.filter("kind = 'MODULE'"), self.project.edges, module)
        grouped = rows.groupBy("module").agg(F.array_sort(F.collect_set("depends_on")).alias("d")).orderBy("module")
        return [{"module": r["module"], "depends_on": r["d"]} for r in grouped.collect()]

    def hotspots(self, since_days: int = 365, top: int = 20) -> list[dict]:
        try:
            return [r.asDict() for r in hotspots(self.spark, self.project, self.workspace.root, since_days, top, zero_scores=False).collect()]
        except Exception:  # a tool answers with what it has; without a history that is nothing
            return []

    def ownership(self, path: str | None = None) -> dict:
        return owners(self.state_dir, path)


def save_snapshot(spark: SparkSession, project: Project, workspace: Workspace, state_dir: str, label: str | None = None) -> str:
    """Write a snapshot document and return its path."""
    import re
    from datetime import datetime, timezone

    row = snapshot.snapshot(project.symbols, project.edges, project.parsed_files, project.unresolved, label, workspace.root)
    text = row.select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    name = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ") + (f"-{re.sub('[^a-zA-Z0-9_-]', '-', label)}" if label and label.strip() else "")
    folder = os.path.join(state_dir, "snapshots")
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name + ".json"), "w", encoding="utf-8") as f:
        json.dump(json.loads(text), f, indent=2)
    return os.path.join(folder, name + ".json")


SNAPSHOT = "createdAt string, label string, parsedFiles long, totalNodes long, totalEdges long, totalFiles long, unresolvedCalls long, moduleCount long, nodesByKind map<string,long>, modules array<string>, topCoupledNodes array<struct<id:string,incomingEdges:long>>"
COUNTERS = ["parsedFiles", "totalNodes", "totalEdges", "totalFiles", "unresolvedCalls", "moduleCount"]


def drift(spark: SparkSession, a: str, b: str) -> dict[str, DataFrame]:
    """counters, kinds, modules and top nodes that differ between two snapshot documents."""
    one, two = (spark.read.schema(SNAPSHOT).option("multiLine", True).json(p) for p in (a, b))

    def kinds(df: DataFrame) -> DataFrame:
        return df.select(F.explode("nodesByKind").alias("kind", "n"))

    def modules(df: DataFrame) -> DataFrame:
        return df.select(F.explode("modules").alias("module"))

    def tops(df: DataFrame) -> DataFrame:
        # Of a repeated id the last entry counts.
        return df.select(F.posexplode("topCoupledNodes").alias("at", "t")).filter("t.id is not null").groupBy(F.col("t.id").alias("id")).agg(F.max_by(F.col("t.incomingEdges"), "at").alias("incoming"))

    return {"counters": snapshot.counters(one, two, COUNTERS), "kinds": snapshot.kind_drift(kinds(one), kinds(two)).orderBy("kind"), "modules": snapshot.module_drift(modules(one), modules(two)).orderBy("module"), "top": snapshot.top_drift(tops(one), tops(two)).orderBy("id")}
