"""Incremental sync as a stream: a source that reports a tree's state, and a sink that syncs on change."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from gneiss.plans import index
from gneiss.sources.layout import Workspace

SUFFIXES = (".java", ".kt")


def fingerprint(roots: list[str]) -> str:
    """A digest of names, sizes and times of all source files, which edits and deletions change too."""
    seen = hashlib.sha256()
    for root in roots:
        for folder, below, names in os.walk(root):
            below.sort()
            for name in sorted(n for n in names if n.lower().endswith(SUFFIXES)):
                path = os.path.join(folder, name)
                stat = os.stat(path)
                seen.update(f"{path}\0{stat.st_size}\0{stat.st_mtime_ns}\n".encode())
    return seen.hexdigest()


class TreeReader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.roots = options.get("roots", "").split(os.pathsep)

    def initialOffset(self) -> dict:
        return {"state": ""}

    def read(self, start: dict):
        now = fingerprint(self.roots)
        return iter([(now,)] if now != start["state"] else []), {"state": now}

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter([(end["state"],)])

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    """A row whenever the state of a source tree is another than before."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "state string"

    def simpleStreamReader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def watch(spark: SparkSession, workspace: Workspace, state_dir: str, target: index.Store, checkpoint: str, embedding: str = "local", once: bool = False, every: str = "10 seconds"):
    """A streaming query that syncs the store when a file was added, edited or deleted."""
    spark.dataSource.register(SourceTree)
    changes = spark.readStream.format("source_tree").option("roots", os.pathsep.join(workspace.roots)).load()

    def apply(batch, number: int) -> None:
        if not batch.isEmpty():
            index.sync(spark, workspace, state_dir, target, embedding)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()
