"""A repository's history as a Spark data source.

`spark.read.format("git_history").option("repo", …)` lists one row for each commit: its place (newest
first), hash, author's address, time and files. The log is read by one process, as git keeps it on one
machine; a folder that is no repository has no rows, a missing git or folder is an error.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

SCHEMA = "commit_seq long, commit string, author string, committed_at timestamp, files array<string>"
HEADER = "\x1e"


def blocks(lines: Iterator[str]) -> Iterator[tuple[str, list[str]]]:
    """(header, listed lines) for each header; blank lines are skipped and others trimmed."""
    header, listed = None, []
    for line in lines:
        if line.startswith(HEADER):
            if header is not None:
                yield header, listed
            header, listed = line[1:].rstrip("\n"), []
        elif header is not None and line.strip():
            listed.append(line.strip())
    if header is not None:
        yield header, listed


class Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.days = options.get("repo", "."), int(options.get("sinceDays", "0"))

    def read(self, partition):
        command = ["git", "-c", "core.quotepath=off", "log", "--name-only", f"--format={HEADER}%H%x1f%ae%x1f%ct", "--diff-filter=d"]
        if self.days > 0:
            command.append(f"--since={self.days}.days")
        with subprocess.Popen(command, cwd=self.repo, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True, errors="replace") as run:
            # Commits without files are left out.
            for number, (header, files) in enumerate((h, f) for h, f in blocks(run.stdout) if f):
                commit, author, seconds = header.split("\x1f")
                yield number, commit, author, datetime.fromtimestamp(int(seconds), timezone.utc), files


class GitHistory(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def commits(spark: SparkSession, repo: str, since_days: int = 0) -> DataFrame:
    spark.dataSource.register(GitHistory)
    return spark.read.format("git_history").option("repo", repo).option("sinceDays", str(since_days)).load()
