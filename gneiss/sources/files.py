"""Source trees as tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANGUAGES = {"JAVA": ".java", "KOTLIN": ".kt"}
EMPTY = "path string, abs_path string, language string, content binary, file_seq long"


def local_path(column) -> F.Column:
    """A file's path without the scheme that Spark puts in front."""
    return F.regexp_replace(column, "^file:(//)?(?=/)", "")


def read_files(spark: SparkSession, roots: list[str], base: str, languages: tuple[str, ...] = ("JAVA", "KOTLIN")) -> DataFrame:
    """path (below base, else absolute), abs_path, language, content, file_seq of every source file under the roots.

    Suffixes are compared without case; roots that are no folders are left out. file_seq follows the paths.
    """
    there = [r for r in dict.fromkeys(r.rstrip("/") or r for r in roots) if os.path.isdir(r) or "://" in r]
    if not there:
        return spark.createDataFrame([], EMPTY)
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in LANGUAGES[lang][1:]) for lang in languages) + "}"
    # Roots inside other roots would list their files twice; paths are cheap to compare, contents are not.
    outer = [r for r in there if not any(r != o and r.rstrip("/").startswith(o.rstrip("/") + "/") for o in there)]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(outer)
    path = local_path(F.col("path"))
    root = base.rstrip("/") + "/"
    language = F.when(F.lower(path).endswith(".java"), "JAVA").otherwise("KOTLIN")
    shown = F.when(F.col("abs_path").startswith(root), F.expr(f"substring(abs_path, {len(root) + 1})")).otherwise(F.col("abs_path"))
    return found.select(path.alias("abs_path"), language.alias("language"), "content").select(shown.alias("path"), "abs_path", "language", "content", F.xxhash64("abs_path").alias("file_seq"))
