"""What changed between two states of a file tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksums(files: DataFrame) -> DataFrame:
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """path, change: added, modified or deleted; unchanged files are left out."""
    joined = current.select("path", F.col("sha256").alias("now")).join(stored.select("path", F.col("sha256").alias("then")), "path", "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "modified")
    return joined.withColumn("change", change).filter("change is not null").select("path", "change")


def to_reindex(changed: DataFrame) -> DataFrame:
    return changed.filter("change in ('added', 'modified')").select("path").distinct()


def to_remove(changed: DataFrame) -> DataFrame:
    return changed.filter("change in ('deleted', 'modified')").select("path").distinct()
