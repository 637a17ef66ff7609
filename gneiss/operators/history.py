"""Version-control history as tables: churn, co-change, ownership, hotspots.

Commits are rows (commit, author, committed_at, file), one for each file that a commit lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_commits(commits: DataFrame) -> DataFrame:
    """One row for each listed file of commits(…, files)."""
    return commits.select(*[c for c in commits.columns if c != "files"], F.explode("files").alias("file"))


def since_days(touched: DataFrame, days: int, as_of: Column | None = None) -> DataFrame:
    """Rows of the last `days` days before as_of (by default the newest commit); 0 keeps all history."""
    if days <= 0:
        return touched
    if as_of is None:
        newest = touched.agg(F.max("committed_at").alias("__as_of"))
        return touched.join(F.broadcast(newest)).filter(F.col("committed_at") >= F.col("__as_of") - F.expr(f"INTERVAL {days} DAYS")).drop("__as_of")
    return touched.filter(F.col("committed_at") >= as_of - F.expr(f"INTERVAL {days} DAYS"))


def churn(touched: DataFrame) -> DataFrame:
    """file, churn: the number of listings of each file."""
    return touched.groupBy("file").agg(F.count("*").alias("churn"))


def cochange_pairs(touched: DataFrame, threshold: int = 1) -> DataFrame:
    """file, partner, frequency: how many commits list both, both ways round, at least `threshold`.

    Both sides of the join are dealt by commit, so partial sums of the pairs are taken before they move.
    Every pair of a commit counts; no commit is too large.
    """
    listed = touched.select("commit", "file").distinct()
    partner = listed.select(F.col("commit"), F.col("file").alias("partner"))
    pairs = listed.join(partner, "commit").filter("file < partner")
    # Half the pairs cross the shuffle; the other half is their mirror image.
    counted = pairs.groupBy("file", "partner").agg(F.count("*").alias("frequency")).filter(F.col("frequency") >= threshold)
    return counted.select(F.explode(F.array(F.struct("file", "partner", "frequency"), F.struct(F.col("partner").alias("file"), F.col("file").alias("partner"), "frequency"))).alias("r")).select("r.*")


def cochange_partners(pairs: DataFrame) -> DataFrame:
    """file, partners (frequency descending, then name), frequency_sum."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("frequency")).alias("n"), F.col("partner").alias("file"))))
    return pairs.groupBy("file").agg(F.transform(ordered, lambda p: F.struct(p["file"].alias("file"), (-p["n"]).alias("frequency"))).alias("partners"), F.sum("frequency").alias("frequency_sum"))


def author_counts(touched: DataFrame) -> DataFrame:
    return touched.filter(F.trim(F.col("author").cast("string")) != "").groupBy("file", "author").agg(F.count("*").alias("n"))


def ownership(touched: DataFrame) -> DataFrame:
    """file, owner, commits: the author of most listings; the smaller name wins a tie."""
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("author")))
    return author_counts(touched).groupBy("file").agg(best.alias("b")).select("file", F.col("b.author").alias("owner"), (-F.col("b.n")).alias("commits"))


def coupling(edges: DataFrame, symbol_files: DataFrame) -> DataFrame:
    """file, coupling: from how many other files the file's symbols are called.

    Edges with an unknown or blank end do not count, nor those within a file.
    """
    files = symbol_files.select("id", "file").filter(F.trim(F.col("file").cast("string")) != "")
    called = edges.join(files.select(F.col("id").alias("to_id"), F.col("file").alias("file")), "to_id")
    calling = called.join(files.select(F.col("id").alias("from_id"), F.col("file").alias("caller")), "from_id")
    return calling.filter("file <> caller").select("file", "caller").distinct().groupBy("file").agg(F.count("*").alias("coupling"))


def hotspots(churned: DataFrame, coupled: DataFrame, top: int | None = 20, zero_scores: bool = True) -> DataFrame:
    """file, churn, coupling, score = churn * coupling, highest first, then by file.

    zero_scores keeps files that have either; without it files of score 0 go.
    """
    joined = churned.join(coupled, "file", "full_outer").select("file", F.coalesce("churn", F.lit(0)).cast("long").alias("churn"), F.coalesce("coupling", F.lit(0)).cast("long").alias("coupling"))
    scored = joined.withColumn("score", F.col("churn") * F.col("coupling"))
    kept = scored.filter("churn > 0 or coupling > 0") if zero_scores else scored.filter("score <> 0")
    ordered = kept.orderBy(F.col("score").desc(), "file")
    return ordered if top is None else ordered.limit(top)


def commit_blocks(lines: DataFrame, header: Column, order: str, stream: str | None = None) -> DataFrame:
    """block, header line and listed lines: a header opens a block; blocks without other lines are left out.

    lines has `line`; blank ones are skipped and others trimmed. `stream` tells independent logs apart.
    """
    by = Window.partitionBy(stream) if stream else Window.partitionBy(F.lit(0))
    marked = lines.withColumn("__h", header).withColumn("block", F.sum(F.col("__h").cast("int")).over(by.orderBy(order)))
    keys = ([stream] if stream else []) + ["block"]
    listed = F.array_sort(F.collect_list(F.when(~F.col("__h") & (F.trim("line") != ""), F.struct(order, F.trim("line").alias("line")))))
    grouped = marked.filter("block > 0").groupBy(*keys).agg(F.max(F.when(F.col("__h"), F.col("line"))).alias("header"), F.transform(listed, lambda x: x["line"]).alias("files"))
    return grouped.filter(F.size("files") > 0)
