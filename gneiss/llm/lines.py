"""Repeated runs of lines, found by winnowing over line hashes, with DataFrame operations only.

Of the hashes of every `run` consecutive lines the smallest is selected (of equal ones the last), so two runs
of that length that are alike have the same line selected: its hash is their fingerprint. Selected positions
are joined by fingerprint, and positions whose fingerprint stands nowhere else go. Each match is extended up
and down to the runs that selected it: positions are regrouped by the lines around them, so a position meets
the earliest one that still matches and never all of them. Runs that match an earlier place are chained where
they overlap, which extends a match as far as it goes, and a document loses the lines of its later runs.
A single line of many words can count as a run too; it is its own fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, internal_id, keep, materialize, scratch

RUN = 2
#: Words from which a single line counts as a run.
LONG_WORDS = 50


def positions(docs: DataFrame, run: int = RUN, long: int | None = LONG_WORDS) -> DataFrame:
    """doc, text_key, fp, runs: every selected line, with start, length n and a digest of each run that selected it."""
    # `long` words have as many bytes and the spaces between.
    least = 2 * long - 1 if long else 0
    worth = F.contains("t", F.lit("\n")) | (F.length("t") >= least if long else F.lit(False))
    rows = docs.select(internal_id("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("t")).filter(worth)
    rows = rows.select("doc", F.xxhash64("t").alias("text_key"), F.split("t", "\n", -1).alias("lines"))
    rows = rows.select("doc", "text_key", "lines", F.transform("lines", lambda line: F.xxhash64(line)).alias("h"))
    n = F.size("h")

    def selected(s: Column) -> Column:
        return s - F.array_min(F.transform(F.slice("h", s + 1, run), lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))["i"]

    starts = F.when(n >= run, F.transform(F.sequence(F.lit(0), F.greatest(n - run, F.lit(0))), selected)).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc", "text_key", "lines", "h", starts.alias("sel"))

    def runs(i: Column) -> Column:
        near = F.sequence(F.greatest(i - run + 1, F.lit(0)), F.least(i, F.greatest(F.size("sel") - 1, F.lit(0))))
        mine = F.filter(near, lambda s: F.coalesce(F.get("sel", s) == i, F.lit(False)))
        found = F.transform(mine, lambda s: F.struct(s.alias("start"), F.lit(run).alias("n"), F.xxhash64(F.slice("h", s + 1, run)).alias("key")))
        if not long:
            return found
        line = F.get("lines", i)
        many = (F.length(line) >= least) & (F.regexp_count(line, F.lit(WORD_PATTERN)) >= long)
        own = F.array(F.struct(i.alias("start"), F.lit(1).alias("n"), F.xxhash64(F.lit(1), line).alias("key")))
        return F.when(many, F.concat(found, own)).otherwise(found)

    every = F.transform("h", lambda x, i: F.struct(x.alias("fp"), runs(i).alias("runs")))
    return rows.select("doc", "text_key", F.explode(every).alias("p")).select("doc", "text_key", "p.fp", "p.runs").filter(F.size("runs") > 0)


def later_runs(docs: DataFrame, run: int = RUN, long: int | None = LONG_WORDS) -> DataFrame:
    """doc, text_key, covered: the lines of runs that also stand earlier (smaller doc_id, or further up).

    A written table; what it was made from is deleted. Joins are merges at every size, which adaptive execution
    splits at a hot fingerprint.
    """
    with scratch(docs.sparkSession):
        found = materialize(positions(docs, run, long))
        at = F.xxhash64("doc", "text_key", F.col("runs")[0]["start"])
        places = found.select("fp", at.alias("at")).groupBy("fp").agg(F.min("at").alias("least"), F.max("at").alias("most"))
        shared = materialize(places.filter("least <> most").select("fp"))
        matched = found.join(shared.hint("merge"), "fp", "left_semi")
        extended = materialize(matched.select("fp", "doc", "text_key", F.explode("runs").alias("r")).select("fp", "r.key", "doc", "text_key", "r.start", "r.n"))
        place = F.struct("doc", "text_key", "start")
        first = extended.groupBy("fp", "key", "n").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
        later = extended.join(materialize(first).hint("merge"), ["fp", "key", "n"]).filter(place > F.col("first"))
        runs = F.collect_set(F.struct("start", "n")).alias("runs")
        chained = F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["start"], r["start"] + r["n"] - 1))))
        return keep(materialize(later.groupBy("doc", "text_key").agg(runs).select("doc", "text_key", chained.alias("covered"))))


def deduplicated(docs: DataFrame, run: int = RUN, long: int | None = LONG_WORDS) -> DataFrame:
    """docs with __kept (the text without its later runs), __n_lines and __n_removed.

    A line is removed if it lies in a run of `run` lines that also starts earlier, or if it has `long` words or
    more and also stands earlier; runs are judged on the input. Lines are compared as they are. A null text stays
    null and, like an empty one, has one line. Repeated rows stand at one place, so neither is later; rows without
    an id come last, in the order of their texts' hashes. No rows give no rows; other columns may have any name.
    """
    found = later_runs(docs, run, long).select(F.col("doc").alias("__doc"), F.col("text_key").alias("__key"), F.col("covered").alias("__covered"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), internal_id("doc_id").alias("__doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"))
    joined = rows.join(found.hint("merge"), ["__doc", "__key"], "left")
    text, covered = F.col("__row")["text"], F.col("__covered")
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
    kept = F.array_join(F.transform(left, lambda i: F.element_at(lines, i + 1)), "\n")
    some = covered.isNotNull()
    counts = [F.size(lines).cast("long").alias("__n_lines"), F.when(some, F.size(covered)).otherwise(0).cast("long").alias("__n_removed")]
    return joined.select("__row.*", F.when(some, kept).otherwise(text).alias("__kept"), *counts)
