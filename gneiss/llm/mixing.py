"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

A source with target t and size s gives every document floor(t / s) whole copies. What is left of the target,
in words, is a sample without replacement with probabilities in proportion to size: a document's inclusion
probability is p = min(1, rate * size), where the rate makes the expected words of the sample the ones still
needed; documents long enough for p = 1 are certain. With a random number u of its own, a document has rank
(u / (1 - u)) / (p / (1 - p)), and the documents of lowest rank are taken while their words fit. The size that
is fixed is that of the sample in words, as targets are. One more document, whose size comes nearest to what is
still missing, closes it. Ranks are cut into a histogram in two levels, so no task orders a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keep, materialize, scratch

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BINS = 1024
SEED = 17
#: Sources up to which their table is sent to all tasks; with more it is joined by source, and adaptive execution splits a hot one.
FEW_SOURCES = 50_000


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def key_of() -> Column:
    """A digest of id, text and source: equal for equal rows, and other rows' numbers are drawn apart."""
    parts = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.md5(F.coalesce("text", F.lit(""))), F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))]
    return F.md5(F.concat_ws(":", *parts))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, __key: the number of words of each row; null and empty texts have none."""
    return docs.select("doc_id", "source", size_of("text").alias("size"), key_of().alias("__key"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds __ordinal to rows with a __key: 0, 1, ... among the rows of one key, which are equal.

    Rows are numbered within the partitions they lie in and partitions by their counts, so a key with very
    many rows is no task's work. Which of them gets which number makes no difference to the result.
    """
    again = materialize(rows.groupBy("__key").agg(F.count("*").alias("__n")).filter("__n > 1").select("__key"))
    if again.isEmpty():
        return rows.withColumn("__ordinal", F.lit(0).cast("long"))
    equal = materialize(rows.join(again, "__key", "left_semi").withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    counts = equal.groupBy("__key", "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__key").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = materialize(counts.select("__key", "__part", F.coalesce(before, F.lit(0)).alias("__before")))
    within = F.row_number().over(Window.partitionBy("__key", "__part").orderBy("__at"))
    some = equal.withColumn("__within", within).join(counts, ["__key", "__part"]).withColumn("__ordinal", F.col("__before") + F.col("__within") - 1)
    return rows.join(again, "__key", "left_anti").withColumn("__ordinal", F.lit(0).cast("long")).select(*rows.columns, "__ordinal").unionByName(some.select(*rows.columns, "__ordinal"))


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """Adds `target` to (source, source_size).

    The k-th source by code point (null last) has the k-th weight, repeating. All sizes are shared by
    weight; a target stops at `most` times its source's size and the excess is shared again. In the order
    of (most * size) / weight the sources that stop come first, so running sums find the common level.
    The order of all sources is one task's work, with a row for each source.
    """
    ordered = per_source.withColumn("__k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__k") % len(weights) + 1).cast("int")).cast("double")
    ordered = ordered.withColumn("__w", weight).withColumn("__cap", (F.col("source_size") * most).cast("double"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    level = left / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    levelled = ordered.withColumn("__level", level)
    # The level before a source is common to all from the first that does not stop.
    open_ = F.struct((F.col("__cap") / F.col("__w")).alias("a"), F.col("__k").alias("b"), F.col("__level").alias("level"))
    common = F.min(F.when(F.col("__cap") >= F.col("__level") * F.col("__w"), open_)).over(every)["level"]
    share = F.least(F.col("__cap"), F.coalesce(common, F.lit(float("inf"))) * F.col("__w"))
    return levelled.withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(share)).select("source", "source_size", "target")


def rates(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """__source, rate: the rate at which min(1, rate * size) of all documents expects `need` words.

    sizes has (source, size, n). From the longest down: with all longer ones certain, the rate would be what is
    needed besides them over the squares of the others; the first size that it does not make certain sets it.
    """
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    longer = F.coalesce(F.sum(F.col("n") * F.col("size")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    square = F.col("n").cast("decimal(38,0)") * (F.col("size") * F.col("size"))
    others = F.sum(square.cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    tried = sizes.filter("size > 0").join(plan.select("__source", "need"), F.col("source").eqNullSafe(F.col("__source")))
    tried = tried.withColumn("__rate", (F.col("need") - longer) / others).filter(F.col("__rate") * F.col("size") <= 1)
    return tried.groupBy("__source").agg(F.max_by("__rate", "size").alias("rate"))


def with_plan(df: DataFrame, other: DataFrame, few: bool) -> DataFrame:
    """df with the columns that a table holds for each __source; the table is sent to all tasks if sources are few."""
    return df.join(F.broadcast(other) if few else other, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Adds __rank and __bin, __sub: where the rank lies among BINS * BINS steps; without words it is null.

    u has 52 bits of an MD5, which any engine can make.
    """
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("__key"), F.col("__ordinal").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10)
    u = (bits.cast("long").cast("double") + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("rate") * F.col("size"))
    rows = rows.withColumn("__p", p).withColumn("__rank", F.when(F.col("__p") > 0, (u / (1 - u)) * ((1 - F.col("__p")) / F.col("__p"))))
    fine = F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    return rows.withColumn("__bin", F.floor(fine / BINS)).withColumn("__sub", fine % BINS).drop("__p")


def crossing(df: DataFrame, name: str) -> DataFrame:
    """The bin of each source where running sizes pass `need`, and what is still needed there."""
    sums = df.groupBy("source", name).agg(F.sum("size").alias("s"), F.first("need").alias("need"))
    run = sums.withColumn("c", F.sum("s").over(Window.partitionBy("source").orderBy(name)))
    at = run.filter((F.col("c") > F.col("need")) & (F.col("c") - F.col("s") <= F.col("need")))
    return materialize(at.select(F.col("source").alias("__source"), F.col(name).alias(f"at{name}"), (F.col("need") - F.col("c") + F.col("s")).alias("need")))


def place() -> Column:
    """Where a row stands in the order of the sample; no two rows stand at one place."""
    return F.struct("__rank", "__key", "__ordinal")


def chosen(rows: DataFrame) -> DataFrame:
    """Adds __in: whether the sample takes the row, but for the closing document."""
    at, cut = F.col("__bin") * BINS + F.col("__sub"), F.col("at__bin") * BINS + F.col("at__sub")
    in_last = (at == cut) & F.col("last").isNotNull() & (place() <= F.col("last"))
    return rows.withColumn("__in", F.coalesce(at < cut, F.lit(False)) | F.coalesce(in_last, F.lit(False)))


def off() -> Column:
    return F.abs(F.col("size") - F.col("gap"))


def null_safe(df: DataFrame, other: DataFrame, name: str) -> DataFrame:
    """Tables of one row for each __source, joined."""
    return df.join(other.withColumnRenamed("__source", name), F.col("__source").eqNullSafe(F.col(name)), "left").drop(name)


def plan_mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """One row for each source: its size, target, whole copies, rate, and where its sample ends."""
    with scratch(rows.sparkSession):
        sizes = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
        plan = targets(sizes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
        whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
        plan = plan.withColumn("whole", whole).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "__source")
        plan = materialize(plan)
        plan = materialize(null_safe(plan, rates(sizes, plan), "__s").fillna(0.0, ["rate"]))
        few = plan.count() <= FEW_SOURCES
        every = ranked(with_plan(rows, plan.select("__source", "rate", "need"), few), seed).filter("__rank is not null")
        first = crossing(every, "__bin")
        second = crossing(with_plan(every.drop("need"), first, few).filter("__bin = at__bin"), "__sub")
        edges = null_safe(first.drop("need"), second, "__s")
        within = with_plan(every.drop("need"), edges, few).filter("__bin = at__bin and __sub = at__sub")
        run = F.sum("size").over(Window.partitionBy("source").orderBy("__rank", "__key", "__ordinal").rowsBetween(Window.unboundedPreceding, 0))
        fits = F.col("__run") <= F.col("need")
        ends = [F.max(F.when(fits, place())).alias("last"), (F.first("need") - F.coalesce(F.max(F.when(fits, F.col("__run"))), F.lit(0))).alias("gap")]
        stop = within.withColumn("__run", run).groupBy("source").agg(*ends).withColumnRenamed("source", "__source")
        stop = materialize(null_safe(stop, edges.drop("need"), "__s"))
        # The document beyond the cut whose size comes nearest to what is still missing, if nearer than none.
        beyond = chosen(with_plan(every.drop("need"), stop, few)).filter(~F.col("__in") & (off() < F.col("gap")))
        closing = beyond.groupBy("source").agg(F.min(F.struct(off().alias("off"), "__rank", "__key", "__ordinal")).alias("closing")).withColumnRenamed("source", "__source")
        return keep(materialize(null_safe(null_safe(plan.drop("need"), stop, "__s"), closing, "__s")))


def apply_mix(rows: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds source_size, target, copies and taken = copies * size to rows with source, size, __key and __ordinal."""
    found = chosen(ranked(with_plan(rows, plan, plan.count() <= FEW_SOURCES), seed))
    closes = place() == F.struct("closing.__rank", "closing.__key", "closing.__ordinal")
    extra = F.col("__in") | F.coalesce(F.col("closing").isNotNull() & closes & ~F.col("__in"), F.lit(False))
    found = found.withColumn("copies", F.col("whole") + extra.cast("long"))
    return found.withColumn("taken", F.col("copies") * F.col("size")).select(*rows.columns, "source_size", "target", "copies", "taken")


def mix_to_weights(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken of every row of docs.

    Reruns agree: every choice depends on doc_id, text, source and seed alone. Equal rows have numbers of their
    own, so some may be taken and others not. A null source is a source, the last; a null doc_id is a value like
    any other; null and empty texts have size 0. No rows give no rows. Other columns may have any name.
    """
    rows = materialize(numbered(materialize(sized(docs))))
    return apply_mix(rows, plan_mix(rows, weights, most, seed), seed).drop("__key", "__ordinal")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; only the plan of a row for each source is joined.

    What mix_to_weights() says of odd rows holds here.
    """
    plan = plan_mix(materialize(numbered(materialize(sized(docs)))), weights, most, seed)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "source", size_of("text").alias("size"), key_of().alias("__key"))
    copies = F.sequence(F.lit(1), F.col("copies").cast("int"))
    taken = apply_mix(numbered(whole), plan, seed).filter("copies > 0").select("__row", F.explode(copies).alias("__copy"))
    return taken.select("__row.*")
