"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def arity(signature: Column) -> Column:
    """How many parameters a signature text has: one more than its commas outside brackets; 0 if it has none.

    Brackets, the arrow's > aside, are counted over the characters that matter, however deep they are nested.
    """
    inner = F.regexp_extract(signature, r"(?s)^[^(]*\((.*)\)[^)]*$", 1)
    marks = F.split(F.regexp_replace(F.replace(inner, F.lit("->"), F.lit("")), "[^<>(),]", ""), "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(1).alias("n"))

    def step(at: Column, mark: Column) -> Column:
        depth = at["depth"] + F.when(mark.isin("<", "("), 1).when(mark.isin(">", ")"), -1).otherwise(0)
        return F.struct(depth.alias("depth"), (at["n"] + F.when((mark == ",") & (at["depth"] == 0), 1).otherwise(0)).alias("n"))

    return F.when(F.coalesce(F.trim(inner), F.lit("")) == "", 0).otherwise(F.aggregate(marks, start, step)["n"]).cast("int")


def table_name(collection: Column, prefix: str = "embeddings_", longest: int = 120) -> Column:
    """A collection's table: lower case, others than a-z 0-9 as single inner underscores, a letter first."""
    name = F.regexp_replace(F.lower(F.trim(collection)), "[^a-z0-9]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_|_$", "")
    name = F.when(name == "", "collection").otherwise(name)
    name = F.when(name.rlike("^[a-z]"), name).otherwise(F.concat(F.lit("c_"), name))
    return F.concat(F.lit(prefix), F.substring(name, 1, longest))


def quoted(identifier: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(identifier, F.lit('"'), F.lit('""')), F.lit('"'))


def signed_delta(before: Column, after: Column) -> Column:
    """`a → b  (+d)`, or `a → b  (no change)`."""
    d = after - before
    shown = F.when(d == 0, "no change").otherwise(F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string")))
    return F.concat(before.cast("string"), F.lit(" → "), after.cast("string"), F.lit("  ("), shown, F.lit(")"))


def lenient_int(value: Column) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(0))


def relative_to(path: Column, root: Column) -> Column:
    """The path below root, or the path itself outside of it."""
    base = F.regexp_replace(root, "/+$", "")
    return F.when(path.startswith(F.concat(base, F.lit("/"))), F.substring(path, F.length(base) + 2, F.length(path))).otherwise(path)


def progress_percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(F.least(F.greatest(done, F.lit(0)), total) * 100 / total)).otherwise(100).cast("int")


def duration(seconds: Column) -> Column:
    """`Hh MMm SSs`, or `Mm SSs` below an hour; negative is zero."""
    s = F.greatest(seconds, F.lit(0)).cast("long")
    hours, minutes, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(hours > 0, F.format_string("%dh %02dm %02ds", hours, minutes, rest)).otherwise(F.format_string("%dm %02ds", minutes, rest))


def first_given(*settings: Column) -> Column:
    """The first setting that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in settings])


def snapshot_label(label: Column, created: Column) -> Column:
    return F.concat_ws(" @ ", label, F.coalesce(created, F.lit("unknown")))


def safe_label(label: Column) -> Column:
    return F.regexp_replace(label, "[^a-zA-Z0-9_-]", "-")


def gradle_path(path: Column) -> Column:
    """An included project's path as a relative folder: dots and colons part folders."""
    return F.replace(F.regexp_replace(F.replace(F.trim(path), F.lit("."), F.lit("/")), "^:+", ""), F.lit(":"), F.lit("/"))
