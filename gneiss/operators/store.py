"""A table of embedded chunks: id, vector, content, metadata (JSON text), seq."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import scratch


def upsert(stored: DataFrame, added: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """Both tables with one row for each key: the added one, or of several the last in order."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(added.withColumn("__new", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(order).desc())
    return both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n", "__new")


def metadata_value(metadata: Column, key: str) -> Column:
    return F.get_json_object(metadata, f"$.{key}")


def matching(stored: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose metadata has the value, compared as text."""
    return stored.filter(metadata_value(F.col("metadata"), key) == F.lit(str(value)))


def delete_ids(stored: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return stored.join(ids.select(F.col(key).alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def delete_matching(stored: DataFrame, key: str | None = None, value: str | None = None) -> DataFrame:
    """Rows without the metadata value; without a key nothing is left."""
    if key is None:
        return stored.filter("false")
    return stored.filter(~F.coalesce(metadata_value(F.col("metadata"), key) == F.lit(str(value)), F.lit(False)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; vectors of different dimensions are an error."""
    checked = F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.raise_error(F.lit("vectors differ in dimension")).cast("double"))
    return checked / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def relevance(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def search(stored: DataFrame, query: list[float] | Column, top: int = 10, min_score: float | None = None, module: str | None = None, tie: str = "id") -> DataFrame:
    """The nearest rows with `score`, best first: filtered, scored, then the `top` (1 at least) of each task and of these."""
    rows = stored if module is None or not module.strip() else matching(stored, "module", module)
    vector = query if isinstance(query, Column) else F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("score", relevance(F.col("vector"), vector))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return scored.orderBy(F.col("score").desc(), tie).limit(max(1, top))


def coerced_number(text: Column) -> Column:
    """JSON numbers as kind:value: INTEGER or LONG where whole, else FLOAT; null for what is no number."""
    value = text.try_cast("double")
    whole = value == F.floor(value)
    return F.when(whole & (F.abs(value) <= 2147483647), F.concat(F.lit("INTEGER:"), value.cast("long").cast("string"))).when(whole, F.concat(F.lit("LONG:"), value.cast("long").cast("string"))).when(value.isNotNull(), F.lit("FLOAT"))


def batches(rows: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Adds batch: `size` rows each in order, numbered from 0, without ordering all rows in one task.

    Rows are dealt by ranges of the order and numbered there; the ranges' sizes, one number for each, give
    every range its first number.
    """
    size = max(1, size)
    # Written once, as the ranges must be the same for the rows and for the sizes.
    placed = scratch(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    numbered = placed.withColumn("__at", F.row_number().over(Window.partitionBy("__part").orderBy(order)))
    sizes = numbered.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return numbered.join(before, "__part").withColumn("batch", F.floor((F.col("__before") + F.col("__at") - 1) / size)).drop("__part", "__at", "__before")
