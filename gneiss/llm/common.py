"""What the operators of this folder share: tables, storage between jobs, texts in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once.
CHUNK_BYTES = 1 << 21
#: Stands for a null id inside an operator; nulls sort after every id.
NO_ID = (1 << 63) - 1
#: The six ASCII white-space bytes; words are what lies between them.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only a session on this machine alone may name none; it gets a temporary folder.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        named = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = named.get() if named.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = worker_state().setdefault("shared_dir", "file://" + tempfile.mkdtemp(prefix="gneiss-"))
    return where.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, so that its lineage ends there.

    Inside scratch() the table is deleted at its end unless keep() saves it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gneiss-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    open_scopes = worker_state().setdefault("scopes", [])
    if open_scopes:
        open_scopes[-1].append(path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._gneiss_path = path
    return found


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables that nothing reads any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables that have been read, and let Spark drop the shuffle files of the steps before.

    Spark drops these when the driver's collector finds that nothing refers to them, which may be long after.
    """
    paths = [t._gneiss_path for t in tables]
    for open_scope in worker_state().setdefault("scopes", []):
        open_scope[:] = [p for p in open_scope if p not in paths]
    discard(spark, paths)
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end the tables written inside but for those that keep() hands on."""
    open_scopes = worker_state().setdefault("scopes", [])
    mine: list[str] = []
    open_scopes.append(mine)
    try:
        yield
    finally:
        open_scopes.pop()
        discard(spark, mine)


def keep(df: DataFrame) -> DataFrame:
    """A table of materialize() that outlives the scratch() it was written in."""
    open_scopes = worker_state()["scopes"]
    open_scopes[-1].remove(df._gneiss_path)
    if len(open_scopes) > 1:
        open_scopes[-2].append(df._gneiss_path)
    return df


def internal_id(name: str) -> Column:
    """A non-null long for an id column."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def outer_id(name: str) -> Column:
    """Undo internal_id."""
    return F.when(F.col(name) != NO_ID, F.col(name))


def worker_state() -> dict:
    """A dictionary that lives as long as this Python process; functions sent by value lose their globals."""
    return sys.modules.setdefault("gneiss_worker_state", types.ModuleType("gneiss_worker_state")).__dict__


def forget() -> None:
    """Drop what tokenizing has left in this process, and give its memory back to the system.

    Workers serve one stage after another and live on with their session; only tokenizing uses it again.
    """
    if not any([worker_state().pop(name, None) for name in ("encoded", "tokenizers")]):
        return
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # the C library may have no such function
        ctypes.CDLL(None).malloc_trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array laid end to end, and the n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def by_bytes(batch: pa.RecordBatch, name: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `most` bytes of text each; a longer text is alone in its slice."""
    _, offsets = text_buffer(batch.column(name))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths: the run that each element belongs to, and its place in the run."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def word_parts(text: bytes, most: int = 1 << 22) -> Iterator[list[bytes]]:
    """The words of a text between ASCII white space, those of about `most` bytes at a time."""
    at = 0
    while len(text) - at > most:
        end = WHITE_BYTE.search(text, at + most)
        if not end:
            break
        yield text[at : end.start()].split()
        at = end.start()
    yield (text[at:] if at else text).split()
