"""Substring deduplication over words, by level-wise doubling.

Level 1 looks at windows of a quarter of the length: of the seeds in each full window the one with the smallest
hash, which loses no repeat. Those that come more than once are extended to either side to twice that length
(level 2) and dealt to tasks by these; what comes more than once again is extended to the full length (level 3).
Each level reads the survivors of the one before and nothing else. Of the windows of full length that come more
than once all but the earliest are removed. Where very many survivors of level 2 are alike, their windows of full
length are sought in blocks first, and the earliest of each block are dealt anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import materialize, outer_id, release, spread, text_buffer, word_parts
from .minhash import word_hashes
from .repeats import FILED, Shape, crowded_keys, cuts, filed, firsts, merged, repeated, rolling, shared_keys

WINDOW = 20
FIELDS = "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string"


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts, and the n + 1 places where texts begin."""
    hashes, counts = [], []
    waiting: list[bytes] = []
    for text in column.cast(pa.binary()).to_pylist():
        n = 0
        for words in word_parts(text):
            n += len(words)
            waiting += words
            if len(waiting) > 1 << 19:
                hashes.append(word_hashes(waiting))
                waiting = []
        counts.append(n)
    hashes.append(word_hashes(waiting))
    return np.concatenate(hashes).astype(np.uint64), np.r_[0, np.cumsum(counts)].astype(np.int64)


def second_level(texts: DataFrame, shape: Shape) -> DataFrame:
    """FILED: the level 1 survivors extended to twice their length, with the words of the full windows around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in cuts(batches, shape, words_of):
            yield from filed(cut, shape)

    return texts.mapInArrow(run, FILED)


def names_of(tokens: np.ndarray, at: np.ndarray, window: int, length: int) -> np.ndarray:
    """A number for the window of `window` tokens at each place: equal for equal windows, unique where nothing repeats.

    Level by level a window's name stands for the names of two shorter ones that cover it; from `length` on, windows
    that begin with a part that no other begins with are left behind.
    """
    names = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    size, alive = 1, np.arange(len(at))
    while size < window and len(alive):
        longer = min(2 * size, window)
        shift = longer - size
        n = len(names) - shift
        pair = names[:n] * (int(names.max()) + 1) + names[shift:]
        names = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        size = longer
        if size >= length:
            own = names[at[alive]]
            alive = alive[np.bincount(own)[own] > 1]
    found = -1 - np.arange(len(at))
    found[alive] = names[at[alive]]
    return found


def third_level(survivors: DataFrame, crowded: DataFrame, shape: Shape) -> DataFrame:
    """FILED: of the windows of full length, whose extended seeds recur, those that also start earlier.

    Rows without data are stretches that such windows cover. Crowded keys are dealt in blocks of about KEY_ROWS rows;
    the earliest window of its kind in a block goes on, one a row, with the hash of the whole window as its key.
    """
    blocks = F.pmod(F.xxhash64("doc", "start"), F.ceil(F.col("n") / repeats.KEY_ROWS))
    dealt = survivors.join(crowded, "key", "left").select(
        F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", blocks)).alias("key"), F.col("n").isNotNull().alias("part"), "doc", "start", "count", "data"
    )
    placed = dealt.repartition("key").sortWithinPartitions("key", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared_keys(batches, "part"):
            raw, starts = text_buffer(group.column("data"))
            tokens = np.frombuffer(raw.tobytes(), dtype=np.uint64)
            row, step = spread(group.column("count").to_numpy().astype(np.int64))
            at = starts[row] // 8 + step
            doc, place = group.column("doc").to_numpy()[row], group.column("start").to_numpy()[row] + step
            part = group.column("part").to_numpy(zero_copy_only=False)[row]
            names = names_of(tokens, at, shape.window, 2 * shape.half)
            by = np.lexsort((place, doc, names))
            new = firsts(names[by])
            head = by[new]
            own = head[np.cumsum(new) - 1]
            late = by[(doc[by] != doc[own]) | (place[by] != place[own])]
            gone, start, end = merged(doc[late], place[late], place[late] + shape.window)
            yield covered(gone, start, end)
            head = head[part[head]]
            key = rolling(tokens, shape.window)[at[head]] if len(head) else at[head]
            for i in range(0, len(head), 1 << 13):
                j = slice(i, i + (1 << 13))
                yield single_windows(tokens, at[head[j]], key[j], doc[head[j]], place[head[j]], shape.window)

    return placed.mapInArrow(run, FILED)


def covered(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """FILED rows of stretches: count is their length, and there is no data."""
    n = len(doc)
    zeros, none = np.zeros(n, np.int64), pa.nulls(n, pa.binary())
    columns = [pa.array(zeros), pa.array(doc), pa.array(start), pa.array((end - start).astype(np.int32)), pa.array(zeros.astype(np.int32)), none]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "start", "count", "shift", "data"])


def single_windows(tokens: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch:
    """FILED rows of one window each."""
    n = len(key)
    data = tokens[at[:, None] + np.arange(window)].tobytes()
    ends = np.arange(n + 1) * (window * tokens.itemsize)
    part = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data)])
    columns = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.ones(n, np.int32)), pa.array(np.zeros(n, np.int32)), part]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "start", "count", "shift", "data"])


def doubling(texts: DataFrame, shape: Shape) -> DataFrame:
    """doc, start, end of the windows that also start earlier, level by level.

    What crowded keys hand on is one in KEY_ROWS of the copies of a window; it goes through the third level again
    until no key is crowded. Crowded keys are one in KEY_ROWS of the rows or fewer: Spark sends their table to all
    tasks where its written size is below its limit, and merges beyond.
    """
    spark = texts.sparkSession
    rows_, done = materialize(second_level(texts, shape)), []
    release(spark)
    while True:
        crowded = crowded_keys(rows_)
        found = materialize(third_level(rows_, crowded, shape))
        release(spark, *([] if done else [rows_]))
        done.append(found.filter("data is null").select("doc", "start", (F.col("start") + F.col("count")).alias("end")))
        rows_ = found.filter("data is not null")
        if crowded.isEmpty():
            return reduce(DataFrame.unionByName, done)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """FIELDS of every row: a word goes if a window of `window` words that covers it also starts earlier.

    Earlier is a smaller doc_id or the same document further up; a null doc_id comes last. Words are what
    lies between ASCII white space; a null text has none. Kept words are joined by single spaces. Repeated rows
    stand at one place, so neither is later; no rows give no rows; other columns may have any name. Words are
    compared by 64 bits of their hashes.
    """
    shape = Shape(window, max(1, window // 4))

    def finish(doc: pa.Array, text: pa.Array, stretches: list) -> pa.RecordBatch:
        out = []
        for t, gone in zip(text.cast(pa.binary()).to_pylist(), stretches, strict=True):
            n, removed, kept, ends = 0, 0, [], iter([*gone, (1 << 62, 1 << 62)])
            a, b = next(ends)
            for words in word_parts(t):
                # The words of this part that lie in no stretch; a stretch may go on in the next part.
                i, left = 0, []
                while i < len(words):
                    if n + i >= b:
                        a, b = next(ends)
                    elif n + i < a:
                        j = min(len(words), a - n)
                        left += words[i:j]
                        i = j
                    else:
                        j = min(len(words), b - n)
                        removed += j - i
                        i = j
                n += len(words)
                if left:
                    kept.append(b" ".join(left))
            kept = b" ".join(kept)
            out.append((n, removed, kept.decode("utf-8", "replace"), hashlib.sha256(kept).hexdigest()))
        n, removed, kept, digest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return repeated(docs, shape, words_of, lambda texts: doubling(texts, shape), finish, FIELDS).withColumn("doc_id", outer_id("doc_id"))
