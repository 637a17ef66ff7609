"""Repeated windows of a token sequence: what substring and suffix-array deduplication share.

A window is `window` consecutive tokens of one document. Among the seeds (`seed` tokens) that start in a
window the one with the smallest hash is the window's anchor; equal windows have their anchor at one
place, so windows whose anchor's seed occurs once in the corpus cannot repeat. Anchors are about two of every
window - seed + 2 seeds. The windows of the other anchors go on to the operator's own method, cut out of
their texts and filed under the tokens around the anchor, and what it finds comes back to the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, by_bytes, keep, materialize, mix64, release, scratch, spread

#: Low bits of a sort key that hold a position; a chunk of tokens is shorter than 2 ** POSITION.
POSITION = 24
MOST_TOKENS = 1 << 22
#: Tokens, and windows, that anchors are cut out of at once.
CUT_TOKENS, CUT_WINDOWS = 1 << 21, 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1


@dataclass(frozen=True)
class Shape:
    """How windows are looked for. Offsets of an anchor in its windows must fit a byte."""

    window: int
    seed: int

    @property
    def reach(self) -> int:
        """Places that a seed can take in a window."""
        return self.window - self.seed + 1

    @property
    def half(self) -> int:
        """Tokens by which a seed is extended; every window holds the extension to one side."""
        return min(self.seed, self.reach // 2)


def rolling(tokens: np.ndarray, width: int) -> np.ndarray:
    """The hash of every `width` consecutive tokens (bytes or 64-bit hashes), put together from windows of doubled lengths."""
    if tokens.dtype == np.uint8:
        tokens = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))[tokens]
    out, at, length, power = None, 0, 1, BASE
    part = tokens
    while True:
        if width & length:
            piece = part[at : len(tokens) - width + 1 + at]
            out = piece.copy() if out is None else out * np.uint64(power) + piece
            at += length
        if 2 * length > width:
            return mix64(out)
        part = part[:-length] * np.uint64(power) + part[length:]
        power = power * power % (1 << 64)
        length *= 2


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    least, length = keys, 1
    while 2 * length <= width:
        least = np.minimum(least[:-length], least[length:])
        length *= 2
    n = len(keys) - width + 1
    return np.minimum(least[:n], least[width - length : width - length + n])


def anchors(tokens: np.ndarray, starts: np.ndarray, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: each anchor's document, place, first and last window, and seed.

    `starts` are the n + 1 places where documents begin.
    """
    n, reach = len(tokens), shape.reach
    nothing = np.empty(0, dtype=np.int64)
    if n < shape.window:
        return nothing, nothing, nothing, nothing, nothing.astype(np.uint64)
    seeds = rolling(tokens, shape.seed)
    low = np.uint64((1 << POSITION) - 1)
    keys = (seeds & ~low) | np.arange(len(seeds), dtype=np.uint64)
    at = (sliding_least(keys, reach) & low).astype(np.int64)
    lengths = np.diff(starts)
    room = np.maximum(lengths - shape.window + 1, 0)
    doc, place = spread(room)
    window = starts[doc] + place
    at = at[window]
    # Another document is another anchor, also where the same place would serve both.
    new = firsts(at, doc)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1 if len(first) else first
    at = at[first]
    return doc[first], at, window[first], window[last], seeds[at]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of one document that overlap or touch, made one."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((end, start, doc))
    doc, start, end = doc[order], start[order], end[order]
    # Farthest end so far within a document: documents are numbered, and ends shifted apart by number.
    number = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    apart = np.int64(1) << 40
    far = np.maximum.accumulate(end + number * apart)
    new = np.r_[True, (start + number * apart)[1:] > far[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], (far[last] - number[last] * apart)


def pack_place(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (at << 16) | ((at - lo) << 8) | (at - hi)


def unpack_place(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = place >> 16
    return at, at - ((place >> 8) & 255), at - (place & 255)


def rows(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=names)


def scan(docs: DataFrame, shape: Shape, tokenize: Callable) -> DataFrame:
    """seed, doc, place of every anchor of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                ids = batch.column("doc").to_numpy()
                tokens, starts = tokenize(batch.column("text"))
                for i, j in chunks(starts):
                    # A longer document goes in parts that overlap, so that every window is in one of them.
                    for a in range(int(starts[i]), max(int(starts[i]) + 1, int(starts[j]) - shape.window + 1), MOST_TOKENS) if starts[j] - starts[i] > MOST_TOKENS else [int(starts[i])]:
                        b = min(int(starts[j]), a + MOST_TOKENS + shape.window - 1)
                        part = np.array([0, b - a]) if j == i + 1 else starts[i : j + 1] - a
                        doc, at, lo, hi, seed = anchors(tokens[a:b], part, shape)
                        origin = starts[i:j][doc] - a
                        yield rows(seed, ids[i:j][doc], pack_place(at - origin, lo - origin, hi - origin), names=["seed", "doc", "place"])

    return docs.mapInArrow(run, "seed long, doc long, place long")


def chunks(starts: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `most` tokens."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, side="right")) - 1)
        yield i, j
        i = j


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    new = np.zeros(len(keys[0]), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Batches of rows sorted by key, cut so that no key is in two of them."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        if values[0] == values[-1] and rest and rest[0].column(key)[0].as_py() == values[0]:
            rest.append(batch)
            continue
        cut = int(np.searchsorted(values, values[-1], side="left"))
        if cut or rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def recurring(found: DataFrame, *keys: str) -> DataFrame:
    """The rows of a written table whose keys come more than once.

    Keys are counted before they move, and joined by merging written tables, which adaptive execution splits
    at a hot key: no task holds a key's rows.
    """
    several = materialize(found.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(*keys))
    release(found.sparkSession)
    return found.join(several.hint("merge"), list(keys), "left_semi")


@dataclass
class Cut:
    """Anchors of some texts: a run of tokens, and in it each anchor's document, place, first and last window."""

    tokens: np.ndarray
    doc: np.ndarray
    origin: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray


def cuts(batches: Iterator[pa.RecordBatch], shape: Shape, tokenize: Callable) -> Iterator[Cut]:
    """The anchors listed in `places` of every text, some at a time; `origin` is where a document begins in the run of tokens."""
    for whole in batches:
        for batch in by_bytes(whole, "text"):
            # Anchors in the order of their places, so that what keeps their order meets the earliest first.
            by = np.argsort(batch.column("doc").to_numpy(), kind="stable")
            if (by[1:] < by[:-1]).any():
                batch = batch.take(pa.array(by))
            tokens, starts = tokenize(batch.column("text"))
            ids = batch.column("doc").to_numpy()
            lists = batch.column("places")
            count = np.asarray(pc.list_value_length(lists)).astype(np.int64)
            at, lo, hi = unpack_place(np.asarray(lists.flatten()).astype(np.int64))
            row = np.repeat(np.arange(len(ids)), count)
            inside = hi + shape.window <= np.diff(starts)[row]  # not so where rows of one id differ in their texts
            at, lo, hi, row = at[inside], lo[inside], hi[inside], row[inside]
            begin = starts[row] + lo
            order = np.argsort(begin, kind="stable")
            at, lo, hi, row, begin = at[order], lo[order], hi[order], row[order], begin[order]
            load = np.cumsum(hi - lo + 1)
            i = 0
            while i < len(at):
                by_tokens = int(np.searchsorted(begin, begin[i] + CUT_TOKENS, side="right"))
                by_windows = int(np.searchsorted(load, (load[i - 1] if i else 0) + CUT_WINDOWS, side="right"))
                j = max(i + 1, min(by_tokens, by_windows))
                x, y = int(begin[i]), int((starts[row[i:j]] + hi[i:j]).max()) + shape.window
                yield Cut(tokens[x:y], ids[row[i:j]], starts[row[i:j]] - x, at[i:j], lo[i:j], hi[i:j])
                i = j


FILED = "key long, doc long, start long, count int, shift int, data binary"


def anchor_keys(cut: Cut, shape: Shape) -> np.ndarray:
    """The keys of a cut's anchors for windows that reach at least shape.half tokens left of them, and then those for
    others: the hash of the tokens from there to the seed's end, and of the seed and as many tokens right of it."""
    long = rolling(cut.tokens, shape.seed + shape.half)
    at = cut.origin + cut.at
    # An anchor that has no such window may have no such tokens.
    left, right = (long[np.clip(x, 0, len(long) - 1)] for x in (at - shape.half, at))
    return np.r_[left ^ np.uint64(0x5555), right]


def filed(cut: Cut, shape: Shape, alive: np.ndarray | None = None, key: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """FILED: the windows of a cut's anchors, under the seed's extension to the left or right.

    data holds the tokens from the first of `count` windows to the end of the last, and the anchor lies `shift`
    tokens after its start. With `alive`, one flag for each window of each anchor, only those set are filed, and a
    row holds windows without a gap. `key` are the cut's anchor_keys(), where they are there already.
    """
    key = anchor_keys(cut, shape) if key is None else key
    anchor, step = spread(cut.hi - cut.lo + 1)
    if alive is not None:
        anchor, step = anchor[alive], step[alive]
    place = cut.lo[anchor] + step
    left = place <= (cut.at - shape.half)[anchor]
    new = firsts(anchor, left) | np.r_[True, place[1:] != place[:-1] + 1][: len(place)]
    head = np.flatnonzero(new)
    if not len(head):
        return
    count = np.diff(np.r_[head, len(place)])
    anchor, left, first = anchor[head], left[head], place[head]
    key = key[np.where(left, anchor, anchor + len(cut.at))]
    size, cell, shift = count + shape.window - 1, cut.tokens.itemsize, (cut.at[anchor] - first).astype(np.int32)
    for i in range(0, len(key), 1 << 13):
        j = min(len(key), i + (1 << 13))
        which, at = spread(size[i:j])
        data = cut.tokens[(cut.origin[anchor[i:j]] + first[i:j])[which] + at].tobytes()
        ends = np.r_[0, np.cumsum(size[i:j] * cell)].astype(np.int32)
        part = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
        columns = [pa.array(key[i:j].view(np.int64)), pa.array(cut.doc[anchor[i:j]]), pa.array(first[i:j]), pa.array(count[i:j].astype(np.int32)), pa.array(shift[i:j]), part]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "start", "count", "shift", "data"])


#: Rows under one key that one task takes at once.
KEY_ROWS = 4096


def key_ranges(number: np.ndarray, most: int = 1 << 13) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` rows that part no key."""
    bounds = np.r_[np.flatnonzero(firsts(number)), len(number)]
    i = 0
    while i < len(bounds) - 1:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield int(bounds[i]), int(bounds[j])
        i = j


def shared_keys(batches: Iterator[pa.RecordBatch], part: str | None = None) -> Iterator[pa.Table]:
    """Of FILED rows sorted by key those whose key comes more than once, whole keys at a time; also those flagged in the column `part`."""
    for group in whole_groups(batches, "key"):
        number = np.cumsum(firsts(group.column("key").to_numpy())) - 1
        wanted = np.bincount(number)[number] > 1
        if part:
            wanted |= group.column(part).to_numpy()
        several = np.flatnonzero(wanted)
        for i, j in key_ranges(number[several]):
            yield group.take(pa.array(several[i:j]))


def crowded_keys(rows_: DataFrame) -> DataFrame:
    """key, n of keys with more than KEY_ROWS rows."""
    found = materialize(rows_.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > KEY_ROWS))
    release(rows_.sparkSession)
    return found


def identified(docs: DataFrame) -> DataFrame:
    """id (null where doc_id is), doc, text: doc orders rows by id; texts without an id come last, each a place of its own by its hash."""
    rows_ = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = rows_.agg(F.max("id").alias("top"), F.count_if(F.col("id").isNull()).alias("unnamed")).first()
    if not known["unnamed"]:
        return rows_.select("id", F.col("id").alias("doc"), "text")
    top = known["top"] if known["top"] is not None else -1
    if top > NO_ID - (1 << 61):
        # No room above the ids: they are numbered in their order.
        ids = rows_.select("id").filter("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
        rows_ = rows_.join(materialize(ids.withColumn("number", F.monotonically_increasing_id())), "id", "left")
        number, top = F.col("number"), 1 << 60
    else:
        number = F.col("id")
    unnamed: Column = F.lit(top + 1) + F.pmod(F.xxhash64("text"), F.lit(min(NO_ID, NO_ID - top)))
    return rows_.select("id", F.coalesce(number, unnamed).alias("doc"), "text")


def repeated(docs: DataFrame, shape: Shape, tokenize: Callable, method: Callable, finish: Callable, fields: str) -> DataFrame:
    """finish(texts, stretches) of all rows of docs, where stretches list what windows with earlier equals cover.

    method(texts with the places of anchors whose seeds recur) gives doc, start, end of what is covered, as a
    written table. docs has doc_id and text; both may be null, and other columns may have any name. Rows that
    repeat a doc_id stand at one place, so neither is later than the other; they should repeat the text too,
    while rows without an id stand apart by their texts. Lists of places are at most as long as their texts.
    """
    named = identified(docs)
    source = named.select("doc", "text")
    spark = docs.sparkSession
    with scratch(spark):
        found = materialize(scan(source, shape, tokenize))
        listed = materialize(recurring(found, "seed").groupBy("doc").agg(F.collect_list("place").alias("places")))
        release(spark, found)
        covered = method(source.join(listed.hint("merge"), "doc"))
        both = F.collect_list(F.shiftleft("start", 32).bitwiseOR(F.col("end")))
        stretches = keep(materialize(covered.groupBy("doc").agg(both.alias("stretches"))))
    release(spark)
    joined = named.join(stretches.hint("merge"), "doc", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                lists = batch.column("stretches")
                count = np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
                both = np.asarray(lists.flatten()).astype(np.int64)
                doc, start, end = merged(np.repeat(np.arange(batch.num_rows), count), both >> 32, both & 0xFFFFFFFF)
                at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                stretches = [list(zip(start[i:j].tolist(), end[i:j].tolist(), strict=True)) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield finish(batch.column("id"), batch.column("text"), stretches)

    return joined.mapInArrow(run, fields)
