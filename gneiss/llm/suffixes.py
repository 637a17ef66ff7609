"""Suffix-array deduplication over bytes, by deep-shallow sorting.

Suffixes are sorted by multikey quicksort, whose characters are eight bytes wide, to a shallow depth: a group of
suffixes that agree so far is parted in three by a pivot's character, the middle part goes on to the next character,
and all groups take their step at once. Groups that are still tied at the shallow depth share a long prefix; a
blind trie for each orders what is left of them up to the length that matters. Neighbours in that order with a
common prefix of the full length are equal, and the later of them are covered.

The suffixes are those of windows whose anchor's seed recurs (see repeats). Each task sorts those of its texts and
sends on the first of equal ones; these are dealt to tasks by the bytes around their anchors and sorted again. Under
a key with very many rows they are sorted in blocks first, and the first ones that are left are dealt by all bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import materialize, outer_id, release, spread, text_buffer
from .repeats import FILED, Shape, anchor_keys, crowded_keys, cuts, filed, firsts, key_ranges, merged, repeated, rolling, shared_keys, whole_groups

LENGTH = 100
SEED = 32
#: Bytes to which multikey quicksort goes.
SHALLOW = 64
FIELDS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"


class BlindTrie:
    """Suffixes in order from one depth to another; nodes know where strings part, not what they have in common.

    An inner node is (place, children by the byte there); a leaf is the list of the numbers of equal suffixes.
    No string is kept: what must be compared is read where the first suffix of a leaf begins.
    """

    def __init__(self, raw: bytes, at: list[int], depth: int, length: int):
        self.raw, self.at, self.depth, self.length, self.root = raw, at, depth, length, None

    def insert(self, number: int) -> None:
        raw, depth, length = self.raw, self.depth, self.length
        mine = self.at[number]
        if self.root is None:
            self.root = [number]
            return
        node = self.root
        while type(node) is tuple:
            node = node[1].get(raw[mine + node[0]]) or next(iter(node[1].values()))
        other = self.at[node[0]]
        like, s = raw[other + depth : other + length], raw[mine + depth : mine + length]
        if like == s:
            node.append(number)
            return
        differs = int.from_bytes(like, "big") ^ int.from_bytes(s, "big")
        place = length - (differs.bit_length() + 7) // 8
        above, node = None, self.root
        while type(node) is tuple and node[0] < place:
            above, node = node, node[1][raw[mine + node[0]]]
        if type(node) is tuple and node[0] == place:
            node[1][raw[mine + place]] = [number]
            return
        parting = (place, {raw[other + place]: node, raw[mine + place]: [number]})
        if above is None:
            self.root = parting
        else:
            above[1][raw[mine + above[0]]] = parting

    def leaves(self):
        """The leaves in the order of their suffixes."""
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield node


def wide_characters(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number that sorts as they do; zeros follow the end."""
    wide = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    for shift in (1, 2, 4):
        wide = (wide[:-shift] << np.uint64(8 * shift)) | wide[shift:]
    return wide


def multikey_quicksort(wide: np.ndarray, at: np.ndarray, order: np.ndarray, size: np.ndarray, length: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of each group by their first `shallow` bytes, in place in `order`; equal ones keep their order.

    Groups of the given sizes lie side by side in `order`. Each round parts every group in three by the character of
    its middle suffix at the group's depth; the part equal to the pivot goes one character on. Groups of one suffix
    are done, and so are those that are tied at the shallow depth: their places and sizes come back.
    """
    least = min(shallow, length)
    places, sizes = [], []
    head = np.r_[0, np.cumsum(size)[:-1]] if len(size) else size
    depth = np.zeros(len(size), np.int64)
    while True:
        done = depth >= least
        places.append(head[done & (size > 1)])
        sizes.append(size[done & (size > 1)])
        on = ~done & (size > 1)
        head, size, depth = head[on], size[on], depth[on]
        if not len(head):
            break
        first = np.cumsum(size) - size
        todo = np.repeat(head - first, size) + np.arange(int(size.sum()))
        o = order[todo]
        character = wide[at[o] + np.repeat(np.minimum(depth, length - 8), size)]
        pivot = np.repeat(character[first + size // 2], size)
        side = (character > pivot).astype(np.int8) - (character < pivot).astype(np.int8)
        part = np.repeat(np.arange(1, 3 * len(size), 3), size) + side
        if side.any():
            by = np.argsort(part, kind="stable")
            order[todo], part = o[by], part[by]
        new = np.flatnonzero(firsts(part))
        parent, middle = part[new] // 3, part[new] % 3 == 1
        head = head[parent] + new - first[parent]
        size = np.diff(np.r_[new, len(part)])
        depth = depth[parent] + 8 * middle
    return np.concatenate(places), np.concatenate(sizes)


def deep_shallow(data: np.ndarray, at: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of data that start `at` these places, compared up to `length` bytes, and in it the
    places where suffixes begin that differ from the one before.

    With `group`, suffixes of one number lie side by side and only these are compared; equal suffixes keep the
    order they were given in. Every suffix must have `length` bytes, 8 at least.
    """
    n = len(at)
    if group is None:
        order, begins = np.arange(n), np.arange(min(n, 1))
    else:
        order = np.argsort(group, kind="stable")
        begins = np.flatnonzero(firsts(group[order]))
    wide = wide_characters(data)
    head, size = multikey_quicksort(wide, at, order, np.diff(np.r_[begins, n]), length, shallow)
    depth = min(shallow, length)
    new = np.ones(n, dtype=bool)
    first = np.cumsum(size) - size
    tied = np.repeat(head - first, size) + np.arange(int(size.sum()))
    new[tied] = False
    new[head] = True
    if depth < length and len(tied):
        # A group whose suffixes are equal to the end would be a trie of one leaf.
        here, like = at[order[tied]], np.repeat(at[order[head]], size)
        differs = np.zeros(len(tied), dtype=bool)
        for place in [*range(depth, length - 8, 8), length - 8]:
            differs |= wide[here + place] != wide[like + place]
        raw, places = data.tobytes(), at.tolist()
        for k in np.flatnonzero(np.logical_or.reduceat(differs, first)):
            i, j = int(head[k]), int(head[k] + size[k])
            trie = BlindTrie(raw, places, depth, length)
            for number in order[i:j].tolist():
                trie.insert(number)
            for leaf in trie.leaves():
                order[i : i + len(leaf)] = leaf
                new[i] = True
                i += len(leaf)
    return order, np.flatnonzero(new)


def neighbours(data: np.ndarray, at: np.ndarray, group: np.ndarray, doc: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of windows that start `at` these places of data, and stand at `place` of `doc`: those that have an equal one
    at an earlier place, and those that are the first of their equals. The same place again is neither.

    Windows of one group must come in the order of their places.
    """
    order, begins = deep_shallow(data, at, length, group=group)
    head = np.repeat(order[begins], np.diff(np.r_[begins, len(order)]))
    late, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
    late[order] = (doc[order] != doc[head]) | (place[order] != place[head])
    first[order[begins]] = True
    return late, first


def groups_of(key: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """A number for each (key, offset of the anchor in the window): equal windows agree in both."""
    return (np.unique(key, return_inverse=True)[1] << 8) | offset


#: FILED rows for the next sort, and (data null) what is covered: doc, start and, as key, the end.
STEP = FILED


def covered(doc: np.ndarray, place: np.ndarray, window: int) -> pa.RecordBatch:
    d, start, end = merged(doc, place, place + window)
    return pa.RecordBatch.from_arrays([pa.array(end), pa.array(d), pa.array(start), pa.array(np.zeros(len(d), np.int32)), pa.array(np.zeros(len(d), np.int32)), pa.nulls(len(d), pa.binary())], names=["key", "doc", "start", "count", "shift", "data"])


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffer(column)


def sorted_texts(texts: DataFrame, shape: Shape) -> DataFrame:
    """STEP: each task sorts the windows of its texts' anchors and files the first of equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in cuts(batches, shape, bytes_of):
            key = anchor_keys(cut, shape)
            anchor, step = spread(cut.hi - cut.lo + 1)
            doc, place = cut.doc[anchor], cut.lo[anchor] + step
            offset = cut.at[anchor] - place
            group = groups_of(key[np.where(offset >= shape.half, anchor, anchor + len(cut.at))], offset)
            late, first = neighbours(cut.tokens, cut.origin[anchor] + place, group, doc, place, shape.window)
            yield covered(doc[late], place[late], shape.window)
            yield from filed(cut, shape, first, key)

    return texts.mapInArrow(run, STEP)


def sorted_group(group: pa.Table, shape: Shape) -> tuple[np.ndarray, ...]:
    """Of FILED rows in the order of doc and start within a key: the bytes, and of all windows key, offset of the
    anchor, where they begin in the bytes, doc, place, late and first."""
    raw, starts = text_buffer(group.column("data"))
    row, step = spread(group.column("count").to_numpy().astype(np.int64))
    doc, place, at = group.column("doc").to_numpy()[row], group.column("start").to_numpy()[row] + step, starts[row] + step
    key, offset = group.column("key").to_numpy()[row], group.column("shift").to_numpy()[row] - step
    late, first = neighbours(raw, at, groups_of(key, offset), doc, place, shape.window)
    return raw, key, offset, at, doc, place, late, first


def sorted_keys(filed_: DataFrame, shape: Shape) -> DataFrame:
    """STEP, covered only: whole keys are sorted in one task."""
    placed = filed_.repartition("key").sortWithinPartitions("key", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in shared_keys(batches):
            *_, doc, place, late, _ = sorted_group(group, shape)
            yield covered(doc[late], place[late], shape.window)

    return placed.mapInArrow(run, STEP)


def sorted_blocks(filed_: DataFrame, shape: Shape) -> DataFrame:
    """STEP: the rows of crowded keys, sorted in blocks; the first windows of each block go on, one a row, dealt by all their bytes.

    filed_ has a column `block`. After this the rows of one string are as many as blocks, not as copies.
    """
    placed = filed_.repartition("block").sortWithinPartitions("block", "key", "doc", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, "block"):
            block = groups.column("block").to_numpy()
            for i, j in key_ranges(np.cumsum(firsts(block)) - 1):
                raw, _, offset, at, doc, place, late, first = sorted_group(groups.slice(i, j - i), shape)
                yield covered(doc[late], place[late], shape.window)
                at, doc, place, offset = at[first], doc[first], place[first], offset[first]
                key = rolling(raw, shape.window)[at] if len(at) else at
                for x in range(0, len(at), 1 << 14):
                    yield single_windows(raw, *(c[x : x + (1 << 14)] for c in (at, key, doc, place, offset)), shape.window)

    return placed.mapInArrow(run, STEP)


def single_windows(raw: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, place: np.ndarray, offset: np.ndarray, window: int) -> pa.RecordBatch:
    """FILED rows of one window each."""
    n = len(key)
    data = raw[at[:, None] + np.arange(window)].tobytes()
    part = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * window).astype(np.int32).tobytes()), pa.py_buffer(data)])
    columns = [pa.array(key.view(np.int64)), pa.array(doc), pa.array(place), pa.array(np.ones(n, np.int32)), pa.array(offset.astype(np.int32)), part]
    return pa.RecordBatch.from_arrays(columns, names=["key", "doc", "start", "count", "shift", "data"])


def suffix_sorted(texts: DataFrame, shape: Shape) -> DataFrame:
    """doc, start, end of the windows that also start earlier."""
    spark = texts.sparkSession
    local = materialize(sorted_texts(texts, shape))
    release(spark)
    first = local.filter("data is not null")
    done = [local.filter("data is null")]
    crowded = crowded_keys(first)
    if crowded.isEmpty():
        done.append(materialize(sorted_keys(first, shape)))
    else:
        done.append(materialize(sorted_keys(first.join(crowded.hint("merge"), "key", "left_anti"), shape)))
        blocks = F.ceil(F.col("n") / repeats.KEY_ROWS)
        dealt = first.join(crowded.hint("merge"), "key").withColumn("block", F.xxhash64("key", F.pmod(F.xxhash64("doc", "start"), blocks)))
        in_blocks = materialize(sorted_blocks(dealt.drop("n"), shape))
        done += [in_blocks.filter("data is null"), materialize(sorted_keys(in_blocks.filter("data is not null"), shape))]
    release(spark)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    return whole.select("doc", "start", F.col("key").alias("end"))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """FIELDS of every row: a byte goes if a string of `length` bytes that covers it also starts earlier.

    Earlier is a smaller doc_id or the same document further up; a null doc_id comes last. Texts are UTF-8
    bytes, a null text is empty, and what is kept may part characters. Repeated rows stand at one place, so
    neither is later; no rows give no rows; other columns may have any name.
    """

    def finish(doc: pa.Array, text: pa.Array, stretches: list) -> pa.RecordBatch:
        out = []
        for t, gone in zip(text.cast(pa.binary()).to_pylist(), stretches, strict=True):
            kept, at = [], 0
            for a, b in gone:
                kept.append(t[at:a])
                at = b
            kept = b"".join([*kept, t[at:]]) if gone else t
            out.append((len(t), len(t) - len(kept), len(gone), kept, hashlib.sha256(kept).hexdigest()))
        n, removed, spans, kept, digest = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([doc, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])

    shape = Shape(length, seed)
    return repeated(docs, shape, bytes_of, lambda texts: suffix_sorted(texts, shape), finish, FIELDS).withColumn("doc_id", outer_id("doc_id"))
