"""Sum-of-squares packing of documents into sequences of fixed capacity.

Only texts longer than the capacity are cut. Pieces are dealt to blocks of bounded size; each block
places its pieces, longest first, where the sum over residual gaps of the squared number of open
sequences with that gap becomes smallest. What a block cannot close is pooled with what other blocks
left and packed again in fewer blocks, until one block of bounded size is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, internal_id, materialize, outer_id
from .tokens import word_ids_of

CAPACITY = 4096
#: Pieces that one block packs.
BLOCK = 16_384
#: A sequence with at most this share of its capacity free is closed by the block that made it.
CLOSED_GAP = 0.004
END_ID = 1


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, remember: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's token ids with end_id after them.

    Workers remember the ids of `remember` words a generation (None: CACHE_PIECES); fewer take less memory and more time.
    """
    source = docs.select(internal_id("doc_id").alias("doc_id"), docs["text"].alias("__text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__text"):
                out: list[tuple] = []
                for doc, ids in zip(batch.column("doc_id").to_pylist(), word_ids_of(batch.column("__text").to_pylist(), path, remember), strict=True):
                    ids += end
                    for i in range(0, len(ids), 4 * capacity):
                        part = ids[i : i + 4 * capacity]
                        out.append((doc, i // (4 * capacity), i // 4, len(part) // 4, zlib.crc32(part)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sequence and offset of each piece, and the gap that each sequence is left with.

    Pieces come in the order given. Moving a sequence from gap g to gap g - s changes the sum of squares
    by 2 (N[g - s] - N[g]) + 2, and by 2 N[0] less where it fills up, as full sequences do not count; a
    new sequence changes it by 2 N[capacity - s] + 1. The smaller gap wins a tie.
    """
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: dict[int, list[int]] = {}
    sequence, offset, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        at = 0
        if s < capacity and counts[s]:
            at = s  # fills a sequence: takes a count away and adds none
        elif s < capacity:
            have = counts[s + 1 : capacity]
            change = 2 * (counts[1 : capacity - s] - have) + 2
            change[have == 0] = np.iinfo(np.int64).max
            if len(change):
                best = int(change.argmin())
                if change[best] <= 2 * counts[capacity - s] + 1:
                    at = best + s + 1
        if at:
            k = open_at[at].pop()
            counts[at] -= 1
            sequence[i], offset[i] = k, capacity - at
        else:
            k, at = len(gaps), capacity
            gaps.append(0)
            sequence[i], offset[i] = k, 0
        gaps[k] = left = at - s
        if left:
            counts[left] += 1
            open_at.setdefault(left, []).append(k)
    return sequence, offset, np.array(gaps, dtype=np.int64)


FIELDS = ("doc_id", "piece", "start", "length", "ids_crc32")
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, done boolean"


def pack_round(pool: DataFrame, blocks: int, number: int, capacity: int, last: bool) -> DataFrame:
    """Every piece of the pool with its sequence in its block; done where that sequence is closed."""
    mixed = F.xxhash64("doc_id", "piece", "start", F.lit(number))
    dealt = pool.select(*FIELDS).withColumn("block", F.pmod(mixed, F.lit(blocks)).cast("int"))

    def run(key: tuple, block: pa.Table) -> pa.Table:
        lengths = block.column("length").to_numpy()
        ties = (block.column("ids_crc32").to_numpy(), block.column("piece").to_numpy(), block.column("doc_id").to_numpy())
        orders = [np.lexsort((*ties, -lengths)), np.lexsort(ties)]
        order, (sequence, offset, gaps) = min(((o, sum_of_squares(lengths[o], capacity)) for o in orders), key=lambda x: len(x[1][2]))
        closed = np.ones(len(gaps), bool) if last else gaps <= CLOSED_GAP * capacity
        taken = block.select(list(FIELDS)).take(pa.array(order))
        ids = ((number << 56) | (int(key[0].as_py()) << 24)) + sequence
        return taken.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset)).append_column("done", pa.array(closed[sequence]))

    return dealt.groupBy("block").applyInArrow(run, PLACED)


def pack(parts: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """All pieces with sequence_id and offset; sequences hold at most `capacity` tokens without gaps before a piece.

    No rows give no rows. Repeated rows are packed as often as they come. Each round pools what sequences
    with a larger gap hold, in at most half as many blocks as the one before; a block has about `block` pieces.
    """
    pool, out, number = materialize(parts), [], 0
    blocks, last = max(1, -(-pool.count() // block)), False
    while True:
        last = last or blocks == 1
        placed = materialize(pack_round(pool, blocks, number, capacity, last))
        out.append(placed.filter("done"))
        if last:
            break
        pool = placed.filter("not done")
        # Where a round closes less than half, as of pieces that are all longer than half a sequence, the next is the last.
        before, blocks, number = blocks, max(1, -(-pool.count() // block)), number + 1
        last = 2 * blocks > before
    whole = out[0]
    for more in out[1:]:
        whole = whole.unionByName(more)
    return whole.select(outer_id("doc_id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, path: str, capacity: int = CAPACITY, remember: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row of docs.

    A null or empty text is one piece that holds the end id alone.
    """
    return pack(pieces(docs, path, capacity, remember=remember), capacity)
