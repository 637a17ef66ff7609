"""Document fingerprints by one-permutation MinHash with optimal densification.

Every word shingle is hashed once; the top bits choose a bin, which keeps its smallest hash. An empty bin
copies the bin that a hash of its number and the attempt points to, trying again while that is empty too.
Of each bin the lowest bits are stored. Two fingerprints agree in a bin with probability
J + (1 - J) / 2 ** bits, which the likeness solves for J.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, internal_id, mix64, outer_id, word_parts

BINS = 256
BITS = 8
SHINGLE = 5
EMPTY = np.uint64((1 << 64) - 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    digest = xxhash.xxh3_64_digest
    return np.frombuffer(b"".join([digest(w) for w in words]), dtype="<u8") if words else np.empty(0, dtype="<u8")


def text_hashes(text: bytes) -> np.ndarray:
    """The hashes of a text's words; a long text's words are not held all at once."""
    parts = [word_hashes(words) for words in word_parts(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_hashes(words: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """One hash for every `width` consecutive words; fewer words are one shingle, none are none."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total = mix64(total * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - width + 1 + i])
    return total


def sketches(shingles: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """A row of `bins` hashes for each document; a document without shingles has EMPTY throughout."""
    lengths = np.array([len(s) for s in shingles])
    table = np.full((len(shingles), bins), EMPTY, dtype=np.uint64)
    if lengths.sum():
        every = np.concatenate(shingles)
        shift = np.uint64(64 - (bins - 1).bit_length())
        at = np.repeat(np.arange(len(shingles)), lengths) * bins + (every >> shift).astype(np.int64)
        np.minimum.at(table.reshape(-1), at, every)
    row, bin_ = np.nonzero(table == EMPTY)
    some = lengths[row] > 0
    row, bin_ = row[some], bin_[some]
    full, attempt = table != EMPTY, 0
    while len(row):
        # The same bins try the same others in every document, so alike documents fill alike.
        other = (mix64(bin_.astype(np.uint64) * np.uint64(0x1F123BB5) + np.uint64(attempt << 32)) % np.uint64(bins)).astype(np.int64)
        found = full[row, other]
        table[row[found], bin_[found]] = table[row[found], other[found]]
        row, bin_, attempt = row[~found], bin_[~found], attempt + 1
    return table


def packed(table: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The lowest `bits` bits of every bin's scrambled hash, as rows of bytes."""
    low = mix64(table) & np.uint64((1 << bits) - 1)
    if bits == 8:
        return low.astype(np.uint8)
    ones = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(ones.reshape(len(table), -1).astype(np.uint8), axis=1)


def unpacked(rows: np.ndarray, bits: int = BITS) -> np.ndarray:
    if bits == 8:
        return rows
    ones = np.unpackbits(rows, axis=1)
    ones = ones[:, : ones.shape[1] // bits * bits].reshape(len(rows), -1, bits)
    return (ones * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2)


def likeness(a: np.ndarray, b: np.ndarray, empty_a: np.ndarray, empty_b: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The corrected share of bins that agree, 0 to 1; two texts without words are alike, one is like no other."""
    agree = (unpacked(a, bits) == unpacked(b, bits)).mean(axis=1)
    chance = 2.0**-bits
    return np.where(empty_a | empty_b, (empty_a & empty_b).astype(float), np.clip((agree - chance) / (1 - chance), 0, 1))


def in_sequence(docs: DataFrame) -> DataFrame:
    """block, extra, doc_id, text in an order of descending doc_id over the partitions' blocks.

    Blocks are ranges of doc_id between bounds that approximate quantiles; a block also gets, as `extra`,
    the first document of the next block, the last block that of the first. Only the bounds and the largest
    doc_id of each block reach the driver: as many numbers as there are blocks.
    """
    rows = docs.select(internal_id("doc_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select("doc_id")
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []))
    bounds = F.array(*[F.lit(min(int(c), NO_ID)).cast("long") for c in reversed(cuts)]) if cuts else None
    block = F.size(F.filter(bounds, lambda c: c >= F.col("doc_id"))) if cuts else F.lit(0)
    tops = ids.groupBy(block.alias("b")).agg(F.max("doc_id").alias("h")).orderBy("b").collect()
    before = {r["h"]: tops[i - 1]["b"] for i, r in enumerate(tops)}
    own = rows.select(block.alias("block"), F.lit(False).alias("extra"), "doc_id", "text")
    if not before:
        return own
    heads = F.create_map(*[x for h, b in before.items() for x in (F.lit(h), F.lit(b))])
    extra = rows.filter(F.col("doc_id").isin(list(before))).select(heads[F.col("doc_id")].alias("block"), F.lit(True).alias("extra"), "doc_id", "text")
    return own.unionByName(extra).repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").desc(), "text")


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(rows: list[tuple[int, str, str]], bins: int, bits: int) -> pa.RecordBatch:
    """The result for (doc_id, text, next text)."""
    edited = []
    for _, text, follower in rows:
        third = len(text) // 3
        edited.append(text[: len(text) - third] + follower[:third])
    texts = [t for _, t, _ in rows] + edited + [f for _, _, f in rows]
    prints = sketches([shingle_hashes(text_hashes(t.encode())) for t in texts], bins)
    n = len(rows)
    empty = (prints == EMPTY).all(axis=1)
    low = packed(prints, bits)
    own, changed, after = low[:n], low[n : 2 * n], low[2 * n :]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(r[1]) for r in rows], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array([x.tobytes().hex() for x in own], pa.string()),
            pa.array([x.tobytes().hex() for x in changed], pa.string()),
            pa.array(likeness(own, changed, empty[:n], empty[n : 2 * n], bits)),
            pa.array(likeness(own, after, empty[:n], empty[2 * n :], bits)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def edited_fingerprints(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how near they and the next document's are.

    A null text is empty. Rows of one doc_id follow each other in the order of their texts; a null doc_id
    comes first. A table of one row is its own next document.
    """
    placed = in_sequence(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, waiting, size = None, [], 0
        for batch in batches:
            for block, extra, doc, text in zip(*(batch.column(c).to_pylist() for c in ("block", "extra", "doc_id", "text")), strict=True):
                if last is not None and last[0] == block:
                    waiting.append((last[1], last[2], text))
                    size += 2 * len(last[2]) + len(text)
                last = None if extra else (block, doc, text)
                if size > 1 << 20:
                    yield compare(waiting, bins, bits)
                    waiting, size = [], 0
        if waiting:
            yield compare(waiting, bins, bits)

    return placed.mapInArrow(run, FIELDS).withColumn("doc_id", outer_id("doc_id"))
