"""Near copies by the Jaccard index of their word shingles, through SimHash and segment popcounts.

A text's distinct shingles give a fingerprint of several 64-bit words, which is cut into parts and these into
segments of two bits. The popcounts of a part's segments are a cell; a fingerprint is at home in one cell of
each part and visits those one step up, so pairs whose counts in some part are at most one step apart meet. Of
two texts with an index of 0.8 a bit differs with probability acos(2 J / (1 + J)) / pi = 0.15, a part of 20
bits is within a step with 0.20, and one of the 16 parts with 0.97 (0.9: over 0.999). Pairs that meet
and differ in at most NEAR of the first 128 bits (a pair at 0.8 does but for 0.002) are candidates. What
candidates reach is gathered, and in there the shingles of all pairs are compared, so that a link is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, by_bytes, forget, internal_id, materialize, mix64
from .components import components
from .minhash import shingle_hashes, text_hashes
from .simhash import Forest, linked, split_cells, without

SHINGLE = 5
LIKENESS = 0.8
#: 64-bit words of a fingerprint, bits of a part and of a segment.
WORDS, PART, SEGMENT = 5, 20, 2
#: Bits of the first 128 in which candidates may differ.
NEAR = 32
#: Texts of a group of candidates that are compared with as many others in one task.
GROUP_ROWS = 256


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, A-Z lowered; fewer words are one shingle, none are none."""
    return np.unique(shingle_hashes(text_hashes(text.lower()), width))


def bits(hashes: np.ndarray) -> np.ndarray:
    """WORDS * 64 bits, each set in over half of the hashes."""
    ones = np.zeros(WORDS * 64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        some = np.stack([mix64(hashes[i : i + (1 << 14)] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) for k in range(WORDS)], axis=1)
        ones += np.unpackbits(some.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes))


def places(docs: DataFrame) -> DataFrame:
    """doc, text_key, text: where a row stands; rows without an id stand apart if their texts differ."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(internal_id("doc_id").alias("doc"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc, text_key, same (digest of the set of shingles), bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                sets = [shingles(t, width) for t in batch.column("text").cast(pa.binary()).to_pylist()]
                same = [hashlib.md5(s.tobytes()).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("text_key"), pa.array(same, pa.binary()), pa.array([bits(s).tobytes() for s in sets], pa.binary())], names=["doc", "text_key", "same", "bits"])

    return places(docs).mapInArrow(run, "doc long, text_key long, same binary, bits binary")


def cells(classes: DataFrame) -> DataFrame:
    """cell, home, fp, fp2, cid: each fingerprint in its own cell of every part and in the cells one step up."""
    parts, counted = WORDS * 64 // PART, PART // SEGMENT
    powers = np.array([(SEGMENT + 1) ** i for i in range(counted)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for i in range(0, whole.num_rows, 1 << 13):
                batch = whole.slice(i, 1 << 13)
                raw = np.frombuffer(b"".join(batch.column("bits").to_pylist()), dtype=np.uint8).reshape(-1, WORDS * 8)
                fp, fp2 = (np.ascontiguousarray(raw[:, k : k + 8]).view(np.int64).ravel() for k in (0, 8))
                cid = batch.column("cid").to_numpy()
                counts = np.unpackbits(raw, axis=1).reshape(len(raw), parts, counted, SEGMENT).sum(axis=3)
                for part in range(parts):
                    own = (counts[:, part].astype(np.int64) * powers).sum(axis=1) * parts + part
                    row, step = np.nonzero(counts[:, part] < SEGMENT)
                    who = np.r_[np.arange(len(own)), row]
                    columns = [np.r_[own, own[row] + parts * powers[step]], np.arange(len(who)) < len(own), fp[who], fp2[who], cid[who]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "home", "fp", "fp2", "cid"])

    return classes.mapInArrow(run, "cell long, home boolean, fp long, fp2 long, cid long")


def stars(links: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from every node to the smallest that the links of a task join it with; tasks then repeat each other's links."""
    forest, seen = Forest(), set()
    for batch in links:
        for x, y in forest.spanning(*(batch.column(c).to_numpy() for c in ("a", "b"))):
            seen.update((x, y))
    nodes = sorted(seen)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["a", "b"])


def alike(group: pa.Table, least: float) -> pa.Table:
    """a, b: links that span what the pairs of a group (or between its two sides) with a Jaccard index of `least` join."""
    group = group.filter(pc.greater(pc.binary_length(group.column("shingles")), 0))
    node, side = group.column("node").to_numpy(), group.column("side").to_numpy()
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
    size = np.array([len(s) for s in sets])
    kept: list[tuple[int, int]] = []
    if len(node) > 1:
        names = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.r_[0, np.cumsum(size)[:-1]]
        forest, mark = Forest(), np.zeros(int(names.max()) + 1, dtype=np.int64)
        for i in range(len(node) - 1):
            own = names[starts[i] : starts[i] + size[i]]
            mark[own] = 1
            common = np.add.reduceat(mark[names[starts[i + 1] :]], starts[i + 1 :] - starts[i + 1])
            mark[own] = 0
            near = (common >= least * (size[i] + size[i + 1 :] - common)) & ((side[i] == 2) | (side[i + 1 :] != side[i]))
            other = node[i + 1 :][near]
            kept += forest.spanning(np.full(len(other), node[i]), other)
    a, b = zip(*kept, strict=True) if kept else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, least: float, width: int, most: int = GROUP_ROWS) -> DataFrame:
    """a, b: links of nodes whose shingles have a Jaccard index of `least`, within what candidates join.

    The members of a group are dealt to blocks of about `most`, and each pair of blocks is a task's work.
    """
    grouped = components(candidates)
    members = grouped.select("node", F.col("component").alias("cluster")).unionByName(grouped.select(F.col("component").alias("node"), F.col("component").alias("cluster"))).distinct()
    members = materialize(members)
    sizes = members.groupBy("cluster").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    found = members.join(sizes, "cluster").join(classes.select(F.col("cid").alias("node"), "place.*"), "node")
    texts = places(docs).join(found, ["doc", "text_key"]).select("cluster", "blocks", "node", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                sets = [shingles(t, width).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "blocks", "node")), pa.array(sets, pa.binary())], names=["cluster", "blocks", "node", "shingles"])

    sets = texts.mapInArrow(run, "cluster long, blocks int, node long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda q: F.struct(F.least(own, q).alias("p"), F.greatest(own, q).alias("q"), F.when(own == q, 2).when(own < q, 0).otherwise(1).alias("side")))
    blocks = sets.select("cluster", "node", "shingles", F.explode(pairs).alias("x")).select("cluster", "x.*", "node", "shingles")
    return blocks.groupBy("cluster", "p", "q").applyInArrow(lambda t: alike(t, least), "a long, b long")


def near_copies(docs: DataFrame, least: float = LIKENESS, width: int = SHINGLE) -> DataFrame:
    """doc, text_key, first: where every row stands, and the first place (doc, text_key) of its component."""
    prints = materialize(fingerprints(docs, width))
    classes = prints.groupBy("same").agg(F.min(F.struct("doc", "text_key")).alias("place"), F.min("bits").alias("bits"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    grid = split_cells(cells(classes), columns=("fp", "fp2", "cid")).repartition("cell").sortWithinPartitions("cell", F.col("home").desc(), "cid")
    candidates = materialize(grid.mapInArrow(lambda batches: stars(linked(batches, NEAR, ("fp", "fp2"))), "a long, b long"))
    joined = components(materialize(verified(docs, classes, candidates, least, width)))
    named = materialize(classes.join(joined, classes.cid == joined.node, "left").select("same", "place", F.coalesce("component", "cid").alias("component")))
    first = named.groupBy("component").agg(F.min("place").alias("first"))
    return prints.select("doc", "text_key", "same").join(named.join(first, "component").select("same", "first"), "same").drop("same")


def keep_first(docs: DataFrame, least: float = LIKENESS, width: int = SHINGLE) -> DataFrame:
    """The rows of docs that stand at the first place of their component; of equal texts without an id one row."""
    found = materialize(near_copies(docs, least, width))
    gone = found.filter(F.struct("doc", "text_key") != F.col("first")).select("doc", "text_key")
    return without(docs, gone, found.filter(F.col("doc") == NO_ID).select("text_key"))
