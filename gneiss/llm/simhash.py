"""SimHash near-duplicates through segment popcounts.

A fingerprint is cut into segments and each segment replaced by its number of set bits. The Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. Of the two halves of
a pair within three bits one has a vector distance of at most one, so a grid whose cells are the vectors of
a half finds every pair: each fingerprint is at home in one cell of each half and visits the cells one step
up. Pairs that meet in a cell are verified on all 64 bits; a cell passes on links that span what it joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, by_bytes, internal_id, materialize, outer_id, word_parts
from .components import components

MOST_BITS = 3
SEGMENT_BITS = 2
SHINGLE = 3
SEED = 42
#: Pairs that a task compares at once.
PAIRS = 1 << 21
#: Rows of a cell that one task takes.
CELL_ROWS = 8192


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The bits set in over half of the shingles' XXH64; 0 without words. A long text goes part by part."""
    import xxhash

    digest = xxhash.xxh64_digest
    ones, n, carried = None, 0, []
    for words in word_parts(text):
        words = carried + words if carried else words
        if len(words) >= width:
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
            hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)
            n += len(hashes)
            for i in range(0, len(hashes), 1 << 16):
                some = np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
                ones = some if ones is None else ones + some
        carried = words[max(0, len(words) - width + 1) :]
    if ones is None:
        return xxhash.xxh64_intdigest(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE, text_key: Column | None = None) -> DataFrame:
    """doc_id (internal), fp: the 64-bit fingerprint of every row's whole text, A-Z lowered; a null text is empty.

    With text_key, a column of that name too.
    """
    more = [] if text_key is None else [text_key.alias("text_key")]
    source = docs.select(internal_id("doc_id").alias("doc_id"), docs["text"].alias("__text"), *more)
    names = ["doc_id", *(["text_key"] if more else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "__text"):
                texts = batch.column("__text").cast(pa.binary()).to_pylist()
                found = [fingerprint(t.lower(), width) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], names=[*names, "fp"])

    return source.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "fp"]))


def cells(prints: DataFrame, segment: int = SEGMENT_BITS) -> DataFrame:
    """cell, home, fp, cid: each fingerprint in its own cell of either half and in the cells one step up.

    A cell's number is the half and the segment counts as digits to the base segment + 1.
    """
    per_half = 32 // segment
    powers = np.array([(segment + 1) ** i for i in range(per_half)], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1 << 16):
                batch = whole.slice(i, 1 << 16)
                fp, cid = batch.column("fp").to_numpy(), batch.column("cid").to_numpy()
                for half in range(2):
                    counts = np.stack([np.bitwise_count((fp.view(np.uint64) >> np.uint64(32 * half + segment * s)) & np.uint64((1 << segment) - 1)) for s in range(per_half)], axis=1)
                    home = (counts.astype(np.int64) * powers).sum(axis=1) * 2 + half
                    row, step = np.nonzero(counts < segment)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([home, home[row] + 2 * powers[step]])), pa.array(np.arange(len(home) + len(row)) < len(home)), pa.array(np.concatenate([fp, fp[row]])), pa.array(np.concatenate([cid, cid[row]]))],
                        names=["cell", "home", "fp", "cid"],
                    )

    return prints.mapInArrow(run, "cell long, home boolean, fp long, cid long")


def split_cells(grid: DataFrame, most: int = CELL_ROWS, columns: tuple[str, ...] = ("fp", "cid")) -> DataFrame:
    """The grid with cells of more than `most` rows taken apart into pairs of blocks, each a cell of its own.

    A cell's rows are dealt to blocks by their fingerprint. Two blocks of rows at home meet once, and every
    block of visitors meets every block at home; of a pair one block is at home and the other visits.
    """
    sizes = materialize(grid.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    if sizes.isEmpty():
        return grid
    blocks = F.ceil(F.col("n") / most).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)

    def pairs(p, q, home):
        return F.struct(p.alias("p"), q.alias("q"), home.alias("home"))

    among_home = F.transform(every, lambda q: pairs(F.least(own, q), F.greatest(own, q), own <= q))
    for_visitors = F.transform(every, lambda q: pairs(own, blocks + q, F.lit(True)))
    visiting = F.transform(every, lambda p: pairs(p, blocks + own, F.lit(False)))
    parts = F.when(F.col("home"), F.concat(among_home, for_visitors)).otherwise(visiting)
    crowded = grid.join(sizes, "cell").select("cell", *columns, F.explode(parts).alias("x")).select(F.xxhash64("cell", "x.p", "x.q").alias("cell"), F.col("x.home").alias("home"), *columns)
    return grid.join(sizes, "cell", "left_anti").select("cell", "home", *columns).unionByName(crowded)


class Forest:
    """Union-find over any integers, that lists the links it was given without those that close a circle."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    def spanning(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        kept = []
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.parent[max(r, s)] = min(r, s)
                kept.append((x, y))
        return kept


def linked(batches: Iterator[pa.RecordBatch], most: int, words: tuple[str, ...] = ("fp",)) -> Iterator[pa.RecordBatch]:
    """Spanning links of rows sorted by cell with those at home first, that differ in at most `most` bits of their words."""
    rest: list[pa.RecordBatch] = []

    def emit(table: pa.Table) -> pa.RecordBatch:
        cell, home = table.column("cell").to_numpy(), table.column("home").to_numpy(zero_copy_only=False)
        prints, cid = [table.column(w).to_numpy().view(np.uint64) for w in words], table.column("cid").to_numpy()
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[starts[1:], len(cell)]
        at_home = np.add.reduceat(home.astype(np.int64), starts)
        # A row meets the rows at home in its cell that come before it.
        group = np.repeat(np.arange(len(starts)), ends - starts)
        before = np.minimum(np.arange(len(cell)) - starts[group], at_home[group])
        forest, kept, done = Forest(), [], np.cumsum(before)
        i = 0
        while i < len(cell):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + PAIRS, side="right")))
            row = np.repeat(np.arange(i, j), before[i:j])
            k = np.arange(len(row)) - np.repeat(np.cumsum(before[i:j]) - before[i:j], before[i:j])
            other = starts[group[row]] + k
            near = sum(np.bitwise_count(fp[row] ^ fp[other]) for fp in prints) <= most
            kept += forest.spanning(cid[row[near]], cid[other[near]])
            i = j
        a, b = zip(*kept, strict=True) if kept else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column("cell").to_numpy()
        cut = int(np.searchsorted(cell, cell[-1], side="left")) if cell[0] <= cell[-1] else 0
        if rest and rest[0].column("cell")[0].as_py() == cell[-1]:
            rest.append(batch)
            continue
        if cut or rest:
            yield emit(pa.Table.from_batches([*rest, batch.slice(0, cut)]))
        rest = [batch.slice(cut)]
    if rest:
        yield emit(pa.Table.from_batches(rest))


def near_duplicates(docs: DataFrame, most: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row: the smallest doc_id that links of at most `most` bits reach.

    Rows with one fingerprint are linked, those without words (null, empty, blank: fingerprint 0) too.
    Equal fingerprints are first made one, so a group of copies costs one row. `most` is at most 3. A null
    doc_id counts as larger than any other and comes back as null.
    """
    if most > MOST_BITS:
        raise ValueError("the grid finds pairs of at most 3 differing bits")
    prints = materialize(fingerprints(docs, width))
    named = components_of(prints, most)
    return prints.join(named, "fp").select(outer_id("doc_id").alias("doc_id"), "fp", outer_id("component_id").alias("component_id"))


def components_of(prints: DataFrame, most: int) -> DataFrame:
    """fp, node, component_id: a node of the fingerprint's component and the smallest doc_id there.

    Fingerprints are the nodes, as rows without an id have none to tell them apart.
    """
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("cid", F.col("fp")))
    grid = split_cells(cells(classes.select("fp", "cid"))).repartition("cell").sortWithinPartitions("cell", F.col("home").desc(), "cid")
    joined = components(grid.mapInArrow(lambda batches: linked(batches, most), "a long, b long"))
    named = materialize(classes.join(joined, classes.fp == joined.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("node")))
    return named.join(named.groupBy("node").agg(F.min("least").alias("component_id")), "node").select("fp", "node", "component_id")


def keep_one(docs: DataFrame, most: int = MOST_BITS, width: int = SHINGLE) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; one row of a component without ids."""
    text_key = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = materialize(fingerprints(docs.select("doc_id", "text"), width, text_key))
    found = prints.join(components_of(prints, most), "fp")
    place = F.struct("doc_id", "text_key")
    first = found.groupBy("node").agg(F.min(place).alias("first"))
    # Rows that repeat the smallest doc_id stay.
    gone = found.join(first, "node").filter((F.col("doc_id") != F.col("first.doc_id")) | ((F.col("doc_id") == NO_ID) & (F.col("text_key") != F.col("first.text_key"))))
    return without(docs, gone.select(F.col("doc_id").alias("doc"), "text_key"), prints.filter(F.col("doc_id") == NO_ID).select("text_key"))


def without(docs: DataFrame, gone: DataFrame, unnamed: DataFrame) -> DataFrame:
    """The rows of docs that stand at no place (doc, text_key) of gone; of equal texts without an id one row.

    unnamed has the text_key of every row without an id.
    """
    places = gone.select(F.col("doc").alias("__doc"), F.col("text_key").alias("__text_key")).distinct()
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    kept = docs.join(places, (internal_id("doc_id") == F.col("__doc")) & (text_key == F.col("__text_key")), "left_anti")
    if unnamed.groupBy("text_key").count().filter("count > 1").isEmpty():
        return kept
    kept = materialize(kept.withColumn("__text_key", text_key))
    return kept.filter("doc_id is not null").unionByName(kept.filter("doc_id is null").dropDuplicates(["__text_key"])).drop("__text_key")
