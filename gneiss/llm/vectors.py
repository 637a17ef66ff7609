"""Near-duplicate vectors through the cells of spherical k-means.

Unit vectors are assigned to the nearest of k centres, about one for every CELL vectors. Two linked vectors are
apart by a chord of at most sqrt(2 - 2 * threshold), so a vector near the plane that parts its own cell from
another visits that one. A chord in no special direction of d dimensions crosses a plane by its length over
sqrt(d - 1) in the mean square: vectors visit the cells whose plane is within REACH such steps, which finds more
than 0.95 of the links at the threshold itself that a plane parts, and more of nearer ones (measured on the test
tables: all). With reach=None they visit all cells that the angle allows and no link is lost, at the price of
nearly all pairs in many dimensions. Members and visitors of a cell meet in blocks of bounded size, whose products
are exact in double precision. Vectors of different dimensions never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, internal_id, materialize, mix64, outer_id, spread
from .components import components
from .simhash import Forest

THRESHOLD = 0.9
#: Vectors that the centres are fitted on, about.
FIT = 20_000
#: Members that a cell should have, and vectors in a block. Beyond MOST_CELLS * CELL vectors the cells grow.
CELL = 256
BLOCK = 4096
MOST_CELLS = 4096
#: Steps from a plane within which vectors visit the other side.
REACH = 2.0
#: Slack for rounding where a plane's distance decides whether a cell is visited.
SLACK = 1e-9


def unit_rows(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors of a list array can link, and for each of these its row of length 1, in double precision.

    Null and empty vectors, those with null or non-finite components and those of length 0 cannot.
    """
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    # Lists of a null row are empty here, and null components not a number.
    values = pc.fill_null(column, []).flatten().cast(pa.float64())
    values = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    usable, rows = np.zeros(len(column), dtype=bool), [np.empty(0)] * len(column)
    for width in np.unique(lengths[lengths > 0]).tolist():
        which = np.flatnonzero(lengths == width)
        block = values[starts[which][:, None] + np.arange(width)]
        good = np.isfinite(block).all(axis=1) & (block != 0).any(axis=1)
        block = block[good] / np.abs(block[good]).max(axis=1, keepdims=True)
        block /= np.sqrt((block * block).sum(axis=1, keepdims=True))
        usable[which[good]] = True
        for i, row in zip(which[good].tolist(), block, strict=True):
            rows[i] = row
    return usable, rows


def normalised(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id (internal), unit: the vector at length 1 as the bytes of doubles, null where it cannot link."""
    source = vectors.select(internal_id(id_).alias("vec_id"), vectors[vector].alias("__v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, rows = unit_rows(batch.column("__v"))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([row.tobytes() if u else None for u, row in zip(usable, rows, strict=True)], pa.binary())], names=["vec_id", "unit"])

    return source.mapInArrow(run, "vec_id long, unit binary")


def stacked(column: pa.Array) -> np.ndarray:
    """Rows of doubles from a binary array of one width."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, dtype=np.float64).reshape(len(column), -1)


def spherical_k_means(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k unit centres; a centre that loses all its rows stays where it is."""
    pick = np.random.default_rng(seed)
    centres = rows[np.sort(pick.choice(len(rows), size=min(k, len(rows)), replace=False))]
    for _ in range(rounds):
        nearest = np.concatenate([(rows[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(rows), 4096)])
        for c in range(len(centres)):
            total = rows[nearest == c].sum(axis=0)
            size = math.sqrt(total @ total)
            if size > 0:
                centres[c] = total / size
    return centres


def fit_centres(classes: DataFrame, count: int, fit: int = FIT, cell: int = CELL) -> np.ndarray:
    """Centres fitted on about `fit` vectors, drawn by their hash; more cells for more vectors."""
    share = min(1.0, fit / max(1, count))
    drawn = classes.filter(F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("unit").orderBy(F.xxhash64("unit")).limit(2 * fit)
    rows = [r["unit"] for r in drawn.collect()]
    return spherical_k_means(np.array([np.frombuffer(r, dtype=np.float64) for r in rows]), max(1, min(MOST_CELLS, -(-count // cell))))


def margin(threshold: float, width: int, reach: float | None) -> float:
    """How far from a plane a vector may lie to visit the other side."""
    most = math.sqrt(max(0.0, 1 - threshold * threshold))
    if reach is None or width < 2:
        return most
    return min(most, reach * math.sqrt(max(0.0, 2 - 2 * threshold) / (width - 1)))


def placed(unit: pa.Array, centres: np.ndarray, between: np.ndarray, near_plane: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell of each vector, and (row, cell) of the cells that it visits.

    The distance to the plane between two cells is the gap of the products over that of the centres. A
    vector visits only cells after its own, as the pair would else be met twice.
    """
    near = stacked(unit) @ centres.T
    own = near.argmax(axis=1)
    meets = (near[np.arange(len(own)), own][:, None] - near <= near_plane * between[own] + SLACK) & (np.arange(len(centres)) > own[:, None])
    return own, *np.nonzero(meets)


def distances(centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * centres @ centres.T))


def crowds(classes: DataFrame, centres: np.ndarray, near_plane: float) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors are at home in each cell and how many visit it."""
    between = distances(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, seen = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                own, _, cell = placed(whole.slice(i, 2048).column("unit"), centres, between, near_plane)
                home += np.bincount(own, minlength=len(centres))
                seen += np.bincount(cell, minlength=len(centres))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(home), pa.array(seen)], names=["cell", "home", "seen"])

    rows = classes.select("unit").mapInArrow(run, "cell int, home long, seen long").groupBy("cell").agg(F.sum("home").alias("home"), F.sum("seen").alias("seen")).collect()
    home, seen = np.zeros(len(centres), np.int64), np.zeros(len(centres), np.int64)
    for r in rows:
        home[r["cell"]], seen[r["cell"]] = r["home"], r["seen"]
    return home, seen


def dealt(classes: DataFrame, centres: np.ndarray, near_plane: float, home: np.ndarray, seen: np.ndarray) -> DataFrame:
    """cell, part, slot, side, cid, copies, unit: the rows of every block pair (cell, part, slot).

    A cell's members and its visitors are dealt to parts of about BLOCK rows by their hash. A pair of parts
    of the members meets once (side 0 and 1, or 2 within a part); every part of the visitors (side 1, slots
    from 0) meets every part of the members.
    """
    between, block = distances(centres), BLOCK
    members, visitors = (np.maximum(1, -(-n // block)) for n in (home, seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                own, row, cell = placed(batch.column("unit"), centres, between, near_plane)
                draw = mix64(batch.column("cid").to_numpy().view(np.uint64))
                part = (draw % members[own].astype(np.uint64)).astype(np.int64)
                # A member goes to its own part, to the pairs with each part after and before it, and to all visitors.
                me, q = spread(members[own])
                slots = visitors[own[me]]
                yield from block_rows(batch, me, own[me], np.minimum(part[me], q), slots + np.maximum(part[me], q), np.where(part[me] == q, 2, (part[me] > q).astype(np.int64)))
                some = np.flatnonzero(seen[own] > 0)
                me, q = spread(visitors[own[some]])
                me = some[me]
                yield from block_rows(batch, me, own[me], part[me], q, np.zeros(len(me), np.int64))
                me, p = spread(members[cell])
                slot = (draw[row] % visitors[cell].astype(np.uint64)).astype(np.int64)
                yield from block_rows(batch, row[me], cell[me], p, slot[me], np.ones(len(me), np.int64))

    return classes.mapInArrow(run, "cell int, part int, slot int, side int, cid long, copies long, unit binary")


def block_rows(batch: pa.RecordBatch, at: np.ndarray, *keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows `at` of the batch under (cell, part, slot, side), some at a time."""
    for i in range(0, len(at), 4096):
        which = pa.array(at[i : i + 4096])
        yield pa.RecordBatch.from_arrays([*(pa.array(k[i : i + 4096].astype(np.int32)) for k in keys), *(batch.column(c).take(which) for c in ("cid", "copies", "unit"))], names=["cell", "part", "slot", "side", "cid", "copies", "unit"])


def meet(block: pa.Table, threshold: float) -> pa.Table:
    """For a block pair: links to other vectors of each class, and links that span what it joins."""
    side = block.column("side").to_numpy()
    cid, copies = block.column("cid").to_numpy(), block.column("copies").to_numpy()
    alike = bool((side == 2).any())
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    if alike:
        right = left
    a = b = np.empty(0, np.int64)
    links, forest, kept = np.zeros(len(cid), np.int64), Forest(), []
    if len(left) and len(right):
        rows = stacked(block.column("unit").combine_chunks())
        for i in range(0, len(right), 256):
            r = right[i : i + 256]
            x, y = np.nonzero(rows[r] @ rows[left].T >= threshold)
            a, b = r[x], left[y]
            if alike:
                a, b = a[b < a], b[b < a]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            kept += forest.spanning(cid[a], cid[b])
    some = np.flatnonzero(links)
    n = len(some)
    x, y = (np.array(v, dtype=np.int64) for v in (zip(*kept, strict=True) if kept else ((), ())))
    return pa.table({"cid": pa.array(np.r_[cid[some], x]), "links": pa.array(np.r_[links[some], np.zeros(len(x), np.int64)]), "other": pa.array(np.r_[np.zeros(n, np.int64), y], mask=np.arange(n + len(x)) < n)})


def met_pairs(classes: DataFrame, threshold: float, reach: float | None) -> DataFrame:
    """What meet() gives for the classes of every dimension: those with many vectors by cells, any others in one cell each."""
    fields = "cid long, links long, other long"
    widths = {r["w"]: r["n"] for r in classes.groupBy(F.length("unit").alias("w")).agg(F.count("*").alias("n")).collect()}
    small = classes.withColumn("w", F.length("unit")).withColumn("side", F.lit(2))
    found = []
    for width, count in sorted(widths.items()):
        if count > CELL:
            small = small.filter(F.col("w") != width)
            some = classes.filter(F.length("unit") == width)
            centres, near_plane = fit_centres(some, count), margin(threshold, width // 8, reach)
            pairs = dealt(some, centres, near_plane, *crowds(some, centres, near_plane))
            found.append(materialize(pairs.groupBy("cell", "part", "slot").applyInArrow(lambda t: meet(t, threshold), fields)))
    if len(found) < len(widths) or not widths:
        found.append(materialize(small.groupBy("w").applyInArrow(lambda t: meet(t, threshold), fields)))
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, id_: str = "vec_id", vector: str = "embedding", reach: float | None = REACH) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Two rows are linked if the cosine of their vectors is at least `threshold`, in double precision. A
    vector that is null, empty, zero or holds null or non-finite components links with nothing, and vectors of
    different dimensions do not link. Equal vectors become one class first, so copies cost one row and are counted,
    not paired. A null vec_id counts as larger than any other; repeated rows are copies. No rows give no rows, and
    other columns may have any name. `reach` is said above; None misses no link.
    """
    units = materialize(normalised(vectors, id_, vector))
    classes = units.filter("unit is not null").groupBy("unit").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # Classes are numbered, as vectors without an id have none to tell them apart.
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    met = met_pairs(classes, threshold, reach)
    joined = components(met.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    links = met.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    named = materialize(classes.join(joined, classes.cid == joined.node, "left").join(links, "cid", "left").select("unit", "least", F.coalesce("component", "cid").alias("node"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n")))
    named = named.join(named.groupBy("node").agg(F.min("least").alias("component")), "node").select("unit", "component", "n")
    found = units.join(named, "unit", "left")
    component = F.coalesce("component", "vec_id")
    return found.select(outer_id("vec_id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.when(component != NO_ID, component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))
