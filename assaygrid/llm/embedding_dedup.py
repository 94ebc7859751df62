"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors have cosine c or more if their squared distance is 2 - 2 c or less. They are rotated to
their principal axes (of second moments over all vectors) and cut into low-dimensional blocks; the
squared distance is dealt to the blocks in proportion to their spread, so a linked pair stays within
budget in at least one block. Each block is range-joined: a vector lies in its own cell of a grid on
some of the block's axes (as many as an estimate of copies and meetings finds cheapest) and goes to
every cell that its budget's radius reaches; inside a task, own vectors are halved along all axes of
the block, and what lies beyond the radius of a half is left out of it.

Rotated vectors travel as 16-bit integers. What these leave open about a candidate, within a bound of
their rounding, is decided in double precision on the vectors as they were given; the rest is certain.
A pair counts in the first block that would find it.

Equal vectors are compared once. Cells are cut into tiles, so no task holds an unbounded one; a task
passes on counts of links and a forest of them, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaygrid.llm import ragged
from assaygrid.llm.components import components, local_forest
from assaygrid.llm.tables import arrow_batches, without, written
from assaygrid.llm.tiles import deal, grouped

#: Axes of a block.
BLOCK = 8
#: Own vectors of a cell, and vectors that they are held against, in a group at most.
TILE, RUN = 16_384, 49_152
#: A rotated unit vector's components are multiples of 1 / SCALE.
SCALE = 32_767
#: Own vectors that are not halved any further.
LEAF = 96
#: Estimated seconds that a copy of a vector and a pair that meets cost, to choose a grid.
COPY_COST, PAIR_COST = 5e-6, 3e-10


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _units(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column over their lengths, with zeros up to width."""
    sizes = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(sizes)), sizes), ragged.expand(np.zeros(len(sizes), np.int64), sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, class (a digest of the vector; null if it has no direction), v."""
    for batch in batches:
        v = batch.column(1)
        valid = v.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(valid, np.asarray(v.value_lengths().fill_null(0)), 0).astype(np.int64)
        flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # a null is NaN, and -0.0 is 0.0
        ends = np.cumsum(sizes)
        odd = np.append(0, np.cumsum(~np.isfinite(flat)))
        some = np.append(0, np.cumsum(flat != 0))
        usable = (odd[ends] == odd[ends - sizes]) & (some[ends] > some[ends - sizes])
        raw = flat.tobytes()
        digest = [xxhash.xxh3_128_digest(raw[8 * (e - n) : 8 * e]) if u else None for e, n, u in zip(ends.tolist(), sizes.tolist(), usable.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), v], ["vec_id", "class", "v"])


def _rotation(classes: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns, widest first) and their second moments, from sums over all unit vectors."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            u = _units(batch.column(0), width)
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width, dtype=np.int32)), pa.array(total.ravel())], ["at", "x"])

    rows = classes.select("v").mapInArrow(summed, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    moment = np.zeros(width * width)
    for r in rows:
        moment[r["at"]] = r["x"]
    spread, axes = np.linalg.eigh(moment.reshape(width, width))
    return axes[:, ::-1], np.maximum(spread[::-1], 0)


def linked_vectors(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", cosine: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row.

    n_links: other rows linked directly (cosine or more, in double precision); component_id: the least
    vec_id that links reach, its own included; kept: vec_id = component_id. Vectors that are null, empty,
    zero or hold null or non-finite components, and vectors of different lengths, do not link. Equal vectors
    link, rows that repeat a vec_id too. Null vec_ids: linked and counted, but a component's id is its
    least that is not null, and kept is false. Other columns are dropped. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4000)
    named = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    classed = named.mapInArrow(_classed, "vec_id long, class binary, v array<double>")
    rows, _ = written(classed.select("vec_id", "class"), "vectors")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = classed.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    # equal vectors have one direction; a class is known by a number of its own
    classes, _ = written(classes.withColumn("number", F.monotonically_increasing_id()), "classes")
    width = classes.agg(F.max(F.size("v"))).first()[0]
    if not width:
        return _closed(alone)
    found, _ = written(_join(classes, int(width), cosine), "links")
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("n"))
    reached = components(found.where("b is not null").select("a", "b"))
    placed = classes.select("class", "number", "copies", "least").join(counts, F.col("number") == F.col("a"), "left").drop("a")
    placed = placed.join(reached, F.col("number") == F.col("node"), "left").select("class", "copies", "least", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "number").alias("root"))
    placed, _ = written(placed, "placed")
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    member = placed.join(ids, "root").select("class", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    return _closed(rows.where("class is not null").join(member, "class").select("vec_id", "n_links", "component_id").unionByName(alone))


def _closed(out: DataFrame) -> DataFrame:
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def grid_axes(n: int, spread: np.ndarray, radius: float) -> int:
    """On how many of a block's first axes a grid of cells of two radii costs least, for n vectors of these second moments."""
    best = (math.inf, 1)
    for k in range(1, len(spread) + 1):
        # a vector lies up to a radius from one neighbour on each axis: cells within the ball, on average
        copies = sum(math.comb(k, j) * math.pi ** (j / 2) / math.gamma(j / 2 + 1) / 2**j for j in range(k + 1))
        meet = math.prod(math.erf(0.75 * radius / max(math.sqrt(x), 1e-12)) for x in spread[:k])
        runs = 1 + math.sqrt(n * meet / TILE)  # copies that tiles and runs of a cell add
        best = min(best, (n * copies * runs * COPY_COST + float(n) * n * meet * PAIR_COST, k))
    return best[1]


def _close(x: np.ndarray, own: np.ndarray, others: np.ndarray, radius: float, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (own, other) of places in x (single precision) at a squared distance of limit or less; none farther apart than radius on an axis."""
    square = (x * x).sum(1)
    left = np.column_stack([-2 * x, square, np.ones(len(x), np.float32)]).astype(np.float32)
    right = np.column_stack([x, np.ones(len(x), np.float32), square]).astype(np.float32)
    todo = [(own, others)]
    while todo:
        o, r = todo.pop()
        if not len(o) or not len(r):
            continue
        if len(o) > LEAF:
            axis = int(np.argmax(x[o].std(0)))
            at, there = x[o, axis], x[r, axis]
            middle = np.partition(at, len(o) // 2)[len(o) // 2]
            low = at < middle
            if low.any():
                todo += [(o[low], r[there <= middle + radius]), (o[~low], r[there >= middle - radius])]
                continue
        for i in range(0, len(o), LEAF):
            for j in range(0, len(r), 16_384):
                p, q = np.nonzero(left[o[i : i + LEAF]] @ right[r[j : j + 16_384]].T <= limit)
                if len(p):
                    yield o[i + p], r[j + q]


def _join(classes: DataFrame, width: int, cosine: float) -> DataFrame:
    """Counts (a, null, n) and links (a, b, 0) of classes."""
    axes, spread = _rotation(classes, width)
    n = classes.count()
    # axes are dealt so that each block has wide and narrow ones, its widest first
    n_blocks = max(1, width // BLOCK)
    blocks = [np.arange(b, width, n_blocks) for b in range(n_blocks)]
    weight = np.array([spread[b].sum() for b in blocks]) + spread.sum() * 1e-3
    most = 2 - 2 * cosine
    off = math.sqrt(width) / SCALE + 1e-9  # a distance's rounding at most: half a step an axis, of either vector
    # from here on all is of whole numbers, so every task decides alike
    radii = [math.ceil(SCALE * (math.sqrt(most * w / weight.sum()) + off)) + 1 for w in weight]
    grids = [grid_axes(n, spread[b] / max(n, 1), r / SCALE) for b, r in zip(blocks, radii, strict=True)]
    sure, open_ = (SCALE * (math.sqrt(most) - off)) ** 2 if math.sqrt(most) > off else -1.0, (SCALE * (math.sqrt(most) + off)) ** 2
    shared = classes.sparkSession.sparkContext.broadcast(axes)

    def whole(batch: pa.RecordBatch) -> np.ndarray:
        return np.rint(_units(batch.column(2), width) @ shared.value * SCALE).astype(np.int64)

    def cells(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
        """Rotated vectors of a batch; and block by block the buckets that rows go to, the rows, whether it is their own."""
        q = whole(batch)
        size = np.asarray(batch.column(2).value_lengths()).astype(np.uint64)
        for number, (block, radius, k) in enumerate(zip(blocks, radii, grids, strict=True)):
            home, inner = np.divmod(q[:, block[:k]], 2 * radius)
            step = np.where(inner < radius, -1, 1)
            gap = np.where(inner < radius, inner, 2 * radius - inner) ** 2
            for moved in (c for j in range(k + 1) for c in combinations(range(k), j)):
                at = np.flatnonzero(gap[:, moved].sum(1) <= radius * radius) if moved else np.arange(len(q))
                cell = home[at]
                cell[:, moved] += step[np.ix_(at, moved)]
                bucket = np.full(len(at), number, np.uint64)
                for c in [*cell.T.astype(np.int64).view(np.uint64), size[at]]:
                    bucket = ragged.mixed(bucket * np.uint64(0x9E3779B97F4A7C15) + c)
                yield q, bucket.view(np.int64), at, np.full(len(at), not moved), number

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, bucket, _, own, _ in cells(batch):
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(own)], ["bucket", "own"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, bucket, at, own, number in cells(batch):
                short = q[at].astype("<i2").tobytes()
                vectors = pa.Array.from_buffers(pa.binary(2 * width), len(at), [None, pa.py_buffer(short)]).cast(pa.binary())
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(own), pa.array(np.full(len(at), number, np.int32)), batch.column(0).take(rows), batch.column(1).take(rows), vectors], ["bucket", "own", "block", "number", "copies", "turned"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, heads, owns in grouped(batches, 4000):
            turned = next(ragged.slices(table["turned"], 1 << 40))[2].view("<i2").reshape(-1, width)
            number, copies, block = (table[c].to_numpy() for c in ("number", "copies", "block"))
            for h, o, e in zip(heads.tolist(), owns.tolist(), [*heads[1:].tolist(), len(number)], strict=True):
                if o and e - h - o > 1:
                    yield from group(turned[h:e], number[h:e], copies[h:e], o, int(block[h]))

    def apart(x: np.ndarray, a: np.ndarray, b: np.ndarray, axes_of) -> np.ndarray:
        d = x[a][:, axes_of].astype(np.int64) - x[b][:, axes_of]
        return np.einsum("ij,ij->i", d, d)

    def group(x: np.ndarray, number: np.ndarray, copies: np.ndarray, o: int, block: int) -> Iterator[pa.RecordBatch]:
        part = (x[:, blocks[block]] / np.float32(SCALE)).astype(np.float32)
        reach = radii[block] / SCALE
        names, back = np.unique(number, return_inverse=True)
        root, links = np.arange(len(names)), np.zeros(o, np.int64)
        # coarse in single precision with room for its error, then in whole numbers
        for p, q in _close(part, np.arange(o), np.arange(o, len(x)), reach + 1e-5, reach * reach + 1e-5):
            keep = number[p] != number[q]
            p, q = p[keep], q[keep]
            for k in range(0, len(p), 100_000):
                a, b = p[k : k + 100_000], q[k : k + 100_000]
                near = apart(x, a, b, blocks[block]) <= radii[block] ** 2
                a, b = a[near], b[near]
                for earlier in range(block):
                    far = apart(x, a, b, blocks[earlier]) > radii[earlier] ** 2
                    a, b = a[far], b[far]
                away = apart(x, a, b, slice(None))
                unsure = (away > sure) & (away <= open_)
                if unsure.any():
                    yield pa.RecordBatch.from_arrays([pa.array(number[a[unsure]]), pa.array(number[b[unsure]]), pa.nulls(int(unsure.sum()), pa.int64())], ["a", "b", "n"])
                a, b = a[away <= sure], b[away <= sure]
                np.add.at(links, a, copies[b])
                pairs = np.unique(root[back[a]] * len(names) + root[back[b]])
                root = local_forest(len(names), pairs // len(names), pairs % len(names))[root]
        some = np.flatnonzero(links)
        joined_to = np.flatnonzero(root != np.arange(len(names)))
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(number[some]), pa.nulls(len(some), pa.int64()), pa.array(links[some])], ["a", "b", "n"])
        if len(joined_to):
            yield pa.RecordBatch.from_arrays([pa.array(names[joined_to]), pa.array(names[root[joined_to]]), pa.array(np.zeros(len(joined_to), np.int64))], ["a", "b", "n"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b, copies of b, their vectors) that are linked: as a count of a, and as a link."""
        for batch in batches:
            u, w = (_units(batch.column(i), width) for i in (3, 4))
            at = pa.array(np.flatnonzero(np.einsum("ij,ij->i", u, w) >= cosine))
            a, b, n = (batch.column(i).take(at) for i in (0, 1, 2))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([a, a]), pa.concat_arrays([none, b]), pa.concat_arrays([n, pa.array(np.zeros(len(at), np.int64))])], ["a", "b", "n"])

    units = classes.select("number", "copies", "v")
    sizes = units.mapInArrow(sized, "bucket long, own boolean")
    keys = units.mapInArrow(keyed, "bucket long, own boolean, block int, number long, copies long, turned binary")
    found, _ = written(deal(keys, "number", TILE, RUN, sizes).mapInArrow(joined, "a long, b long, n long"), "candidates")
    shared.destroy()
    first = units.select(F.col("number").alias("a"), F.col("v").alias("u"))
    second = units.select(F.col("number").alias("b"), F.col("copies").alias("n"), F.col("v").alias("w"))
    unsure = found.where("n is null").select("a", "b").join(first, "a").join(second, "b").select("a", "b", "n", "u", "w")
    return found.where("n is not null").unionByName(unsure.mapInArrow(checked, "a long, b long, n long"))


def drop_near_duplicates(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", cosine: float = 0.95) -> DataFrame:
    """vectors without rows of linked_vectors that are not kept; rows with a null vec_id stay."""
    gone = linked_vectors(without(vectors.select(vec_id, vector)), vector, vec_id, cosine).where("vec_id is not null and not kept").select(F.col("vec_id").alias("_gone")).distinct()
    return vectors.join(gone, vectors[vec_id] == gone["_gone"], "left_anti")
