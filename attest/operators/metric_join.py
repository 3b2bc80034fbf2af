"""Exact distance joins in Euclidean space over a metric tree of two levels and row blocks.

A point goes to the super-cell of its nearest top pivot (at most TOP of them, on the driver),
and inside it to the cell of its nearest sub-pivot. Sub-pivots are rows, one list per
super-cell, and meet blocks of points in a join: nothing on the driver grows with the rows.
The distance from a point x to the hyperplane between its nearest pivot p and another
pivot q is (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)), so a cell whose hyperplane or annulus is
farther than the search radius, on either level, cannot hold a partner and is never visited.
Cells are cut into row blocks of bounded size; Spark equi-joins block pairs on
(cell, block) and a numpy product compares one pair of blocks at a time. No
task ever holds a whole cell, and no row pair is materialised unless it matches.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.scale import pack_blocks
from attest.session import discard, settle

BLOCK_ROWS = 1024
TOP = 256  # top pivots at most
LANDMARKS = 16  # of them, those that bound the blocks of a product
PARTS = 4  # of the base in a product: so many times a point's nearest leave a task
_SUB = 32  # a cell's number is its super-cell's, shifted by so many bits, and its own
_ARROW_BYTES = 16 * 1024 * 1024


def bound_arrow_batches(spark: SparkSession) -> None:
    """Block rows are about a megabyte each: cap a batch by bytes, not by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(_ARROW_BYTES))


def matrix_of(column: pa.Array) -> np.ndarray:
    """An Arrow list<double> column as an n x d matrix without copying values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    count = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(count, -1) if count else np.empty((0, 0))


def block_of(column: pa.Array, row: int) -> pa.StructArray:
    """The struct rows of one packed block."""
    return column[row].values


def pivot_count(rows: int) -> int:
    """Cells grow with the square root of the rows, and so do the rows of a cell."""
    return int(max(4, np.sqrt(rows) / 2))


@dataclass
class Tree:
    """``top`` pivots with the smallest and largest radius of their super-cells, and
    ``subs(super, pivots, low, high)`` with the same for the cells of each super-cell."""

    top: np.ndarray
    rings: np.ndarray
    subs: DataFrame


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (
        (points * points).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2.0 * points @ pivots.T
    )
    return np.sqrt(np.maximum(square, 0.0))


def _with_top(points: DataFrame, vec: str, top: np.ndarray, names: list[str]) -> DataFrame:
    """``names`` of the points with ``super`` and ``top_radius``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(matrix_of(batch.column(vec)), top)
            cell = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "super", "top_radius"])

    source = points.select(*names)
    schema = T.StructType(source.schema.fields + [
        T.StructField("super", T.IntegerType()), T.StructField("top_radius", T.DoubleType())])
    return source.mapInArrow(run, schema)


def _by_super(rows: DataFrame, payload: list[str], subs: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Blocks of rows of one super-cell, each beside the columns of its sub-pivots."""
    blocks = pack_blocks(rows, ["super"], "vid", payload, size).select("super", "rows")
    return blocks.hint("merge").join(subs.select("super", *columns), "super")


def build_tree(points: DataFrame, ident: str, vec: str, keep: list[str], size: int = BLOCK_ROWS) -> tuple[Tree, DataFrame]:
    """The tree over ``points``, and the points with ``vid``, ``keep``, their ``cell`` and its radius (settled)."""
    total = points.count()
    wanted = pivot_count(total)
    count = min(TOP, wanted)
    # At most TOP vectors reach the driver.
    rows = points.orderBy(F.xxhash64(F.col(ident), F.lit(17)), ident).limit(count).select(vec).collect()
    top = np.unique(np.asarray([r[0] for r in rows], dtype=np.float64), axis=0)
    named = points.select(F.col(ident).alias("vid"), F.col(vec).alias("vec"), *keep)
    placed = settle(_with_top(named, "vec", top, ["vid", "vec", *keep]))
    rings = np.full((len(top), 2), np.nan)
    for r in placed.groupBy("super").agg(F.min("top_radius"), F.max("top_radius")).collect():
        rings[r[0]] = (r[1], r[2])
    # The top pivot itself and a share of the points of its super-cell, by hash.
    own = points.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(top)], "super int, pivot array<double>")
    share = max(0, wanted - count) / max(1, total)
    more = placed.where(F.pmod(F.xxhash64("vid", F.lit(29)), F.lit(1 << 53)) < share * float(1 << 53)).select(
        "super", F.col("vec").cast("array<double>").alias("pivot"))
    pivots = settle(own.union(more).groupBy("super").agg(F.array_sort(F.collect_set("pivot")).alias("pivots")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, subs = block_of(batch.column("rows"), i), matrix_of(batch.column("pivots")[i].values)
                far = _distances(matrix_of(block.field("vec")), subs)
                near = far.argmin(1)
                cell = (batch.column("super")[i].as_py() << _SUB) + near.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*[block.field(c) for c in ("vid", "vec", *keep)], pa.array(cell), pa.array(far[np.arange(len(near)), near])],
                    names=["vid", "vec", *keep, "cell", "radius"])

    bound_arrow_batches(points.sparkSession)
    schema = T.StructType([f for f in placed.schema.fields if f.name not in ("super", "top_radius")] + [
        T.StructField("cell", T.LongType()), T.StructField("radius", T.DoubleType())])
    stored = settle(_by_super(placed, ["vec", *keep], pivots, ["pivots"], size).mapInArrow(run, schema))
    cells = stored.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"))
    listed = pivots.select("super", F.posexplode("pivots").alias("sub", "pivot")).withColumn(
        "cell", F.shiftleft(F.col("super").cast("bigint"), _SUB) + F.col("sub"))
    entry = F.array_sort(F.collect_list(F.struct("sub", "pivot", "low", "high")))
    subs = listed.join(cells, "cell", "left").groupBy("super").agg(entry.alias("e")).select(
        "super", F.col("e.pivot").alias("pivots"), F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    tree = Tree(top, rings, settle(subs))
    discard(placed)
    return tree, stored


def _open(far: np.ndarray, between: np.ndarray, rings: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Which cells of the pivots may hold a partner of each point; empty cells have no rings."""
    home = far.argmin(1)
    line = np.arange(len(home))
    with np.errstate(divide="ignore", invalid="ignore"):
        margin = (far**2 - far[line, home][:, None] ** 2) / (2.0 * between[home])
    margin[line, home] = 0.0
    # Equal pivots have no plane between them.
    margin = np.nan_to_num(margin, nan=0.0, posinf=np.inf)
    return (margin <= reach) & (far - reach <= rings[:, 1]) & (far + reach >= rings[:, 0])


def copies(rows: pa.RecordBatch, who: np.ndarray, name: str, values: np.ndarray, size: int) -> Iterator[pa.RecordBatch]:
    """The rows ``who`` beside ``values``, ``size`` at a time: where bounds prune little, a row is asked in every cell."""
    for at in range(0, len(who), size):
        yield pa.RecordBatch.from_arrays([*rows.take(pa.array(who[at:at + size])).columns, pa.array(values[at:at + size])],
                                         names=[*rows.schema.names, name])


def target_cells(points: DataFrame, tree: Tree, include_home: bool, only_lower: bool = False, size: int = BLOCK_ROWS) -> DataFrame:
    """One row ``(vid, vec, cell)`` per point and cell that may hold a partner within its reach.

    ``points(vid, vec, cell, reach)`` with their own cell. ``only_lower`` keeps cells
    numbered up to the own one, for symmetric joins.
    """
    tolerance = 1e-9
    top, rings = tree.top, tree.rings
    between = _distances(top, top)

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(matrix_of(batch.column("vec")), top)
            own = batch.column("cell").to_numpy(zero_copy_only=False) >> _SUB
            reach = batch.column("reach").to_numpy(zero_copy_only=False)[:, None] + tolerance
            able = _open(far, between, rings, reach)
            able[np.arange(len(own)), own] = True
            if only_lower:
                able &= np.arange(len(top))[None, :] <= own[:, None]
            who, cell = np.nonzero(able)
            yield from copies(batch, who, "super", cell.astype(np.int32), size)

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, subs = block_of(batch.column("rows"), i), matrix_of(batch.column("pivots")[i].values)
                ring = np.stack([batch.column(c)[i].values.to_numpy(zero_copy_only=False).astype(float) for c in ("low", "high")], axis=1)
                own = block.field("cell").to_numpy(zero_copy_only=False)
                reach = block.field("reach").to_numpy(zero_copy_only=False)[:, None] + tolerance
                cells = (batch.column("super")[i].as_py() << _SUB) + np.arange(len(subs), dtype=np.int64)
                able = _open(_distances(matrix_of(block.field("vec")), subs), _distances(subs, subs), ring, reach)
                mine = cells[None, :] == own[:, None]
                able = able | mine if include_home else able & ~mine
                if only_lower:
                    able &= cells[None, :] <= own[:, None]
                who, cell = np.nonzero(able)
                asked = pa.RecordBatch.from_arrays([block.field("vid"), block.field("vec")], names=["vid", "vec"])
                yield from copies(asked, who, "cell", cells[cell], size)

    bound_arrow_batches(points.sparkSession)
    source = points.select("vid", "vec", "cell", F.col("reach").cast("double").alias("reach"))
    kinds = {f.name: f for f in source.schema.fields}
    asked = source.mapInArrow(above, T.StructType([*source.schema.fields, T.StructField("super", T.IntegerType())]))
    schema = T.StructType([kinds["vid"], kinds["vec"], T.StructField("cell", T.LongType())])
    return _by_super(settle(asked), ["vec", "cell", "reach"], tree.subs, ["pivots", "low", "high"], size).mapInArrow(below, schema)


def join_blocks(
    probes: DataFrame,
    base: DataFrame,
    ident: str,
    vec: str,
    base_payload: list[str],
    kernel: Callable[[pa.StructArray, pa.StructArray], pa.RecordBatch],
    schema: T.StructType,
    size: int = BLOCK_ROWS,
) -> DataFrame:
    """Run ``kernel(probe block, base block)`` on every pair of blocks of equal cell.

    Probe blocks are copied once per base block of their cell, so the key
    (cell, block) spreads a hot cell over as many tasks as it has base blocks.
    """
    bound_arrow_batches(probes.sparkSession)
    stored = pack_blocks(base, ["cell"], ident, [vec, *base_payload], size)
    counts = stored.groupBy("cell").agg(F.max("n_blocks").alias("base_blocks"))
    asked = (
        pack_blocks(probes, ["cell"], ident, [vec], size)
        .select("cell", F.col("rows").alias("probe"))
        .join(counts, "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("base_blocks") - 1)))
        .drop("base_blocks")
    )
    # Copies of probe blocks are invisible to the size estimate: never broadcast them.
    paired = asked.hint("merge").join(
        stored.select("cell", "block", F.col("rows").alias("base")), ["cell", "block"]
    ).select("probe", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("probe"), batch.column("base")
            for i in range(batch.num_rows):
                out = kernel(block_of(left, i), block_of(right, i))
                if out.num_rows:
                    yield out

    return paired.mapInArrow(run, schema)


def packed(points: DataFrame, tree: Tree, keep: int) -> DataFrame:
    """Blocks of points of one cell as plain bytes (settled), with their distances to the landmarks.

    ``points(vid, vec, cell, asked)``; all can be found. The ``keep``-th nearest row of its own block bounds what an
    asked point has to look for; where a block has fewer rows, nothing does.
    """
    marks = tree.top[np.unique(np.linspace(0, len(tree.top) - 1, LANDMARKS).astype(int))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = block_of(batch.column("rows"), i)
                vec, reach = matrix_of(rows.field("vec")), np.full(len(rows), np.inf)
                if len(rows) >= keep:
                    own = _distances(vec, vec)
                    slack = 1e-9 * (1.0 + (vec * vec).sum(1).max())
                    reach = np.sqrt(np.partition(own, keep - 1, axis=1)[:, keep - 1] ** 2 + slack)
                reach[~rows.field("asked").to_numpy(zero_copy_only=False)] = np.nan
                far, most = _distances(vec, marks), np.nanmax(reach, initial=-1.0)
                vid = rows.field("vid").to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "vid": vid.tobytes(), "vec": vec.tobytes(), "reach": reach.tobytes(), "most": most,
                    "low": far.min(0).tolist(), "high": far.max(0).tolist()}], pa.schema([
                        ("vid", pa.binary()), ("vec", pa.binary()), ("reach", pa.binary()), ("most", pa.float64()),
                        ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    bound_arrow_batches(points.sparkSession)
    blocks = pack_blocks(points, ["cell"], "vid", ["vec", "asked"], BLOCK_ROWS).select("rows")
    return settle(blocks.mapInArrow(run, "vid binary, vec binary, reach binary, most double, low array<double>, high array<double>")
                  .withColumn("block", F.monotonically_increasing_id()))


def nearest(blocks: DataFrame, keep: int) -> DataFrame:
    """``(vid, distance, n_ord)``: per asked point and part of the base its ``keep`` nearest points by (distance, vid), itself included.

    ``blocks`` from ``packed``; a point's reach, a number or infinite, bounds what it looks for. Block meets block in a product
    whose tasks read their sides from the settled files: no copies of points are shuffled, however many blocks
    a point must look into, and blocks that a landmark keeps farther apart than the reach are not shipped.
    A task keeps the nearest of its asked points, which leave it once.
    """
    marks = len(blocks.select("low").first()[0])
    asked = blocks.where("most >= 0").select("block", "vid", "vec", "reach", "most", F.col("low").alias("p_low"), F.col("high").alias("p_high"))
    base = blocks.select(F.col("vid").alias("b_vid"), F.col("vec").alias("b_vec"), "low", "high").coalesce(PARTS)
    meets = F.lit(True)
    for t in range(marks):
        at = lambda c: F.get(c, F.lit(t))
        # Rounding of distances that come from products of large numbers.
        reach = F.col("most") + F.lit(1e-6) * (1 + at("high") + at("p_high"))
        meets &= (at("p_low") - reach <= at("high")) & (at("low") - reach <= at("p_high"))
    paired = base.hint("shuffle_replicate_nl").join(asked, meets).select("b_vid", "b_vec", "block", "vid", "vec", "reach")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.iinfo(np.int64).max
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                number = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                vid, names = number("vid", np.int64), number("b_vid", np.int64)
                left, right = number("vec", float).reshape(len(vid), -1), number("b_vec", float).reshape(len(names), -1)
                reach = number("reach", float)
                able = ~np.isnan(reach)
                if not able.all():
                    vid, left, reach = vid[able], left[able], reach[able]
                found = held.setdefault(batch.column("block")[i].as_py(), (
                    vid.copy(), np.full((len(vid), keep), np.inf), np.full((len(vid), keep), none)))
                _merge_nearest(left, right, names, reach, found[1], found[2])
        for vid, distance, near in held.values():
            who, place = np.nonzero(near != none)
            yield pa.RecordBatch.from_arrays([pa.array(vid[who]), pa.array(distance[who, place]), pa.array(near[who, place])],
                                             names=["vid", "distance", "n_ord"])

    bound_arrow_batches(blocks.sparkSession)
    return paired.mapInArrow(run, "vid bigint, distance double, n_ord bigint")


def _merge_nearest(left: np.ndarray, right: np.ndarray, names: np.ndarray, reach: np.ndarray,
                   distance: np.ndarray, near: np.ndarray, size: int = 1 << 16) -> None:
    """Put rows of ``right`` among the nearest of the rows of ``left``, in place: ``distance`` and ``near`` by (distance, name)."""
    keep = distance.shape[1]
    a, b = (left * left).sum(1), (right * right).sum(1)
    square = a[:, None] + b[None, :] - 2.0 * left @ right.T
    slack = 1e-9 * (1.0 + a.max() + b.max())
    limit = np.minimum(reach, distance[:, -1])
    hit = square <= (limit * limit * (1 + 1e-9))[:, None] + slack
    many = np.flatnonzero(hit.sum(1) > keep)
    if len(many):
        some = square[many]
        hit[many] &= some <= np.partition(some, keep - 1, axis=1)[:, keep - 1][:, None] + slack
    who, at = np.nonzero(hit)
    for start in range(0, len(who), size):
        w, n = who[start:start + size], at[start:start + size]
        gap = left[w] - right[n]
        rows = np.unique(w)
        row = np.concatenate([w, np.repeat(rows, keep)])
        far = np.concatenate([np.sqrt((gap * gap).sum(1)), distance[rows].ravel()])
        name = np.concatenate([names[n], near[rows].ravel()])
        order = np.lexsort((name, far, row))
        first = np.searchsorted(row[order], rows)
        best = order[first[:, None] + np.arange(keep)]
        distance[rows], near[rows] = far[best], name[best]
