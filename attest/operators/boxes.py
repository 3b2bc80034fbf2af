"""Annotation geometry: box validity, coverage, missing labels and shifted layouts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.schemas import as_findings, config_hash
from attest.session import settle

SIZE = ["width", "height"]


def explode_boxes(images: DataFrame) -> DataFrame:
    """``images(image_id, ord, width, height, boxes)`` -> one row per box with its index."""
    return images.select(
        "image_id", "ord", *SIZE, F.posexplode("boxes").alias("box_index", "box")
    ).select("image_id", "ord", *SIZE, "box_index", "box.x", "box.y", "box.w", "box.h")


def _empty_extent() -> Column:
    return (F.col("w") <= 0) | (F.col("h") <= 0)


def _outside() -> Column:
    return (
        (F.col("x") < 0) | (F.col("y") < 0)
        | (F.col("x") + F.col("w") > F.col("width"))
        | (F.col("y") + F.col("h") > F.col("height"))
    )


def invalid_box_area(boxes: DataFrame) -> DataFrame:
    return boxes.where(_empty_extent())


def box_out_of_bounds(boxes: DataFrame) -> DataFrame:
    return boxes.where(~_empty_extent() & _outside())


def box_findings(boxes: DataFrame) -> DataFrame:
    """Both per-box checks in one pass over the boxes."""
    kind = F.when(_empty_extent(), "invalid_box_area").when(_outside(), "box_out_of_bounds")
    bad = boxes.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return as_findings(
        bad,
        asset_id=F.col("image_id"),
        finding_type=F.col("kind"),
        severity=F.when(F.col("kind") == "invalid_box_area", 0.8).otherwise(0.7),
        confidence=1.0,
        modality="ANNOTATION",
        detector_id="annotation_integrity",
        evidence=[F.format_string("Box %d: x=%s y=%s w=%s h=%s in %s by %s.", F.col("box_index"),
                                  *[F.col(c).cast("string") for c in ("x", "y", "w", "h", *SIZE)])],
        counter_evidence=["A different box format or unclipped truncated objects can explain the values."],
        ord=F.col("ord"),
    )


# Boxes that a tile is swept with at most, and the parts a fuller tile is cut into along each side.
TILE_BOXES, TILE_PARTS = 64, 8
_TILE = ["image_id", "left", "top", "right", "bottom"]
_EDGES = ["x1", "y1", "x2", "y2"]


def _cut_tiles(rows: DataFrame, parts: int) -> DataFrame:
    """The boxes of each tile in its ``parts`` x ``parts`` equal parts, clipped, copies once."""
    def spread(low: str, high: str, start: str, end: str) -> Column:
        step = (F.col(high) - F.col(low)) / parts
        first = F.greatest(F.lit(0), F.floor((F.col(start) - F.col(low)) / step) - 1)
        last = F.least(F.lit(parts - 1), F.floor((F.col(end) - F.col(low)) / step) + 1)
        return F.sequence(first.cast("int"), last.cast("int"))

    def side(low: str, high: str, at: Column) -> Column:
        # The right side of a part is, digit for digit, the left side of the next.
        return F.when(at == parts, F.col(high)).otherwise(F.col(low) + (F.col(high) - F.col(low)) * at / parts)

    columns = rows.withColumn("i", F.explode(spread("left", "right", "x1", "x2"))).withColumn("j", F.explode(spread("top", "bottom", "y1", "y2")))
    cut = columns.select(
        "image_id", *SIZE, *_EDGES, side("left", "right", F.col("i")).alias("l"), side("top", "bottom", F.col("j")).alias("t"),
        side("left", "right", F.col("i") + 1).alias("r"), side("top", "bottom", F.col("j") + 1).alias("b"))
    return cut.select(
        "image_id", *SIZE, F.col("l").alias("left"), F.col("t").alias("top"), F.col("r").alias("right"), F.col("b").alias("bottom"),
        F.greatest("x1", "l").alias("x1"), F.greatest("y1", "t").alias("y1"), F.least("x2", "r").alias("x2"), F.least("y2", "b").alias("y2"),
    ).where("x2 > x1 and y2 > y1").distinct()


def _swept(rows: DataFrame) -> DataFrame:
    """``(image_id, area)`` per tile: x strips between neighbouring edges, and in a strip a running maximum of y."""
    key = ["image_id", "left", "top"]
    edges = rows.select(*key, F.explode(F.array("x1", "x2")).alias("start")).distinct()
    strips = edges.withColumn("end", F.lead("start").over(Window.partitionBy(*key).orderBy("start"))).where(F.col("end").isNotNull())
    cut = strips.join(rows, key).where("x1 < end and x2 > start")
    before = Window.partitionBy(*key, "start").orderBy("y1", "y2", "x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("y2").over(before), F.lit(0.0))
    gain = F.greatest(F.lit(0.0), F.col("y2") - F.greatest(F.col("y1"), reached))
    return cut.select("image_id", ((F.col("end") - F.col("start")) * gain).alias("area"))


def covered_fraction(boxes: DataFrame, tile_boxes: int | None = None) -> DataFrame:
    """Area of the union of clipped boxes over the image area: ``(image_id, coverage)``.

    An image starts as one tile. A tile with more than ``tile_boxes`` different boxes is cut into
    8 x 8 parts, and these again, until all can be swept; a part that one box covers whole is
    done. A task so gets tiles, not images, and the work of an image with very many
    boxes grows with them, not with their square. Tile areas add up.
    """
    most = tile_boxes or TILE_BOXES
    clipped = boxes.select(
        "image_id", *SIZE, F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.col("width").alias("right"), F.col("height").alias("bottom"),
        F.greatest(F.lit(0.0), "x").alias("x1"), F.greatest(F.lit(0.0), "y").alias("y1"),
        F.least(F.col("width"), F.col("x") + F.col("w")).alias("x2"),
        F.least(F.col("height"), F.col("y") + F.col("h")).alias("y2"),
    ).where("x2 > x1 and y2 > y1")
    size = clipped.groupBy("image_id").agg(F.first(F.col("width") * F.col("height")).alias("size"))
    current, areas = settle(clipped.distinct()), []
    while True:
        full = (F.col("x1") == F.col("left")) & (F.col("y1") == F.col("top")) & (F.col("x2") == F.col("right")) & (F.col("y2") == F.col("bottom"))
        tiles = current.groupBy(*_TILE).agg(F.count(F.lit(1)).alias("n"), F.bool_or(full).alias("full")).where(F.col("n") > most)
        if tiles.isEmpty():
            areas.append(_swept(current))
            break
        tiles = settle(tiles)
        areas.append(_swept(current.join(tiles, _TILE, "left_anti")))
        areas.append(tiles.where("full").select("image_id", ((F.col("right") - F.col("left")) * (F.col("bottom") - F.col("top"))).alias("area")))
        current = settle(_cut_tiles(current.join(tiles.where("not full"), _TILE, "left_semi"), TILE_PARTS))
    total = areas[0]
    for more in areas[1:]:
        total = total.union(more)
    return total.groupBy("image_id").agg(F.sum("area").alias("area")).join(size, "image_id").select(
        "image_id", (F.col("area") / F.col("size")).alias("coverage"))


def valid_images(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """Images without an invalid or out-of-bounds box."""
    bad = boxes.where(_empty_extent() | _outside()).select("image_id").distinct()
    return images.join(bad, "image_id", "left_anti")


def image_coverage(images: DataFrame) -> DataFrame:
    """``(image_id, ord, width, height, coverage)`` of valid images; 0 without boxes."""
    boxes = explode_boxes(images)
    return (
        valid_images(images, boxes).select("image_id", "ord", *SIZE)
        .join(covered_fraction(boxes), "image_id", "left")
        .withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    )


def peer_median_coverage(coverage: DataFrame) -> DataFrame:
    """Adds ``peers`` and ``peer_median``: the median of labelled *other* images of equal size.

    Removing one value moves the median by at most one rank, so three middle order
    statistics per size answer every image; no image is compared with all others.
    """
    slots = 4096
    labelled = coverage.where("coverage > 0").withColumn(
        "slot", F.floor(F.least(F.col("coverage"), F.lit(1.0)) * slots)
    )
    totals = labelled.groupBy(*SIZE).agg(F.count(F.lit(1)).alias("n"))
    # At most slots + 1 rows per size; only the slots around the middle are opened.
    per_slot = labelled.groupBy(*SIZE, "slot").agg(F.count(F.lit(1)).alias("c"))
    ahead = Window.partitionBy(*SIZE).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    half = F.floor(F.col("n") / 2)
    opened = (
        per_slot.withColumn("before", F.coalesce(F.sum("c").over(ahead), F.lit(0)))
        .join(totals, SIZE)
        .where((F.col("before") <= half + 1) & (F.col("before") + F.col("c") > half - 2))
        .select(*SIZE, "slot", "n", "before")
    )
    counted = labelled.join(opened, [*SIZE, "slot"]).groupBy(*SIZE, "slot", "n", "before", "coverage").agg(
        F.count(F.lit(1)).alias("c")
    )
    running = Window.partitionBy(*SIZE, "slot").orderBy("coverage").rowsBetween(Window.unboundedPreceding, 0)
    placed = counted.withColumn("hi", F.col("before") + F.sum("c").over(running)).withColumn(
        "lo", F.col("hi") - F.col("c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("lo") <= rank) & (rank < F.col("hi")), F.col("coverage")))

    # s_k: the order statistics around the middle (0-based rank half + k).
    middle = placed.groupBy(*SIZE, "n").agg(
        at(half - 1).alias("s_1"), at(half).alias("s0"), at(half + 1).alias("s1")
    )
    value = F.col("coverage")
    odd = F.pmod(F.col("n"), F.lit(2)) == 1
    own = value > 0
    whole = F.when(odd, F.col("s0")).otherwise((F.col("s_1") + F.col("s0")) / 2)
    # Without the own value: n odd leaves an even count (two middles), n even one middle.
    from_odd = (
        F.when(value < F.col("s0"), (F.col("s0") + F.col("s1")) / 2)
        .when(value > F.col("s0"), (F.col("s_1") + F.col("s0")) / 2)
        .otherwise((F.col("s_1") + F.col("s1")) / 2)
    )
    from_even = F.when(value <= F.col("s_1"), F.col("s0")).otherwise(F.col("s_1"))
    without = F.when(odd, from_odd).otherwise(from_even)
    return coverage.join(middle, SIZE).select(
        "image_id", "ord", *SIZE, "coverage",
        (F.col("n") - own.cast("int")).alias("peers"),
        F.when(own, without).otherwise(whole).alias("peer_median"),
    )


def large_unlabeled_region(images: DataFrame, uncovered: float = 0.6, gap: float = 0.4) -> DataFrame:
    # Three narrow columns per image, read by several aggregates.
    scored = peer_median_coverage(settle(image_coverage(images)))
    return scored.where(
        (F.col("peers") >= 2)
        & (1 - F.col("coverage") >= uncovered)
        & (F.col("peer_median") - F.col("coverage") >= gap)
    )


def unlabeled_region_findings(hits: DataFrame) -> DataFrame:
    return as_findings(
        hits,
        asset_id=F.col("image_id"),
        finding_type="large_unlabeled_region",
        severity=0.6,
        confidence=0.5,
        modality="ANNOTATION",
        detector_id="annotation_integrity",
        evidence=[F.format_string("Coverage %.3f against a median of %.3f over %d labelled images of equal size.",
                                  F.col("coverage"), F.col("peer_median"), F.col("peers"))],
        counter_evidence=["Background-only images can rightly carry no labels."],
        ord=F.col("ord"),
    )


def _round4(values: np.ndarray) -> np.ndarray:
    """Round to four decimals by the exact binary value; only near-ties need the slow way."""
    scaled = values * 1e4
    out = np.rint(scaled) / 1e4
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.trunc(scaled)) - 0.5) < 1e-6):
        out[i] = round(float(values[i]), 4)
    return out + 0.0  # no negative zero


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _rounded(lists: pa.Array) -> pa.Array:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(_round4(flat)))


def systematic_box_shift(images: DataFrame, min_boxes: int = 3, threshold: float = 0.05,
                         tolerance: float = 0.01) -> DataFrame:
    """Images whose whole layout is displaced alike against the majority layout of equal shape."""
    boxes = explode_boxes(images)
    usable = valid_images(images, boxes).where(F.size("boxes") > 0)
    scaled = F.array_sort(F.transform("boxes", lambda b: F.struct(
        (b["x"] / F.col("width")).alias("x"), (b["y"] / F.col("height")).alias("y"),
        (b["w"] / F.col("width")).alias("w"), (b["h"] / F.col("height")).alias("h"),
    )))
    side = lambda a, b: _rounded(F.flatten(F.transform("layout", lambda x: F.array(x[a], x[b]))))
    layouts = usable.select("image_id", "ord", *SIZE, scaled.alias("layout")).select(
        "*", side("w", "h").alias("shape"), side("x", "y").alias("signature")
    )
    group = [*SIZE, "shape"]
    counted = layouts.groupBy(*group, "signature").agg(
        F.count(F.lit(1)).alias("c"), F.min("ord").alias("first_ord")
    )
    majority = counted.groupBy(*group).agg(
        F.max_by(F.struct("signature", "c"), F.struct("c", -F.col("first_ord"))).alias("top"),
        F.sum("c").alias("members"),
    ).where("top.c >= 2 and top.c > members / 2")
    moved = layouts.join(
        majority.select(*group, F.col("top.signature").alias("baseline")), group
    ).where("signature <> baseline")
    offsets = moved.select(
        "image_id", "ord", *group, F.size("layout").alias("boxes"),
        F.transform("layout", lambda b, i: b["x"] - F.get("baseline", i * 2)).alias("dxs"),
        F.transform("layout", lambda b, i: b["y"] - F.get("baseline", i * 2 + 1)).alias("dys"),
    )

    def middle(values: str) -> Column:
        ordered, n = F.array_sort(values), F.size(values)
        upper, lower = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
        return (F.get(ordered, lower) + F.get(ordered, upper)) / 2

    near = offsets.select("*", middle("dxs").alias("dx"), middle("dys").alias("dy"))
    steady = near.where(
        (F.greatest(F.abs("dx"), F.abs("dy")) >= threshold)
        & F.forall("dxs", lambda v: F.abs(v - F.col("dx")) <= tolerance)
        & F.forall("dys", lambda v: F.abs(v - F.col("dy")) <= tolerance)
    ).select(
        "image_id", "ord", *group, "boxes", "dx", "dy",
        F.bround(F.col("dx") / tolerance, 0).cast("bigint").alias("bx"),
        F.bround(F.col("dy") / tolerance, 0).cast("bigint").alias("by"),
    )
    bucket = [*group, "bx", "by"]
    enough = steady.groupBy(*bucket).agg(F.sum("boxes").alias("box_count")).where(F.col("box_count") >= min_boxes)
    return steady.join(enough, bucket).select("image_id", "ord", "dx", "dy", "box_count")


def box_shift_findings(hits: DataFrame) -> DataFrame:
    return as_findings(
        hits,
        asset_id=F.col("image_id"),
        finding_type="systematic_box_shift",
        severity=0.65,
        confidence=0.6,
        modality="ANNOTATION",
        detector_id="annotation_integrity",
        evidence=[F.format_string("Offset (%.4f, %.4f) against the majority layout over %d boxes.",
                                  F.col("dx"), F.col("dy"), F.col("box_count"))],
        counter_evidence=["Camera motion or a real translation can explain the offset."],
        config=config_hash(detector="systematic_box_shift"),
        ord=F.col("ord"),
    )


def annotation_findings(images: DataFrame) -> DataFrame:
    boxes = explode_boxes(images)
    return (
        box_findings(boxes)
        .unionByName(unlabeled_region_findings(large_unlabeled_region(images)))
        .unionByName(box_shift_findings(systematic_box_shift(images)))
    )
