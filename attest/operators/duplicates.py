"""Near-duplicate joins: Hamming distance over fingerprints, cosine over vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions import vectors as V
from attest.functions.scale import salted_join
from attest.operators import metric_join as M
from attest.operators.components import connected_components
from attest.schemas import as_findings, config_hash
from attest.session import settle

BITS = 63
# Rows of one bucket that are compared in one unit of work; larger buckets are compared in pairs of such blocks.
HOT_BUCKET = 8_192
# Fingerprints of a bucket on average, before keys are made of one band more.
BUCKET_ROWS = 4_096
# Copies of a fingerprint that travel together.
LOT_ROWS = 64
# Postings of a task; rows gathered before they are compared; pairs that leave together.
_TASK_ROWS, _GATHER, _PAIRS = 50_000, 1 << 15, 1 << 16


def _bands(total: int, parts: int) -> list[tuple[int, int]]:
    """(offset, width) of ``parts`` contiguous bands covering ``total`` bits."""
    cuts = [round(i * total / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _masks(parts: int) -> np.ndarray:
    return np.array([((1 << w) - 1) << o for o, w in _bands(BITS, parts)], np.uint64)


def _near_rows(points: DataFrame, threshold: int, bands: int, hot_bucket: int, payload, schema: str, total: int) -> DataFrame:
    """``payload`` over all pairs of rows of ``points`` with fingerprints in ``fp`` that differ in at most ``threshold`` bits.

    Pigeonhole: of m bands two such fingerprints share at least m - t. Every set of m - t
    bands is a key, and rows with equal bits there are compared inside a task; a pair is
    given by its first shared bands only, so none comes twice and candidates never leave a task.
    Rows with equal numbers in ``kin``, where ``points`` have it, are one group and no pairs.
    ``payload(batch, i, j, distance)`` makes the output of the pairs (i, j) of row places.
    """
    bands = min(max(bands, threshold + 1), BITS)
    shared = bands - threshold
    masks = _masks(bands)
    sets = list(combinations(range(bands), shared))
    codes = np.array([sum(1 << c for c in s) for s in sets], np.int64)
    fields = points.columns
    keyed = points.select(*fields, F.inline(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(int(sum(int(masks[c]) for c in s)))).alias("key"))
        for i, s in enumerate(sets)])))
    hot = (keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket)
           .select("part", "key", F.ceil(F.col("n") / hot_bucket).cast("int").alias("blocks")))
    block = F.pmod(F.xxhash64("fp", *[F.col(c) for c in fields if c in ("kin", "lot")]), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = keyed.join(hot, ["part", "key"], "left").withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).select(
        "part", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", *fields)
    order = ["part", "key", "lo", "hi", "block"]

    def first_shared(differ: np.ndarray) -> np.ndarray:
        """The first bands on which pairs agree, as bits."""
        code, taken = np.zeros(len(differ), np.int64), np.zeros(len(differ), np.int64)
        for c, mask in enumerate(masks):
            agree = ((differ & mask) == 0) & (taken < shared)
            code |= agree.astype(np.int64) << c
            taken += agree
        return code

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def candidates(fp: np.ndarray, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            n = len(fp)
            change = (keys[1:, :4] != keys[:-1, :4]).any(1)
            first = np.flatnonzero(np.append(True, change))
            sizes = np.diff(np.append(first, n))
            remaining = np.repeat(first + sizes, sizes) - np.arange(n)
            inside = keys[:, 2] == keys[:, 3]
            at = np.flatnonzero(inside & (remaining > 1))
            step = 1
            while len(at):
                close = at[np.bitwise_count(fp[at] ^ fp[at + step]) <= threshold]
                if len(close):
                    yield close, close + step
                step += 1
                at = at[remaining[at] > step]
            for start, size in zip(first[~inside[first]], sizes[~inside[first]]):
                middle = start + int((keys[start:start + size, 4] == keys[start, 2]).sum())
                right = fp[middle:start + size]
                for i in range(start, middle):
                    close = np.flatnonzero(np.bitwise_count(fp[i] ^ right) <= threshold)
                    if len(close):
                        yield np.full(len(close), i), middle + close

        def compared(rows: pa.RecordBatch, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = rows.column("fp").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            kin = rows.column("kin").to_numpy(zero_copy_only=False) if "kin" in fields else np.arange(len(fp))
            held, size = [], 0

            def out() -> Iterator[pa.RecordBatch]:
                i, j = (np.concatenate(x) for x in zip(*held))
                differ = fp[i] ^ fp[j]
                own = (kin[i] != kin[j]) & (first_shared(differ) == codes[keys[i, 0]])
                i, j, differ = i[own], j[own], differ[own]
                for a in range(0, len(i), _PAIRS):
                    b = slice(a, a + _PAIRS)
                    yield payload(rows, i[b], j[b], np.bitwise_count(differ[b]).astype(np.int32))

            for pair in candidates(fp, keys):
                held.append(pair)
                size += len(pair[0])
                if size >= _PAIRS:
                    yield from out()
                    held, size = [], 0
            if held:
                yield from out()

        def ended(held: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch | None]:
            """Outputs of all whole groups; then what is left of the last one."""
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in order], axis=1)
            differs = np.flatnonzero((keys[:, :4] != keys[-1, :4]).any(1))
            cut = len(keys) if last else int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield from compared(rows.slice(0, cut), keys[:cut])
            yield rows.slice(cut) if cut < len(keys) else None

        held, size, enough = [], 0, _GATHER
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= enough:
                *done, rest = ended(held, False)
                yield from done
                held = [rest]
                size = rest.num_rows
                enough = size + _GATHER
        if held:
            *done, _ = ended(held, True)
            yield from done

    # Little data but much work: as many tasks as the postings ask for, which Spark's size checks would put together.
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, total * len(sets) // _TASK_ROWS)
    return dealt.repartition(tasks, *order[:4]).sortWithinPartitions(*order).mapInArrow(run, schema)


def fingerprint_pairs(
    fingerprints: DataFrame, fp: str, threshold: int, bands: int, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """Pairs of distinct fingerprints within ``threshold`` bits: ``(a, b, distance)``, a < b.

    ``bands`` are at least ``threshold + 1``; more of them give longer keys and smaller buckets.
    """
    if not 0 <= threshold <= BITS:
        raise ValueError("threshold must be in [0, 63]")
    distinct = settle(fingerprints.select(F.col(fp).cast("bigint").alias("fp")).where("fp is not null").distinct())

    def payload(rows: pa.RecordBatch, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        fps = rows.column("fp").to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(fps[i], fps[j])), pa.array(np.maximum(fps[i], fps[j])), pa.array(distance)],
                                          names=["a", "b", "distance"])

    return _near_rows(distinct, threshold, bands, hot_bucket, payload, "a bigint, b bigint, distance int", distinct.count())


def choose_bands(distinct: int, threshold: int) -> int:
    """The fewest bands whose keys leave BUCKET_ROWS fingerprints to a bucket, if bits were even; three bands in a key at most."""
    bands = threshold + 1
    while bands < threshold + 3 and distinct > BUCKET_ROWS * 2 ** (BITS * (bands - threshold) // bands):
        bands += 1
    return min(bands, BITS)


def hamming_near_duplicates(
    rows: DataFrame, ident: str, ord: str, fp: str, threshold: int = 6, bands: int | None = None, content: str | None = None
) -> DataFrame:
    """Each later row with every earlier-starting group of copies near its own.

    Output ``(asset_id, ord, match_id, distance, match_rows, confidence)``. Copies are
    rows of equal ``content``; different contents with one fingerprint are pairs at
    distance 0 like any other. Without ``content`` equal fingerprints make copies. Copies
    are reported against the first of them (``match_rows`` tells how many there are), so
    a group costs one row per copy, not one per pair. Without copies this is exactly one
    row per pair, reported on the later row.

    Copies travel in lots, with what is reported of their group, so the
    pairs found in a task are results already: nothing is joined or sorted after.
    """
    if not 0 <= threshold <= BITS:
        raise ValueError("threshold must be in [0, 63]")
    # Fingerprints are narrow but dear to compute, and they are read several times.
    same = ["fp"] if content is None else ["fp", "content"]
    more = [] if content is None else [F.coalesce(F.col(content), F.lit("")).alias("content")]
    rows = settle(rows.select(F.col(ident).alias("asset_id"), F.col(ord).alias("ord"), F.col(fp).cast("bigint").alias("fp"), *more).where("fp is not null"))
    groups = settle(rows.groupBy(*same).agg(
        F.min("ord").alias("first_ord"),
        F.min_by("asset_id", "ord").alias("match_id"),
        F.count(F.lit(1)).alias("match_rows"),
    ).withColumn("kin", F.monotonically_increasing_id()))
    # Lot zero has the first row and stands for its group.
    lot = F.when(F.col("ord") == F.col("first_ord"), 0).otherwise(
        1 + F.pmod(F.xxhash64("ord"), F.ceil(F.col("match_rows") / LOT_ROWS)).cast("int"))
    lots = settle(salted_join(rows.where("ord is not null"), groups, same).withColumn("lot", lot)
                  .groupBy("fp", "kin", "lot").agg(
                      F.any_value("first_ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.any_value("match_id").alias("match_id"),
                      F.any_value("match_rows").alias("match_rows"), F.collect_list(F.struct("asset_id", "ord")).alias("rows")))
    total = lots.count()
    if bands is None:
        bands = choose_bands(total, threshold)

    def payload(batch: pa.RecordBatch, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
        late, match = np.concatenate([i, j]), np.concatenate([j, i])
        distance = np.concatenate([distance, distance])
        column = lambda name, at: batch.column(name).take(pa.array(at))
        able = (batch.column("lot").to_numpy(zero_copy_only=False)[match] == 0)
        able &= pc.greater(column("last_ord", late), column("first_ord", match)).to_numpy(zero_copy_only=False)
        late, match, distance = late[able], match[able], distance[able]
        listed = column("rows", late)
        parent = pc.list_parent_indices(listed).to_numpy(zero_copy_only=False)
        each, match = pc.list_flatten(listed), match[parent]
        ord_, first = pc.struct_field(each, "ord"), column("first_ord", match)
        found = pa.RecordBatch.from_arrays(
            [pc.struct_field(each, "asset_id"), ord_, column("match_id", match), pa.array(distance[parent]), column("match_rows", match)],
            names=["asset_id", "ord", "match_id", "distance", "match_rows"])
        return found.filter(pc.greater(ord_, first))

    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    near = _near_rows(lots, threshold, bands, HOT_BUCKET, payload,
                      f"asset_id {kind['asset_id']}, ord {kind['ord']}, match_id {kind['asset_id']}, distance int, match_rows bigint", total)
    copies = lots.where("match_rows > 1").select("first_ord", "match_id", "match_rows", F.inline("rows")).where("ord > first_ord").select(
        "asset_id", "ord", "match_id", F.lit(0).alias("distance"), "match_rows")
    return near.unionByName(copies).withColumn(
        "confidence", F.lit(0.9) - F.lit(0.2) * F.col("distance") / F.lit(float(BITS)))


def perceptual_duplicate_findings(matches: DataFrame, threshold: int = 6) -> DataFrame:
    return as_findings(
        matches,
        asset_id=F.col("asset_id"),
        finding_type="perceptual_duplicate",
        severity=0.5,
        confidence=F.col("confidence"),
        modality="PIXEL",
        detector_id="duplicates",
        evidence=[F.format_string("Fingerprint distance to %s is %d of 63 bits (limit %d).",
                                  F.col("match_id").cast("string"), F.col("distance"), F.lit(threshold))],
        counter_evidence=["Plain content can share a fingerprint; repeated views are not proof of flooding."],
        config=config_hash(hamming_threshold=threshold),
        ord=F.col("ord"),
    )


def _forest_kernel(similarity: float, ident: str, vec: str):
    """Star edges (member, smallest id) of the match graph inside one pair of blocks.

    A dense patch of matches yields at most one edge per row, not one per pair.
    """
    def kernel(probe: pa.StructArray, base: pa.StructArray) -> pa.RecordBatch:
        left_id = probe.field(ident).to_numpy(zero_copy_only=False)
        right_id = base.field(ident).to_numpy(zero_copy_only=False)
        left, right = M.matrix_of(probe.field(vec)), M.matrix_of(base.field(vec))
        hit = left @ right.T >= similarity
        rows, cols = left_id.astype(np.int64).copy(), right_id.astype(np.int64).copy()
        big = np.iinfo(np.int64).max
        while True:
            new_rows = np.minimum(rows, np.where(hit, cols[None, :], big).min(1, initial=big))
            new_cols = np.minimum(cols, np.where(hit, new_rows[:, None], big).min(0, initial=big))
            if (new_rows == rows).all() and (new_cols == cols).all():
                break
            rows, cols = new_rows, new_cols
        u = np.concatenate([left_id, right_id])
        v = np.concatenate([rows, cols])
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=["u", "v"])

    return kernel


def cosine_clusters(rows: DataFrame, ord: str, vec: str, similarity: float = 0.995) -> DataFrame:
    """Single-link clusters of cosine >= ``similarity``: ``(ord, root, size)``, size >= 2.

    Unit vectors with cosine >= s lie within sqrt(2 - 2s) of each other, which
    turns the search into an exact range join. Equal directions are collapsed
    first; two zero vectors count as equal, a zero and a non-zero one do not match.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity must be in (0, 1]")
    length = V.norm(F.col(vec))
    unit = F.when(length == 0, F.col(vec)).otherwise(F.transform(F.col(vec), lambda x: x / length))
    prepared = rows.select(F.col(ord).alias("ord"), unit.alias("unit"), (length == 0).alias("zero"))
    groups = settle(prepared.groupBy("unit").agg(
        F.min("ord").alias("vid"), F.count(F.lit(1)).alias("copies"), F.first("zero").alias("zero")
    ))
    points = groups.where(~F.col("zero")).select("vid", "unit")
    total = points.count()
    copies = (
        salted_join(prepared.select("unit", "ord"), groups.where("copies > 1").select("unit", "vid"), ["unit"])
        .select(F.col("ord").alias("u"), F.col("vid").alias("v")).where("u <> v")
    )
    edges = copies
    if total > 1:
        tree, stored = M.build_tree(points, "vid", "unit", [])
        reach = math.sqrt(max(0.0, 2.0 - 2.0 * similarity)) + 1e-9
        probes = M.target_cells(stored.withColumn("reach", F.lit(reach)), tree, include_home=True, only_lower=True)
        schema = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])
        near = M.join_blocks(
            probes, stored.select("vid", "vec", "cell"), "vid", "vec", [],
            _forest_kernel(similarity - 1e-12, "vid", "vec"), schema,
        )
        edges = copies.union(near)
    members = connected_components(edges)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return members.join(sizes, "root").select(F.col("node").alias("ord"), "root", "size")


def semantic_duplicate_findings(rows: DataFrame, ident: str, ord: str, clusters: DataFrame,
                                similarity: float = 0.995) -> DataFrame:
    """Every cluster member but the first is a finding."""
    late = clusters.where(F.col("ord") != F.col("root")).select(F.col("ord").alias(ord), "root", "size")
    return as_findings(
        rows.select(ident, ord).join(late, ord),
        asset_id=F.col(ident),
        finding_type="semantic_near_duplicate",
        severity=0.4,
        confidence=0.55,
        modality="EMBEDDING",
        detector_id="duplicates",
        evidence=[F.format_string("Single-link cosine cluster of %d rows starting at position %d.",
                                  F.col("size"), F.col("root"))],
        counter_evidence=["Single-link clusters can chain: not every pair of members passes the limit."],
        config=config_hash(similarity_threshold=similarity),
        ord=F.col(ord),
    )
