"""Per-class outlier detectors over feature vectors and activations."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import vectors as V
from attest.functions.scale import order_statistics
from attest.operators.metric_join import matrix_of
from attest.operators.moments import MODEL_BYTES, Model, class_models, score_rows
from attest.schemas import as_findings, config_hash
from attest.session import settle


def leave_one_out_distance(regularization: float, min_rows: int):
    """Mahalanobis distance of each row to its class without that row.

    Removing a row is a rank-one change of the class scatter, so one shared
    eigen-decomposition answers every row of the class.
    """
    def score(rows: np.ndarray, model: Model) -> np.ndarray:
        n, d = model.n, rows.shape[1]
        if n - 1 < min_rows - 1 or n < 3:
            return np.full(len(rows), np.nan)
        peers = n - 1
        lift = n / peers
        u = (rows - model.mean) @ model.basis
        trace = (model.eigenvalues.sum() - lift * (u * u).sum(1)) / (peers - 1)
        ridge = regularization * np.maximum(trace / d, 1.0)
        inverse = 1.0 / (model.eigenvalues[None, :] / (peers - 1) + ridge[:, None])
        q = (u * u * inverse).sum(1)
        left = 1.0 - q * lift / (peers - 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            square = lift * lift * q / left
        # The update cancels when a row carries nearly all of its direction's
        # variance: solve those few rows from the reduced scatter directly.
        for i in np.flatnonzero(left < 1e-6):
            reduced = np.diag(model.eigenvalues) - lift * np.outer(u[i], u[i])
            cov = reduced / (peers - 1) + np.eye(d) * ridge[i]
            delta = lift * u[i]
            square[i] = delta @ np.linalg.solve(cov, delta)
        return np.sqrt(np.maximum(square, 0.0))

    return score


def mahalanobis_distances(rows: DataFrame, ord: str, label: str, vec: str,
                          regularization: float = 1e-6, min_rows: int = 3) -> DataFrame:
    models = class_models(rows, label, vec)
    return score_rows(rows, models, ord, label, vec, leave_one_out_distance(regularization, min_rows)) \
        .withColumnRenamed("score", "distance")


def ood_mahalanobis(rows: DataFrame, ident: str, ord: str, label: str, vec: str,
                    threshold: float = 5.0, regularization: float = 1e-6, min_rows: int = 3) -> DataFrame:
    scored = mahalanobis_distances(rows, ord, label, vec, regularization, min_rows)
    far = scored.where(F.col("distance") > threshold).select(F.col("ord").alias("_o"), "distance")
    hit = rows.join(far, rows[ord] == far["_o"])
    return as_findings(
        hit,
        asset_id=F.col(ident),
        finding_type="out_of_distribution",
        severity=0.7,
        confidence=F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.45) * (1 - F.lit(threshold) / F.col("distance"))),
        modality="EMBEDDING",
        detector_id="ood",
        evidence=[F.format_string("Leave-one-out distance to class %s is %.6f; limit %.2f.",
                                  F.col(label).cast("string"), F.col("distance"), F.lit(threshold))],
        counter_evidence=["Rare legitimate rows and singular classes can be far as well; not calibrated."],
        config=config_hash(threshold=threshold, regularization=regularization, min_rows=min_rows),
        ord=F.col(ord),
    )


def _projection(min_rows: int):
    def score(rows: np.ndarray, model: Model) -> np.ndarray:
        top = model.eigenvalues[-1] / max(model.n - 1, 1)
        if model.n < min_rows or top <= np.finfo(float).eps:
            return np.full(len(rows), np.nan)
        return (rows - model.mean) @ model.basis[:, -1]

    return score


def spectral_deviations(rows: DataFrame, ord: str, label: str, vec: str, min_rows: int = 4) -> DataFrame:
    """``(ord, label, deviation, scaled)`` along the top direction of each class.

    ``scaled`` is the deviation over the median-based scale; both medians are exact.
    """
    models = class_models(rows, label, vec)
    # The projection feeds two medians: keep the narrow (ord, label, score) rows.
    projected = settle(score_rows(rows, models, ord, label, vec, _projection(min_rows)))
    centre = order_statistics(projected, ["label"], "score", {"middle": 0.5})
    extent = projected.groupBy("label").agg(F.max(F.abs("score")).alias("extent"))
    deviated = projected.join(centre.join(extent, "label"), "label").withColumn(
        "deviation", F.abs(F.col("score") - F.col("middle"))
    )
    spread = order_statistics(deviated, ["label"], "deviation", {"mad": 0.5}).select("label", "mad")
    scale = F.greatest(
        F.lit(1.4826) * F.col("mad"), F.lit(1e-12) * F.greatest(F.lit(1.0), F.col("extent"))
    )
    return deviated.join(spread, "label").select(
        "ord", "label", "deviation", (F.col("deviation") / scale).alias("scaled")
    )


def spectral_signature(rows: DataFrame, ident: str, ord: str, label: str, vec: str,
                       mad_threshold: float = 5.0, min_rows: int = 4) -> DataFrame:
    far = spectral_deviations(rows, ord, label, vec, min_rows).where(F.col("scaled") > mad_threshold)
    return _activation_findings(
        rows, ident, ord, far.select(F.col("ord").alias("_o"), "scaled"), "spectral_signature",
        F.format_string("Deviation along the top class direction is %.6f scaled medians.", F.col("scaled")),
        config_hash(mad_threshold=mad_threshold, min_rows=min_rows),
    )


def _activation_findings(rows, ident, ord, hits, detector, evidence, config) -> DataFrame:
    return as_findings(
        rows.join(hits, rows[ord] == hits["_o"]),
        asset_id=F.col(ident),
        finding_type=detector,
        severity=0.7,
        confidence=0.6,
        modality="ACTIVATION",
        detector_id=detector,
        evidence=[evidence, "A candidate for poisoning, not proof."],
        counter_evidence=["Natural subclasses and rare variants can stand apart in the same way."],
        config=config,
        access="gray_box",
        ord=F.col(ord),
    )


def two_means(rows: DataFrame, ord: str, label: str, vec: str, min_rows: int = 4,
              max_rounds: int = 100) -> DataFrame:
    """Deterministic two-means in every class at once.

    Returns ``(ord, label, vec, cluster, own, other)`` where ``own`` and ``other`` are
    the final centres of the row's cluster and of the opposite one. Classes in
    which a cluster runs empty are left out.
    """
    data = rows.select(
        F.col(ord).cast("bigint").alias("ord"),
        F.col(label).cast("string").alias("label"),
        F.col(vec).cast("array<double>").alias("vec"),
    )
    sizes = data.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    # Read once per round: written to the shared folder, which outlives a lost executor.
    data = settle(data.join(sizes.select("label"), "label"))
    dims = data.select(F.size("vec")).first()
    if dims is None:
        empty = data.select("ord", "label", "vec", F.lit(0).alias("cluster"),
                            F.col("vec").alias("own"), F.col("vec").alias("other"))
        return empty
    width = dims[0]
    small = data.select("label").distinct().count() * width * 4 * 8 <= MODEL_BYTES

    def square(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)

    centres = _iterate_small(data, width, max_rounds) if small else _first_centres(data, square)

    def nearest(a: str, b: str):
        return F.when(square(F.col("vec"), F.col(b)) < square(F.col("vec"), F.col(a)), 1).otherwise(0)

    for _ in range(0 if small else max_rounds):
        active = centres.where("valid and not done")
        assigned = data.join(active, "label").select(
            "label", "vec", nearest("c0", "c1").alias("now"),
            F.when(F.col("p0").isNull(), 0).otherwise(nearest("p0", "p1")).alias("before"),
        )
        sums = assigned.groupBy("label", "now").agg(
            F.array(*[F.avg(F.col("vec")[i]) for i in range(width)]).alias("centre"),
            F.sum((F.col("now") != F.col("before")).cast("int")).alias("moved"),
        )
        step = sums.groupBy("label").agg(
            F.max(F.when(F.col("now") == 0, F.col("centre"))).alias("n0"),
            F.max(F.when(F.col("now") == 1, F.col("centre"))).alias("n1"),
            F.sum("moved").alias("moved"),
        )
        both = F.col("n0").isNotNull() & F.col("n1").isNotNull()
        updated = active.join(step, "label").select(
            "label", F.col("c0").alias("p0"), F.col("c1").alias("p1"),
            F.when(both, F.col("n0")).otherwise(F.col("c0")).alias("c0"),
            F.when(both, F.col("n1")).otherwise(F.col("c1")).alias("c1"),
            (F.col("moved") == 0).alias("done"), both.alias("valid"),
        )
        centres = settle(centres.where("not valid or done").unionByName(updated))
        if centres.where("valid and not done").limit(1).count() == 0:
            break
    settled = data.join(centres.where("valid"), "label").withColumn("cluster", nearest("p0", "p1"))
    pick = lambda a, b: F.when(F.col("cluster") == 0, F.col(a)).otherwise(F.col(b))
    return settled.select("ord", "label", "vec", "cluster", pick("c0", "c1").alias("own"), pick("c1", "c0").alias("other"))


_CENTRES = "label string, p0 array<double>, p1 array<double>, c0 array<double>, c1 array<double>, done boolean, valid boolean"


def _first_centres(data: DataFrame, square) -> DataFrame:
    """The row farthest from the median of its class and the one farthest from that, as a table of any length."""
    flat = data.select("label", F.posexplode("vec").alias("pos", "value"))
    middle = order_statistics(flat, ["label", "pos"], "value", {"middle": 0.5}).groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "middle"))), lambda s: s["middle"]).alias("middle")
    )

    def farthest(source: DataFrame, anchor: str, name: str) -> DataFrame:
        # Ties go to the earliest row, as an argmax over input order does.
        ranked = F.struct(square(F.col("vec"), F.col(anchor)).alias("far"), (-F.col("ord")).alias("back"))
        return source.groupBy("label").agg(F.max_by("vec", ranked).alias(name))

    first = settle(farthest(data.join(middle, "label"), "middle", "c0"))
    second = farthest(data.join(first, "label"), "c0", "c1")
    # p0/p1: the centres behind the previous assignment (null before the first round).
    none = F.lit(None).cast("array<double>")
    return settle(first.join(second, "label").select(
        "label", none.alias("p0"), none.alias("p1"), "c0", "c1", F.lit(False).alias("done"), F.lit(True).alias("valid")
    ))


def _blocks(data: DataFrame) -> DataFrame:
    """(label, ord, vec): rows of one class as bytes, written once and read in every pass."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix_of(batch.column("vec"))
            ords = batch.column("ord").to_numpy(zero_copy_only=False).astype(np.int64)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(str)
            for name in np.unique(labels):
                own = labels == name
                yield pa.RecordBatch.from_pydict({"label": [str(name)], "ord": [ords[own].tobytes()], "vec": [values[own].tobytes()]})

    tasks = data.sparkSession.sparkContext.defaultParallelism
    return settle(data.select("label", "ord", "vec").mapInArrow(pack, "label string, ord binary, vec binary").repartition(tasks))


def _each_block(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    for batch in batches:
        for name, ord, vec in zip(*[batch.column(c) for c in ("label", "ord", "vec")], strict=True):
            yield name.as_py(), np.frombuffer(ord.as_buffer(), np.int64), np.frombuffer(vec.as_buffer(), np.float64).reshape(-1, width)


# Bits of a value that are settled in each pass of ``_medians``: sign and exponent, then the fraction.
_DIGITS = (12, 13, 13, 13, 13)
_TOP = np.uint64(1 << 63)


def _ordered(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the values, NaN last."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.uint64)
    return np.where(bits & _TOP, ~bits, bits | _TOP)


def _medians(blocks: DataFrame, sizes: dict[str, int], width: int) -> dict[str, np.ndarray]:
    """Exact medians of every coordinate of each class, by digits from the top.

    A pass counts the next digit of the values that share the digits found so far: no value
    is a row, and what a task returns is a count of each digit it saw.
    """
    ranks = {k: np.array([[(n - 1) // 2] * width, [n // 2] * width], np.int64) for k, n in sizes.items()}
    found = {k: np.zeros((2, width), np.uint64) for k in sizes}
    spark, left = blocks.sparkSession, 64
    for digits in _DIGITS:
        before, left = left, left - digits

        def scan(batches: Iterator[pa.RecordBatch], before=before, left=left, digits=digits, found=found) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[str, int], list] = {}
            size = 0

            def out() -> Iterator[pa.RecordBatch]:
                for (name, side), parts in held.items():
                    code, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    n = np.bincount(at, np.concatenate([p[1] for p in parts]), len(code)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(code), pa.string()), pa.array(np.full(len(code), side, np.int32)),
                         pa.array((code >> digits).astype(np.int32)), pa.array((code & ((1 << digits) - 1)).astype(np.int32)), pa.array(n)],
                        names=["label", "side", "pos", "digit", "n"])

            for name, _, values in _each_block(batches, width):
                keys = _ordered(values)
                digit = ((keys >> np.uint64(left)) & np.uint64((1 << digits) - 1)).astype(np.int64)
                code = np.arange(width) << digits | digit
                for side in (0, 1):
                    able = np.ones(keys.shape, bool) if before == 64 else keys >> np.uint64(before) == found[name][side]
                    part = np.unique(code[able], return_counts=True)
                    held.setdefault((name, side), []).append(part)
                    size += len(part[0])
                if size > 1 << 20:
                    yield from out()
                    held, size = {}, 0
            yield from out()

        keys = ["label", "side", "pos"]
        counts = blocks.mapInArrow(scan, "label string, side int, pos int, digit int, n bigint").groupBy(*keys, "digit").agg(F.sum("n").alias("n"))
        asked = spark.createDataFrame(
            [(k, s, p, int(r[s, p])) for k, r in ranks.items() for s in (0, 1) for p in range(width)], "label string, side int, pos int, rank bigint")
        # At most 2^13 digits of a coordinate.
        running = Window.partitionBy(*keys).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        placed = counts.withColumn("_hi", F.sum("n").over(running)).join(asked, keys)
        for r in placed.where((F.col("rank") < F.col("_hi")) & (F.col("rank") >= F.col("_hi") - F.col("n"))).collect():  # two for each coordinate
            found[r["label"]][r["side"], r["pos"]] = found[r["label"]][r["side"], r["pos"]] << np.uint64(digits) | np.uint64(r["digit"])
            ranks[r["label"]][r["side"], r["pos"]] = r["rank"] - (r["_hi"] - r["n"])
    out = {}
    for k, key in found.items():
        low, high = np.where(key & _TOP, key ^ _TOP, ~key).view(np.float64)
        out[k] = low if sizes[k] % 2 else low + (high - low) * 0.5
    return out


def _farthest(blocks: DataFrame, anchors: dict[str, np.ndarray], width: int) -> dict[str, np.ndarray]:
    """Of each class the row farthest from its anchor; ties go to the earliest row, as an argmax over input order does."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, tuple] = {}
        for name, ord, values in _each_block(batches, width):
            far = np.zeros(len(values))
            for j in range(width):
                far += (values[:, j] - anchors[name][j]) ** 2
            far = np.where(np.isnan(far), np.inf, far)
            at = np.flatnonzero(far == far.max())
            at = at[ord[at].argmin()]
            if name not in best or (far[at], -ord[at]) > best[name][:2]:
                best[name] = (far[at], -ord[at], values[at])
        if best:
            yield pa.RecordBatch.from_pydict({
                "label": list(best), "far": [float(v[0]) for v in best.values()], "back": [int(v[1]) for v in best.values()],
                "vec": [v[2].tolist() for v in best.values()]})

    tops = blocks.mapInArrow(scan, "label string, far double, back bigint, vec array<double>")
    rows = tops.groupBy("label").agg(F.max_by("vec", F.struct("far", "back")).alias("vec")).collect()  # one for each class
    return {r["label"]: np.array(r["vec"]) for r in rows}


def _iterate_small(data: DataFrame, width: int, max_rounds: int) -> DataFrame:
    """First centres and rounds of ``two_means`` with the centres (a bounded table) sent along with the tasks.

    One pass over the rows per round; each task returns two sums per class.
    """
    blocks = _blocks(data)
    sizes = {r["label"]: r["count"] for r in data.groupBy("label").count().collect()}  # one for each class
    first = _farthest(blocks, _medians(blocks, sizes, width), width)
    second = _farthest(blocks, first, width)
    state = {k: {"before": None, "now": np.array([first[k], second[k]]), "done": False, "valid": True} for k in first}

    def one_pass(active: dict) -> DataFrame:
        def nearest(rows, pair):
            gap = [((rows - centre) ** 2).sum(1) for centre in pair]
            return (gap[1] < gap[0]).astype(int)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[tuple[str, int], list] = {}
            for name, _, rows in _each_block(batches, width):
                if name not in active:
                    continue
                before, now = active[name]
                new = nearest(rows, now)
                old = np.zeros(len(rows), int) if before is None else nearest(rows, before)
                for side in (0, 1):
                    part = new == side
                    held = sums.setdefault((name, side), [0, 0, np.zeros(width)])
                    held[0] += int(part.sum())
                    held[1] += int((part & (old != side)).sum())
                    held[2] += rows[part].sum(0)
            if sums:
                yield pa.RecordBatch.from_pydict({
                    "label": [k[0] for k in sums], "side": pa.array([k[1] for k in sums], pa.int32()),
                    "n": [v[0] for v in sums.values()], "moved": [v[1] for v in sums.values()],
                    "total": [v[2].tolist() for v in sums.values()],
                })

        partial = blocks.mapInArrow(
            scan, "label string, side int, n bigint, moved bigint, total array<double>")
        return partial.groupBy("label", "side").agg(
            F.sum("n").alias("n"), F.sum("moved").alias("moved"),
            F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"),
        )

    for _ in range(max_rounds):
        active = {k: (v["before"], v["now"]) for k, v in state.items() if v["valid"] and not v["done"]}
        if not active:
            break
        found: dict[str, dict] = {}
        for r in one_pass(active).collect():  # two rows per class
            found.setdefault(r["label"], {})[r["side"]] = r
        for name, sides in found.items():
            item = state[name]
            item["before"] = item["now"]
            if min(sides[0]["n"], sides[1]["n"]) == 0:
                item["valid"] = False
                continue
            item["now"] = np.array([np.asarray(sides[i]["total"]) / sides[i]["n"] for i in (0, 1)])
            item["done"] = sides[0]["moved"] + sides[1]["moved"] == 0
    listed = [
        (k, v["before"][0].tolist(), v["before"][1].tolist(), v["now"][0].tolist(), v["now"][1].tolist(), v["done"], v["valid"])
        for k, v in state.items() if v["before"] is not None
    ]
    return data.sparkSession.createDataFrame(listed, _CENTRES)


def minority_clusters(clusters: DataFrame, max_fraction: float = 0.25, separation: float = 0.7) -> DataFrame:
    """Rows of small, well separated clusters: ``(ord, label, fraction, separation)``."""
    within, between = V.l2_delta(F.col("vec"), F.col("own")), V.l2_delta(F.col("vec"), F.col("other"))
    scored = clusters.select("ord", "label", "cluster", within.alias("w"), between.alias("b")).withColumn(
        "score", (F.col("b") - F.col("w")) / F.greatest(F.greatest("w", "b"), F.lit(1e-12))
    )
    by_cluster = scored.groupBy("label", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("total")
    )
    per_class = by_cluster.groupBy("label").agg(
        F.min(F.struct("n", "cluster", "total")).alias("small"),
        F.sum("n").alias("rows"), F.sum("total").alias("all"),
    ).select(
        "label", F.col("small.cluster").alias("cluster"),
        (F.col("small.n") / F.col("rows")).alias("fraction"),
        F.least(F.col("all") / F.col("rows"), F.col("small.total") / F.col("small.n")).alias("separation"),
    )
    chosen = per_class.where((F.col("fraction") <= max_fraction) & (F.col("separation") >= separation))
    return scored.join(chosen, ["label", "cluster"]).select("ord", "label", "fraction", "separation")


def activation_clustering(rows: DataFrame, ident: str, ord: str, label: str, vec: str,
                          max_fraction: float = 0.25, separation: float = 0.7, min_rows: int = 4) -> DataFrame:
    small = minority_clusters(two_means(rows, ord, label, vec, min_rows), max_fraction, separation)
    return _activation_findings(
        rows, ident, ord, small.select(F.col("ord").alias("_o"), "fraction", "separation"), "activation_clustering",
        F.format_string("Secondary cluster holds %.6f of its class; separation %.6f.",
                        F.col("fraction"), F.col("separation")),
        config_hash(max_fraction=max_fraction, separation=separation, min_rows=min_rows),
    )
