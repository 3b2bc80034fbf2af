"""Distribution drift between a reference and a current batch."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions import imaging
from attest.functions import vectors as V
from attest.functions.scale import pack_blocks, with_row
from attest.operators.metric_join import BLOCK_ROWS, bound_arrow_batches, matrix_of
from attest.schemas import as_findings, config_hash

BINS = 16
# Blocks a side, so that a row is copied about twice as often at any size; and the rows of a block at most.
SIDE_BLOCKS, MOST_ROWS = 16, 1 << 14


# -- kernel two-sample statistic -------------------------------------------

def tile_rows(rows: int) -> int:
    """Rows of a block for a side of so many: a row's copies do not grow with the rows until blocks reach MOST_ROWS."""
    return min(MOST_ROWS, max(BLOCK_ROWS, -(-rows // SIDE_BLOCKS)))


def kernel_sums(rows: DataFrame, side: str, vec: str, gamma: float, size: int | None = None) -> DataFrame:
    """Exact sums of exp(-gamma d^2) per pair of sides: ``(pair, total)``.

    Equal vectors are collapsed to one weighted row. Rows are packed into bounded
    blocks; a grid of keys (i, j) brings each pair of blocks together once, and only
    one number per pair of blocks leaves the task, which compares BLOCK_ROWS by
    BLOCK_ROWS rows at a time. Blocks grow with the rows (``tile_rows``). Work is quadratic in
    distinct rows by definition; ``mmd_random_features`` is the linear, approximate form.
    """
    bound_arrow_batches(rows.sparkSession)
    weighted = rows.select(F.col(side).cast("string").alias("side"), F.col(vec).cast("array<double>").alias("vec")) \
        .groupBy("side", "vec").agg(F.count(F.lit(1)).alias("weight"))
    keyed = weighted.withColumn("vid", F.xxhash64("vec"))
    if size is None:
        size = tile_rows(max((r["count"] for r in rows.groupBy(F.col(side)).count().collect()), default=0))  # two rows
    blocks = pack_blocks(keyed, ["side"], "vid", ["vec", "weight"], size)
    counts = blocks.groupBy("side").agg(F.max("n_blocks").alias("n"))  # two rows
    wide = counts.agg(
        F.max(F.when(F.col("side") == "reference", F.col("n"))).alias("n_ref"),
        F.max(F.when(F.col("side") == "current", F.col("n"))).alias("n_cur"),
    )
    sized = with_row(blocks, wide)
    span = lambda low, high: F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    zero = F.lit(0)
    same = F.col("n_blocks") - 1
    kind = F.when(F.col("side") == "reference", "rr").otherwise("cc")
    left_keys = F.when(
        F.col("side") == "reference",
        F.concat(
            F.transform(span(F.col("block"), same), lambda j: F.struct(F.lit("rr").alias("pair"), F.col("block").alias("i"), j.alias("j"))),
            F.transform(span(zero, F.col("n_cur") - 1), lambda j: F.struct(F.lit("rc").alias("pair"), F.col("block").alias("i"), j.alias("j"))),
        ),
    ).otherwise(
        F.transform(span(F.col("block"), same), lambda j: F.struct(F.lit("cc").alias("pair"), F.col("block").alias("i"), j.alias("j")))
    )
    own = F.transform(span(zero, F.col("block")), lambda i: F.struct(kind.alias("pair"), i.alias("i"), F.col("block").alias("j")))
    right_keys = F.when(F.col("side") == "reference", own).otherwise(F.concat(
        own,
        F.transform(span(zero, F.col("n_ref") - 1), lambda i: F.struct(F.lit("rc").alias("pair"), i.alias("i"), F.col("block").alias("j"))),
    ))
    left = sized.select(F.col("rows").alias("a"), F.inline(left_keys))
    right = sized.select(F.col("rows").alias("b"), F.inline(right_keys))
    # Copies of blocks are invisible to the size estimate: never broadcast them.
    tiles = left.hint("merge").join(right, ["pair", "i", "j"]).select("pair", "i", "j", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, totals = [], []
            for n in range(batch.num_rows):
                a, b = batch.column("a")[n].values, batch.column("b")[n].values
                x, y = matrix_of(a.field("vec")), matrix_of(b.field("vec"))
                wa = a.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)
                wb = b.field("weight").to_numpy(zero_copy_only=False).astype(np.float64)
                pair = batch.column("pair")[n].as_py()
                same_block = pair != "rc" and batch.column("i")[n].as_py() == batch.column("j")[n].as_py()
                ia, ib = (s.field("vid").to_numpy(zero_copy_only=False) for s in (a, b))
                total = 0.0
                for p in range(0, len(x), BLOCK_ROWS):
                    for q in range(0, len(y), BLOCK_ROWS):
                        u, v = slice(p, p + BLOCK_ROWS), slice(q, q + BLOCK_ROWS)
                        square = np.maximum((x[u] * x[u]).sum(1)[:, None] + (y[v] * y[v]).sum(1)[None, :] - 2 * x[u] @ y[v].T, 0.0)
                        value = np.exp(-gamma * square)
                        if same_block:
                            # A row against itself is not a pair; its copies are.
                            value[(ia[u][:, None] == ib[v][None, :]) & (square < 1e-9)] = 0.0
                        total += wa[u] @ value @ wb[v]
                total = total + (wa * (wa - 1.0)).sum() if same_block else total * (1.0 if pair == "rc" else 2.0)
                pairs.append(pair)
                totals.append(float(total))
            if pairs:
                yield pa.RecordBatch.from_pydict({"pair": pairs, "total": totals})

    return tiles.mapInArrow(run, "pair string, total double").groupBy("pair").agg(F.sum("total").alias("total"))


def mmd_rbf(rows: DataFrame, side: str, vec: str, gamma: float | None = None, size: int | None = None) -> DataFrame:
    """Unbiased squared MMD: one row ``(n, m, gamma, mmd)``; may be negative.

    ``side`` holds 'reference' or 'current'; gamma defaults to 1 / dimension.
    """
    if gamma is None:
        head = rows.select(F.size(vec)).first()
        gamma = 1.0 / head[0]
    if not gamma > 0:
        raise ValueError("gamma must be positive")
    sums = kernel_sums(rows, side, vec, gamma, size).agg(*[
        F.coalesce(F.sum(F.when(F.col("pair") == p, F.col("total"))), F.lit(0.0)).alias(p) for p in ("rr", "cc", "rc")
    ])
    counts = rows.agg(
        F.sum((F.col(side) == "reference").cast("int")).cast("bigint").alias("n"),
        F.sum((F.col(side) == "current").cast("int")).cast("bigint").alias("m"),
    )
    n, m = F.col("n"), F.col("m")
    value = F.col("rr") / (n * (n - 1)) + F.col("cc") / (m * (m - 1)) - 2 * F.col("rc") / (n * m)
    enough = F.when((n >= 2) & (m >= 2), value).otherwise(
        F.raise_error(F.lit("each side needs at least two rows")).cast("double")
    )
    return with_row(sums, counts).select("n", "m", F.lit(gamma).alias("gamma"), enough.alias("mmd"))


def mmd_random_features(rows: DataFrame, side: str, vec: str, gamma: float, features: int = 512,
                        seed: int = 7) -> DataFrame:
    """Approximate MMD^2 from random Fourier features: linear in rows, one scan.

    Labelled approximate: the kernel is replaced by ``features`` cosine pairs drawn
    from a seeded generator, each side is reduced to its mean feature vector.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[int, np.ndarray]] = {}
        basis = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column("vec"))
            if basis is None:
                basis = np.random.default_rng(seed).normal(0.0, np.sqrt(2 * gamma), (x.shape[1], features))
            angle = x @ basis
            z = np.hstack([np.cos(angle), np.sin(angle)]) / np.sqrt(features)
            names = batch.column("side").to_numpy(zero_copy_only=False).astype(str)
            for name in np.unique(names):
                chosen = z[names == name]
                n, total = sums.get(name, (0, np.zeros(2 * features)))
                sums[name] = (n + len(chosen), total + chosen.sum(0))
        for name, (n, total) in sums.items():
            yield pa.RecordBatch.from_pydict({
                "side": [name] * len(total), "pos": pa.array(range(len(total)), pa.int32()), "total": total.tolist(),
                "n": [n if i == 0 else 0 for i in range(len(total))],
            })

    source = rows.select(F.col(side).cast("string").alias("side"), F.col(vec).cast("array<double>").alias("vec"))
    merged = source.mapInArrow(run, "side string, pos int, total double, n bigint").groupBy("pos").agg(
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("total"))), F.lit(0.0)).alias(a)
          for s, a in (("reference", "r"), ("current", "c"))],
        *[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(a)
          for s, a in (("reference", "nr"), ("current", "nc"))],
    ).agg(
        F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("c") * F.col("c")).alias("cc"),
        F.sum(F.col("r") * F.col("c")).alias("rc"), F.sum("nr").alias("n"), F.sum("nc").alias("m"),
    )
    n, m = F.col("n"), F.col("m")
    value = (F.col("rr") - n) / (n * (n - 1)) + (F.col("cc") - m) / (m * (m - 1)) - 2 * F.col("rc") / (n * m)
    return merged.select("n", "m", F.lit(gamma).alias("gamma"), value.alias("approx_mmd"))


# -- histograms -------------------------------------------------------------

def kl_of(p: Column, q: Column, epsilon: float = 1e-10) -> Column:
    """KL divergence of two count arrays, smoothed and floored at zero."""
    def prepare(counts: Column) -> Column:
        top = F.greatest(F.array_max(counts), F.lit(1.0))
        return F.transform(counts, lambda v: v / top + F.lit(epsilon))

    first, second = prepare(p), prepare(q)
    a, b = V.total(first), V.total(second)
    terms = F.zip_with(first, second, lambda x, y: (x / a) * F.log((x / a) / (y / b)))
    return F.greatest(F.lit(0.0), V.total(terms))


def kl_histogram(histograms: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys.., kl)`` from rows ``(keys.., bin, p, q)``; the bins of a key are few."""
    packed = F.array_sort(F.collect_list(F.struct("bin", F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q"))))
    grouped = (histograms.groupBy(*keys) if keys else histograms.groupBy()).agg(packed.alias("h"))
    return grouped.select(
        *keys, kl_of(F.transform("h", lambda b: b["p"]), F.transform("h", lambda b: b["q"])).alias("kl")
    )


def marginal_kl(rows: DataFrame, side: str, vec: str, bins: int = BINS) -> DataFrame:
    """``(pos, kl)`` per dimension over equal bins between the joint minimum and maximum."""
    flat = rows.select(F.col(side).alias("side"), F.posexplode(F.col(vec).cast("array<double>")).alias("pos", "value"))
    limits = flat.groupBy("pos").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # One row per dimension: a fixed-width feature vector, broadcast-sized.
    low = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    step = (F.col("high") - F.col("low")) / F.lit(float(bins))
    edged = limits.select("pos", low.alias("low"), high.alias("high")).select(
        "pos", F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda i: F.col("low") + i * step).alias("inner")
    )
    placed = flat.join(edged, "pos").select(
        "pos", "side", F.size(F.filter("inner", lambda e: e <= F.col("value"))).alias("bin")
    )
    count = lambda s, b: F.sum(((F.col("side") == s) & (F.col("bin") == b)).cast("double"))
    table = placed.groupBy("pos").agg(
        F.array(*[count("reference", b) for b in range(bins)]).alias("p"),
        F.array(*[count("current", b) for b in range(bins)]).alias("q"),
    )
    return table.select("pos", kl_of(F.col("p"), F.col("q")).alias("kl"))


def mean_marginal_kl(rows: DataFrame, side: str, vec: str, bins: int = BINS) -> DataFrame:
    return marginal_kl(rows, side, vec, bins).agg(F.avg("kl").alias("mean_kl"))


# -- energy -----------------------------------------------------------------

def energy_shift(rows: DataFrame, side: str, logits: str) -> DataFrame:
    """Mean energy of both sides and their difference; descriptive only."""
    score = V.energy_score(F.col(logits))
    mean = lambda s: F.avg(F.when(F.col("s") == s, F.col("e")))
    return rows.select(F.col(side).alias("s"), score.alias("e")).agg(
        mean("reference").alias("reference_energy"), mean("current").alias("current_energy")
    ).withColumn("delta", F.col("current_energy") - F.col("reference_energy"))


# -- causes -----------------------------------------------------------------

def shift_cause_breakdown(rows: DataFrame, side: str, features: str) -> DataFrame:
    """Share of light, colour, blur/noise and structure in the change between batches.

    ``features`` holds the 70 values of ``imaging.shift_features``; batch means are
    plain averages per position.
    """
    flat = rows.select(F.col(side).alias("side"), F.posexplode(features).alias("pos", "value"))
    means = flat.groupBy("pos").agg(
        F.avg(F.when(F.col("side") == "reference", F.col("value"))).alias("r"),
        F.avg(F.when(F.col("side") == "current", F.col("value"))).alias("c"),
    )
    spot = {k: (a, a + n - 1) for k, (a, n) in imaging.SHIFT_LAYOUT.items()}
    inside = lambda k: F.col("pos").between(*spot[k])
    delta = F.abs(F.col("c") - F.col("r"))
    root = F.abs(F.sqrt("c") - F.sqrt("r"))
    pick = lambda k, v, how=F.sum: how(F.when(inside(k), v))
    raw = means.agg(
        pick("brightness", delta).alias("illumination"),
        (pick("channel", delta, F.avg) + pick("chroma", delta) / 6).alias("color"),
        (pick("blur", root) + pick("noise", delta)).alias("blur_noise"),
        pick("structure", delta, F.avg).alias("structural"),
    )
    causes = ["illumination", "color", "blur_noise", "structural"]
    cleaned = raw.select(*[F.when(F.col(k) < 1e-12, 0.0).otherwise(F.col(k)).alias(k) for k in causes])
    whole = sum((F.col(k) for k in causes[1:]), F.col(causes[0]))
    share = lambda k: F.when(F.col("total_magnitude") > 0, F.col(k) / F.col("total_magnitude")).otherwise(0.0)
    return cleaned.withColumn("total_magnitude", whole).select(
        *causes, "total_magnitude", *[share(k).alias(f"{k}_share") for k in causes]
    )


def distribution_shift(measures: DataFrame, mmd_threshold: float = 0.1, image_threshold: float = 0.1) -> DataFrame:
    """Findings from rows ``(batch_id, mmd, mean_kl, total_magnitude)`` above either limit."""
    hit = measures.where((F.col("mmd") > mmd_threshold) | (F.col("total_magnitude") > image_threshold))
    worst = F.greatest(F.col("mmd") / 2, F.col("total_magnitude"))
    return as_findings(
        hit,
        asset_id=F.col("batch_id"),
        finding_type="distribution_shift",
        severity=F.least(F.lit(0.8), F.greatest(F.lit(0.2), worst)),
        confidence=0.6,
        modality="EMBEDDING",
        detector_id="distribution_shift",
        evidence=[F.format_string("Squared MMD %.6f, mean marginal KL %.6f, image change %.6f.",
                                  F.col("mmd"), F.col("mean_kl"), F.col("total_magnitude"))],
        counter_evidence=["Sampling, sensors or ordinary change of scene can move these measures."],
        scope="batch",
        config=config_hash(mmd_threshold=mmd_threshold, image_threshold=image_threshold),
    )


def unclassified_anomaly(scores: DataFrame, matched: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Scores above the limit that no other finding explains."""
    checked = scores.withColumn("score", F.when(
        F.col("score").between(0.0, 1.0) & ~F.isnan("score"), F.col("score")
    ).otherwise(F.raise_error(F.lit("anomaly scores must be in [0, 1]")).cast("double")))
    left = checked.where(F.col("score") > threshold).join(
        matched.select("asset_id").distinct(), "asset_id", "left_anti"
    )
    return as_findings(
        left,
        asset_id=F.col("asset_id"),
        finding_type="unclassified_anomaly",
        severity=F.col("score"),
        confidence=0.5,
        modality="BEHAVIORAL",
        detector_id="unclassified_anomaly",
        evidence=[F.format_string("Unmatched anomaly score %.6f exceeds %.2f.", F.col("score"), F.lit(threshold))],
        counter_evidence=["Unseen but legitimate variation can score high; the score is not calibrated."],
        config=config_hash(threshold=threshold),
    )
