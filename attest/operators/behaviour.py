"""Model-behaviour checks over prediction, activation and tensor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions import vectors as V
from attest.functions.scale import order_statistics, with_row
from attest.schemas import as_findings, config_hash

# What each check can see at each access level.
CAPABILITIES = {
    "Model Identity (hash check)": {"white_box": "yes", "gray_box": "yes", "black_box": "yes"},
    "Weight/activation statistics": {"white_box": "yes", "gray_box": "partial", "black_box": "no"},
    "Trigger reconstruction": {"white_box": "yes", "gray_box": "partial", "black_box": "no"},
    "Fine-Pruning": {"white_box": "yes", "gray_box": "no", "black_box": "no"},
    "Reference-battery comparison": {"white_box": "yes", "gray_box": "yes", "black_box": "yes (output-only)"},
    "Merkle activation commitment": {"white_box": "yes", "gray_box": "partial", "black_box": "no"},
}

# What would let a check run in full.
RECOMMENDATIONS = {
    "Model Identity (hash check)": "ask for the model file, and for its digest from a source you trust",
    "Weight/activation statistics": "ask for the weights, and for statistics of the same model when it was sound",
    "Trigger reconstruction": "ask for gradients, or for the whole model",
    "Fine-Pruning": "ask for access to single neurons, and for inputs with known outputs",
    "Reference-battery comparison": "collect the model's outputs on inputs whose right outputs are known",
    "Merkle activation commitment": "ask for the activations of hidden layers, and for the roots committed to earlier",
}
NO_RECOMMENDATION = "say which access this check needs, and list it"


# -- outputs against a baseline --------------------------------------------

def output_statistics(outputs: DataFrame, keys: list[str], logits: str) -> DataFrame:
    """``(keys.., pos, mean, std)`` per class, population standard deviation."""
    flat = outputs.select(*keys, F.posexplode(logits).alias("pos", "value"))
    return flat.groupBy(*keys, "pos").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def reference_battery(outputs: DataFrame, baseline: DataFrame, key: str, logits: str,
                      threshold: float = 0.25) -> DataFrame:
    """``(key, deviation, shifted)``; ``baseline(key, pos, mean, std)``."""
    seen = output_statistics(outputs, [key], logits)
    base = baseline.select(key, "pos", F.col("mean").alias("b_mean"), F.col("std").alias("b_std"))
    scale = F.greatest(F.col("b_std"), F.lit(1.0))
    worst = F.greatest(F.abs(F.col("mean") - F.col("b_mean")) / scale, F.abs(F.col("std") - F.col("b_std")) / scale)
    # A class on one side only means the vectors do not line up: no deviation, degraded.
    return seen.join(base, [key, "pos"], "full_outer").groupBy(key).agg(
        F.max(worst).alias("deviation"),
        F.bool_and(F.col("mean").isNotNull() & F.col("b_mean").isNotNull()).alias("complete"),
    ).select(
        key, F.when(F.col("complete"), F.col("deviation")).alias("deviation"),
        F.when(F.col("complete"), F.col("deviation") > threshold).alias("shifted"),
    )


def reference_battery_findings(scored: DataFrame, key: str, threshold: float = 0.25) -> DataFrame:
    shifted = F.col("shifted")
    known = as_findings(
        scored.where(shifted.isNotNull()),
        asset_id=F.col(key),
        finding_type=F.when(shifted, "model_behavioral_mismatch").otherwise("model_behavioral_match"),
        severity=F.when(shifted, 0.7).otherwise(0.0),
        confidence=0.8,
        modality="BEHAVIORAL",
        detector_id="reference_battery",
        evidence=[F.format_string("Largest standardised deviation %.6f; limit %.2f.", F.col("deviation"), F.lit(threshold))],
        counter_evidence=["Preprocessing, precision or a legitimate update can change outputs."],
        action=F.when(shifted, "review").otherwise("accept"),
        scope=F.when(shifted, "model"),
        config=config_hash(threshold=threshold),
    )
    return known.unionByName(degraded_findings(
        scored.where(shifted.isNull()).select(F.col(key).alias("asset_id"), F.lit("outputs do not match the baseline").alias("reason")),
        "reference_battery", "black_box",
    ))


def degraded_findings(missing: DataFrame, detector: str, access: str) -> DataFrame:
    """``missing(asset_id, reason)`` -> a low-severity, zero-confidence gap per asset."""
    return as_findings(
        missing,
        asset_id=F.col("asset_id"),
        finding_type=f"{detector}_unverified",
        severity=0.1,
        confidence=0.0,
        modality="BEHAVIORAL",
        detector_id=detector,
        evidence=[F.concat(F.lit("DEGRADED: "), F.col("reason"), F.lit(" (the check did not finish)."))],
        counter_evidence=["A check that could not run says nothing about the asset."],
        scope="model",
        access=access,
    )


def degraded_check(required: DataFrame, supplied: DataFrame, key: str) -> DataFrame:
    """``(asset_id, reason)`` for required inputs that were not supplied."""
    return required.join(supplied.select(key).distinct(), key, "left_anti").select(
        F.col(key).cast("string").alias("asset_id"), F.lit("required input is missing").alias("reason")
    )


def tensor_statistics(tensors: DataFrame) -> DataFrame:
    """``tensors(tensor, value)`` -> mean, population std and L2 norm per tensor."""
    return tensors.groupBy("tensor").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"),
    )


def weight_statistics(tensors: DataFrame, baseline: DataFrame) -> DataFrame:
    """``(tensor, deviation, missing)`` against ``baseline(tensor, mean, std, norm)``."""
    seen = tensor_statistics(tensors)
    base = baseline.select("tensor", *[F.col(c).alias(f"b_{c}") for c in ("mean", "std", "norm")])
    relative = lambda c: F.abs(F.col(c) - F.col(f"b_{c}")) / F.greatest(F.abs(f"b_{c}"), F.lit(1e-6))
    return base.join(seen, "tensor", "left").select(
        "tensor", F.greatest(relative("mean"), relative("std"), relative("norm")).alias("deviation"),
        F.col("mean").isNull().alias("missing"),
    )


def weight_findings(scored: DataFrame, model_id: str, threshold: float = 0.5) -> DataFrame:
    odd = as_findings(
        scored.where(~F.col("missing") & (F.col("deviation") > threshold)),
        asset_id=F.lit(model_id),
        finding_type="weight_statistics_outlier",
        severity=0.6,
        confidence=0.5,
        modality="BEHAVIORAL",
        detector_id="weight_stats",
        evidence=[F.format_string("Tensor %s deviates by %.6f; limit %.2f.", F.col("tensor"), F.col("deviation"), F.lit(threshold))],
        counter_evidence=["Retraining, quantisation or reparameterisation changes weights as well."],
        scope="model",
        access="white_box",
        config=config_hash(threshold=threshold),
    )
    gaps = scored.where("missing").select(
        F.lit(model_id).alias("asset_id"), F.concat(F.lit("tensor missing: "), F.col("tensor")).alias("reason")
    )
    return odd.unionByName(degraded_findings(gaps, "weight_stats", "white_box"))


# -- counterfactuals --------------------------------------------------------

def prediction_flips(before: DataFrame, after: DataFrame, key: str, logits: str) -> DataFrame:
    """``(key, before_class, after_class, persists, delta)`` for the same sample in two runs."""
    joined = before.select(key, F.col(logits).alias("b")).join(after.select(key, F.col(logits).alias("a")), key)
    return joined.select(
        key, V.argmax(F.col("b")).alias("before_class"), V.argmax(F.col("a")).alias("after_class"),
        (V.argmax(F.col("b")) == V.argmax(F.col("a"))).alias("persists"),
        V.l2_delta(F.col("b"), F.col("a")).alias("delta"),
    )


def low_activation_neurons(activations: DataFrame, vec: str, fraction: float) -> DataFrame:
    """``(pos, mean_abs)`` of the least active neurons, ties by position.

    The neuron table has one row per vector position, so the ranking is small.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    width = activations.select(F.size(vec)).first()[0]
    means = activations.select(F.posexplode(vec).alias("pos", "value")).groupBy("pos").agg(
        F.avg(F.abs("value")).alias("mean_abs")
    )
    return means.orderBy("mean_abs", "pos").limit(max(1, int(width * fraction)))


def pruned(battery: DataFrame, vec: str, neurons: DataFrame) -> DataFrame:
    """``battery`` with the chosen neurons set to zero."""
    chosen = neurons.agg(F.collect_list(F.col("pos").cast("int")).alias("_pruned"))
    return with_row(battery, chosen).withColumn(vec, V.mask_positions(F.col(vec), F.col("_pruned"))).drop("_pruned")


def pruning_verification(flips: DataFrame, suspicious: DataFrame, key: str) -> DataFrame:
    """One row: flips among suspicious rows, flips elsewhere, and the flipped share."""
    marked = flips.join(suspicious.select(key, F.lit(True).alias("s")), key, "left")
    flag = F.coalesce("s", F.lit(False))
    count = lambda c: F.sum(c.cast("int")).cast("bigint")
    return marked.agg(
        count(flag).alias("suspicious"),
        count(flag & ~F.col("persists")).alias("suspicious_changed"),
        count(~flag & ~F.col("persists")).alias("other_changed"),
    ).withColumn("fraction", F.col("suspicious_changed") / F.col("suspicious"))


def pruning_findings(measured: DataFrame, asset_id: str) -> DataFrame:
    return as_findings(
        measured,
        asset_id=F.lit(asset_id),
        finding_type="fine_pruning_verification",
        severity=F.col("fraction"),
        confidence=0.6 * F.col("fraction"),
        modality="ACTIVATION",
        detector_id="fine_pruning",
        evidence=[F.format_string("Flagged predictions changed: %d of %d; others changed: %d.",
                                  F.col("suspicious_changed"), F.col("suspicious"), F.col("other_changed"))],
        counter_evidence=["Pruned neurons can be rare but legitimate feature detectors."],
        scope="model",
        access="white_box",
    )


def mad_outlier_class(norms: DataFrame, group: str, threshold: float = 3.5, min_classes: int = 3) -> DataFrame:
    """The high-norm class of each group: ``norms(group, class_id, norm)``.

    Score is (largest - median) over the median absolute deviation.
    """
    good = norms.where(F.col("norm").isNotNull())
    centre = order_statistics(good, [group], "norm", {"middle": 0.5})
    joined = good.join(centre, group).withColumn("gap", F.abs(F.col("norm") - F.col("middle")))
    spread = order_statistics(joined, [group], "gap", {"mad": 0.5}).select(group, "mad")
    top = good.groupBy(group).agg(
        F.max("norm").alias("norm"),
        F.max_by("class_id", F.struct(F.col("norm"), (-F.col("class_id")).alias("back"))).alias("class_id"),
    )
    index = (F.col("norm") - F.col("middle")) / F.greatest(F.lit(1.4826) * F.col("mad"), F.lit(1e-6))
    scored = top.join(centre.where(F.col("n") >= min_classes), group).join(spread, group).select(
        group, "class_id", "norm", F.col("middle").alias("median"), "mad", index.alias("anomaly_index")
    ).where(F.col("anomaly_index") > threshold)
    severity = F.col("anomaly_index") / (1 + F.col("anomaly_index"))
    return scored.withColumn("severity", severity).withColumn(
        "confidence", F.least(F.lit(0.6), F.lit(0.4) + 0.2 * F.col("severity"))
    )


# -- perturbed predictions --------------------------------------------------

def prediction_entropy(predictions: DataFrame, key: str, probs: str, threshold: float = 0.2) -> DataFrame:
    """Samples whose predictions stay certain under overlays.

    ``predictions(key, overlay, probs)`` -> ``(key, entropy, share, overlays)`` below the limit.
    """
    p = F.col(probs)
    valid = (F.abs(V.total(p) - 1) <= 1e-5) & F.forall(p, lambda v: (v >= 0) & (v <= 1)) & (F.size(p) >= 2)
    checked = F.when(valid, V.entropy(p)).otherwise(
        F.raise_error(F.lit("each prediction needs two or more probabilities that sum to one")).cast("double")
    )
    per_class = predictions.select(key, checked.alias("e"), V.argmax(p).alias("c")).groupBy(key, "c").agg(
        F.count(F.lit(1)).alias("n"), F.sum("e").alias("e")
    )
    total = per_class.groupBy(key).agg(
        (F.sum("e") / F.sum("n")).alias("entropy"), (F.max("n") / F.sum("n")).alias("share"), F.sum("n").alias("overlays")
    )
    return total.where(F.col("entropy") < threshold)


def prediction_entropy_findings(low: DataFrame, key: str, threshold: float = 0.2) -> DataFrame:
    return as_findings(
        low,
        asset_id=F.col(key),
        finding_type="strip_low_entropy",
        severity=0.7,
        confidence=0.6,
        modality="BEHAVIORAL",
        detector_id="strip",
        evidence=[F.format_string("Mean prediction entropy %.6f nats under %d overlays; dominant class share %.4f.",
                                  F.col("entropy"), F.col("overlays"), F.col("share"))],
        counter_evidence=["Confident models and weak overlays give low entropy without any trigger."],
        config=config_hash(threshold=threshold),
    )


def overlay_pick(seed: int, key: Column, overlay: Column, count: Column) -> Column:
    """Which background an overlay uses: a seeded hash, the same on every run."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), overlay.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), count)


def overlay_blend(images: DataFrame, backgrounds: DataFrame, key: str, pixels: str, overlays: int = 16,
                  alpha: float = 0.5, seed: int = 7) -> DataFrame:
    """``(key, overlay, background, pixels)``: each image blended with seeded backgrounds.

    ``backgrounds(background, pixels)`` carries dense numbers from 0.
    """
    count = backgrounds.agg(F.count(F.lit(1)).alias("_count"))
    planned = with_row(images, count).withColumn("overlay", F.explode(F.sequence(F.lit(0), F.lit(overlays - 1))))
    chosen = planned.withColumn("background", overlay_pick(seed, F.col(key), F.col("overlay"), F.col("_count")))
    back = backgrounds.select(F.col("background").cast("bigint").alias("background"), F.col("pixels").alias("_back"))
    return chosen.join(back, "background").select(
        key, "overlay", "background", V.blend(F.col(pixels), F.col("_back"), alpha).alias("pixels")
    )


# -- access and coverage ----------------------------------------------------

def access_matrix(requests: DataFrame, available: DataFrame) -> DataFrame:
    """Eligibility of every check for ``requests(asset_id, access_level)``.

    ``available(asset_id, check)`` lists installed checks; checks without a
    capability contract are reported as skipped.
    """
    spark = requests.sparkSession
    contract = spark.createDataFrame(
        [(c, level, v) for c, levels in CAPABILITIES.items() for level, v in levels.items()],
        "check string, access_level string, capability string",
    )
    known = requests.join(F.broadcast(contract), "access_level")
    present = available.distinct().withColumn("present", F.lit(True))
    joined = known.join(present, ["asset_id", "check"], "left")
    foreign = available.distinct().where(~F.col("check").isin(list(CAPABILITIES))).join(requests, "asset_id")
    unknown = foreign.select(
        "asset_id", "access_level", "check", F.lit("no").alias("capability"), F.lit("skipped").alias("status"),
        F.lit("no contract is known for this check").alias("reason"),
    )
    status = F.when(F.col("present").isNull() | (F.col("capability") == "no"), "skipped") \
        .when(F.col("capability") == "partial", "partial").otherwise("ran")
    reason = (
        F.when(F.col("present").isNull(), "the check or an input of it is absent")
        .when(F.col("capability") == "no", F.concat(F.col("access_level"), F.lit(" access is not enough")))
        .when(F.col("capability") == "partial", "only what the access level shows is evaluated")
        .otherwise(F.col("capability"))
    )
    return joined.select("asset_id", "access_level", "check", "capability", status.alias("status"), reason.alias("reason")) \
        .unionByName(unknown)


def coverage_confidence(matrix: DataFrame) -> DataFrame:
    """``(asset_id, requested, ran, coverage)`` over distinct checks; partial checks count."""
    per_check = matrix.groupBy("asset_id", "check").agg(
        F.max((F.col("status") != "skipped").cast("int")).alias("ran")
    )
    return per_check.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("requested"), F.sum("ran").alias("ran")
    ).withColumn("coverage", F.col("ran") / F.col("requested"))


def assurance_debt(matrix: DataFrame) -> DataFrame:
    """A gap with its recommendation for every skipped or partial check."""
    advice = F.create_map(*[F.lit(x) for item in RECOMMENDATIONS.items() for x in item])
    owed = matrix.where("status <> 'ran'")
    text = F.concat("check", F.lit(": "), "reason", F.lit(" — "),
                    F.coalesce(F.try_element_at(advice, F.col("check")), F.lit(NO_RECOMMENDATION)))
    return owed.select("asset_id", "check", F.col("reason").alias("gap"), text.alias("recommendation"))


def assessment_coverage(tier_log: DataFrame) -> DataFrame:
    """``tier_log(assessment_id, provider, ran)`` -> requested, ran, skipped and coverage per run."""
    per = tier_log.groupBy("assessment_id", "provider").agg(F.max(F.col("ran").cast("int")).alias("ran"))
    return per.groupBy("assessment_id").agg(
        F.count(F.lit(1)).alias("requested"), F.sum("ran").alias("ran"), F.sum(1 - F.col("ran")).alias("skipped")
    ).withColumn("coverage", F.col("ran") / F.col("requested"))
