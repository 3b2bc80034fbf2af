"""How well detectors do: counts, curves, calibration, ablation, cost, corruption."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.scale import order_statistics, prefix_totals, with_row
from attest.functions.vectors import bin_index, linspace
from attest.operators.spotcheck import seeded_unit
from attest.schemas import counts_as_anomaly
from attest.session import settle


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0)).cast("double")


def _scores() -> dict[str, Column]:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall)}


def flagged_assets(findings: DataFrame) -> DataFrame:
    """Distinct (detector_id, asset_id) of findings that count."""
    return findings.where(counts_as_anomaly()).select(
        F.col("provenance.detector_id").alias("detector_id"), "asset_id"
    ).distinct()


def detector_metrics(findings: DataFrame, truth: DataFrame, detectors: DataFrame) -> DataFrame:
    """Counts and rates per detector on distinct assets.

    ``truth(detector_id, asset_id)``: a null detector id is the common truth, a named
    one replaces it for that detector. ``detectors(detector_id)`` also lists silent
    detectors. The common truth is compared once with the flagged assets; it is not
    copied per detector.
    """
    flagged = flagged_assets(findings)
    own = truth.where("detector_id is not null").distinct()
    named = own.select("detector_id").distinct().withColumn("has_own", F.lit(True))
    common = truth.where("detector_id is null").select("asset_id").distinct()
    everyone = detectors.select("detector_id").union(
        findings.select("provenance.detector_id")
    ).union(own.select("detector_id")).distinct().join(named, "detector_id", "left")
    hits = flagged.join(own.withColumn("in_own", F.lit(1)), ["detector_id", "asset_id"], "left").join(
        common.withColumn("in_common", F.lit(1)), "asset_id", "left"
    ).groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("flagged"), F.count("in_own").alias("own_hit"), F.count("in_common").alias("common_hit")
    )
    own_size = own.groupBy("detector_id").agg(F.count(F.lit(1)).alias("own_size"))
    sized = with_row(
        everyone.join(hits, "detector_id", "left").join(own_size, "detector_id", "left").na.fill(0),
        common.agg(F.count(F.lit(1)).alias("common_size")),
    )
    has = F.coalesce("has_own", F.lit(False))
    tp = F.when(has, F.col("own_hit")).otherwise(F.col("common_hit"))
    size = F.when(has, F.col("own_size")).otherwise(F.col("common_size"))
    counted = sized.select(
        "detector_id", tp.alias("tp"), (F.col("flagged") - tp).alias("fp"), (size - tp).alias("fn")
    )
    return counted.withColumns(_scores())


def _curve(scored: DataFrame) -> DataFrame:
    """``(threshold, tp, fp, positives, negatives)`` per distinct score, plus +infinity."""
    # One row per distinct score, read for the cut points, the totals and the curve.
    per = settle(scored.groupBy(F.col("score").cast("double").alias("threshold")).agg(
        F.sum(F.col("truth").cast("int")).cast("bigint").alias("tp"),
        F.sum(1 - F.col("truth").cast("int")).cast("bigint").alias("fp"),
    ))
    totals = per.agg(F.coalesce(F.sum("tp"), F.lit(0)).alias("positives"),
                     F.coalesce(F.sum("fp"), F.lit(0)).alias("negatives"))
    running = prefix_totals(per, "threshold", ["tp", "fp"]).select(
        "threshold", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp")
    )
    zero = F.lit(0).cast("bigint")
    start = totals.select(F.lit(float("inf")).alias("threshold"), zero.alias("tp"), zero.alias("fp"))
    return with_row(start.union(running), totals)


def roc_points(scored: DataFrame) -> DataFrame:
    """``scored(score, truth)`` -> ``(threshold, tpr, fpr)``; undefined rates are null."""
    return _curve(scored).select(
        "threshold", F.try_divide("tp", "positives").alias("tpr"), F.try_divide("fp", "negatives").alias("fpr")
    )


def pr_points(scored: DataFrame) -> DataFrame:
    """``(threshold, precision, recall)``; precision is 1 before anything is predicted."""
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(1.0))
    return _curve(scored).select("threshold", precision.alias("precision"), F.try_divide("tp", "positives").alias("recall"))


def reliability_diagram(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``scored(confidence, correct)`` -> counts, mean confidence and accuracy per equal bin."""
    edges = linspace(0.0, 1.0, bins)
    table = scored.sparkSession.createDataFrame(
        [(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lower double, upper double"
    )
    filled = scored.groupBy(bin_index(F.col("confidence"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"),
    )
    return F.broadcast(table).join(filled, "bin", "left").select(
        "bin", "lower", "upper", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "mean_confidence", "accuracy"
    )


def brier_score(scored: DataFrame) -> DataFrame:
    gap = F.col("confidence") - F.col("correct").cast("double")
    return scored.agg(F.avg(gap * gap).alias("brier"))


def interpolate(value: Column, knots: Mapping[float, float]) -> Column:
    """Piecewise-linear through sorted knots, clamped at both ends."""
    points = sorted((float(k), float(v)) for k, v in knots.items())
    if not points:
        raise ValueError("a nonempty calibration mapping is required")
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        if x1 <= x0 or y1 < y0:
            raise ValueError("knots must be unique and monotonic")
    if any(not 0 <= n <= 1 for p in points for n in p):
        raise ValueError("knots must lie in [0, 1]")
    result = F.when(value <= points[0][0], F.lit(points[0][1]))
    for (x0, y0), (x1, y1) in zip(points, points[1:]):
        result = result.when(value <= x1, F.lit((y1 - y0) / (x1 - x0)) * (value - x0) + y0)
    return result.otherwise(F.lit(points[-1][1]))


def apply_calibration(findings: DataFrame, knots: Mapping[float, float]) -> DataFrame:
    """Calibrated confidence; the raw value is kept, so applying twice changes nothing."""
    attrs = F.col("provenance.attrs")
    raw = F.coalesce(F.try_element_at(attrs, F.lit("uncalibrated_confidence")).cast("double"), F.col("confidence"))
    kept = F.map_concat(
        F.map_filter(attrs, lambda k, v: ~k.isin("uncalibrated_confidence", "calibration_applied")),
        F.create_map(F.lit("uncalibrated_confidence"), F.col("_raw").cast("string"),
                     F.lit("calibration_applied"), F.lit("true")),
    )
    return findings.withColumn("_raw", raw).withColumn(
        "provenance", F.col("provenance").withField("attrs", kept)
    ).withColumn("confidence", interpolate(F.col("_raw"), knots)).drop("_raw")


def ablation(findings: DataFrame, truth: DataFrame, modules: Sequence[str]) -> DataFrame:
    """Effect of leaving out one module at a time: ``(module, tp.., precision_delta, recall_delta)``.

    An asset is lost only when the left-out module was the single one flagging it,
    so one row per asset answers every ablation at once.
    """
    names = findings.sparkSession.createDataFrame([(m,) for m in dict.fromkeys(modules)], "module string")
    per_asset = flagged_assets(findings).groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("modules"), F.min("detector_id").alias("module")
    )
    affected = truth.select("asset_id").distinct()
    judged = per_asset.join(affected.withColumn("hit", F.lit(1)), "asset_id", "left")
    base = with_row(
        judged.agg(F.count("hit").alias("b_tp"), (F.count(F.lit(1)) - F.count("hit")).alias("b_fp")),
        affected.agg(F.count(F.lit(1)).alias("size")),
    )
    lost = judged.where("modules = 1").groupBy("module").agg(
        F.count("hit").alias("l_tp"), (F.count(F.lit(1)) - F.count("hit")).alias("l_fp")
    )
    tp, fp = F.col("b_tp") - F.col("l_tp"), F.col("b_fp") - F.col("l_fp")
    counted = with_row(F.broadcast(names).join(lost, "module", "left").na.fill(0), base).select(
        "module", tp.alias("tp"), fp.alias("fp"), (F.col("size") - tp).alias("fn"),
        _ratio(F.col("b_tp"), F.col("b_tp") + F.col("b_fp")).alias("base_precision"),
        _ratio(F.col("b_tp"), F.col("size")).alias("base_recall"),
    ).withColumns(_scores())
    return counted.select(
        "module", "tp", "fp", "fn", "precision", "recall", "f1",
        (F.col("precision") - F.col("base_precision")).alias("precision_delta"),
        (F.col("recall") - F.col("base_recall")).alias("recall_delta"),
    )


def false_positive_cost(verdicts: DataFrame, variants: DataFrame, limit: float = 0.05) -> DataFrame:
    """Share of clean variants with any REVIEW or QUARANTINE; one row."""
    raised = F.coalesce(F.upper("verdict").isin("REVIEW", "QUARANTINE"), F.lit(False)).cast("int")
    stopped = F.coalesce(F.upper("verdict") == "QUARANTINE", F.lit(False)).cast("int")
    per = variants.select("variant").distinct().join(verdicts, "variant", "left").groupBy("variant").agg(
        F.max(raised).alias("raised"), F.max(stopped).alias("stopped")
    )
    return per.agg(
        F.count(F.lit(1)).alias("variants"), F.coalesce(F.sum("raised"), F.lit(0)).alias("false_positives"),
        F.avg("raised").alias("rate"), F.avg("stopped").alias("quarantine_rate"),
    ).withColumn("flag", F.coalesce(F.col("rate") > limit, F.lit(False)))


def false_positive_costs(verdicts: DataFrame, variants: DataFrame, limit: float = 0.05) -> DataFrame:
    """The same for every detector of verdicts(detector_id, variant, verdict): its share of all clean variants."""
    known = variants.select("variant").distinct()
    up = F.upper("verdict")
    per = verdicts.join(known, "variant", "left_semi").groupBy("detector_id", "variant").agg(
        F.max(F.coalesce(up.isin("REVIEW", "QUARANTINE"), F.lit(False)).cast("int")).alias("raised"),
        F.max(F.coalesce(up == "QUARANTINE", F.lit(False)).cast("int")).alias("stopped"))
    sums = per.groupBy("detector_id").agg(F.sum("raised").alias("false_positives"), F.sum("stopped").alias("stopped"))
    return with_row(sums, known.agg(F.count(F.lit(1)).alias("variants"))).select(
        "detector_id", "variants", "false_positives", (F.col("false_positives") / F.col("variants")).alias("rate"),
        (F.col("stopped") / F.col("variants")).alias("quarantine_rate"), (F.col("false_positives") / F.col("variants") > limit).alias("flag"))


def run_diff(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows only in one of two runs, copies counted: ``(run, <columns>)``."""
    columns = first.columns
    a, b = first, second.select(*columns)
    return a.exceptAll(b).select(F.lit("run_1").alias("run"), *columns).union(
        b.exceptAll(a).select(F.lit("run_2").alias("run"), *columns)
    )


def deterministic(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row ``(deterministic, differences)``."""
    return run_diff(first, second).agg(F.count(F.lit(1)).alias("differences")).select(
        (F.col("differences") == 0).alias("deterministic"), "differences"
    )


def runtime_cost(timings: DataFrame) -> DataFrame:
    """``timings(detector_id, seconds, ran)`` -> count, mean, p50, p95 and max per detector."""
    valid = F.when(
        (F.col("seconds") >= 0) & ~F.isnan("seconds") & (F.col("seconds") < float("inf")), F.col("seconds")
    ).otherwise(F.raise_error(F.lit("timings must be finite and nonnegative")).cast("double"))
    ran = timings.where("ran").select("detector_id", valid.alias("seconds"))
    ranks = order_statistics(ran, ["detector_id"], "seconds", {"p50": 0.5, "p95": 0.95}).drop("n")
    return ran.groupBy("detector_id").agg(
        F.count(F.lit(1)).alias("runs"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest")
    ).join(ranks, "detector_id")


# -- corruption with known truth -------------------------------------------

def pick_exactly(rows: DataFrame, ident: str, rate: float, seed: int) -> DataFrame:
    """Exactly int(n x rate) ids with the smallest seeded hashes.

    Hashes are uniform, so their leading 16 bits split the ids evenly: whole slots
    below the boundary are taken, and only the boundary slot is ranked.
    """
    if not 0 <= rate <= 1:
        raise ValueError("rate must be in [0, 1]")
    unit = seeded_unit(seed, F.col(ident))
    hashed = rows.select(ident, unit.alias("_u"), F.floor(unit * 65536).alias("_slot"))
    per_slot = hashed.groupBy("_slot").agg(F.count(F.lit(1)).alias("_c"))  # 65536 rows at most
    order = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    quota = F.floor(F.col("_total") * F.lit(float(rate)))
    ahead = with_row(
        per_slot.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0))),
        per_slot.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("_total")),
    ).select("_slot", "_before", "_c", quota.alias("_quota")).where("_before < _quota")
    placed = hashed.join(F.broadcast(ahead), "_slot")
    whole = placed.where("_before + _c <= _quota").select(ident)
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy("_u", ident))
    edge = placed.where("_before + _c > _quota").withColumn("_rank", rank).where("_before + _rank <= _quota")
    return whole.union(edge.select(ident))


def corrupt_table(rows: DataFrame, ident: str, vec: str, label: str, rate: float, seed: int,
                  mode: str = "label_flip") -> DataFrame:
    """``rows`` with the chosen corruption and ``affected``: true where the row really changed."""
    chosen = pick_exactly(rows, ident, rate, seed).withColumn("_chosen", F.lit(True))
    marked = rows.join(chosen, ident, "left").withColumn("_chosen", F.coalesce("_chosen", F.lit(False)))
    if mode == "label_flip":
        classes = rows.select(F.col(label).alias("_class")).distinct()
        first = classes.agg(F.min("_class").alias("_first"))
        order = Window.orderBy("_class")  # one row per class
        following = with_row(classes.withColumn("_lead", F.lead("_class").over(order)), first).select(
            F.col("_class").alias(label), F.coalesce("_lead", "_first").alias("_next")
        )
        changed = marked.join(following, label).select(
            *[F.when(F.col("_chosen"), F.col("_next")).otherwise(F.col(label)).alias(label) if c == label else F.col(c)
              for c in rows.columns],
            (F.col("_chosen") & (F.col("_next") != F.col(label))).alias("affected"),
        )
    elif mode == "duplicate_flood":
        head = rows.groupBy().agg(F.min_by(F.struct(F.col(vec).alias("v"), F.col(label).alias("l")), ident).alias("_head"))
        joined = with_row(marked, head)
        new_vec = F.when(F.col("_chosen"), F.col("_head.v")).otherwise(F.col(vec))
        new_label = F.when(F.col("_chosen"), F.col("_head.l")).otherwise(F.col(label))
        changed = joined.select(
            *[new_vec.alias(vec) if c == vec else new_label.alias(label) if c == label else F.col(c) for c in rows.columns],
            ((new_vec != F.col(vec)) | (new_label != F.col(label))).alias("affected"),
        )
    elif mode == "ood_insert":
        spread = rows.agg(F.max(F.array_max(vec)).cast("double").alias("_high"), F.min(F.array_min(vec)).cast("double").alias("_low"))
        joined = with_row(marked, spread)
        width = F.greatest(F.col("_high") - F.col("_low"), F.lit(1.0))
        unit = lambda i: seeded_unit(seed, F.concat_ws(":", F.col(ident).cast("string"), i.cast("string")))
        pushed = F.transform(vec, lambda v, i: F.col("_high") + width * (F.lit(2.0) + unit(i)))
        new_vec = F.when(F.col("_chosen"), pushed).otherwise(F.col(vec).cast("array<double>"))
        changed = joined.select(
            *[new_vec.alias(vec) if c == vec else F.col(c) for c in rows.columns], F.col("_chosen").alias("affected")
        )
    else:
        raise ValueError("unknown corruption mode")
    return changed


def tamper_log(records: DataFrame, positions: Column, seed: int) -> DataFrame:
    """Replace output_hash where ``positions`` holds, keep everything else; ``affected`` is the truth."""
    fresh = F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col("log_id").cast("string"), F.col("pos").cast("string")), 256)
    other = F.when(F.substring(fresh, 1, 1) == "0", F.concat(F.lit("1"), F.substring(fresh, 2, 63))) \
        .otherwise(F.concat(F.lit("0"), F.substring(fresh, 2, 63)))
    value = F.when(fresh == F.col("output_hash"), other).otherwise(fresh)
    return records.withColumn("affected", positions).withColumn(
        "output_hash", F.when(F.col("affected"), value).otherwise(F.col("output_hash"))
    )


def detection_rate(cases: DataFrame, detected: str = "detected") -> DataFrame:
    """Mean of 0/1 detections over fixed cases; anything else fails the job."""
    flag = F.col(detected).cast("int")
    binary = F.when(flag.isin(0, 1), flag).otherwise(F.raise_error(F.lit("detections must be 0 or 1")).cast("int"))
    return cases.agg(F.count(F.lit(1)).alias("cases"), F.avg(binary).alias("rate"))
