"""Contributor risk: prevalence, severity, convergence, concentration and rate jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.scale import numbered, with_row
from attest.operators.evidence import family_of
from attest.schemas import counts_as_anomaly
from attest.session import settle

# Severities are added as decimals: the sum does not depend on the order of rows.
EXACT = "decimal(18,12)"


def sample_anomalies(findings: DataFrame) -> DataFrame:
    """Per sample: ``(asset_id, severity, convergence)`` over its counting findings."""
    modalities = F.array_distinct(F.concat(F.array("modality"), F.coalesce("provenance.modalities", F.array())))
    seen = findings.where(counts_as_anomaly()).select(
        "asset_id", family_of(F.col("finding_type")).alias("family"), "severity",
        F.explode(modalities).alias("modality"),
    )
    per_family = seen.groupBy("asset_id", "family").agg(
        F.max("severity").alias("severity"), F.size(F.collect_set("modality")).alias("agreeing")
    )
    return per_family.groupBy("asset_id").agg(
        F.max("severity").alias("severity"), F.max("agreeing").alias("convergence")
    )


def batch_rates(findings: DataFrame, samples: DataFrame, batch_order: DataFrame) -> DataFrame:
    """One row per (contributor, batch) with its samples, clean ones included.

    ``samples(asset_id, contributor_id, batch_id)``, ``batch_order(batch_id, pos)``.
    """
    known = samples.where("contributor_id is not null and batch_id is not null")
    joined = known.join(sample_anomalies(findings), "asset_id", "left")
    return joined.groupBy("contributor_id", "batch_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count("severity").alias("anomaly_count"),
        F.coalesce(F.sum(F.col("severity").cast(EXACT)), F.lit(0)).alias("severity_sum"),
        F.coalesce(F.sum("convergence"), F.lit(0)).alias("convergence_sum"),
        F.coalesce(F.max("convergence"), F.lit(0)).alias("convergence_count"),
    ).join(batch_order, "batch_id").withColumn(
        "anomaly_rate", F.col("anomaly_count") / F.col("sample_count")
    )


def temporal_change_points(batches: DataFrame, window: int = 2, drift_threshold: float = 0.15) -> DataFrame:
    """The largest upward jump between adjacent rolling windows of each contributor."""
    order = Window.partitionBy("contributor_id").orderBy("pos")
    before, after = order.rowsBetween(-window, -1), order.rowsBetween(0, window - 1)
    rated = batches.select(
        "contributor_id", "batch_id", "pos",
        F.avg("anomaly_rate").over(before).alias("before_rate"),
        F.count("anomaly_rate").over(before).alias("n_before"),
        F.avg("anomaly_rate").over(after).alias("after_rate"),
        F.count("anomaly_rate").over(after).alias("n_after"),
    ).where((F.col("n_before") == window) & (F.col("n_after") == window))
    jump = F.col("after_rate") - F.col("before_rate")
    best = rated.withColumn("jump", jump).groupBy("contributor_id").agg(
        F.max_by(F.struct("batch_id", "before_rate", "after_rate", "jump"), F.struct("jump", -F.col("pos"))).alias("b")
    )
    return best.select("contributor_id", "b.*").where(F.col("jump") >= drift_threshold)


def contributor_risk(batches: DataFrame, window: int = 2, drift_threshold: float = 0.15) -> DataFrame:
    """Risk per contributor from its batch rows; a heuristic in [0, 1], not a probability."""
    # One row per contributor and batch; both branches below read it.
    batches = settle(batches)
    points = temporal_change_points(batches, window, drift_threshold)
    totals = batches.groupBy("contributor_id").agg(
        F.sum("sample_count").alias("samples"),
        F.sum("anomaly_count").alias("anomalies"),
        F.sum("severity_sum").alias("severity_sum"),
        F.sum("convergence_sum").alias("convergence_sum"),
        F.max("anomaly_count").alias("peak"),
    )
    rate = lambda top, bottom: F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0)).cast("double")
    measured = totals.join(
        points.select("contributor_id", F.col("jump").alias("jump"), F.col("batch_id").alias("change_batch")),
        "contributor_id", "left",
    ).select(
        "contributor_id", "samples", "anomalies", "change_batch",
        rate("anomalies", "samples").alias("prevalence"),
        F.coalesce(F.try_divide(F.col("severity_sum").cast("double"), F.col("anomalies")), F.lit(0.0)).alias("severity"),
        rate("convergence_sum", "anomalies").alias("convergence_count"),
        rate("peak", "anomalies").alias("batch_concentration"),
        F.coalesce("jump", F.lit(0.0)).alias("temporal_change"),
    )
    score = F.col("prevalence") * (
        0.5 * F.col("severity")
        + 0.2 * F.least(F.col("convergence_count") / 5, F.lit(1.0))
        + 0.15 * F.col("batch_concentration")
    ) + 0.15 * F.col("temporal_change")
    return measured.withColumn("risk_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def metadata_coverage(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """One row: sample counts and the share with contributor and batch."""
    complete = (F.col("contributor_id").isNotNull() & F.col("batch_id").isNotNull()).cast("int")
    counted = samples.agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(1 - complete), F.lit(0)).alias("missing"),
        F.coalesce(F.try_divide(F.sum(complete), F.count(F.lit(1))), F.lit(0.0)).alias("coverage"),
    )
    return with_row(counted, unmatched_findings(findings, samples).agg(F.count(F.lit(1)).alias("unmatched")))


def missing_metadata(samples: DataFrame) -> DataFrame:
    return samples.where("contributor_id is null or batch_id is null")


def unmatched_findings(findings: DataFrame, samples: DataFrame) -> DataFrame:
    """Assets with findings that no sample row describes."""
    return findings.select("asset_id").distinct().join(samples, "asset_id", "left_anti")


def unknown_batches(samples: DataFrame, batch_order: DataFrame) -> DataFrame:
    """Batches used by samples but absent from the explicit order: a violation."""
    used = samples.where("contributor_id is not null and batch_id is not null").select("batch_id").distinct()
    return used.join(batch_order, "batch_id", "left_anti")


def batch_series(batches: DataFrame) -> DataFrame:
    """Heat-map rows: the anomaly rates of a contributor in batch order.

    The list is as long as the batch order, which the caller declares explicitly.
    """
    return batches.groupBy("contributor_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "batch_id", "anomaly_rate"))),
            lambda b: F.struct(b["batch_id"].alias("batch_id"), b["anomaly_rate"].alias("anomaly_rate")),
        ).alias("series")
    )


def merged_batch_order(declared: DataFrame) -> DataFrame:
    """Batch order over several assets: first seen by (asset_id, pos) wins.

    ``declared(asset_id, pos, batch_id)`` -> ``(batch_id, pos)`` with dense positions from 1.
    """
    first = declared.groupBy("batch_id").agg(F.min(F.struct("asset_id", "pos")).alias("seen"))
    return numbered(first, ["seen", "batch_id"], "pos").select("batch_id", (F.col("pos") + 1).alias("pos"))


def namespaced(rows: DataFrame, asset: str, sample: str, out: str = "asset_id") -> DataFrame:
    """Samples of several assets under names that tell equal sample ids apart."""
    escaped = F.replace(F.replace(F.col(asset), F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F"))
    return rows.withColumn(out, F.concat(escaped, F.lit("/"), F.col(sample)))
