"""The one findings schema every detector emits, and its constants."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the finding model.
MODALITIES = ("PIXEL", "EMBEDDING", "ANNOTATION", "ACTIVATION", "BEHAVIORAL")
ACTIONS = ("accept", "review", "quarantine")
ACCESS_LEVELS = ("black_box", "gray_box", "white_box")

_STRINGS = T.ArrayType(T.StringType())

PROVENANCE = T.StructType([
    T.StructField("detector_id", T.StringType()),
    T.StructField("version", T.StringType()),
    T.StructField("input_hashes", _STRINGS),
    T.StructField("config_hash", T.StringType()),
    T.StructField("detector_ids", _STRINGS),
    T.StructField("signal_ids", _STRINGS),
    T.StructField("modalities", _STRINGS),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
])

FINDING = T.StructType([
    T.StructField("asset_id", T.StringType()),
    T.StructField("finding_type", T.StringType()),
    T.StructField("severity", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("evidence", _STRINGS),
    T.StructField("modality", T.StringType()),
    T.StructField("provenance", PROVENANCE),
    T.StructField("recommended_action", T.StringType()),
    T.StructField("quarantine_scope", T.StringType()),
    T.StructField("access_assumptions", T.StringType()),
    T.StructField("counter_evidence", _STRINGS),
    # Stable input position: every "first in input order" rule breaks ties on it.
    T.StructField("ord", T.LongType()),
])


def config_hash(**settings: Any) -> str:
    """Digest of a detector's settings (driver-side, a handful of scalars)."""
    text = json.dumps(settings, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def _col(value: Any, kind: str = "string") -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast(kind)


def _strings(values: Any) -> Column:
    if isinstance(values, Column):
        return values
    parts = [_col(v) for v in (values or [])]
    return F.array(*parts).cast("array<string>")


def as_findings(
    df: DataFrame,
    *,
    asset_id: Column,
    finding_type: Any,
    severity: Any,
    confidence: Any,
    modality: Any,
    detector_id: Any,
    evidence: Any = None,
    counter_evidence: Any = None,
    input_hashes: Any = None,
    config: Any = "",
    action: Any = "review",
    scope: Any = "sample",
    access: Any = "black_box",
    signal_ids: Any = None,
    attrs: Column | None = None,
    ord: Any = 0,
) -> DataFrame:
    """Project ``df`` onto the findings schema; a narrow stage, no shuffle."""
    empty_map = F.create_map().cast("map<string,string>")
    provenance = F.struct(
        _col(detector_id).alias("detector_id"),
        F.lit("1.0.0").alias("version"),
        _strings(input_hashes).alias("input_hashes"),
        _col(config).alias("config_hash"),
        _strings(None).alias("detector_ids"),
        _strings(signal_ids).alias("signal_ids"),
        _strings(None).alias("modalities"),
        (attrs if attrs is not None else empty_map).alias("attrs"),
    )
    return df.select(
        asset_id.cast("string").alias("asset_id"),
        _col(finding_type).alias("finding_type"),
        _col(severity, "double").cast("double").alias("severity"),
        _col(confidence, "double").cast("double").alias("confidence"),
        _strings(evidence).alias("evidence"),
        _col(modality).alias("modality"),
        provenance.alias("provenance"),
        _col(action).alias("recommended_action"),
        _col(scope).alias("quarantine_scope"),
        _col(access).alias("access_assumptions"),
        _strings(counter_evidence).alias("counter_evidence"),
        _col(ord, "bigint").cast("bigint").alias("ord"),
    )


def counts_as_anomaly() -> Column:
    """A finding carries weight when it is positive and not accepted."""
    return (
        (F.col("severity") > 0)
        & (F.col("confidence") > 0)
        & (F.lower("recommended_action") != "accept")
    )


def check_scores(df: DataFrame) -> DataFrame:
    """Fail the job on a severity or confidence outside [0, 1] (NaN included)."""
    def bounded(name: str) -> Column:
        value = F.col(name)
        ok = value.between(0.0, 1.0) & ~F.isnan(value)
        return F.when(ok, value).otherwise(
            F.raise_error(F.lit(f"{name} must be finite and in [0, 1]"))
        ).cast("double")

    return df.withColumn("severity", bounded("severity")).withColumn("confidence", bounded("confidence"))
