from pyspark.sql import functions as F

from attest.schemas import as_findings


def make_findings(spark, rows):
    """Findings from dicts; anything left out takes a plain default."""
    base = dict(asset_id="a", finding_type="perceptual_duplicate", severity=0.6, confidence=0.6, modality="PIXEL",
                detector_id="d1", evidence="seen", counter="maybe", signal=None, action="review", scope="sample",
                access="black_box", ord=0)
    full = [{**base, "ord": i, **row} for i, row in enumerate(rows)]
    kinds = dict(severity="double", confidence="double", ord="bigint")
    schema = ", ".join(f"{k} {kinds.get(k, 'string')}" for k in base)
    df = spark.createDataFrame([tuple(f[k] for k in base) for f in full], schema)
    one = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    return as_findings(df, asset_id=F.col("asset_id"), finding_type=F.col("finding_type"), severity=F.col("severity"),
                       confidence=F.col("confidence"), modality=F.col("modality"), detector_id=F.col("detector_id"),
                       evidence=one("evidence"), counter_evidence=one("counter"), signal_ids=one("signal"),
                       action=F.col("action"), scope=F.col("scope"), access=F.col("access"), ord=F.col("ord"))


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
