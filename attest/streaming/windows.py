"""Windowed measures over event streams and the handling of late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.scale import with_row
from attest.functions.vectors import bin_index
from attest.operators.drift import kl_of


def stream_anomaly_rate(events: DataFrame, time: str, contributor: str, anomalous: Column,
                        width: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Anomalies over samples per contributor and window; tumbling unless ``slide`` is given."""
    window = F.window(F.col(time), width, slide) if slide else F.window(F.col(time), width)
    return events.withWatermark(time, delay).groupBy(window.alias("window"), F.col(contributor).alias("contributor_id")).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(anomalous.cast("int")).cast("bigint").alias("anomalies")
    ).select(
        F.col("window.start").alias("window_start"), "contributor_id", "samples", "anomalies",
        (F.col("anomalies") / F.col("samples")).alias("anomaly_rate"),
    )


def reference_histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """``(bin, reference_n)`` of a table outside the stream, with at most as many rows as bins."""
    return rows.groupBy(bin_index(F.col(value), edges).alias("bin")).agg(F.count(F.lit(1)).alias("reference_n"))


def stream_histogram(events: DataFrame, time: str, value: str, edges: list[float],
                     width: str = "1 day", delay: str = "1 hour", reference: DataFrame | None = None) -> DataFrame:
    """Counts per window and bin; the bins are fixed by the reference.

    With ``reference(bin, reference_n)``, every micro-batch meets this static table, and its rows carry
    the reference's count of their bin.
    """
    counts = events.withWatermark(time, delay).groupBy(
        F.window(F.col(time), width).alias("window"), bin_index(F.col(value), edges).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), "bin", "n")
    if reference is None:
        return counts
    return counts.join(reference, "bin", "left").select("window_start", "bin", "n", F.coalesce("reference_n", F.lit(0)).alias("reference_n"))


def window_kl(counts: DataFrame, reference: DataFrame, bins: int) -> DataFrame:
    """KL of the reference against every window: ``(window_start, kl)``.

    ``counts(window_start, bin, n)``, ``reference(bin, reference_n)`` with at most ``bins`` rows.
    """
    def packed(df: DataFrame, keys: list[str]) -> DataFrame:
        sums = [F.coalesce(F.sum(F.when(F.col("bin") == b, F.col("n"))), F.lit(0)).cast("double") for b in range(bins)]
        return (df.groupBy(*keys) if keys else df.groupBy()).agg(F.array(*sums).alias("h"))

    base = packed(reference.withColumnRenamed("reference_n", "n"), []).withColumnRenamed("h", "reference_h")
    return with_row(packed(counts, ["window_start"]), base).select(
        "window_start", kl_of(F.col("reference_h"), F.col("h")).alias("kl")
    )


def run_to_files(stream: DataFrame, folder: str, mode: str = "update") -> None:
    """Drain what is available now; every micro-batch replaces its own folder, so retries are safe."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()


def latest_rows(spark: SparkSession, folder: str, schema: str, keys: list[str]) -> DataFrame:
    """The last update of each key over all micro-batches written by ``run_to_files``."""
    rows = spark.read.schema(schema + ", batch int").parquet(f"{folder}/out")
    values = [c for c in rows.columns if c not in keys and c != "batch"]
    if not values:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def split_late(stream: DataFrame, time: str, delay_seconds: int, folder: str) -> None:
    """Write rows in time and rows behind the watermark to separate folders.

    The watermark of a micro-batch is the largest event time of all earlier ones
    minus the delay, as Spark's own; the maxima are kept in files (one row per
    micro-batch), so a restart or a lost executor finds the same watermark.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        earlier = None
        if number > 0:
            marks = spark.read.schema("top timestamp, batch int").parquet(f"{folder}/marks")
            earlier = marks.where(F.col("batch") < number).agg(F.max("top").alias("top")).first()["top"]
        if earlier is None:
            late = F.lit(False)
        else:
            limit = F.lit(earlier) - F.expr(f"make_dt_interval(0, 0, 0, {int(delay_seconds)})")
            late = F.col(time) < limit
        marked = batch.withColumn("late", late)
        marked.where("late").drop("late").write.mode("overwrite").parquet(f"{folder}/late/batch={number}")
        marked.where("not late").drop("late").write.mode("overwrite").parquet(f"{folder}/in_time/batch={number}")
        batch.agg(F.max(time).alias("top")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={number}")

    query = (
        stream.writeStream.option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
