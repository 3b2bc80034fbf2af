"""Streaming queries: file streams over the event table, drained and compared with batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.vectors import linspace
from attest.plans import roles
from attest.plans.provenance import _FRESH
from attest.plans.registry import query, r, table
from attest.plans.roles import with_roles
from attest.session import scratch, settle
from attest.streaming import freshness as S
from attest.streaming import windows as W

_DAY = "epoch_us(date_trunc('day', ts)) // 1000000"


def _in_seconds(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.unix_timestamp(F.col("window_start").cast("timestamp")))


def _events(spark, folder):
    """The event table as a file stream."""
    schema = table(spark, folder, "events").schema
    # A micro-batch takes a bounded number of files.
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 64).parquet(folder)
    # The table stores wall-clock times: read them as UTC whatever the session zone.
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))")
    return raw.withColumn("ts", F.timestamp_micros(micros))


@query("stream_anomaly_rate", f"""
SELECT CAST({_DAY} AS BIGINT) AS window_start, user_id % 20 AS contributor_id, count(*) AS samples, count(*) FILTER (value > 20) AS anomalies,
  round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS anomaly_rate FROM events GROUP BY 1, 2""")
def stream_anomaly_rate(spark, folder):
    events = _events(spark, folder).withColumn("contributor", F.col("user_id") % 20)
    rates = W.stream_anomaly_rate(events, "ts", "contributor", F.col("value") > 20)
    place = scratch(spark, "rates")
    W.run_to_files(_in_seconds(rates), place)
    out = W.latest_rows(spark, place, "window_start bigint, contributor_id bigint, samples bigint, anomalies bigint, anomaly_rate double",
                        ["window_start", "contributor_id"])
    return out.withColumn("anomaly_rate", r("anomaly_rate"))


@query("stream_sliding_rate", """
SELECT CAST(epoch_us(date_trunc('day', ts)) // 1000000 - d * 86400 AS BIGINT) AS window_start, event_type AS contributor_id, count(*) AS samples,
  count(*) FILTER (value > 20) AS anomalies FROM events, range(2) AS o(d) GROUP BY 1, 2""")
def stream_sliding_rate(spark, folder):
    rates = W.stream_anomaly_rate(_events(spark, folder), "ts", "event_type", F.col("value") > 20, "2 days", "1 day")
    place = scratch(spark, "sliding")
    W.run_to_files(_in_seconds(rates), place)
    return W.latest_rows(spark, place, "window_start bigint, contributor_id string, samples bigint, anomalies bigint",
                         ["window_start", "contributor_id"])


_BINS = 10


@query("stream_marginal_kl", f"""
WITH b AS (SELECT CAST({_DAY} AS BIGINT) AS window_start, CAST(least(floor(value / 5), 9) AS INT) AS bin FROM events),
past AS (SELECT CAST(least(floor(l_quantity / 5), 9) AS INT) AS bin FROM lineitem),
ref AS (SELECT g.bin, count(past.bin) AS n FROM range({_BINS}) AS g(bin) LEFT JOIN past ON past.bin = g.bin GROUP BY g.bin),
h AS (SELECT w.window_start, g.bin, count(b.bin) AS q FROM (SELECT DISTINCT window_start FROM b) w CROSS JOIN range({_BINS}) AS g(bin)
  LEFT JOIN b ON b.window_start = w.window_start AND b.bin = g.bin GROUP BY ALL),
s AS (SELECT window_start, h.bin, n / greatest(max(n) OVER w, 1) + 1e-10 AS p, q / greatest(max(q) OVER w, 1) + 1e-10 AS q FROM h JOIN ref ON ref.bin = h.bin WINDOW w AS (PARTITION BY window_start)),
t AS (SELECT window_start, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM s WINDOW w AS (PARTITION BY window_start))
SELECT window_start, round(greatest(0, sum(p * ln(p / q))), 6) AS kl FROM t GROUP BY window_start""")
def stream_marginal_kl(spark, folder):
    """The quantities of past orders are the reference; the stream's values are measured against them."""
    edges = linspace(0.0, 50.0, _BINS)
    past = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("double").alias("value"))
    reference = settle(W.reference_histogram(past, "value", edges))
    counts = W.stream_histogram(_events(spark, folder), "ts", "value", edges, reference=reference)
    place = scratch(spark, "histogram")
    W.run_to_files(_in_seconds(counts), place)
    latest = W.latest_rows(spark, place, "window_start bigint, bin int, n bigint, reference_n bigint", ["window_start", "bin"])
    return W.window_kl(latest, reference, _BINS).select("window_start", r("kl").alias("kl"))


@query("stream_against_reference", f"""
WITH b AS (SELECT CAST({_DAY} AS BIGINT) AS window_start, CAST(least(floor(value / 5), 9) AS INT) AS bin FROM events),
ref AS (SELECT CAST(least(floor(l_quantity / 5), 9) AS INT) AS bin, count(*) AS reference_n FROM lineitem GROUP BY 1)
SELECT window_start, bin, count(*) AS n, coalesce(any_value(reference_n), 0) AS reference_n FROM b LEFT JOIN ref USING (bin) GROUP BY ALL""")
def stream_against_reference(spark, folder):
    edges = linspace(0.0, 50.0, _BINS)
    past = table(spark, folder, "lineitem").select(F.col("l_quantity").cast("double").alias("value"))
    counts = W.stream_histogram(_events(spark, folder), "ts", "value", edges, reference=settle(W.reference_histogram(past, "value", edges)))
    place = scratch(spark, "bins")
    W.run_to_files(_in_seconds(counts), place)
    return W.latest_rows(spark, place, "window_start bigint, bin int, n bigint, reference_n bigint", ["window_start", "bin"])


@query("freshness_stream", with_roles("replay", body=_FRESH))
def freshness_stream(spark, folder):
    text = roles.expand(roles.ROLES["replay"], 0)
    records = spark.sql(text, events=_events(spark, folder))
    place = scratch(spark, "replay")
    W.run_to_files(S.freshness_stream(records), place, "append")
    return spark.read.schema("log_id bigint, pos bigint, property string, reason string, batch int") \
        .parquet(f"{place}/out").select("log_id", "pos", "reason")


@query("stream_late_side_output", """
WITH e AS (SELECT ts, event_id % 10 = 0 AS second FROM events), m AS (SELECT max(ts) AS top FROM e WHERE NOT second)
SELECT 'in_time' AS side, count(*) FILTER (NOT (second AND ts < top - INTERVAL 1 HOUR)) AS records FROM e, m
UNION ALL SELECT 'late', count(*) FILTER (second AND ts < top - INTERVAL 1 HOUR) FROM e, m""")
def stream_late_side_output(spark, folder):
    """A tenth of the events arrives after all others: the watermark has passed most of it."""
    place, inbox = scratch(spark, "late"), scratch(spark, "inbox")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST(ts AS timestamp_ntz))")
    events = table(spark, folder, "events").withColumn("ts", F.timestamp_micros(micros))
    for arrival in (F.col("event_id") % 10 != 0, F.col("event_id") % 10 == 0):
        events.where(arrival).write.mode("append").parquet(inbox)
        W.split_late(spark.readStream.schema(events.schema).parquet(inbox), "ts", 3600, place)
    side = lambda name: spark.read.schema(events.schema).parquet(f"{place}/{name}").agg(F.count(F.lit(1)).alias("records")).select(
        F.lit(name).alias("side"), "records")
    return side("in_time").unionByName(side("late"))
