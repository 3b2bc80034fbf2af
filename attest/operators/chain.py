"""Hash-chained inference logs: append, integrity, authenticity, freshness."""

from __future__ import annotations

import hashlib
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.canonical import canonical_epoch, canonical_object, canonical_string

# The fields a record hash covers.
TEXT_FIELDS = ["input_hash", "model_digest", "config_hash", "output_hash", "nonce",
               "previous_record_hash", "merkle_root", "consumer_id"]
# Positions per chunk of the two-phase running maximum.
CHUNK = 100_000
# The reasons of freshness failures.
REPLAYED = "Nonce replay detected"
REGRESSED = "Sequence number regression or replay"
UNNAMED = "Missing nonce"


def _fields(skip: str | None = None) -> dict[str, Column]:
    text = lambda c: F.coalesce(canonical_string(F.col(c)), F.lit("null"))
    out = {c: text(c) for c in TEXT_FIELDS if c != skip}
    out["sequence_number"] = F.col("sequence_number").cast("string")
    out["timestamp"] = canonical_epoch(F.col("timestamp"))
    return out


def record_hash() -> Column:
    """SHA-256 over the canonical JSON of the ten record fields; JVM-side."""
    return F.sha2(canonical_object(_fields()), 256)


def chain_append(records: DataFrame) -> DataFrame:
    """Link unlinked records ``(log_id, pos, ..)`` into one chain per log.

    Adds sequence_number, previous_record_hash and record_hash. A hash chain is
    sequential within a log by definition; logs run in parallel, each partition is
    streamed in (log, position) order and only the last hash is carried.
    """
    fields = _fields(skip="previous_record_hash")
    before = [n for n in sorted(fields) if n < "previous_record_hash"]
    after = [n for n in sorted(fields) if n > "previous_record_hash" and n != "sequence_number"]
    head = F.concat(F.lit("{"), *[F.concat(F.lit(f'"{n}":'), fields[n], F.lit(",")) for n in before])
    tail = F.concat(*[F.concat(F.lit(f',"{n}":'), fields[n]) for n in after], F.lit("}"))
    source = records.withColumn("sequence_number", F.lit(0)).select(
        "log_id", "pos", head.alias("head"), tail.alias("tail")
    ).repartition("log_id").sortWithinPartitions("log_id", "pos")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log, last, number = None, "", 0
        for batch in batches:
            numbers, previous, hashes = [], [], []
            for this, start, end in zip(*(batch.column(c).to_pylist() for c in ("log_id", "head", "tail"))):
                if this != log:
                    log, last, number = this, "", 0
                text = f'{start}"previous_record_hash":"{last}","sequence_number":{number}{end}'
                numbers.append(number)
                previous.append(last)
                last = hashlib.sha256(text.encode()).hexdigest()
                hashes.append(last)
                number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("log_id"), batch.column("pos"), pa.array(numbers, pa.int64()),
                 pa.array(previous, pa.string()), pa.array(hashes, pa.string())],
                names=["log_id", "pos", "sequence_number", "previous_record_hash", "record_hash"],
            )

    log_type = records.schema["log_id"].dataType.simpleString()
    pos_type = records.schema["pos"].dataType.simpleString()
    linked = source.mapInArrow(
        link,
        f"log_id {log_type}, pos {pos_type}, sequence_number bigint, previous_record_hash string, record_hash string",
    )
    kept = [c for c in records.columns if c not in ("sequence_number", "previous_record_hash", "record_hash")]
    return records.select(*kept).join(linked, ["log_id", "pos"])


def chain_integrity(records: DataFrame) -> DataFrame:
    """Positions whose back link is not the hash of the record before them.

    A position self-join: no window over a whole log, so one giant log is as
    parallel as many small ones. Positions are dense from 0 within a log.
    """
    hashed = records.select("log_id", "pos", record_hash().alias("h"))
    previous = hashed.select("log_id", (F.col("pos") + 1).alias("pos"), F.col("h").alias("expected"))
    joined = records.select("log_id", "pos", "previous_record_hash").join(previous, ["log_id", "pos"], "left")
    expected = F.coalesce("expected", F.lit(""))
    return joined.where(~F.col("previous_record_hash").eqNullSafe(expected)).select(
        "log_id", "pos", F.lit("integrity").alias("property"), F.lit("chain break").alias("reason")
    )


def chain_authenticity(records: DataFrame) -> DataFrame:
    """``signature_ok`` null means missing, false means invalid."""
    reason = F.when(F.col("signature_ok").isNull(), "missing signature").when(~F.col("signature_ok"), "signature invalid")
    return records.select(
        "log_id", "pos", F.lit("authenticity").alias("property"), reason.alias("reason")
    ).where(F.col("reason").isNotNull())


def freshness(records: DataFrame, last_sequence: DataFrame | None = None,
              seen_nonces: DataFrame | None = None) -> DataFrame:
    """Replay and regression per log: ``(log_id, pos, property, reason)``.

    ``last_sequence(log_id, last)`` and ``seen_nonces(log_id, nonce)`` hold the state of
    earlier clean batches. Failing records still move the scan on. The running
    maximum is taken in chunks of positions, then across chunk maxima.
    """
    rows = records.select("log_id", "pos", "sequence_number", F.coalesce("nonce", F.lit("")).alias("nonce"))
    # Blank nonces may be most of a log: their first position goes with the chunks, and only others are a key.
    named, blank = rows.where("nonce <> ''"), F.col("nonce") == ""
    first = named.groupBy("log_id", "nonce").agg(F.min("pos").alias("first_pos"))
    if seen_nonces is not None:
        seen = seen_nonces.where("nonce <> ''").select("log_id", "nonce", F.lit(True).alias("seen")).distinct()
        first = first.join(seen, ["log_id", "nonce"], "left").withColumn(
            "first_pos", F.when(F.col("seen"), F.lit(-1)).otherwise(F.col("first_pos"))
        ).drop("seen")
    placed = named.join(first, ["log_id", "nonce"]).select(*rows.columns, "first_pos").unionByName(
        rows.where(blank).withColumn("first_pos", F.lit(None).cast(first.schema["first_pos"].dataType)))
    chunked = placed.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    # First allowed sequence is 0, so the scan starts at -1.
    peaks = rows.groupBy("log_id", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(
        F.max("sequence_number").alias("peak"), F.min(F.when(blank, F.col("pos"))).alias("blank")
    )
    whole = Window.partitionBy("log_id").orderBy("chunk")
    earlier, all_ = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = peaks.select("log_id", "chunk", F.coalesce(F.max("peak").over(earlier), F.lit(-1)).alias("carried"),
                           F.min("blank").over(all_).alias("first_blank"))
    if last_sequence is not None:
        carried = carried.join(last_sequence, "log_id", "left").select(
            "log_id", "chunk", F.greatest("carried", F.coalesce("last", F.lit(-1))).alias("carried"), "first_blank"
        )
    if seen_nonces is not None:
        before = seen_nonces.where(blank).select("log_id", F.lit(-1).alias("seen_blank")).distinct()
        carried = carried.join(before, "log_id", "left").select("log_id", "chunk", "carried", F.coalesce("seen_blank", "first_blank").alias("first_blank"))
    local = Window.partitionBy("log_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    scanned = chunked.join(carried, ["log_id", "chunk"]).withColumns({
        "top": F.greatest(F.col("carried"), F.coalesce(F.max("sequence_number").over(local), F.lit(-1))),
        "first_pos": F.when(blank, F.col("first_blank")).otherwise(F.col("first_pos"))})
    reason = (
        F.when(F.col("first_pos") < F.col("pos"), REPLAYED)
        .when(F.col("sequence_number") <= F.col("top"), REGRESSED)
        .when(F.col("nonce") == "", UNNAMED)
    )
    return scanned.select("log_id", "pos", F.lit("freshness").alias("property"), reason.alias("reason")).where(
        F.col("reason").isNotNull()
    )


def committed_state(records: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State of logs without any failure: ``(log_id, last)`` and ``(log_id, nonce)``."""
    clean = records.join(failures.select("log_id").distinct(), "log_id", "left_anti")
    last = clean.groupBy("log_id").agg(F.max("sequence_number").alias("last"))
    return last, clean.select("log_id", F.coalesce("nonce", F.lit("")).alias("nonce")).distinct()


def verify_chain(records: DataFrame) -> DataFrame:
    """``(log_id, records, integrity, authenticity, freshness, freshness_checked, passed)``.

    Freshness is only assessed for logs whose chain and signatures are clean.
    """
    broken = chain_integrity(records).unionByName(chain_authenticity(records))
    stale = freshness(records).join(broken.select("log_id").distinct(), "log_id", "left_anti")
    failures = broken.unionByName(stale)
    count = lambda p: F.sum((F.col("property") == p).cast("int")).cast("bigint").alias(p)
    per_log = failures.groupBy("log_id").agg(count("integrity"), count("authenticity"), count("freshness"))
    totals = records.groupBy("log_id").agg(F.count(F.lit(1)).alias("records"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return totals.join(per_log, "log_id", "left").select(
        "log_id", "records", zero("integrity"), zero("authenticity"), zero("freshness")
    ).withColumn("freshness_checked", (F.col("integrity") + F.col("authenticity")) == 0).withColumn(
        "passed", (F.col("integrity") + F.col("authenticity") + F.col("freshness")) == 0
    )
