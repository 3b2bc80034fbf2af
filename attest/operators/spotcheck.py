"""Sampled re-execution of logged inferences."""

from __future__ import annotations

from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seeded_unit(seed: int, ident: Column) -> Column:
    """A number in [0, 1) fixed by the seed and the id."""
    prefix = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), ident.cast("string"))), 1, 8)
    return F.conv(prefix, 16, 10).cast("double") / F.lit(4294967296.0)


def spot_sample(records: DataFrame, ident: str, rate: float, seed: int = 0) -> DataFrame:
    """Each record is kept with probability ``rate``; a filter, no shuffle."""
    if not 0 <= rate <= 1:
        raise ValueError("rate must be in [0, 1]")
    return records.where(seeded_unit(seed, F.col(ident)) < F.lit(float(rate)))


def recompute(inputs: DataFrame, predict: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str) -> DataFrame:
    """Run a user's Arrow batch function over the stored inputs of sampled records."""
    return inputs.mapInArrow(predict, schema)


def spot_check(sampled: DataFrame, recomputed: DataFrame, ident: str) -> DataFrame:
    """Recorded against recomputed hashes: ``(ident, output_match, merkle_match, mismatches)``.

    A record without a recomputed row is a failed re-execution, never a match.
    """
    again = recomputed.select(
        ident, F.col("input_hash").alias("r_input"), F.col("output_hash").alias("r_output"),
        F.col("merkle_root").alias("r_root"), F.lit(True).alias("done"),
    )
    joined = sampled.select(ident, "input_hash", "output_hash", "merkle_root").join(again, ident, "left")
    done = F.coalesce("done", F.lit(False))
    same = lambda a, b: done & F.coalesce(F.col(a) == F.col(b), F.lit(False))
    labels = F.array_compact(F.array(
        F.when(~done, "re-execution error"),
        F.when(done & ~same("input_hash", "r_input"), "input_hash"),
        F.when(done & ~same("output_hash", "r_output"), "output_hash"),
        F.when(done & ~same("merkle_root", "r_root"),
               F.when(F.coalesce("merkle_root", F.lit("")) == "", "missing_merkle_root").otherwise("merkle_root")),
    ))
    return joined.select(
        ident, same("output_hash", "r_output").alias("output_match"),
        same("merkle_root", "r_root").alias("merkle_match"), labels.alias("mismatches"),
    )


def computation_status(reports: DataFrame) -> DataFrame:
    """One row ``(checked, status, fully_assured)``; sampling never assures everything."""
    clean = F.col("output_match") & F.col("merkle_match") & (F.size("mismatches") == 0)
    return reports.agg(F.count(F.lit(1)).alias("checked"), F.bool_and(clean).alias("_ok")).select(
        "checked",
        F.when(F.col("checked") == 0, "not checked").when(F.col("_ok"), "partial assurance")
        .otherwise("mismatch").alias("status"),
        F.lit(False).alias("fully_assured"),
    )
