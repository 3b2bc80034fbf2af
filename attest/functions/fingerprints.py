"""63-bit fingerprints of vectors and whole texts, and content hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 63


def vector_fingerprint(vec: Column) -> Column:
    """Sides of 63 fixed hyperplanes that together use every coordinate.

    With the differences d[j] = vec[j + 1] - vec[j], bit i tells whether the sum of d[i],
    d[i + 63], d[i + 126] ... is positive. Fewer than 64 coordinates are an error.
    """
    steps = F.zip_with(F.slice(vec, 2, F.size(vec) - 1), F.slice(vec, 1, F.size(vec) - 1), lambda b, a: b - a)
    short = F.raise_error(F.lit("vector_fingerprint needs at least 64 coordinates")).cast("bigint")

    def side(i: Column) -> Column:
        own = F.transform(F.sequence(i, F.size(steps) - 1, F.lit(BITS)), lambda j: F.get(steps, j))
        total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b)
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))

    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), side)
    fp = F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, b: a.bitwiseOR(b))
    return F.when(vec.isNull(), F.lit(None)).when(F.size(vec) <= BITS, short).otherwise(fp)


def text_fingerprints(rows: DataFrame, ident: str, text: str) -> DataFrame:
    """``(ident, fp)``: every word of the text votes on each bit of a 63-bit fingerprint.

    Votes are 63 counters per row, summed before the shuffle; a long text is
    exploded into words, never held as vote arrays.
    """
    words = rows.select(ident, F.explode(F.split(F.col(text), "[ \\t\\n\\r]+")).alias("word")).where("word <> ''")
    digest = F.md5(F.col("word"))
    hashed = words.select(
        ident,
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").alias("hi"),
        F.conv(F.substring(digest, 9, 8), 16, 10).cast("bigint").alias("lo"),
    )
    def bit(i: int) -> Column:
        word, place = ("lo", i) if i < 32 else ("hi", i - 32)
        return F.shiftright(F.col(word), place).bitwiseAND(F.lit(1))

    sums = hashed.groupBy(ident).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(bit(i)).alias(f"b{i}") for i in range(BITS)]
    )
    fp = None
    for i in range(BITS):
        part = F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
        fp = part if fp is None else fp.bitwiseOR(part)
    return sums.select(ident, fp.alias("fp"))


@F.arrow_udf(T.BinaryType())
def _float_bytes(vectors: pa.Array) -> pa.Array:
    """The values buffer of a batch cut by its offsets; a null inside a vector is NaN, a null vector null."""
    starts = vectors.offsets.to_numpy().astype(np.int64)
    values = pc.fill_null(vectors.values[starts[0]:starts[-1]], float("nan")).to_numpy().astype("<f8", copy=False)
    offsets = ((starts - starts[0]) * 8).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])
    return pc.if_else(vectors.is_valid(), found, pa.scalar(None, pa.binary())) if vectors.null_count else found


def vector_hash(vec: Column) -> Column:
    """SHA-256 over the little-endian float64 bytes of a vector."""
    return F.sha2(_float_bytes(vec.cast("array<double>")), 256)


def exact_duplicates(rows: DataFrame, ident: str, hash_col: str) -> DataFrame:
    """Groups of equal content: ``(hash, first_id, copies)``, reduced map-side."""
    return rows.groupBy(F.col(hash_col).alias("content_hash")).agg(
        F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("copies")
    ).where("copies > 1")
