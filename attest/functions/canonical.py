"""Canonical text and digests of rows (JSON with sorted keys, six-decimal floats)."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FAIL = "non-finite numbers have no canonical form"
_LARGE = "numbers from 10^38 on have no canonical form"
_MILLION = 1_000_000.0
_HALF = float(1 << 63)


def _unfit(value: Column) -> Column:
    return F.isnan(value) | (F.abs(value) == float("inf"))


def _millionths(part: Column) -> Column:
    """Millionths of a number in [0, 1), rounded by its exact binary value, half to even.

    The product's rounding error is had exactly from the two halves of the number, and
    moves the result only where the product itself lies half-way.
    """
    product = part * _MILLION
    scaled = part * 134217729.0
    high = scaled - (scaled - part)
    error = (high * _MILLION - product) + (part - high) * _MILLION
    near = F.rint(product)
    off = product - near
    return F.when((off == 0.5) & (error > 0), near + 1).when((off == -0.5) & (error < 0), near - 1).otherwise(near).cast("bigint")


def canonical_float(value: Column) -> Column:
    """Six decimals of the exact binary value; JVM formatting would round the decimal text instead."""
    size = F.abs(value)
    whole = F.floor(size)
    parts = _millionths(F.when(size < _HALF, size - whole.cast("double")).otherwise(0.0))
    small = whole + F.when(parts == 1_000_000, 1).otherwise(0)
    # From 2^63 on numbers are whole: high and low part of 63 bits each.
    above = F.floor(size / _HALF)
    rest = (size - above.cast("double") * _HALF).cast("bigint").cast("decimal(38,0)")
    large = (above.cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + rest).cast("string")
    digits = F.when(size < _HALF, F.concat(small.cast("string"), F.lit("."), F.lpad((parts % 1_000_000).cast("string"), 6, "0"))).when(
        size < 1e38, F.concat(large, F.lit(".000000")))
    zero = (size < _HALF) & (small == 0) & (parts == 0)
    text = F.concat(F.when((value < 0) & ~zero, F.lit("-")).otherwise(F.lit("")), digits)
    fail = F.when(_unfit(value), F.raise_error(F.lit(_FAIL))).otherwise(F.raise_error(F.lit(_LARGE)))
    return F.when(_unfit(value) | (size >= 1e38), fail.cast("string")).otherwise(text)


def canonical_float_array(values: Column) -> Column:
    texts = F.transform(values, lambda v: F.coalesce(canonical_float(v), F.lit("null")))
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def canonical_epoch(ts: Column) -> Column:
    """Epoch seconds of a timestamp with six decimals, without leaving the JVM."""
    micros = F.unix_micros(ts)
    million = F.lit(1_000_000)
    return F.format_string("%d.%06d", F.floor(micros / million), F.pmod(micros, million))


def canonical_string(value: Column) -> Column:
    """A JSON string: quotes, backslashes and control characters escaped, UTF-8 kept."""
    inner = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    inner = F.replace(inner, F.lit('"'), F.lit('\\"'))
    for raw, name in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        inner = F.replace(inner, F.lit(raw), F.lit("\\" + name))
    rare = F.replace(F.replace(inner, F.lit("\b"), F.lit("\\b")), F.lit("\f"), F.lit("\\f"))
    for code in [c for c in range(32) if c not in (8, 9, 10, 12, 13)]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    quoted = F.when(value.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"), rare).otherwise(inner)
    return F.concat(F.lit('"'), quoted, F.lit('"'))


def canonical_value(column: Column, kind: T.DataType) -> Column:
    """Canonical text of one column by its type; null becomes ``null``."""
    if isinstance(kind, T.StringType):
        text = canonical_string(column)
    elif isinstance(kind, T.BooleanType):
        text = F.when(column, "true").otherwise("false")
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        text = column.cast("string")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = canonical_float(column.cast("double"))
    elif isinstance(kind, T.DecimalType):
        # As few decimals as it takes, so that the declared scale plays no part.
        plain = column.cast("string") if kind.scale == 0 else F.regexp_replace(column.cast("string"), r"\.?0+$", "")
        text = F.when(column == 0, "0").otherwise(plain)
    elif isinstance(kind, T.TimestampType):
        text = canonical_epoch(column)
    elif isinstance(kind, (T.DateType, T.TimestampNTZType)):
        text = F.concat(F.lit('"'), column.cast("string"), F.lit('"'))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('"'), F.lower(F.hex(column)), F.lit('"'))
    elif isinstance(kind, T.StructType):
        text = canonical_object({f.name: canonical_value(column.getField(f.name), f.dataType) for f in kind.fields})
    elif isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        entries = F.transform(F.array_sort(F.map_keys(column)), lambda k: F.concat(
            canonical_string(k), F.lit(":"), canonical_value(F.element_at(column, k), kind.valueType)))
        text = F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}"))
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
        text = canonical_float_array(column.cast("array<double>"))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(column, lambda v: canonical_value(v, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))
    else:
        raise TypeError(f"no canonical form for {kind.simpleString()}")
    return F.coalesce(F.when(column.isNotNull(), text), F.lit("null"))


def canonical_object(fields: dict[str, Column]) -> Column:
    """``{"a":..,"b":..}`` with sorted keys from already canonical values."""
    parts: list[Column] = [] if fields else [F.lit("{")]
    for i, name in enumerate(sorted(fields)):
        lead = ("{" if i == 0 else ",") + json.dumps(name, ensure_ascii=False) + ":"
        parts += [F.lit(lead), fields[name]]
    return F.concat(*parts, F.lit("}"))


def canonical_row(schema: T.StructType, names: list[str] | None = None) -> Column:
    kinds = {f.name: f.dataType for f in schema.fields}
    chosen = names or list(kinds)
    return canonical_object({n: canonical_value(F.col(n), kinds[n]) for n in chosen})


def digest(text: Column) -> Column:
    return F.sha2(text, 256)
