"""Building blocks that keep results exact without one task holding a hot group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.session import settle

# A key with more rows than this is spread by ``salted_join``, over one task for each such lot.
HOT_ROWS = 200_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key with more than ``hot_rows`` rows, and the number of salts its rows ask for."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > hot_rows)
        .select(*keys, F.ceil(F.col("_n") / F.lit(hot_rows)).cast("int").alias("_salts"))
    )


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Equi-join in which a hot key of ``left`` is spread over as many tasks as it has lots of rows.

    Only right rows of hot keys are copied (once per salt), so the extra volume is small.
    ``how`` may be inner or left. Exact: every left row meets each matching right row once.
    """
    hot = hot_keys(left, keys, hot_rows)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce("_salts", F.lit(1))).cast("int")
    salted_left = left.join(hot, keys, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = right.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")


# Distances of the cut points from a percentile: thin ranges next to it, wide ones farther off.
_NEAR = (2e-4, 2e-3, 2e-2, 0.2)


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key: one row per key, one column per name.

    Cut points from an approximate sketch split each key's values into ranges, thin ones
    around the percentiles. Range totals, counted exactly, tell which ranges hold the
    wanted ranks; only those are sorted, value by value. The sketch decides how thin they
    are, never the result, and the path is the same for every size.
    """
    source = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value))
    probes = sorted({min(1.0, max(0.0, q + side * s)) for q in ranks.values() for s in _NEAR for side in (-1, 1)})
    grouped = source.groupBy(*keys) if keys else source.groupBy()
    stats = grouped.agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(value, probes, 20_000).alias("_cut"))
    ranged = _attach(source, stats, keys).withColumn("_range", F.size(F.filter("_cut", lambda e: e < F.col(value))))

    totals = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    # At most one row per cut point and key.
    lower = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("_start", F.coalesce(F.sum("_c").over(lower), F.lit(0)))
    position = {name: F.lit(q) * (F.col("_n") - 1) for name, q in ranks.items()}
    wanted = [end(p) for p in position.values() for end in (F.floor, F.ceil)]
    holds = reduce(lambda a, b: a | b, [(F.col("_start") <= w) & (w < F.col("_start") + F.col("_c")) for w in wanted])
    needed = placed.where(holds).select(*keys, "_range", "_start")

    counted = ranged.join(needed, [*keys, "_range"]).groupBy(*keys, "_range", "_start", "_n", F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumn("_hi", F.col("_start") + F.sum("_c").over(running)).withColumn("_lo", F.col("_hi") - F.col("_c"))
    at = lambda r: F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col("_v")))
    picked = counted.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        *[at(F.floor(p)).alias(f"_b_{name}") for name, p in position.items()],
        *[at(F.ceil(p)).alias(f"_a_{name}") for name, p in position.items()],
    )
    share = {name: F.lit(q) * (F.col("n") - 1) - F.floor(F.lit(q) * (F.col("n") - 1)) for name, q in ranks.items()}
    return picked.select(*keys, "n", *[
        (F.col(f"_b_{name}") + (F.col(f"_a_{name}") - F.col(f"_b_{name}")) * share[name]).alias(name) for name in ranks])


def with_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate as a scalar subquery (no join)."""
    packed = one.select(F.struct(*one.columns)).scalar()
    return rows.withColumn("_one", packed).select(*rows.columns, "_one.*")


def _attach(rows: DataFrame, per_key: DataFrame, keys: list[str]) -> DataFrame:
    """Add one-row-per-key columns."""
    return rows.join(per_key, keys) if keys else with_row(rows, per_key)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with dense numbers from 0 in the given order, sorted in ranges and never in one task.

    Rows are numbered inside their range; one number per range is added to that.
    """
    ranged = settle(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    # One row per range: the only window without a partition key.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return ranged.withColumn("_part", part).join(starts, "_part").select(
        *df.columns, (F.col("_start") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def prefix_totals(df: DataFrame, order: str, totals: list[str], buckets: int = 64) -> DataFrame:
    """Running sums of ``totals`` in descending ``order``, as ``cum_<name>``.

    ``df`` has one row per distinct ``order`` value. Cut points (at most
    ``buckets`` numbers reach the driver) split the order into ranges; range totals
    give each range its offset, and windows only run inside a range.
    """
    cuts = sorted(set(df.approxQuantile(order, [i / buckets for i in range(1, buckets)], 0.005)))
    edges = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    # F.filter over a sorted literal array: bucket = number of cuts <= value.
    bucketed = df.withColumn("_bucket", F.size(F.filter(edges, lambda e: e <= F.col(order))))
    sums = bucketed.groupBy("_bucket").agg(*[F.sum(t).alias(f"_t_{t}") for t in totals])
    # At most ``buckets`` rows: the only window without a partition key.
    over = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "_bucket", *[F.coalesce(F.sum(f"_t_{t}").over(over), F.lit(0)).alias(f"_o_{t}") for t in totals]
    )
    local = Window.partitionBy("_bucket").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bucketed.join(F.broadcast(offsets), "_bucket")
        .select(
            *df.columns,
            *[(F.sum(t).over(local) + F.col(f"_o_{t}")).alias(f"cum_{t}") for t in totals],
        )
    )


def pack_blocks(
    df: DataFrame, keys: list[str], ident: str, payload: list[str], size: int = 1024
) -> DataFrame:
    """Group rows into blocks of about ``size`` rows per key: ``(keys.., block, rows)``.

    The number of blocks of a key follows its row count, so no group grows with
    the data. Block numbers come from a hash of ``ident`` and are stable.
    """
    counts = (df.groupBy(*keys) if keys else df.groupBy()).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / F.lit(size)).cast("int")
    placed = _attach(df, counts, keys).withColumn("n_blocks", F.greatest(blocks, F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64(F.col(ident)), F.col("n_blocks")).cast("int"))
    return placed.groupBy(*keys, "n_blocks", "block").agg(
        F.collect_list(F.struct(ident, *payload)).alias("rows")
    )
