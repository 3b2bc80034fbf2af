"""Model-behaviour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions import vectors as V
from attest.functions.scale import numbered
from attest.operators import behaviour as B
from attest.plans.registry import query, r, table
from attest.plans.roles import role, with_roles


def _logits(spark, folder):
    """Whole vectors as the logits of a model per label group."""
    return role(spark, folder, "samples").select(
        "ord", F.concat(F.lit("m"), (F.col("label") % 4).cast("string")).alias("model"), F.col("vec").alias("logits"))


@query("reference_battery", with_roles("samples", body="""
+ l AS (SELECT ord, 'm' || TEXT(label % 4) AS model, unnest(range(1, len(vec) + 1)) AS pos, vec FROM samples),
f AS (SELECT model, pos, ord, vec[pos] AS v FROM l),
b AS (SELECT model, pos, avg(v) AS m, stddev_pop(v) AS s FROM f WHERE ord % 3 = 0 GROUP BY ALL),
c AS (SELECT model, pos, avg(v + CASE WHEN model = 'm2' THEN 0.3 ELSE 0 END) AS m, stddev_pop(v) AS s FROM f WHERE ord % 3 > 0 GROUP BY ALL)
SELECT b.model, round(max(greatest(abs(c.m - b.m), abs(c.s - b.s)) / greatest(b.s, 1)), 6) AS deviation,
  max(greatest(abs(c.m - b.m), abs(c.s - b.s)) / greatest(b.s, 1)) > 0.25 AS shifted FROM b JOIN c USING (model, pos) GROUP BY b.model"""))
def reference_battery(spark, folder):
    logits = _logits(spark, folder)
    base = B.output_statistics(logits.where("ord % 3 = 0"), ["model"], "logits")
    lift = F.when(F.col("model") == "m2", 0.3).otherwise(0.0)
    now = logits.where("ord % 3 > 0").withColumn("logits", F.transform("logits", lambda v: v + lift))
    return B.reference_battery(now, base, "model", "logits").select("model", r("deviation").alias("deviation"), "shifted")


@query("weight_statistics", """
WITH s AS (SELECT p_brand AS tensor, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, sqrt(sum(p_retailprice * p_retailprice)) AS n FROM part GROUP BY 1),
b AS (SELECT p_brand AS tensor, avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, sqrt(sum(p_retailprice * p_retailprice)) AS n FROM part WHERE p_size <= 25 GROUP BY 1
  UNION ALL SELECT 'absent', 1, 1, 1)
SELECT tensor, round(greatest(abs(s.m - b.m) / greatest(abs(b.m), 1e-6), abs(s.s - b.s) / greatest(abs(b.s), 1e-6), abs(s.n - b.n) / greatest(abs(b.n), 1e-6)), 6) AS deviation,
  s.m IS NULL AS missing FROM b LEFT JOIN s USING (tensor)""".replace("round(greatest(", "round(CASE WHEN s.m IS NOT NULL THEN greatest(").replace(", 1e-6)), 6)", ", 1e-6)) END, 6)"))
def weight_statistics(spark, folder):
    tensors = table(spark, folder, "part").select(F.col("p_brand").alias("tensor"), F.col("p_retailprice").alias("value"), "p_size")
    base = B.tensor_statistics(tensors.where("p_size <= 25"))
    absent = spark.createDataFrame([("absent", 1.0, 1.0, 1.0)], base.schema)
    return B.weight_statistics(tensors, base.unionByName(absent)).select("tensor", r("deviation").alias("deviation"), "missing")


@query("degraded_check", """
SELECT 'c' || CAST(c_custkey AS VARCHAR) AS asset_id, 'required input is missing' AS reason FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def degraded_check(spark, folder):
    wanted = table(spark, folder, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("model"))
    given = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model"))
    return B.degraded_check(wanted, given, "model")


_FLIP_SQL = """
+ a AS (SELECT ord, vec AS l, list_concat([0::DOUBLE], vec[2:8], [0::DOUBLE], vec[10:]) AS z FROM samples)
SELECT ord, CAST(list_position(l, list_max(l)) - 1 AS BIGINT) AS before_class, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS after_class,
  list_position(l, list_max(l)) = list_position(z, list_max(z)) AS persists, round(list_distance(l, z), 6) AS delta FROM a
"""


@query("prediction_flips", with_roles("samples", body=_FLIP_SQL))
def prediction_flips(spark, folder):
    before = _logits(spark, folder)
    masked = before.withColumn("logits", V.mask_positions(F.col("logits"), F.array(F.lit(0), F.lit(8))))
    return B.prediction_flips(before, masked, "ord", "logits").select(
        "ord", F.col("before_class").cast("bigint").alias("before_class"), F.col("after_class").cast("bigint").alias("after_class"),
        "persists", r("delta").alias("delta"))


@query("mask_region", with_roles("samples", body="""
SELECT ord, round(list_sum([CASE WHEN i % 8 BETWEEN 2 AND 4 AND i // 8 BETWEEN 1 AND 5 THEN 0 ELSE vec[i + 1] END FOR i IN range(64)]), 6) AS total FROM samples"""))
def mask_region(spark, folder):
    masked = V.mask_region(F.col("vec"), 8, 1, 2, 1, 3, 5)
    return role(spark, folder, "samples").select("ord", r(V.total(masked)).alias("total"))


@query("mask_channels", with_roles("samples", body="""
SELECT ord, round(list_sum([CASE WHEN i % 4 IN (1, 3) THEN 0.5 ELSE vec[i + 1] END FOR i IN range(64)]), 6) AS total FROM samples"""))
def mask_channels(spark, folder):
    masked = V.mask_channels(F.col("vec"), 4, [1, 3], 0.5)
    return role(spark, folder, "samples").select("ord", r(V.total(masked)).alias("total"))


@query("low_activation_neurons", with_roles("samples", body="""
+ f AS (SELECT pos, vec[pos + 1] AS v FROM (SELECT vec, unnest(range(64)) AS pos FROM samples))
SELECT CAST(pos AS INT) AS pos, round(avg(abs(v)), 6) AS mean_abs FROM f GROUP BY pos ORDER BY avg(abs(v)), pos LIMIT 6"""))
def low_activation_neurons(spark, folder):
    out = B.low_activation_neurons(role(spark, folder, "samples"), "vec", 0.1)
    return out.select("pos", r("mean_abs").alias("mean_abs"))


@query("pruning_verification", with_roles("samples", body="""
+ f AS (SELECT pos, vec[pos + 1] AS v FROM (SELECT vec, unnest(range(64)) AS pos FROM samples)),
low AS (SELECT pos FROM f GROUP BY pos ORDER BY avg(abs(v)), pos LIMIT 12),
z AS (SELECT ord, label, vec, [CASE WHEN list_contains(lows, i) THEN 0 ELSE vec[i + 1] END FOR i IN range(64)] AS m
  FROM samples, (SELECT list(pos) AS lows FROM low)),
c AS (SELECT label = 3 AS s, list_position(vec, list_max(vec)) <> list_position(m, list_max(m)) AS changed FROM z)
SELECT count(*) FILTER (s) AS suspicious, count(*) FILTER (s AND changed) AS suspicious_changed, count(*) FILTER (NOT s AND changed) AS other_changed,
  round(count(*) FILTER (s AND changed) / count(*) FILTER (s), 6) AS fraction FROM c"""))
def pruning_verification(spark, folder):
    rows = role(spark, folder, "samples")
    neurons = B.low_activation_neurons(rows, "vec", 0.2)
    flips = B.prediction_flips(rows, B.pruned(rows, "vec", neurons), "ord", "vec")
    out = B.pruning_verification(flips, rows.where("label = 3"), "ord")
    return out.select("suspicious", "suspicious_changed", "other_changed", r("fraction").alias("fraction"))


@query("mad_outlier_class", """
WITH n AS (SELECT user_id AS grp, event_type AS cls, max(value) AS norm FROM events GROUP BY ALL),
m AS (SELECT grp, median(norm) AS mid, count(*) AS k FROM n GROUP BY grp),
d AS (SELECT grp, median(gap) AS mad FROM (SELECT n.grp, abs(norm - mid) AS gap FROM n JOIN m ON n.grp = m.grp) GROUP BY grp),
t AS (SELECT grp, mid, mad, max(norm) AS norm, (max(norm) - mid) / greatest(1.4826 * mad, 1e-6) AS idx FROM n JOIN m USING (grp) JOIN d USING (grp) WHERE k >= 3 GROUP BY grp, mid, mad)
SELECT grp, round(norm, 6) AS norm, round(mid, 6) AS median, round(mad, 6) AS mad, round(idx, 5) AS anomaly_index,
  round(idx / (1 + idx), 6) AS severity, round(least(0.6, 0.4 + 0.2 * idx / (1 + idx)), 6) AS confidence FROM t WHERE idx > 1.5""")
def mad_outlier_class(spark, folder):
    norms = table(spark, folder, "events").groupBy(F.col("user_id").alias("grp"), "event_type").agg(F.max("value").alias("norm")) \
        .withColumn("class_id", F.xxhash64("event_type"))
    out = B.mad_outlier_class(norms, "grp", threshold=1.5)
    return out.select("grp", *[r(c).alias(c) for c in ("norm", "median", "mad")], r("anomaly_index", 5).alias("anomaly_index"),
                      r("severity").alias("severity"), r("confidence").alias("confidence"))


@query("prediction_entropy", with_roles("predictions", body="""
+ e AS (SELECT ord, -list_sum([p * ln(greatest(p, 1e-300)) FOR p IN probs]) AS h, list_position(probs, list_max(probs)) AS c FROM predictions),
k AS (SELECT ord, c, count(*) AS n, sum(h) AS h FROM e GROUP BY ALL)
SELECT ord, round(sum(h) / sum(n), 6) AS entropy, round(max(n) / sum(n), 6) AS share, CAST(sum(n) AS BIGINT) AS overlays FROM k GROUP BY ord HAVING sum(h) / sum(n) < 0.2"""))
def prediction_entropy(spark, folder):
    out = B.prediction_entropy(role(spark, folder, "predictions"), "ord", "probs")
    return out.select("ord", r("entropy").alias("entropy"), r("share").alias("share"), "overlays")


@query("overlay_blend", with_roles("samples", body="""
+ b AS (SELECT CAST(row_number() OVER (ORDER BY ord) - 1 AS BIGINT) AS background, vec FROM samples WHERE label = 0),
o AS (SELECT ord, vec, CAST(unnest(range(4)) AS INT) AS overlay FROM samples WHERE label > 0),
p AS (SELECT *, CAST('0x' || substr(md5('7|' || TEXT(ord) || '|' || TEXT(overlay)), 1, 8) AS BIGINT) % (SELECT count(*) FROM b) AS background FROM o)
SELECT p.ord, overlay, background, CAST(k - 1 AS INT) AS place, round(p.vec[k] * 0.5 + b.vec[k] * 0.5, 6) AS value
FROM p JOIN b USING (background), range(1, 65) AS places(k)"""))
def overlay_blend(spark, folder):
    rows = role(spark, folder, "samples")
    pool = numbered(rows.where("label = 0").select("ord", F.col("vec").alias("pixels")), ["ord"], "background").select("background", "pixels")
    out = B.overlay_blend(rows.where("label > 0").select("ord", "vec"), pool, "ord", "vec", overlays=4)
    each = out.select("ord", "overlay", "background", F.posexplode("pixels").alias("place", "value"))
    return each.withColumn("value", r("value"))
