"""Drift queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest.functions import imaging, vectors as V
from attest.functions.scale import with_row
from attest.operators import drift as D
from attest.plans.registry import query, r, table
from attest.plans.roles import role, with_roles

_MMD = """
+ p AS (SELECT a.side AS s, b.side AS t, sum(exp(-list_distance(a.vec, b.vec) * list_distance(a.vec, b.vec) / 64)) AS k
  FROM batches a JOIN batches b ON a.ord <> b.ord GROUP BY ALL),
n AS (SELECT count(*) FILTER (side = 'reference') AS n, count(*) FILTER (side = 'current') AS m FROM batches),
v AS (SELECT n, m, (SELECT k FROM p WHERE s = 'reference' AND t = 'reference') / (n * (n - 1))
  + (SELECT k FROM p WHERE s = 'current' AND t = 'current') / (m * (m - 1))
  - 2 * (SELECT k FROM p WHERE s = 'reference' AND t = 'current') / (n * m) AS mmd FROM n)
"""
_KL_BINS = """
+ f AS (SELECT side, pos, vec[pos] AS v FROM (SELECT side, vec, unnest(range(1, 65)) AS pos FROM batches)),
lim AS (SELECT pos, min(v) AS lo, max(v) AS hi FROM f GROUP BY pos),
b AS (SELECT f.pos, side, CAST(list_sum([CASE WHEN lo + i * ((hi - lo) / 16) <= v THEN 1 ELSE 0 END FOR i IN range(1, 16)]) AS INT) AS bin FROM f JOIN lim USING (pos)),
h AS (SELECT pos, g.bin, count(*) FILTER (side = 'reference') AS p, count(*) FILTER (side = 'current') AS q
  FROM (SELECT pos, unnest(range(16)) AS bin FROM lim) g LEFT JOIN b USING (pos, bin) GROUP BY ALL),
s AS (SELECT pos, bin, p / greatest(max(p) OVER w, 1) + 1e-10 AS p, q / greatest(max(q) OVER w, 1) + 1e-10 AS q FROM h WINDOW w AS (PARTITION BY pos)),
t AS (SELECT pos, bin, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM s WINDOW w AS (PARTITION BY pos)),
kl AS (SELECT pos, greatest(0, sum(p * ln(p / q))) AS kl FROM t GROUP BY pos)
"""


@query("mmd_rbf", with_roles("batches", body=_MMD + "SELECT n, m, round(mmd, 8) AS mmd FROM v"))
def mmd_rbf(spark, folder):
    return D.mmd_rbf(role(spark, folder, "batches"), "side", "vec").select("n", "m", r("mmd", 8).alias("mmd"))


@query("mmd_random_features")
def mmd_random_features(spark, folder):
    return D.mmd_random_features(role(spark, folder, "batches"), "side", "vec", 1 / 64).select("n", "m", r("approx_mmd").alias("approx_mmd"))


@query("kl_histogram", """
WITH h AS (SELECT event_type, CAST(floor(value / 10) AS INT) AS bin, count(*) FILTER (user_id % 2 = 0) AS p, count(*) FILTER (user_id % 2 = 1) AS q FROM events GROUP BY ALL),
s AS (SELECT event_type, bin, p / greatest(max(p) OVER w, 1) + 1e-10 AS p, q / greatest(max(q) OVER w, 1) + 1e-10 AS q FROM h WINDOW w AS (PARTITION BY event_type)),
t AS (SELECT event_type, p / sum(p) OVER w AS p, q / sum(q) OVER w AS q FROM s WINDOW w AS (PARTITION BY event_type))
SELECT event_type, round(greatest(0, sum(p * ln(p / q))), 6) AS kl FROM t GROUP BY event_type""")
def kl_histogram(spark, folder):
    h = table(spark, folder, "events").groupBy("event_type", F.floor(F.col("value") / 10).alias("bin")).agg(
        F.count_if(F.col("user_id") % 2 == 0).alias("p"), F.count_if(F.col("user_id") % 2 == 1).alias("q"))
    return D.kl_histogram(h, ["event_type"]).select("event_type", r("kl").alias("kl"))


@query("marginal_kl", with_roles("batches", body=_KL_BINS + "SELECT CAST(pos - 1 AS INT) AS pos, round(kl, 6) AS kl FROM kl"))
def marginal_kl(spark, folder):
    return D.marginal_kl(role(spark, folder, "batches"), "side", "vec").select("pos", r("kl").alias("kl"))


@query("energy_score", with_roles("batches", body="""
SELECT ord, round(-(list_max(vec) + ln(list_sum([exp(x - list_max(vec)) FOR x IN vec]))), 6) AS energy FROM batches"""))
def energy_score(spark, folder):
    return role(spark, folder, "batches").select("ord", r(V.energy_score(F.col("vec"))).alias("energy"))


@query("energy_shift", with_roles("batches", body="""
+ e AS (SELECT side, -(list_max(vec) + ln(list_sum([exp(x - list_max(vec)) FOR x IN vec]))) AS e FROM batches)
SELECT round(avg(e) FILTER (side = 'reference'), 6) AS reference_energy, round(avg(e) FILTER (side = 'current'), 6) AS current_energy,
  round(avg(e) FILTER (side = 'current') - avg(e) FILTER (side = 'reference'), 6) AS delta FROM e"""))
def energy_shift(spark, folder):
    out = D.energy_shift(role(spark, folder, "batches"), "side", "vec")
    return out.select(*[r(c).alias(c) for c in ("reference_energy", "current_energy", "delta")])


def _pictures(spark, folder):
    """Vectors as 8 x 8 grey pictures in [0, 1]; the current batch is lighter."""
    rows = role(spark, folder, "batches")
    shift = F.when(F.col("side") == "current", 0.2).otherwise(0.0)
    pixels = F.transform("vec", lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 + v / 2 + shift)))
    return rows.select("side", "ord", pixels.alias("pixels"))


@query("mean_rgb", with_roles("batches", body="""
SELECT ord, round(list_sum(list_concat(vec[1:1], [vec[1 + 4 * i] FOR i IN range(1, 16)])) / 16 / 255, 8) AS c0,
  round(list_sum([vec[2 + 4 * i] FOR i IN range(16)]) / 16 / 255, 8) AS c1, round(list_sum([vec[3 + 4 * i] FOR i IN range(16)]) / 16 / 255, 8) AS c2,
  round(list_sum([vec[4 + 4 * i] FOR i IN range(16)]) / 16 / 255, 8) AS c3 FROM batches"""))
def mean_rgb(spark, folder):
    means = V.channel_means(F.col("vec"), 4, 255.0)
    return role(spark, folder, "batches").select("ord", means.alias("m")).select(
        "ord", *[r(F.col("m")[i], 8).alias(f"c{i}") for i in range(4)])


# Pictures as lists of 64 grey values, and one row per pixel.
_PICTURES = """
+ pic AS (SELECT ord, [greatest(0, least(1, 0.4 + v / 2 + CASE WHEN side = 'current' THEN 0.2 ELSE 0 END)) FOR v IN vec] AS p FROM batches),
px AS (SELECT ord, p, i, i // 8 AS y, i % 8 AS x, p[i + 1] AS l FROM pic, range(64) AS t(i))
"""


def _joined(values: Column, digits: int = 6) -> Column:
    """Values as text for comparison, minus zero as zero."""
    return F.array_join(F.transform(values, lambda v: F.format_string("%.6f", F.round(v, digits) + 0.0)), " ")


@query("color_features", with_roles("batches", body=_PICTURES + """,
h AS (SELECT ord, b, count(px.i) / 64 AS share FROM (SELECT ord, b FROM pic, range(8) AS t(b)) AS g LEFT JOIN px USING (ord)
  WHERE least(7, floor(l * 8)) = b GROUP BY ALL),
f AS (SELECT g.ord, string_agg(printf('%.6f', coalesce(share, 0)), ' ' ORDER BY b) AS bins
  FROM (SELECT ord, b FROM pic, range(8) AS t(b)) AS g LEFT JOIN h USING (ord, b) GROUP BY g.ord)
SELECT ord, round(list_sum(p) / 64, 6) AS red, round(list_sum(p) / 64, 6) AS green, round(list_sum(p) / 64, 6) AS blue,
  bins || ' ' || bins || ' ' || bins AS bins FROM pic JOIN f USING (ord)"""))
def color_features(spark, folder):
    out = _pictures(spark, folder).select("ord", imaging.color_features(8, 8, 1, F.col("pixels")).alias("f"))
    return out.select("ord", *[r(F.col("f")[i]).alias(n) for i, n in enumerate(("red", "green", "blue"))],
                      _joined(F.slice("f", 4, 24)).alias("bins"))


@query("perceptual_fingerprint", with_roles("batches", body=_PICTURES + """,
wave AS (SELECT u, v, i, cos(pi() * u * (2 * (i // 8) + 1) / 16) * CASE WHEN u = 0 THEN sqrt(0.5) ELSE 1 END
    * cos(pi() * v * (2 * (i % 8) + 1) / 16) * CASE WHEN v = 0 THEN sqrt(0.5) ELSE 1 END AS c
  FROM range(8) AS a(u), range(8) AS b(v), range(64) AS t(i) WHERE u + v > 0),
s AS (SELECT ord, u * 8 + v - 1 AS k, sum(c * l) AS raw FROM px JOIN wave USING (i) GROUP BY ALL),
z AS (SELECT ord, k, CASE WHEN abs(raw) < 1e-8 THEN 0 ELSE raw END AS s FROM s),
m AS (SELECT ord, median(s) AS mid FROM z GROUP BY ord)
SELECT ord, CAST(sum(CASE WHEN s > mid THEN 1::BIGINT << k::BIGINT ELSE 0 END) AS BIGINT) AS fp FROM z JOIN m USING (ord) GROUP BY ord"""))
def perceptual_fingerprint(spark, folder):
    return _pictures(spark, folder).select("ord", imaging.perceptual_fingerprint(8, F.col("pixels")).alias("fp"))


@query("shift_features", with_roles("batches", body=_PICTURES + """,
lap AS (SELECT ord, p[abs(y - 1) * 8 + x + 1] + p[(7 - abs(7 - (y + 1))) * 8 + x + 1] + p[y * 8 + abs(x - 1) + 1]
  + p[y * 8 + 7 - abs(7 - (x + 1)) + 1] - 4 * l AS e FROM px),
mid AS (SELECT ord, median(e) AS m FROM lap GROUP BY ord),
edge AS (SELECT ord, var_pop(e) AS blur, median(abs(e - m)) / (0.67448975 * sqrt(20)) AS noise FROM lap JOIN mid USING (ord) GROUP BY ord),
cell AS (SELECT ord, y // 2 AS gy, x // 2 AS gx, avg(l) - list_sum(any_value(p)) / 64 AS s FROM px GROUP BY ALL),
st AS (SELECT ord, string_agg(printf('%.6f', round(s, 6) + 0), ' ' ORDER BY gy, gx) AS structure FROM cell GROUP BY ord)
SELECT ord, round(list_sum(p) / 64, 6) AS brightness, 0.0::DOUBLE AS channel, 3.0::DOUBLE AS chroma, 3.0::DOUBLE AS chroma_grey,
  round(blur, 6) AS blur, round(noise, 6) AS noise, structure FROM pic JOIN edge USING (ord) JOIN st USING (ord)"""))
def shift_features(spark, folder):
    """Grey pictures: no channel differs, and all chroma is in the middle bin."""
    out = _pictures(spark, folder).select("ord", imaging.shift_features(8, 8, 1, F.col("pixels")).alias("f"))
    part = {k: F.slice("f", a + 1, n) for k, (a, n) in imaging.SHIFT_LAYOUT.items()}
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + F.abs(x))
    grey = F.col("f")[12] + F.col("f")[28] + F.col("f")[44]
    return out.select("ord", r(part["brightness"][0]).alias("brightness"), r(total(part["channel"])).alias("channel"),
                      r(total(part["chroma"])).alias("chroma"), r(grey).alias("chroma_grey"), r(part["blur"][0]).alias("blur"),
                      r(part["noise"][0]).alias("noise"), _joined(part["structure"]).alias("structure"))


def _causes(spark, folder):
    pics = _pictures(spark, folder).withColumn("f", imaging.shift_features(8, 8, 1, F.col("pixels")))
    return D.shift_cause_breakdown(pics, "side", "f")


@query("shift_cause_breakdown")
def shift_cause_breakdown(spark, folder):
    out = _causes(spark, folder)
    return out.select(*[r(c).alias(c) for c in out.columns])


@query("distribution_shift", with_roles("batches", body=_MMD + """
SELECT 'moved' AS asset_id, round(least(0.8, greatest(0.2, greatest(mmd / 2, 0.25))), 6) AS severity, 0.6::DOUBLE AS confidence FROM v
UNION ALL SELECT 'still', round(least(0.8, greatest(0.2, mmd / 2)), 6), 0.6 FROM v WHERE mmd > 0.1"""))
def distribution_shift(spark, folder):
    rows = role(spark, folder, "batches")
    mmd = D.mmd_rbf(rows, "side", "vec").select("mmd")
    base = with_row(mmd, D.mean_marginal_kl(rows, "side", "vec"))
    cases = base.select("mmd", "mean_kl", F.inline(F.array(
        F.struct(F.lit("moved").alias("batch_id"), F.lit(0.25).alias("total_magnitude")),
        F.struct(F.lit("still").alias("batch_id"), F.lit(0.0).alias("total_magnitude")))))
    return D.distribution_shift(cases).select("asset_id", r("severity").alias("severity"), "confidence")


@query("unclassified_anomaly", with_roles("scored", "findings", body="""
+ a AS (SELECT DISTINCT asset_id, CAST((ord // 16 * 31) % 101 AS DOUBLE) / 100 AS score FROM findings)
SELECT asset_id, score AS severity FROM a WHERE score > 0.7
  AND asset_id NOT IN (SELECT asset_id FROM findings WHERE detector_id = 'ood' AND severity > 0.5)"""))
def unclassified_anomaly(spark, folder):
    found = role(spark, folder, "findings")
    scores = found.select("asset_id", ((F.floor(F.col("ord") / 16) * 31 % 101).cast("double") / 100).alias("score")).distinct()
    matched = found.where("detector_id = 'ood' and severity > 0.5")
    return D.unclassified_anomaly(scores, matched).select("asset_id", "severity")
