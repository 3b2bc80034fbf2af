"""Outlier and annotation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import boxes as X
from attest.operators import outliers as O
from attest.plans.registry import query, r
from attest.plans.roles import role, with_roles

_LOO = """
+ p AS (SELECT ord, label, vec[1] AS x, vec[2] AS y FROM samples_2d),
c AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY label),
d AS (SELECT p.ord, label, n, x - mx AS x, y - my AS y FROM p JOIN c USING (label)),
s AS (SELECT label, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY label),
l AS (SELECT ord, label, n, x * n / (n - 1) AS dx, y * n / (n - 1) AS dy,
  (sxx - x * x * n / (n - 1)) / (n - 2) AS a, (sxy - x * y * n / (n - 1)) / (n - 2) AS b, (syy - y * y * n / (n - 1)) / (n - 2) AS e FROM d JOIN s USING (label)),
q AS (SELECT *, 1e-6 * greatest((a + e) / 2, 1) AS ridge FROM l),
m AS (SELECT ord, label, sqrt(((e + ridge) * dx * dx - 2 * b * dx * dy + (a + ridge) * dy * dy) / ((a + ridge) * (e + ridge) - b * b)) AS distance FROM q)
"""


@query("ood_mahalanobis", with_roles("samples_2d", body=_LOO + """
SELECT 'v' || TEXT(ord) AS asset_id, round(least(0.95, 0.5 + 0.45 * (1 - 2.0 / distance)), 6) AS confidence FROM m WHERE distance > 2.0"""))
def ood_mahalanobis(spark, folder):
    found = O.ood_mahalanobis(role(spark, folder, "samples_2d"), "sample_id", "ord", "label", "vec", threshold=2.0)
    return found.select("asset_id", r("confidence").alias("confidence"))


@query("mahalanobis_distances", with_roles("samples_2d", body=_LOO + "SELECT ord, TEXT(label) AS label, round(distance, 6) AS distance FROM m"))
def mahalanobis_distances(spark, folder):
    out = O.mahalanobis_distances(role(spark, folder, "samples_2d"), "ord", "label", "vec")
    return out.select("ord", "label", r("distance").alias("distance"))


@query("ood_mahalanobis_64d")
def ood_mahalanobis_64d(spark, folder):
    out = O.mahalanobis_distances(role(spark, folder, "samples"), "ord", "label", "vec")
    return out.select("ord", "label", r("distance").alias("distance"))


@query("spectral_deviations", with_roles("samples_2d", body="""
+ p AS (SELECT ord, label, vec[1] AS x, vec[2] AS y FROM samples_2d),
d AS (SELECT ord, label, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM p WINDOW w AS (PARTITION BY label)),
s AS (SELECT label, count(*) AS n, sum(x * x) AS a, sum(x * y) AS b, sum(y * y) AS e FROM d GROUP BY label),
j AS (SELECT ord, label, x * cos(0.5 * atan2(2 * b, a - e)) + y * sin(0.5 * atan2(2 * b, a - e)) AS proj FROM d JOIN s USING (label) WHERE n >= 4),
t AS (SELECT label, median(proj) AS mid, max(abs(proj)) AS extent FROM j GROUP BY label),
v AS (SELECT ord, label, abs(proj - mid) AS deviation, extent FROM j JOIN t USING (label)),
z AS (SELECT label, median(deviation) AS mad FROM v GROUP BY label)
SELECT ord, TEXT(label) AS label, round(deviation, 6) AS deviation, round(deviation / greatest(1.4826 * mad, 1e-12 * greatest(1, extent)), 5) AS scaled
FROM v JOIN z USING (label)"""))
def spectral_deviations(spark, folder):
    out = O.spectral_deviations(role(spark, folder, "samples_2d"), "ord", "label", "vec")
    return out.select("ord", "label", r("deviation").alias("deviation"), r("scaled", 5).alias("scaled"))


@query("spectral_signature")
def spectral_signature(spark, folder):
    pushed = F.when(F.col("ord") % 37 == 0, F.transform("vec", lambda v: v + 1.0)).otherwise(F.col("vec"))
    rows = role(spark, folder, "samples").withColumn("vec", pushed)
    return O.spectral_signature(rows, "sample_id", "ord", "label", "vec").select("asset_id", "severity", "confidence")


@query("activation_clustering")
def activation_clustering(spark, folder):
    rows = role(spark, folder, "near_vectors").withColumn("label", F.col("ord") % 4)
    far = F.when(F.col("ord") % 28 < 2, F.transform("vec", lambda v: v + 3.0)).otherwise(F.col("vec"))
    named = rows.withColumn("vec", far).withColumn("id", F.concat(F.lit("v"), F.col("ord").cast("string")))
    return O.activation_clustering(named, "id", "ord", "label", "vec").select("asset_id", "severity", "confidence")


@query("two_means")
def two_means(spark, folder):
    out = O.two_means(role(spark, folder, "samples"), "ord", "label", "vec")
    return out.groupBy("label", "cluster").agg(F.count(F.lit(1)).alias("rows"))


def _images(spark, folder, boxes):
    """Images with their boxes as an array; an order has a handful of lines."""
    packed = boxes.groupBy("image_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "x", "y", "w", "h"))),
        lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))).alias("boxes"))
    none = F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")
    return role(spark, folder, "images").join(packed, "image_id", "left").withColumn("boxes", F.coalesce("boxes", none))


def _boxed(spark, folder):
    return _images(spark, folder, role(spark, folder, "boxes"))


@query("invalid_box_area", with_roles("boxes", body="SELECT image_id, x, y, w, h FROM boxes WHERE w <= 0 OR h <= 0"))
def invalid_box_area(spark, folder):
    return X.invalid_box_area(role(spark, folder, "boxes")).select("image_id", "x", "y", "w", "h")


@query("box_out_of_bounds", with_roles("boxes", body="""
SELECT image_id, x, y, w, h FROM boxes WHERE w > 0 AND h > 0 AND (x < 0 OR y < 0 OR x + w > width OR y + h > height)"""))
def box_out_of_bounds(spark, folder):
    return X.box_out_of_bounds(role(spark, folder, "boxes")).select("image_id", "x", "y", "w", "h")


# Independent check: all coordinates are multiples of five, so count covered 5 x 5 cells.
_COVER = """
+ cells AS (SELECT DISTINCT image_id, width, height, cx, cy FROM (
  SELECT image_id, width, height, unnest(range(CAST(greatest(x, 0) AS INT), CAST(least(x + w, width) AS INT), 5)) AS cx, y, h FROM boxes WHERE w > 0 AND h > 0),
  range(0, 120, 5) AS g(cy) WHERE cy >= greatest(y, 0) AND cy < least(y + h, height)),
covered AS (SELECT image_id, count(*) * 25 / min(width * height) AS coverage FROM cells GROUP BY image_id)
"""


@query("covered_fraction", with_roles("boxes", body=_COVER + "SELECT image_id, round(coverage, 6) AS coverage FROM covered"))
def covered_fraction(spark, folder):
    boxes = role(spark, folder, "boxes").withColumnRenamed("line_no", "box_index")
    return X.covered_fraction(boxes.where("w > 0 and h > 0")).select("image_id", r("coverage").alias("coverage"))


@query("large_unlabeled_region", with_roles("sparse_boxes", "images", body=_COVER.replace("FROM boxes", "FROM sparse_boxes") + """,
bad AS (SELECT DISTINCT image_id FROM sparse_boxes WHERE w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > width OR y + h > height),
ok AS (SELECT i.image_id, i.width, i.height, coalesce(coverage, 0) AS coverage FROM images i LEFT JOIN covered USING (image_id)
  WHERE i.image_id NOT IN (SELECT image_id FROM bad)),
lists AS (SELECT width, height, list_sort(list(coverage)) AS l FROM ok WHERE coverage > 0 GROUP BY ALL),
val AS (SELECT DISTINCT width, height, coverage FROM ok),
med AS (SELECT val.*, CASE WHEN coverage > 0 THEN list_concat(l[:list_position(l, coverage) - 1], l[list_position(l, coverage) + 1:]) ELSE l END AS peers
  FROM val JOIN lists USING (width, height)),
m AS (SELECT width, height, coverage, len(peers) AS n, list_aggregate(peers, 'median') AS mid FROM med)
SELECT image_id, round(coverage, 6) AS coverage, n AS peers, round(mid, 6) AS peer_median FROM ok JOIN m USING (width, height, coverage)
WHERE n >= 2 AND 1 - coverage >= 0.6 AND mid - coverage >= 0.03"""))
def large_unlabeled_region(spark, folder):
    out = X.large_unlabeled_region(_images(spark, folder, role(spark, folder, "sparse_boxes")), gap=0.03)
    return out.select("image_id", r("coverage").alias("coverage"), "peers", r("peer_median").alias("peer_median"))


@query("systematic_box_shift", with_roles("layouts", body="""
+ n AS (SELECT image_id, ord, width, height, line_no, x / width AS x, y / height AS y, w / width AS w, h / height AS h FROM layouts),
sig AS (SELECT image_id, ord, width, height, string_agg(printf('%.4f,%.4f', w, h), ';' ORDER BY x, y) AS shape,
  string_agg(printf('%.4f,%.4f', x, y), ';' ORDER BY x, y) AS sig FROM n GROUP BY ALL),
cnt AS (SELECT width, height, shape, sig, count(*) AS c, min(ord) AS o FROM sig GROUP BY ALL),
top AS (SELECT *, sum(c) OVER (PARTITION BY width, height, shape) AS total,
  row_number() OVER (PARTITION BY width, height, shape ORDER BY c DESC, o) AS k FROM cnt),
base AS (SELECT top.width, top.height, top.shape, top.sig, rn, round(x, 4) AS bx, round(y, 4) AS by FROM top JOIN sig ON sig.ord = top.o
  JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, y) AS rn FROM n) b ON b.image_id = sig.image_id
  WHERE k = 1 AND c >= 2 AND c > total / 2),
off_ AS (SELECT s.image_id, s.width, s.height, s.shape, b.x - base.bx AS dx, b.y - base.by AS dy FROM sig s
  JOIN base ON s.width = base.width AND s.height = base.height AND s.shape = base.shape AND s.sig <> base.sig
  JOIN (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY x, y) AS rn FROM n) b ON b.image_id = s.image_id AND b.rn = base.rn),
med AS (SELECT image_id, width, height, shape, count(*) AS boxes, median(dx) AS mx, median(dy) AS my, max(dx) AS hx, min(dx) AS lx, max(dy) AS hy, min(dy) AS ly FROM off_ GROUP BY ALL),
good AS (SELECT * FROM med WHERE greatest(abs(mx), abs(my)) >= 0.05 AND greatest(hx - mx, mx - lx, hy - my, my - ly) <= 0.01),
f AS (SELECT *, sum(boxes) OVER (PARTITION BY width, height, shape, round(mx / 0.01), round(my / 0.01)) AS box_count FROM good)
SELECT image_id, round(mx, 4) AS dx, round(my, 4) AS dy, CAST(box_count AS BIGINT) AS box_count FROM f WHERE box_count >= 3"""))
def systematic_box_shift(spark, folder):
    layouts = role(spark, folder, "layouts")
    packed = layouts.groupBy("image_id", "ord", "width", "height").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("line_no", "x", "y", "w", "h"))),
        lambda b: F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"))).alias("boxes"))
    return X.systematic_box_shift(packed).select("image_id", r("dx", 4).alias("dx"), r("dy", 4).alias("dy"), "box_count")


@query("annotation_findings", with_roles("boxes", body="""
SELECT CASE WHEN w <= 0 OR h <= 0 THEN 'invalid_box_area' ELSE 'box_out_of_bounds' END AS finding_type, count(*) AS findings
FROM boxes WHERE w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > width OR y + h > height GROUP BY 1"""))
def annotation_findings(spark, folder):
    return X.box_findings(X.explode_boxes(_boxed(spark, folder))).groupBy("finding_type").agg(F.count(F.lit(1)).alias("findings"))
