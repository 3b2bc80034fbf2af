"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import evaluation as X
from attest.operators import evidence as E
from attest.plans.evidence import SQL_COUNTS, SQL_VERDICT, findings
from attest.plans.registry import query, r
from attest.plans.roles import role, with_roles

_RATES = """round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1"""


@query("detector_metrics", with_roles("findings", "truth", body=f"""
+ flagged AS (SELECT DISTINCT detector_id, asset_id FROM findings WHERE {SQL_COUNTS}),
own AS (SELECT DISTINCT detector_id, asset_id FROM truth WHERE detector_id IS NOT NULL),
common AS (SELECT DISTINCT asset_id FROM truth WHERE detector_id IS NULL),
det AS (SELECT DISTINCT detector_id FROM findings UNION SELECT 'silent'),
t AS (SELECT detector_id, asset_id FROM det, common WHERE detector_id NOT IN (SELECT detector_id FROM own) UNION ALL SELECT * FROM own),
c AS (SELECT det.detector_id, (SELECT count(*) FROM flagged f JOIN t ON f.detector_id = t.detector_id AND f.asset_id = t.asset_id WHERE f.detector_id = det.detector_id) AS tp,
  (SELECT count(*) FROM flagged f WHERE f.detector_id = det.detector_id) AS k, (SELECT count(*) FROM t WHERE t.detector_id = det.detector_id) AS n FROM det),
m AS (SELECT detector_id, tp, k - tp AS fp, n - tp AS fn FROM c)
SELECT detector_id, tp, fp, fn, {_RATES} FROM m"""))
def detector_metrics(spark, folder):
    silent = spark.createDataFrame([("silent",)], "detector_id string")
    out = X.detector_metrics(findings(spark, folder), role(spark, folder, "truth"), silent)
    return out.select("detector_id", "tp", "fp", "fn", *[r(c).alias(c) for c in ("precision", "recall", "f1")])


_CURVE = """
+ s AS (SELECT score, sum(truth) AS p, count(*) - sum(truth) AS n FROM scored GROUP BY score),
tot AS (SELECT sum(p) AS pp, sum(n) AS nn FROM s),
c AS (SELECT 'infinity'::DOUBLE AS threshold, 0 AS tp, 0 AS fp UNION ALL
  SELECT score, (SELECT sum(p) FROM s b WHERE b.score >= a.score), (SELECT sum(n) FROM s b WHERE b.score >= a.score) FROM s a)
"""


@query("roc_points", with_roles("scored", body=_CURVE + """
SELECT threshold, round(tp / pp, 6) AS tpr, round(fp / nn, 6) AS fpr FROM c, tot"""))
def roc_points(spark, folder):
    return X.roc_points(role(spark, folder, "scored")).select("threshold", r("tpr").alias("tpr"), r("fpr").alias("fpr"))


@query("pr_points", with_roles("scored", body=_CURVE + """
SELECT threshold, round(CASE WHEN tp + fp = 0 THEN 1 ELSE tp / (tp + fp) END, 6) AS precision, round(tp / pp, 6) AS recall FROM c, tot"""))
def pr_points(spark, folder):
    return X.pr_points(role(spark, folder, "scored")).select(
        "threshold", r("precision").alias("precision"), r("recall").alias("recall"))


@query("reliability_diagram", with_roles("scored", body="""
+ e AS (SELECT CAST(i AS INT) AS bin, i * (1.0::DOUBLE / 10) AS lower, CASE WHEN i = 9 THEN 1.0 ELSE (i + 1) * (1.0::DOUBLE / 10) END AS upper FROM range(10) AS t(i))
SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS upper, count(score) AS n, round(avg(score), 6) AS mean_confidence, round(avg(truth), 6) AS accuracy
FROM e LEFT JOIN scored ON score >= lower AND (score < upper OR (bin = 9 AND score <= 1)) GROUP BY bin, lower, upper"""))
def reliability_diagram(spark, folder):
    scored = role(spark, folder, "scored").select(F.col("score").alias("confidence"), F.col("truth").alias("correct"))
    return X.reliability_diagram(scored).select(
        "bin", r("lower").alias("lower"), r("upper").alias("upper"), "n",
        r("mean_confidence").alias("mean_confidence"), r("accuracy").alias("accuracy"))


@query("brier_score", with_roles("scored", body="SELECT round(avg((score - truth) * (score - truth)), 6) AS brier FROM scored"))
def brier_score(spark, folder):
    scored = role(spark, folder, "scored").select(F.col("score").alias("confidence"), F.col("truth").alias("correct"))
    return X.brier_score(scored).select(r("brier").alias("brier"))


@query("apply_calibration", with_roles("findings", body="""
SELECT CAST(ord AS BIGINT) AS ord, round(CASE WHEN confidence <= 0.1 THEN 0.05 WHEN confidence <= 0.5 THEN 0.05 + (confidence - 0.1) * (0.3 - 0.05) / (0.5 - 0.1)
  WHEN confidence <= 0.9 THEN 0.3 + (confidence - 0.5) * (0.85 - 0.3) / (0.9 - 0.5) ELSE 0.85 END, 6) AS confidence,
  round(confidence, 6) AS raw FROM findings"""))
def apply_calibration(spark, folder):
    knots = {0.1: 0.05, 0.5: 0.3, 0.9: 0.85}
    twice = X.apply_calibration(X.apply_calibration(findings(spark, folder), knots), knots)
    raw = F.col("provenance.attrs")["uncalibrated_confidence"].cast("double")
    return twice.select("ord", r("confidence").alias("confidence"), r(raw).alias("raw"))


@query("ablation", with_roles("findings", "truth", body=f"""
+ flagged AS (SELECT DISTINCT detector_id, asset_id FROM findings WHERE {SQL_COUNTS}),
affected AS (SELECT DISTINCT asset_id FROM truth),
mods AS (SELECT DISTINCT detector_id AS module FROM findings UNION ALL SELECT '' ),
k AS (SELECT module, asset_id FROM mods JOIN flagged ON detector_id <> module GROUP BY ALL),
c AS (SELECT mods.module, count(k.asset_id) AS p, count(affected.asset_id) AS tp FROM mods LEFT JOIN k USING (module) LEFT JOIN affected ON k.asset_id = affected.asset_id GROUP BY ALL),
m AS (SELECT module, tp, p - tp AS fp, (SELECT count(*) FROM affected) - tp AS fn FROM c),
b AS (SELECT tp / (tp + fp) AS bp, tp / (tp + fn) AS br FROM m WHERE module = '')
SELECT module, tp, fp, fn, {_RATES}, round(tp / (tp + fp) - bp, 6) AS precision_delta, round(tp / (tp + fn) - br, 6) AS recall_delta
FROM m, b WHERE module <> ''"""))
def ablation(spark, folder):
    names = ["duplicates", "mislabeling", "ood", "spectral_signature", "activation_clustering", "strip",
             "trigger_reconstruction", "fine_pruning", "image_hash", "model_identity"]
    out = X.ablation(findings(spark, folder), role(spark, folder, "truth"), names)
    return out.select("module", "tp", "fp", "fn", *[
        r(c).alias(c) for c in ("precision", "recall", "f1", "precision_delta", "recall_delta")])


@query("false_positive_cost", with_roles("findings", body=f"""
+ v AS (SELECT DISTINCT asset_id AS variant FROM findings),
j AS (SELECT variant, max(CASE WHEN asset_id IS NOT NULL AND {SQL_VERDICT} <> 'ACCEPT' THEN 1 ELSE 0 END) AS raised,
  max(CASE WHEN asset_id IS NOT NULL AND {SQL_VERDICT} = 'QUARANTINE' THEN 1 ELSE 0 END) AS stopped
  FROM v LEFT JOIN findings f ON asset_id = variant GROUP BY variant)
SELECT count(*) AS variants, CAST(sum(raised) AS BIGINT) AS false_positives, round(avg(raised), 6) AS rate, round(avg(stopped), 6) AS quarantine_rate,
  avg(raised) > 0.05 AS flag FROM j"""))
def false_positive_cost(spark, folder):
    every = findings(spark, folder)
    verdicts = E.decide(every).select(F.col("asset_id").alias("variant"), "verdict")
    out = X.false_positive_cost(verdicts, every.select(F.col("asset_id").alias("variant")))
    return out.select("variants", "false_positives", r("rate").alias("rate"), r("quarantine_rate").alias("quarantine_rate"), "flag")


@query("false_positive_costs", with_roles("findings", body=f"""
+ j AS (SELECT detector_id, asset_id, max(CASE WHEN {SQL_VERDICT} <> 'ACCEPT' THEN 1 ELSE 0 END) AS raised,
  max(CASE WHEN {SQL_VERDICT} = 'QUARANTINE' THEN 1 ELSE 0 END) AS stopped FROM findings GROUP BY ALL),
n AS (SELECT count(DISTINCT asset_id) AS variants FROM findings)
SELECT detector_id, variants, CAST(sum(raised) AS BIGINT) AS false_positives, round(sum(raised) / variants, 6) AS rate, round(sum(stopped) / variants, 6) AS quarantine_rate,
  sum(raised) / variants > 0.05 AS flag FROM j, n GROUP BY detector_id, variants"""))
def false_positive_costs(spark, folder):
    every = findings(spark, folder)
    verdicts = E.decide(every).select(F.col("provenance.detector_id").alias("detector_id"), F.col("asset_id").alias("variant"), "verdict")
    out = X.false_positive_costs(verdicts, every.select(F.col("asset_id").alias("variant")))
    return out.withColumn("rate", r("rate")).withColumn("quarantine_rate", r("quarantine_rate"))


@query("run_diff", with_roles("findings", body="""
+ a AS (SELECT asset_id, finding_type, round(severity, 6) AS severity FROM findings),
b AS (SELECT asset_id, finding_type, round(CASE WHEN ord % 50 = 0 THEN severity / 2 ELSE severity END, 6) AS severity FROM findings WHERE ord % 77 > 0)
SELECT 'run_1' AS run, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT 'run_2', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"""))
def run_diff(spark, folder):
    every = findings(spark, folder)
    first = every.select("asset_id", "finding_type", r("severity").alias("severity"))
    changed = F.when(F.col("ord") % 50 == 0, F.col("severity") / 2).otherwise(F.col("severity"))
    second = every.where("ord % 77 > 0").select("asset_id", "finding_type", r(changed).alias("severity"))
    return X.run_diff(first, second)


@query("deterministic", with_roles("findings", body="SELECT true AS deterministic, CAST(0 AS BIGINT) AS differences"))
def deterministic(spark, folder):
    one, two = findings(spark, folder), findings(spark, folder).repartition(5)
    pick = ["asset_id", "finding_type", "severity", "confidence", "ord"]
    return X.deterministic(one.select(*pick), two.select(*pick))


@query("runtime_cost", with_roles("timings", body="""
SELECT detector_id, count(*) AS runs, round(avg(seconds), 6) AS mean, round(quantile_cont(seconds, 0.5), 6) AS p50,
  round(quantile_cont(seconds, 0.95), 6) AS p95, round(max(seconds), 6) AS longest FROM timings WHERE ran GROUP BY detector_id"""))
def runtime_cost(spark, folder):
    out = X.runtime_cost(role(spark, folder, "timings"))
    return out.select("detector_id", "runs", *[r(c).alias(c) for c in ("mean", "p50", "p95", "longest")])


_PICK = """
+ h AS (SELECT *, CAST('0x' || substr(md5('11|' || TEXT(ord)), 1, 8) AS BIGINT) AS u FROM samples),
k AS (SELECT *, row_number() OVER (ORDER BY u, ord) <= floor(count(*) OVER () * 0.25) AS chosen FROM h)
"""


@query("corrupt_label_flip", with_roles("samples", body=_PICK + """,
cls AS (SELECT label, coalesce(lead(label) OVER (ORDER BY label), min(label) OVER ()) AS nxt FROM (SELECT DISTINCT label FROM samples))
SELECT ord, CASE WHEN chosen THEN nxt ELSE label END AS label, chosen AS affected FROM k JOIN cls USING (label)"""))
def corrupt_label_flip(spark, folder):
    return X.corrupt_table(role(spark, folder, "samples"), "ord", "vec", "label", 0.25, 11, "label_flip") \
        .select("ord", "label", "affected")


@query("corrupt_duplicate_flood", with_roles("samples", body=_PICK + """,
f AS (SELECT vec AS v, label AS l FROM samples ORDER BY ord LIMIT 1)
SELECT ord, CASE WHEN chosen THEN l ELSE label END AS label, round(CASE WHEN chosen THEN v[1] ELSE vec[1] END, 6) AS first_value,
  chosen AND (v <> vec OR l <> label) AS affected FROM k, f"""))
def corrupt_duplicate_flood(spark, folder):
    out = X.corrupt_table(role(spark, folder, "samples"), "ord", "vec", "label", 0.25, 11, "duplicate_flood")
    return out.select("ord", "label", r(F.col("vec")[0]).alias("first_value"), "affected")


@query("corrupt_ood_insert", with_roles("samples", body=_PICK + """,
x AS (SELECT max(list_max(vec)) AS hi, min(list_min(vec)) AS lo FROM samples)
SELECT ord, chosen AS affected, round(CASE WHEN chosen THEN hi + greatest(hi - lo, 1) * (2 + CAST('0x' || substr(md5('11|' || TEXT(ord) || ':0'), 1, 8) AS BIGINT) / 4294967296.0)
  ELSE vec[1] END, 6) AS first_value FROM k, x"""))
def corrupt_ood_insert(spark, folder):
    out = X.corrupt_table(role(spark, folder, "samples"), "ord", "vec", "label", 0.25, 11, "ood_insert")
    return out.select("ord", "affected", r(F.col("vec")[0]).alias("first_value"))


@query("tamper_log", with_roles("log", body="""
SELECT log_id, pos, (log_id + pos) % 6 = 0 AS affected,
  CASE WHEN (log_id + pos) % 6 = 0 THEN SHA('5|' || TEXT(log_id) || '|' || TEXT(pos)) ELSE output_hash END AS output_hash FROM log"""))
def tamper_log(spark, folder):
    log = role(spark, folder, "log")
    return X.tamper_log(log, (F.col("log_id") + F.col("pos")) % 6 == 0, 5).select("log_id", "pos", "affected", "output_hash")


@query("detection_rate", with_roles("scored", body="SELECT count(*) AS cases, round(avg(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END), 6) AS rate FROM scored"))
def detection_rate(spark, folder):
    cases = role(spark, folder, "scored").select((F.col("score") >= 0.5).alias("detected"))
    return X.detection_rate(cases).select("cases", r("rate").alias("rate"))
