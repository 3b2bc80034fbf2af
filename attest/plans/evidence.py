"""Evidence, decision and report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.scale import with_row
from attest.operators import behaviour as B
from attest.operators import contributors as C
from attest.operators import evidence as E
from attest.operators import lineage as L
from attest.operators import passport as P
from attest.operators.condensed import condense
from attest.plans import roles
from attest.plans.registry import query, r, table
from attest.plans.roles import ROLES, role, with_roles
from attest.schemas import as_findings
from attest.session import scratch, settle
from attest.sources import sinks

# SQL shared by several checks.
SQL_BAND = "(CASE WHEN {c} >= 0.7 THEN 2 WHEN {c} >= 0.3 THEN 1 ELSE 0 END)"
SQL_COUNTS = "severity > 0 AND confidence > 0 AND recommended_action <> 'accept'"
SQL_FAMILY = """CASE WHEN finding_type IN ('perceptual_duplicate', 'semantic_near_duplicate') THEN 'duplicate'
  WHEN finding_type IN ('spectral_signature', 'activation_clustering', 'out_of_distribution') THEN 'data_anomaly'
  WHEN finding_type IN ('candidate_backdoor_trigger', 'fine_pruning_verification', 'strip_low_entropy') THEN 'backdoor'
  ELSE finding_type END"""
SQL_VERDICT = """CASE WHEN severity < 0.3 OR confidence < 0.3 THEN 'ACCEPT'
  WHEN severity >= 0.7 AND confidence >= 0.7 THEN 'QUARANTINE' ELSE 'REVIEW' END"""


def findings(spark: SparkSession, folder: str) -> DataFrame:
    """The findings role in the findings schema."""
    flat = role(spark, folder, "findings")
    texts = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    return as_findings(
        flat,
        asset_id=F.col("asset_id"), finding_type=F.col("finding_type"), severity=F.col("severity"),
        confidence=F.col("confidence"), modality=F.col("modality"), detector_id=F.col("detector_id"),
        evidence=texts("evidence_text"), counter_evidence=texts("counter_text"), signal_ids=texts("signal_id"),
        config=F.col("config_hash"), action=F.col("recommended_action"), scope=F.col("quarantine_scope"),
        access=F.col("access_assumptions"), ord=F.col("ord"),
    )


@query("union_findings", with_roles("findings", body="""
SELECT detector_id, modality, CAST(count(*) AS BIGINT) AS findings, round(sum(severity), 6) AS severity
FROM findings WHERE detector_id IN ('ood', 'strip', 'duplicates') GROUP BY ALL"""))
def union_findings(spark, folder):
    every = findings(spark, folder)
    parts = [every.where(F.col("provenance.detector_id") == d) for d in ("ood", "strip", "duplicates")]
    joined = E.union_findings(spark, parts)
    return joined.groupBy(F.col("provenance.detector_id").alias("detector_id"), "modality").agg(
        F.count(F.lit(1)).alias("findings"), r(F.sum("severity")).alias("severity"))


@query("tier_gate", with_roles("findings", body="""
SELECT detector_id, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT asset_id) AS BIGINT) AS assets
FROM findings WHERE detector_id IN ('spectral_signature', 'strip', 'fine_pruning') AND asset_id IN (
  SELECT asset_id FROM findings WHERE detector_id IN ('duplicates', 'mislabeling', 'ood') AND severity > 0.4)
GROUP BY detector_id"""))
def tier_gate(spark, folder):
    every = findings(spark, folder)
    detector = F.col("provenance.detector_id")
    cheap = every.where(detector.isin("duplicates", "mislabeling", "ood"))
    costly = every.where(detector.isin("spectral_signature", "strip", "fine_pruning"))
    return E.tier_gate(costly, cheap).groupBy(detector.alias("detector_id")).agg(
        F.count(F.lit(1)).alias("findings"), F.countDistinct("asset_id").alias("assets"))


@query("tier_log", with_roles("findings", body="""
SELECT provider, tier, tier = 'cheap' OR (SELECT max(severity) FROM findings WHERE detector_id = 'ood') > 0.4 AS ran,
  CASE WHEN tier = 'cheap' THEN 'cheap checks run on every asset'
       WHEN (SELECT max(severity) FROM findings WHERE detector_id = 'ood') > 0.4 THEN 'a cheap finding exceeds 0.4'
       ELSE 'no cheap finding exceeds 0.4' END AS reason
FROM (SELECT DISTINCT detector_id AS provider,
        CASE WHEN detector_id = 'ood' THEN 'cheap' ELSE 'expensive' END AS tier FROM findings)"""))
def tier_log(spark, folder):
    every = findings(spark, folder)
    providers = every.select(F.col("provenance.detector_id").alias("provider")).distinct().withColumn(
        "tier", F.when(F.col("provider") == "ood", "cheap").otherwise("expensive"))
    return E.tier_log(every.where("provenance.detector_id = 'ood'"), providers)


@query("provider_preparation", """
SELECT name, CASE WHEN name = 'logits_check' THEN 'Missing input: documents.logits'
  WHEN name = 'image_check' THEN 'Missing input: images' ELSE 'ready' END AS reason,
  CASE WHEN name = 'text_check' THEN (SELECT count(*) FROM documents) ELSE 0 END AS rows_ready
FROM (VALUES ('text_check'), ('logits_check'), ('image_check')) AS t(name)""")
def provider_preparation(spark, folder):
    inputs = {"documents": table(spark, folder, "documents")}
    wanted = {"text_check": ["documents.text"], "logits_check": ["documents.logits"], "image_check": ["images"]}
    ready, skipped = E.prepare_detectors(inputs, wanted)
    known = spark.createDataFrame([(n, "ready") for n in ready] + skipped, "name string, reason string")
    total = inputs["documents"].agg(F.count(F.lit(1)).alias("total"))
    return with_row(known, total).select(
        "name", "reason", F.when(F.col("reason") == "ready", F.col("total")).otherwise(F.lit(0)).alias("rows_ready"))


_CONVERGE_CTE = f"""
+ f AS (SELECT *, {SQL_FAMILY} AS family, ({SQL_COUNTS}) AS eligible FROM findings),
e AS (SELECT * FROM f WHERE eligible),
peak AS (SELECT asset_id, family, modality, max(confidence) AS m FROM e GROUP BY ALL),
shared AS (SELECT asset_id, family, count(*) > count(DISTINCT detector_id) OR count(signal_id) > count(DISTINCT signal_id) AS shared FROM e GROUP BY ALL),
div AS (SELECT asset_id, family, count(*) AS mods, min(m) AS low, max(m) AS best FROM peak GROUP BY ALL HAVING count(*) >= 2),
comp AS (SELECT asset_id, family, mods, least(0.95, best + CASE WHEN shared THEN 0 ELSE (1 - best) * 0.2 * low * (mods - 1) END) AS confidence, shared
  FROM div JOIN shared USING (asset_id, family)),
head AS (SELECT e.asset_id, e.family, max(e.severity) AS severity, min(e.ord) AS ord, count(*) AS members,
  CASE WHEN count(DISTINCT coalesce(e.quarantine_scope, '-')) = 1 THEN min(e.quarantine_scope) END AS scope,
  max(CASE e.access_assumptions WHEN 'white_box' THEN 2 WHEN 'gray_box' THEN 1 ELSE 0 END) AS a
  FROM e GROUP BY ALL),
lead_ AS (SELECT asset_id, family, modality FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, family ORDER BY confidence DESC, ord) AS k FROM e) WHERE k = 1),
ids AS (SELECT asset_id, family, string_agg(d, ',' ORDER BY d) AS detectors FROM (SELECT DISTINCT asset_id, family, detector_id AS d FROM e) GROUP BY ALL)
"""


@query("converge_findings", with_roles("findings", body=_CONVERGE_CTE + """
SELECT asset_id, 'composite_' || family AS finding_type, severity, round(comp.confidence, 9) AS confidence, modality,
  detectors, coalesce(scope, 'none') AS scope, CASE a WHEN 2 THEN 'white_box' WHEN 1 THEN 'gray_box' ELSE 'black_box' END AS access,
  'review' AS action, CAST(ord AS BIGINT) AS ord, TEXT(members) AS members
FROM comp JOIN head USING (asset_id, family) JOIN lead_ USING (asset_id, family) JOIN ids USING (asset_id, family)
UNION ALL
SELECT f.asset_id, f.finding_type, f.severity, round(f.confidence, 9), f.modality, '', coalesce(f.quarantine_scope, 'none'),
  f.access_assumptions, f.recommended_action, CAST(f.ord AS BIGINT), ''
FROM f LEFT JOIN comp ON f.asset_id = comp.asset_id AND f.family = comp.family WHERE comp.asset_id IS NULL OR NOT f.eligible"""))
def converge_findings(spark, folder):
    merged = E.converge(findings(spark, folder))
    return merged.select(
        "asset_id", "finding_type", "severity", r("confidence", 9).alias("confidence"), "modality",
        F.array_join("provenance.detector_ids", ",").alias("detectors"),
        F.coalesce("quarantine_scope", F.lit("none")).alias("scope"),
        F.col("access_assumptions").alias("access"), F.col("recommended_action").alias("action"), "ord",
        F.coalesce(F.col("provenance.attrs")["members"], F.lit("")).alias("members"))


@query("verdict_warnings_composites", with_roles("findings", body=_CONVERGE_CTE + f"""
, con AS (SELECT asset_id, family, count(*) AS n, string_agg(counter_text, '|' ORDER BY o) AS texts
  FROM (SELECT asset_id, family, counter_text, min(ord) AS o FROM e WHERE counter_text IS NOT NULL GROUP BY ALL) GROUP BY ALL),
ev AS (SELECT asset_id, family, string_agg(evidence_text, '|' ORDER BY o) AS texts
  FROM (SELECT asset_id, family, evidence_text, min(ord) AS o FROM e GROUP BY ALL) GROUP BY ALL),
c AS (SELECT asset_id, family, head.severity, comp.confidence FROM comp JOIN head USING (asset_id, family)),
v AS (SELECT *, {SQL_VERDICT} AS verdict FROM c)
SELECT v.asset_id, 'composite_' || v.family AS finding_type, verdict, coalesce(con.n, 0)::BIGINT AS counters,
  coalesce(con.texts, '') AS counter_texts, ev.texts AS evidence_texts,
  coalesce(verdict = 'QUARANTINE' AND con.n IS NULL, false) AS warned
FROM v JOIN ev USING (asset_id, family) LEFT JOIN con USING (asset_id, family)"""))
def verdict_warnings_composites(spark, folder):
    """Composites judged with what their members say for and against them."""
    judged = E.decide(E.converge(findings(spark, folder))).where(F.col("provenance.detector_id") == "correlation_engine")
    return judged.select(
        "asset_id", "finding_type", "verdict", F.size("counter_evidence").cast("bigint").alias("counters"),
        F.array_join("counter_evidence", "|").alias("counter_texts"),
        # The first three lines are the composite's own.
        F.array_join(F.slice("evidence", 4, F.size("evidence")), "|").alias("evidence_texts"),
        F.col("warning").isNotNull().alias("warned"))


@query("composite_evidence", with_roles("findings", body=_CONVERGE_CTE + """
SELECT e.asset_id, 'composite_' || e.family AS finding_type, kind, text, CAST(min(e.ord) AS BIGINT) AS ord FROM (
  SELECT asset_id, family, ord, 'evidence' AS kind, evidence_text AS text FROM e
  UNION ALL SELECT asset_id, family, ord, 'counter_evidence', counter_text FROM e WHERE counter_text IS NOT NULL) AS e
JOIN comp USING (asset_id, family) GROUP BY ALL"""))
def composite_evidence(spark, folder):
    return E.composite_evidence(findings(spark, folder)).select("asset_id", "finding_type", "kind", "text", "ord")


@query("decide", with_roles("findings", body=f"""
SELECT asset_id, CAST(ord AS BIGINT) AS ord, {SQL_VERDICT} AS verdict FROM findings"""))
def decide(spark, folder):
    return E.decide(findings(spark, folder)).select("asset_id", "ord", "verdict")


@query("verdict_warnings", with_roles("findings", body=f"""
SELECT asset_id, CAST(ord AS BIGINT) AS ord, 'Nothing given speaks against this quarantine: have it reviewed again.' AS warning
FROM findings WHERE {SQL_VERDICT} = 'QUARANTINE' AND counter_text IS NULL"""))
def verdict_warnings(spark, folder):
    judged = E.decide(findings(spark, folder))
    return judged.where("warning is not null").select("asset_id", "ord", "warning")


@query("trust_score", with_roles("findings", body="""
+ c AS (SELECT detector_id, 1 - max(severity * confidence) AS trust FROM findings GROUP BY detector_id)
SELECT detector_id, round(trust, 6) AS trust FROM c UNION ALL SELECT '(all)', round(avg(trust), 6) FROM c"""))
def trust_score(spark, folder):
    return E.trust_score(findings(spark, folder)).select(
        F.coalesce("detector_id", F.lit("(all)")).alias("detector_id"), r("trust").alias("trust"))


@query("matrix_counts", with_roles("findings", body=f"""
+ g AS (SELECT s, c FROM range(3) AS a(s), range(3) AS b(c)),
n AS (SELECT {SQL_BAND.format(c='severity')} AS s, {SQL_BAND.format(c='confidence')} AS c, count(*) AS k FROM findings GROUP BY ALL)
SELECT CAST(g.s AS INT) AS severity_band, CAST(g.c AS INT) AS confidence_band,
  CASE WHEN g.s = 0 OR g.c = 0 THEN 'ACCEPT' WHEN g.s = 2 AND g.c = 2 THEN 'QUARANTINE' ELSE 'REVIEW' END AS verdict,
  CAST(coalesce(k, 0) AS BIGINT) AS findings
FROM g LEFT JOIN n ON g.s = n.s AND g.c = n.c"""))
def matrix_counts(spark, folder):
    return E.matrix_counts(findings(spark, folder))


@query("findings_summary", with_roles("findings", body=f"""
+ x AS (SELECT 'total' AS grouping_name, 'all' AS value, confidence FROM findings
  UNION ALL SELECT 'severity', CASE {SQL_BAND.format(c='severity')} WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END, confidence FROM findings
  UNION ALL SELECT 'type', finding_type, confidence FROM findings)
SELECT grouping_name, value, count(*) AS findings, round(avg(confidence), 6) AS mean_confidence,
  min(confidence) AS min_confidence, max(confidence) AS max_confidence, round(median(confidence), 6) AS median_confidence
FROM x GROUP BY ALL"""))
def findings_summary(spark, folder):
    out = E.findings_summary(findings(spark, folder))
    return out.select(F.col("grouping").alias("grouping_name"), "value", "findings",
                      r("mean_confidence").alias("mean_confidence"), "min_confidence", "max_confidence",
                      r("median_confidence").alias("median_confidence"))


@query("radar", with_roles("findings", body="""
SELECT asset_id, detector_id, CASE WHEN detector_id = 'model_identity' THEN 'identity' ELSE 'behavioral' END AS axis,
  max(severity) AS severity, max(confidence) AS confidence, count(*) AS findings
FROM findings WHERE detector_id = 'model_identity' OR modality IN ('BEHAVIORAL', 'ACTIVATION') GROUP BY ALL"""))
def radar(spark, folder):
    return E.radar(findings(spark, folder))


@query("explain_verdict", with_roles("findings", body=f"""
SELECT CAST(ord AS BIGINT) AS ord, md5({SQL_VERDICT} || ' — ' || coalesce(quarantine_scope, 'sample') || ' (' || asset_id || ')' || chr(10)
  || 'Evidence | Counter-evidence' || chr(10) || '--- | ---' || chr(10) || evidence_text || ' | ' || coalesce(counter_text, 'Not provided')
  || CASE WHEN {SQL_VERDICT} = 'QUARANTINE' AND counter_text IS NULL
     THEN chr(10) || 'Nothing given speaks against this quarantine: have it reviewed again.' ELSE '' END) AS explanation_md5
FROM findings"""))
def explain_verdict(spark, folder):
    judged = E.decide(findings(spark, folder)).withColumn("scope", F.coalesce("quarantine_scope", F.lit("sample"))) \
        .withColumn("scope_asset_id", F.col("asset_id"))
    return E.explain_verdict(judged).select("ord", F.md5("explanation").alias("explanation_md5"))


@query("contributor_risk", with_roles("findings", "sample_meta", "batch_order", body=f"""
+ fam AS (SELECT asset_id, {SQL_FAMILY} AS family, max(severity) AS sev, count(DISTINCT modality) AS mods
  FROM findings WHERE {SQL_COUNTS} GROUP BY ALL),
per AS (SELECT asset_id, max(sev) AS sev, max(mods) AS conv FROM fam GROUP BY asset_id),
b AS (SELECT contributor_id, pos, count(*) AS n, count(sev) AS bad, coalesce(sum(CAST(sev AS DECIMAL(18,12))), 0) AS ssum, coalesce(sum(conv), 0) AS csum
  FROM sample_meta LEFT JOIN per USING (asset_id) JOIN batch_order USING (batch_id)
  WHERE contributor_id IS NOT NULL GROUP BY ALL),
w AS (SELECT *, bad / n AS rate,
  avg(bad / n) OVER p AS before_rate, count(*) OVER p AS nb, avg(bad / n) OVER q AS after_rate, count(*) OVER q AS na FROM b
  WINDOW p AS (PARTITION BY contributor_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
         q AS (PARTITION BY contributor_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
j AS (SELECT contributor_id, max(after_rate - before_rate) AS jump FROM w WHERE nb = 2 AND na = 2 GROUP BY contributor_id),
t AS (SELECT contributor_id, sum(n) AS n, sum(bad) AS bad, sum(ssum) AS s, sum(csum) AS c, max(bad) AS peak FROM b GROUP BY contributor_id),
m AS (SELECT t.contributor_id, n, bad, bad / n AS prevalence, coalesce(CAST(s AS DOUBLE) / nullif(bad, 0), 0) AS severity,
  coalesce(c / nullif(bad, 0), 0) AS conv, coalesce(peak / nullif(bad, 0), 0) AS conc,
  CASE WHEN jump >= 0.15 THEN jump ELSE 0 END AS temporal FROM t LEFT JOIN j USING (contributor_id))
SELECT contributor_id, CAST(n AS BIGINT) AS samples, CAST(bad AS BIGINT) AS anomalies, round(prevalence, 6) AS prevalence,
  round(severity, 6) AS severity, round(conv, 6) AS convergence_count, round(conc, 6) AS batch_concentration,
  round(temporal, 6) AS temporal_change,
  round(least(1, greatest(0, prevalence * (0.5 * severity + 0.2 * least(conv / 5, 1) + 0.15 * conc) + 0.15 * temporal)), 6) AS risk_score
FROM m"""))
def contributor_risk(spark, folder):
    batches = C.batch_rates(findings(spark, folder), role(spark, folder, "sample_meta"), role(spark, folder, "batch_order"))
    risk = C.contributor_risk(batches)
    return risk.select("contributor_id", "samples", "anomalies", *[
        r(c).alias(c) for c in ("prevalence", "severity", "convergence_count", "batch_concentration", "temporal_change", "risk_score")])


@query("temporal_change_point", with_roles("findings", "sample_meta", "batch_order", body=f"""
+ bad AS (SELECT DISTINCT asset_id FROM findings WHERE {SQL_COUNTS}),
b AS (SELECT contributor_id, batch_id, pos, count(bad.asset_id) / count(*) AS rate
  FROM sample_meta LEFT JOIN bad USING (asset_id) JOIN batch_order USING (batch_id) WHERE contributor_id IS NOT NULL GROUP BY ALL),
w AS (SELECT *, avg(rate) OVER p AS before_rate, count(*) OVER p AS nb, avg(rate) OVER q AS after_rate, count(*) OVER q AS na FROM b
  WINDOW p AS (PARTITION BY contributor_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING),
         q AS (PARTITION BY contributor_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
k AS (SELECT *, row_number() OVER (PARTITION BY contributor_id ORDER BY after_rate - before_rate DESC, pos) AS rn FROM w WHERE nb = 2 AND na = 2)
SELECT contributor_id, batch_id, round(before_rate, 6) AS before_rate, round(after_rate, 6) AS after_rate
FROM k WHERE rn = 1 AND after_rate - before_rate >= 0.01"""))
def temporal_change_point(spark, folder):
    batches = C.batch_rates(findings(spark, folder), role(spark, folder, "sample_meta"), role(spark, folder, "batch_order"))
    points = C.temporal_change_points(batches, drift_threshold=0.01)
    return points.select("contributor_id", "batch_id", r("before_rate").alias("before_rate"), r("after_rate").alias("after_rate"))


@query("metadata_coverage", with_roles("findings", "sample_meta", body="""
SELECT count(*) AS samples, count(*) FILTER (contributor_id IS NULL OR batch_id IS NULL) AS missing,
  round(avg(CASE WHEN contributor_id IS NULL OR batch_id IS NULL THEN 0 ELSE 1 END), 6) AS coverage,
  (SELECT count(DISTINCT asset_id) FROM findings WHERE asset_id NOT IN (SELECT asset_id FROM sample_meta)) AS unmatched
FROM sample_meta"""))
def metadata_coverage(spark, folder):
    out = C.metadata_coverage(findings(spark, folder), role(spark, folder, "sample_meta"))
    return out.select("samples", "missing", r("coverage").alias("coverage"), "unmatched")


@query("semi_anti_sets", with_roles("findings", "sample_meta", "batch_order", body="""
SELECT 'missing_metadata' AS kind, asset_id AS subject FROM sample_meta WHERE contributor_id IS NULL OR batch_id IS NULL
UNION ALL SELECT DISTINCT 'unmatched_finding', asset_id FROM findings WHERE asset_id NOT IN (SELECT asset_id FROM sample_meta)
UNION ALL SELECT DISTINCT 'unknown_batch', batch_id FROM sample_meta
  WHERE contributor_id IS NOT NULL AND batch_id IS NOT NULL AND batch_id NOT IN (SELECT batch_id FROM batch_order WHERE pos < 6)"""))
def semi_anti_sets(spark, folder):
    samples, found = role(spark, folder, "sample_meta"), findings(spark, folder)
    order = role(spark, folder, "batch_order").where("pos < 6")
    pick = lambda df, kind, c: df.select(F.lit(kind).alias("kind"), F.col(c).alias("subject"))
    return pick(C.missing_metadata(samples), "missing_metadata", "asset_id") \
        .unionByName(pick(C.unmatched_findings(found, samples), "unmatched_finding", "asset_id")) \
        .unionByName(pick(C.unknown_batches(samples, order), "unknown_batch", "batch_id"))


# Documents dealt to three assets, whose sample ids repeat; the first has every other batch only.
ROLES["asset_samples"] = """
SELECT 'set/' || TEXT(doc_id % 3) AS owner, 's' || TEXT((doc_id - doc_id % 3) / 3) AS sample, 'doc-' || TEXT(doc_id) AS asset_id,
  CASE WHEN doc_id % 53 > 0 THEN source END AS contributor_id, 'b' || TEXT(doc_id % 7) AS batch_id, CAST((doc_id % 7 * (doc_id % 3 + 2)) % 7 AS BIGINT) AS pos
FROM {documents} WHERE NOT (doc_id % 3 = 0 AND doc_id % 7 % 2 = 1)"""


@query("contributor_heatmap", with_roles("findings", "asset_samples", body=f"""
+ bad AS (SELECT DISTINCT asset_id FROM findings WHERE {SQL_COUNTS}),
seen AS (SELECT batch_id, min(struct_pack(owner := owner, pos := pos)) AS s FROM asset_samples GROUP BY batch_id),
o AS (SELECT batch_id, row_number() OVER (ORDER BY s, batch_id) AS pos FROM seen),
b AS (SELECT contributor_id, a.batch_id, o.pos, round(count(bad.asset_id) / count(*), 6) AS rate
  FROM asset_samples a LEFT JOIN bad USING (asset_id) JOIN o ON o.batch_id = a.batch_id WHERE contributor_id IS NOT NULL GROUP BY ALL)
SELECT contributor_id, string_agg(batch_id || '=' || printf('%.4f', rate), ' ' ORDER BY pos) AS series FROM b GROUP BY contributor_id"""))
def contributor_heatmap(spark, folder):
    """Over all assets: samples go by (asset, sample), and the batch order is merged as first seen."""
    samples = role(spark, folder, "asset_samples")
    order = C.merged_batch_order(samples.select(F.col("owner").alias("asset_id"), "pos", "batch_id").distinct())
    names = samples.select("asset_id", "owner", "sample")
    found = C.namespaced(findings(spark, folder).join(names, "asset_id"), "owner", "sample").drop("owner", "sample")
    meta = C.namespaced(samples.drop("asset_id"), "owner", "sample").select("asset_id", "contributor_id", "batch_id")
    series = C.batch_series(C.batch_rates(found, meta, order))
    cells = F.transform("series", lambda s: F.concat(s["batch_id"], F.lit("="), F.format_string("%.4f", F.round(s["anomaly_rate"], 6))))
    return series.select("contributor_id", F.array_join(cells, " ").alias("series"))


_RUNS = """SELECT 'run-' || TEXT(order_key) AS assessment_id, 'cust-' || TEXT(o_custkey) AS asset_id, day_no AS finished_at FROM (
  SELECT o_orderkey AS order_key, o_custkey, US_OF(o_orderdate) AS day_no FROM {orders}) AS q"""


def _runs(spark, folder):
    return spark.sql(roles.expand(_RUNS, 0), orders=table(spark, folder, "orders"))


@query("latest_assessment", with_roles(body="""
+ runs AS (""" + _RUNS.replace("{orders}", "orders") + """)
SELECT asset_id, assessment_id, CAST(finished_at AS BIGINT) AS finished_at FROM (
  SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY finished_at DESC, assessment_id DESC) AS k FROM runs) WHERE k = 1"""))
def latest_assessment(spark, folder):
    return E.latest_assessment(_runs(spark, folder))


@query("assessment_findings", with_roles("findings", body="""
+ x AS (SELECT asset_id, 'run-' || TEXT(ord % 3) AS run, ord, ord % 3 AS at FROM findings),
latest AS (SELECT asset_id, max(run) AS run FROM x GROUP BY asset_id)
SELECT asset_id, run AS assessment_id, CAST(count(*) AS BIGINT) AS findings FROM x JOIN latest USING (asset_id, run) GROUP BY ALL"""))
def assessment_findings(spark, folder):
    run = F.concat(F.lit("run-"), (F.col("ord") % 3).cast("string"))
    stored = findings(spark, folder).withColumn(
        "provenance", F.col("provenance").withField("attrs", F.create_map(F.lit("assessment_id"), run)))
    runs = stored.select("asset_id", run.alias("assessment_id"), (F.col("ord") % 3).alias("finished_at")).distinct()
    kept = E.findings_of(stored, E.latest_assessment(runs))
    return kept.groupBy("asset_id", F.col("provenance.attrs")["assessment_id"].alias("assessment_id")).agg(
        F.count(F.lit(1)).alias("findings"))


@query("assessment_coverage", """
SELECT 'user-' || CAST(user_id AS VARCHAR) AS assessment_id, count(DISTINCT event_type) AS requested,
  count(DISTINCT CASE WHEN value > 20 THEN event_type END) AS ran,
  count(DISTINCT event_type) - count(DISTINCT CASE WHEN value > 20 THEN event_type END) AS skipped,
  round(count(DISTINCT CASE WHEN value > 20 THEN event_type END) / count(DISTINCT event_type), 6) AS coverage
FROM events GROUP BY user_id""")
def assessment_coverage(spark, folder):
    log = table(spark, folder, "events").select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("assessment_id"),
        F.col("event_type").alias("provider"), (F.col("value") > 20).alias("ran"))
    return B.assessment_coverage(log).select("assessment_id", "requested", F.col("ran").cast("bigint").alias("ran"),
                                             F.col("skipped").cast("bigint").alias("skipped"), r("coverage").alias("coverage"))


def _access_inputs(spark, folder):
    customers = table(spark, folder, "customer")
    level = F.element_at(F.array(*[F.lit(x) for x in ("black_box", "gray_box", "white_box")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    requests = customers.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("asset_id"), level.alias("access_level"))
    checks = sorted(B.CAPABILITIES) + ["Custom probe"]
    every = customers.select("c_custkey", F.posexplode(F.array(*[F.lit(c) for c in checks])).alias("no", "check"))
    available = every.where((F.col("c_custkey") * 3 + F.col("no") * 5) % 7 < 4).select(
        F.concat(F.lit("m"), F.col("c_custkey").cast("string")).alias("asset_id"), "check")
    return requests, available


_ACCESS_SQL = """
WITH cap(no, "check", black_box, gray_box, white_box) AS (VALUES
  (0, 'Fine-Pruning', 'no', 'no', 'yes'), (1, 'Merkle activation commitment', 'no', 'partial', 'yes'),
  (2, 'Model Identity (hash check)', 'yes', 'yes', 'yes'), (3, 'Reference-battery comparison', 'yes (output-only)', 'yes', 'yes'),
  (4, 'Trigger reconstruction', 'no', 'partial', 'yes'), (5, 'Weight/activation statistics', 'no', 'partial', 'yes'),
  (6, 'Custom probe', NULL, NULL, NULL)),
m AS (SELECT 'm' || CAST(c_custkey AS VARCHAR) AS asset_id, CASE c_custkey % 3 WHEN 0 THEN 'black_box' WHEN 1 THEN 'gray_box' ELSE 'white_box' END AS level,
  "check", (c_custkey * 3 + no * 5) % 7 < 4 AS present,
  CASE c_custkey % 3 WHEN 0 THEN black_box WHEN 1 THEN gray_box ELSE white_box END AS capability, no
  FROM customer, cap WHERE no < 6 OR (c_custkey * 3 + no * 5) % 7 < 4),
x AS (SELECT asset_id, "check", CASE WHEN no = 6 OR NOT present OR capability = 'no' THEN 'skipped' WHEN capability = 'partial' THEN 'partial' ELSE 'ran' END AS status,
  CASE WHEN no = 6 THEN 'no contract is known for this check'
    WHEN NOT present THEN 'the check or an input of it is absent'
    WHEN capability = 'no' THEN level || ' access is not enough'
    WHEN capability = 'partial' THEN 'only what the access level shows is evaluated' ELSE capability END AS reason FROM m)
"""


@query("access_matrix", _ACCESS_SQL + 'SELECT asset_id, "check", status, reason FROM x')
def access_matrix(spark, folder):
    return B.access_matrix(*_access_inputs(spark, folder)).select("asset_id", "check", "status", "reason")


@query("coverage_confidence", _ACCESS_SQL + """
SELECT asset_id, count(*) AS requested, count(*) FILTER (status <> 'skipped') AS ran,
  round(avg(CASE WHEN status <> 'skipped' THEN 1 ELSE 0 END), 6) AS coverage FROM x GROUP BY asset_id""")
def coverage_confidence(spark, folder):
    out = B.coverage_confidence(B.access_matrix(*_access_inputs(spark, folder)))
    return out.select("asset_id", "requested", F.col("ran").cast("bigint").alias("ran"), r("coverage").alias("coverage"))


@query("assurance_debt", _ACCESS_SQL + """
SELECT "check", reason AS gap, count(*) AS owed FROM x WHERE status <> 'ran' GROUP BY ALL""")
def assurance_debt(spark, folder):
    owed = B.assurance_debt(B.access_matrix(*_access_inputs(spark, folder)))
    return owed.groupBy("check", "gap").agg(F.count(F.lit(1)).alias("owed"))


_STATIC_SQL = ("(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in [
    *[("attack_class", n, f"near to {e}; its checks may miss cases") for n, e in P.ATTACK_CLASSES.items()],
    ("fallback", "black_box", P.FALLBACK), *[("limitation", f"{i:02d}", t) for i, t in enumerate(P.LIMITATIONS, 1)],
    ("evaluation", "ablation", "reported for the data given"), ("evaluation", "adaptive_attacker", "not evaluated")]) + ") s(section, item, status)")
_STATEMENT_SQL = f"""SELECT section, item, status FROM {_STATIC_SQL}
UNION ALL SELECT 'capability', "check" || ' / ' || level, CASE level WHEN 'black_box' THEN black_box WHEN 'gray_box' THEN gray_box ELSE white_box END
  FROM cap, (VALUES ('black_box'), ('gray_box'), ('white_box')) l(level) WHERE no < 6
UNION ALL SELECT DISTINCT 'assurance_debt', "check", reason FROM x WHERE status <> 'ran'"""


def _debt(spark, folder):
    return B.assurance_debt(B.access_matrix(*_access_inputs(spark, folder)))


@query("coverage_statement", _ACCESS_SQL + _STATEMENT_SQL)
def coverage_statement(spark, folder):
    return P.coverage_statement(_debt(spark, folder), ["ablation"])


# Manifests of every asset that has findings, and of some that have none; assets of the debts.
ROLES["passport_assets"] = """
SELECT 'doc-' || TEXT(doc_id) AS asset_id, CASE WHEN doc_id % 3 > 0 THEN 'dataset' END AS node_type, CASE WHEN doc_id % 5 > 0 THEN md5(source) END AS hash FROM {documents}"""
ROLES["passport_manifests"] = """
SELECT 'doc-' || TEXT(doc_id) AS asset_id, CASE no WHEN 1 THEN 'dataset' WHEN 2 THEN 'model' ELSE 'pipeline' END AS kind,
  md5(source || TEXT(no)) AS digest, CASE WHEN no < 3 THEN '/data/' || source || '_' || TEXT(no) END AS path
FROM (SELECT doc_id, source, EACH(1, 3) AS no FROM {documents}) AS d WHERE (doc_id + no) % 4 > 0"""
ROLES["passport_debts"] = """
SELECT 'doc-' || TEXT(doc_id) AS asset_id, 'Probe ' || TEXT(no) AS check_name, 'gap of ' || lang AS gap,
  'Probe ' || TEXT(no) || ': run it on ' || lang AS recommendation
FROM (SELECT doc_id, lang, EACH(1, 2) AS no FROM {documents}) AS d WHERE (doc_id + no) % 6 = 0"""


def _passports(spark, folder):
    judged = E.decide(findings(spark, folder))
    assets, manifests = role(spark, folder, "passport_assets"), role(spark, folder, "passport_manifests")
    debt = role(spark, folder, "passport_debts").withColumnRenamed("check_name", "check")
    rows = P.passport_rows(judged, assets, manifests, debt)
    statement = P.coverage_statement(_debt(spark, folder), ["ablation"])
    heads = P.passport_headers(judged, rows, assets, statement, F.lit("2024-05-01 12:00:00").cast("timestamp"))
    return judged, manifests, debt, rows, heads


_NUM = "printf('%.6f', {})"
_TEXT = "coalesce('\"' || {} || '\"', 'null')"
_SUMS = "coalesce(TEXT(sum(CAST('0x' || substr(h, {}, 15) AS BIGINT)::HUGEINT)), '0')"
_H4 = " || ':' || ".join(_SUMS.format(1 + 15 * i) for i in range(4))
_LIMITS_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in P.LIMITATIONS) + "]"
_PASSPORT_CTE = _ACCESS_SQL.rstrip() + f""",
judged AS (SELECT *, {SQL_VERDICT} AS verdict FROM findings),
body AS (SELECT *, CASE WHEN verdict = 'QUARANTINE' AND counter_text IS NULL THEN 'Nothing given speaks against this quarantine: have it reviewed again.' END AS warning,
  replace(finding_type, '_', ' ') || ': ' || evidence_text || ' (severity ' || TEXT(severity) || ', confidence ' || TEXT(confidence) || ': ' || lower(verdict) || ')' AS reason FROM judged),
content AS (
  SELECT asset_id, 'finding' AS section, '{{"access_assumptions":' || {_TEXT.format('access_assumptions')} || ',"asset_id":"' || asset_id || '","confidence":' || {_NUM.format('confidence')}
    || ',"counter_evidence":[' || coalesce('"' || counter_text || '"', '') || '],"disposition":"' || lower(verdict) || '","evidence":["' || evidence_text || '"],"finding_type":"' || finding_type
    || '","modality":"' || modality || '","ord":' || TEXT(ord) || ',"provenance":{{"attrs":{{}},"config_hash":"' || config_hash || '","detector_id":"' || detector_id
    || '","detector_ids":[],"input_hashes":[],"modalities":[],"signal_ids":[' || coalesce('"' || signal_id || '"', '') || '],"version":"1.0.0"}},"quarantine_scope":' || {_TEXT.format('quarantine_scope')}
    || ',"reason":"' || reason || '","recommended_action":"' || recommended_action || '","severity":' || {_NUM.format('severity')} || ',"verdict":"' || verdict || '","warning":' || {_TEXT.format('warning')} || '}}' AS content FROM body
  UNION ALL SELECT asset_id, 'asset', '{{"asset_id":"' || asset_id || '","hash":' || {_TEXT.format('hash')} || ',"node_type":' || {_TEXT.format('node_type')} || '}}' FROM passport_assets
  UNION ALL SELECT asset_id, 'manifest', '{{"asset_id":"' || asset_id || '","digest":"' || digest || '","kind":"' || kind || '","path":' || {_TEXT.format('path')} || '}}' FROM passport_manifests
  UNION ALL SELECT asset_id, 'debt', '{{"asset_id":"' || asset_id || '","check":"' || check_name || '","gap":"' || gap || '","recommendation":"' || recommendation || '"}}' FROM passport_debts),
sums AS (SELECT asset_id, {_H4} AS all_rows, count(*) FILTER (section = 'manifest') AS manifests, count(*) FILTER (section = 'debt') AS debts
  FROM (SELECT *, sha256(section || ':' || content) AS h FROM content) GROUP BY asset_id),
stated AS (SELECT sha256({_H4}) AS coverage_digest FROM (SELECT sha256('{{"item":"' || item || '","section":"' || section || '","status":' || {_TEXT.format('status')} || '}}') AS h FROM ({_STATEMENT_SQL}))),
counts AS (SELECT asset_id, count(*) AS findings, count(*) FILTER (verdict = 'QUARANTINE') AS quarantine, count(*) FILTER (verdict = 'REVIEW') AS review,
  count(*) FILTER (verdict = 'ACCEPT') AS accept, list_sort(list(DISTINCT access_assumptions)) AS access_used FROM judged GROUP BY asset_id),
heads AS (SELECT a.asset_id, node_type, hash, coalesce(findings, 0) AS findings, coalesce(quarantine, 0) AS quarantine, coalesce(review, 0) AS review, coalesce(accept, 0) AS accept,
  manifests, debts, coalesce(access_used, []) AS access_used, list_concat({_LIMITS_SQL}, CASE WHEN findings IS NULL THEN ['{P.NO_FINDINGS}'] ELSE [] END, ['{P.PRECISION}']) AS limitations,
  coverage_digest, all_rows FROM passport_assets a LEFT JOIN counts USING (asset_id) JOIN sums USING (asset_id), stated),
passports AS (SELECT *, sha256(concat_ws(chr(10), all_rows, '"' || asset_id || '"', {_TEXT.format('node_type')}, {_TEXT.format('hash')}, '"1.0.0"', '1714564800.000000', TEXT(findings), TEXT(quarantine),
  TEXT(review), TEXT(accept), TEXT(manifests), TEXT(debts), '[' || coalesce('"' || array_to_string(access_used, '","') || '"', '') || ']', '["' || array_to_string(limitations, '","') || '"]',
  '"' || coverage_digest || '"')) AS digest FROM (SELECT * REPLACE (CASE WHEN len(access_used) = 0 THEN NULL ELSE access_used END AS access_used) FROM heads))
"""


@query("passport", with_roles("findings", "passport_assets", "passport_manifests", "passport_debts", body="+ " + _PASSPORT_CTE.strip().removeprefix("WITH") + """
SELECT asset_id, node_type, hash, findings, quarantine, review, accept, manifests, debts, coalesce(array_to_string(access_used, ','), '') AS access_used,
  array_to_string(limitations, '|') AS limitations, coverage_digest, digest FROM passports"""))
def passport(spark, folder):
    heads = _passports(spark, folder)[-1]
    return heads.drop("version", "issued_at").withColumns(
        {"access_used": F.array_join("access_used", ","), "limitations": F.array_join("limitations", "|")})


@query("passport_rows", with_roles("findings", "passport_assets", "passport_manifests", "passport_debts", body="+ " + _PASSPORT_CTE.strip().removeprefix("WITH") + """
SELECT asset_id, section, content FROM content"""))
def passport_rows(spark, folder):
    return _passports(spark, folder)[3].select("asset_id", "section", "content")


@query("passport_reasons", with_roles("findings", body=f"""
SELECT asset_id, CAST(ord AS BIGINT) AS ord, lower({SQL_VERDICT}) AS disposition,
  replace(finding_type, '_', ' ') || ': ' || evidence_text AS reason_start FROM findings"""))
def passport_reasons(spark, folder):
    body = E.passport_findings(E.decide(findings(spark, folder)))
    return body.select("asset_id", "ord", "disposition", F.substring_index("reason", " (severity ", 1).alias("reason_start"))


_CLEAN = "regexp_replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([\\\\`*_{{}}\\[\\]()#+\\-.!|])', '\\\\\\1', 'g')"


@query("passport_markdown", with_roles("findings", "passport_assets", "passport_manifests", "passport_debts", body="+ " + _PASSPORT_CTE.strip().removeprefix("WITH") + f"""
, texts AS (
SELECT asset_id, 0 AS section, 0 AS ord, ['# Passport', 'Asset: ' || {_CLEAN.format('asset_id')}, 'Type: ' || {_CLEAN.format("coalesce(node_type, 'unknown')")}, 'Hash: ' || coalesce(hash, 'none'),
  'Version: 1\\.0\\.0', 'Issued: 2024\\-05\\-01 12:00:00', 'quarantine ' || TEXT(quarantine) || ', review ' || TEXT(review) || ', accept ' || TEXT(accept) || ', findings ' || TEXT(findings)] AS l FROM passports
UNION ALL SELECT asset_id, 1, ord, list_concat(['### ' || {_CLEAN.format('finding_type')}, 'Disposition: ' || lower(verdict), 'Evidence:', '- ' || {_CLEAN.format('evidence_text')}, 'Counter-evidence:'],
  CASE WHEN counter_text IS NULL THEN [] ELSE ['- ' || {_CLEAN.format('counter_text')}] END, ['Modality: ' || {_CLEAN.format('modality')}, 'Access: ' || {_CLEAN.format('access_assumptions')}]) FROM body
UNION ALL SELECT asset_id, 1, 0, ['{P.NO_FINDINGS}'] FROM passports WHERE findings = 0
UNION ALL SELECT asset_id, 2, CASE kind WHEN 'dataset' THEN 1 WHEN 'model' THEN 2 ELSE 3 END, ['- ' || kind || ' manifest ' || digest || coalesce(' of ' || {_CLEAN.format('path')}, '')] FROM passport_manifests
UNION ALL SELECT asset_id, 3, -1, ['- ' || {_CLEAN.format('recommendation')}] FROM passport_debts
UNION ALL SELECT asset_id, 4, 0, list_transform(limitations, lambda t: '- ' || {_CLEAN.format('t')}) FROM passports
UNION ALL SELECT asset_id, 5, 0, ['Coverage statement: ' || coverage_digest, 'Digest: ' || digest] FROM passports)
SELECT asset_id, section, CAST(ord AS BIGINT) AS ord, CAST(part AS INT) AS part, l[part + 1] AS line FROM (SELECT *, unnest(range(len(l))) AS part FROM texts)"""))
def passport_markdown(spark, folder):
    judged, manifests, debt, _, heads = _passports(spark, folder)
    out = P.passport_lines(heads, judged, manifests, debt)
    # Debts stand in the order of a hash, which the check does not repeat.
    return out.withColumn("ord", F.when(F.col("section") == 3, -1).otherwise(F.col("ord")))


@query("verify_passports", with_roles("passport_assets", "passport_manifests", body="""
SELECT a.asset_id, count(digest) FILTER (kind = 'model' AND length(a.asset_id) % 2 = 0) = 0 AS valid
FROM passport_assets a LEFT JOIN passport_manifests m USING (asset_id) GROUP BY a.asset_id"""))
def verify_passports(spark, folder):
    """Model manifests of every asset with an id of even length are tampered with."""
    _, _, _, rows, heads = _passports(spark, folder)
    hit = (F.col("section") == "manifest") & F.col("content").contains('"kind":"model"') & (F.length("asset_id") % 2 == 0)
    return P.verify_passports(heads, rows.withColumn("content", F.when(hit, F.replace("content", F.lit("/data/"), F.lit("/date/"))).otherwise(F.col("content"))))


@query("staleness", """
WITH issued AS (SELECT 'p' || CAST(c_custkey AS VARCHAR) AS passport_id, kind, no, c_custkey AS k
  FROM customer, (VALUES ('dataset', 1), ('model', 2), ('pipeline', 3)) AS v(kind, no) WHERE (c_custkey + no) % 5 > 0),
sent AS (SELECT 'p' || CAST(c_custkey AS VARCHAR) AS passport_id, kind, no, c_custkey AS k
  FROM customer, (VALUES ('dataset', 1), ('model', 2), ('pipeline', 3)) AS v(kind, no) WHERE (c_custkey * 3 + no) % 11 > 0 AND c_custkey % 19 > 0),
j AS (SELECT coalesce(i.passport_id, s.passport_id) AS passport_id, coalesce(i.kind, s.kind) AS kind, coalesce(i.no, s.no) AS no,
  coalesce(i.k, s.k) AS k, i.k IS NOT NULL AS bound, s.k IS NOT NULL AS supplied
  FROM issued i FULL JOIN sent s ON i.passport_id = s.passport_id AND i.kind = s.kind),
q AS (SELECT passport_id, kind, supplied, CASE WHEN NOT supplied THEN kind || ' has no manifest any more'
  WHEN bound AND (k + no) % 7 = 0 THEN kind || ' has another manifest than when issued'
  WHEN NOT bound AND (k + no) % 4 = 0 AND kind <> 'pipeline' THEN kind || ' has no input to compare with'
  WHEN NOT bound AND (k + no) % 4 = 0 THEN 'pipeline was not recorded at issue'
  WHEN (k + no) % 9 = 0 THEN kind || ' manifest cannot be read'
  WHEN (k + no) % 6 = 0 THEN kind || ' no longer agrees with its manifest' END AS reason FROM j),
g AS (SELECT passport_id, count(*) FILTER (supplied) AS supplied, string_agg(reason, '; ' ORDER BY reason) AS kinds FROM q GROUP BY passport_id)
SELECT p.passport_id, concat_ws('; ', CASE WHEN coalesce(supplied, 0) = 0 THEN 'no manifest was given to compare with' END,
  CASE WHEN NOT valid THEN 'the digest of the passport is wrong' END, CASE WHEN valid THEN kinds END) AS reasons
FROM (SELECT 'p' || CAST(c_custkey AS VARCHAR) AS passport_id, c_custkey % 17 > 0 AS valid FROM customer) AS p LEFT JOIN g USING (passport_id)""")
def staleness(spark, folder):
    base = table(spark, folder, "customer").select(
        F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("passport_id"), F.col("c_custkey").alias("k"))
    kinds = base.select("*", F.posexplode(F.array(F.lit("dataset"), F.lit("model"), F.lit("pipeline"))).alias("no", "kind")) \
        .withColumn("no", F.col("no") + 1)
    key = F.col("k") + F.col("no")
    issued = kinds.where((key % 5) > 0).select(
        "passport_id", "kind", F.md5(F.concat("passport_id", "kind")).alias("digest"),
        F.when(F.col("kind") != "pipeline", F.concat(F.lit("/data/"), F.col("passport_id"))).alias("path"))
    # Only unbound manifests can lack a path: bound ones fall back to the signed one.
    current = kinds.where((F.col("k") * 3 + F.col("no")) % 11 > 0).where("k % 19 > 0").select(
        "passport_id", "kind",
        F.when(key % 7 == 0, F.lit("other")).otherwise(F.md5(F.concat("passport_id", "kind"))).alias("digest"),
        F.when(key % 4 > 0, F.lit("/now")).alias("path"),
        F.when(key % 9 > 0, key % 6 > 0).alias("matches"))
    passports = base.select("passport_id", (F.col("k") % 17 > 0).alias("valid"))
    return E.staleness(issued, current, passports).select("passport_id", F.array_join("reasons", "; ").alias("reasons"))


def _graph(spark, folder):
    # Nodes are grouped and edges made distinct by what reads them, so not here as well.
    edges, declared = (role(spark, folder, name, repeats=True) for name in ("lineage_edges", "lineage_nodes"))
    return edges, declared, L.build_nodes(declared, edges)


@query("lineage_nodes", with_roles("lineage_edges", "lineage_nodes", body="""
SELECT id, node_type, coalesce(hash, '') AS hash, false AS orphan FROM lineage_nodes
UNION ALL SELECT DISTINCT parent, parent_type, '', true FROM lineage_edges WHERE parent NOT IN (SELECT id FROM lineage_nodes)"""))
def lineage_nodes(spark, folder):
    _, _, nodes = _graph(spark, folder)
    return nodes.select("id", "node_type", F.coalesce("hash", F.lit("")).alias("hash"), "orphan")


_EDGES_SQL = with_roles("lineage_edges", "findings", "log", body="""
SELECT DISTINCT parent, child, parent_type FROM lineage_edges
UNION ALL SELECT DISTINCT asset_id, 'finding:' || sha256(concat_ws(chr(31), asset_id, finding_type, TEXT(severity), TEXT(confidence), modality, detector_id, evidence_text)), 'asset' FROM findings
UNION ALL SELECT DISTINCT CASE WHEN model_digest = md5('user') THEN 'user-model' ELSE 'unknown-model:' || model_digest END, input_hash, 'model' FROM log""")


@query("lineage_edges", _EDGES_SQL)
def lineage_edges(spark, folder):
    """Declared edges, those to findings, and those from models to inference records by digest."""
    edges, _, _ = _graph(spark, folder)
    models = spark.createDataFrame([("user-model", "user")], "id string, name string").select("id", F.md5("name").alias("hash"))
    records = role(spark, folder, "log").select(F.col("input_hash").alias("record_hash"), "model_digest")
    return edges.select("parent", "child", "parent_type").distinct().unionByName(L.finding_edges(findings(spark, folder))).unionByName(
        L.inference_edges(records, models))


@query("published_lineage", _EDGES_SQL)
def published_lineage(spark, folder):
    """Nodes and edges as one release, then a release whose second table fails: what is read is the first, whole."""
    path = scratch(spark, "lineage")
    sinks.publish({"nodes": lineage_nodes(spark, folder), "edges": lineage_edges(spark, folder)}, path)
    # The second release writes what the first one made.
    edges = sinks.published(spark, path)["edges"]
    failing = F.when(F.col("parent") == "user-model", F.raise_error(F.lit("lost on the way"))).otherwise(F.lit("late")).cast("string")
    try:
        sinks.publish({"nodes": edges.select("child"), "edges": edges.withColumn("parent_type", failing)}, path)
    except Exception as error:
        if "lost on the way" not in str(error):
            raise
    return sinks.published(spark, path)["edges"]


@query("lineage_type_conflicts", with_roles("lineage_nodes", body="""
+ x AS (SELECT id, node_type FROM lineage_nodes UNION ALL SELECT 'order-' || TEXT(o_orderkey), 'dataset' FROM orders WHERE o_orderkey % 50 = 0)
SELECT id, min(node_type) AS first_type, max(node_type) AS second_type FROM x WHERE node_type <> 'asset' GROUP BY id HAVING min(node_type) <> max(node_type)"""))
def lineage_type_conflicts(spark, folder):
    _, declared, _ = _graph(spark, folder)
    extra = table(spark, folder, "orders").where("o_orderkey % 50 = 0").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("dataset").alias("node_type"))
    return L.type_conflicts(declared.select("id", "node_type").unionByName(extra))


@query("orphan_nodes", with_roles("lineage_edges", "lineage_nodes", body="""
SELECT DISTINCT parent AS id, parent_type AS node_type FROM lineage_edges WHERE parent NOT IN (SELECT id FROM lineage_nodes)
UNION ALL SELECT 'unknown-training-dataset:order-' || TEXT(o_orderkey), 'dataset' FROM orders WHERE o_orderkey % 40 = 0"""))
def orphan_nodes(spark, folder):
    edges, declared, _ = _graph(spark, folder)
    models = declared.where("node_type = 'model'")
    known = edges.where("parent_type = 'dataset'").select(F.col("child").alias("model_id"), F.col("parent").alias("dataset_id")) \
        .where("cast(substring_index(model_id, '-', -1) as double) % 40 > 0")
    synthetic = L.model_parents(models.select("id"), known).where("parent like 'unknown-training-dataset:%'")
    return L.orphan_parents(declared, edges).unionByName(
        synthetic.select(F.col("parent").alias("id"), F.col("parent_type").alias("node_type")))


@query("lineage_cycles", with_roles("lineage_edges", recursive=True, body="""
+ e AS (SELECT parent, child FROM lineage_edges
  UNION SELECT 'nation-' || TEXT(n_nationkey), 'region-' || TEXT(n_regionkey) FROM nation WHERE n_nationkey % 5 = 0
  UNION SELECT 'customer-' || TEXT(c_custkey), 'nation-' || TEXT(c_nationkey) FROM customer WHERE c_custkey % 41 = 0
  UNION SELECT 'order-' || TEXT(o_orderkey), 'customer-' || TEXT(o_custkey) FROM orders WHERE o_orderkey % 83 = 0),
t AS (SELECT * FROM e WHERE child IN (SELECT parent FROM e)),
u AS (SELECT * FROM t WHERE child IN (SELECT parent FROM t)),
reach(src, dst) AS (SELECT parent, child FROM u UNION SELECT r.src, u.child FROM reach r JOIN u ON r.dst = u.parent)
SELECT e.parent, e.child FROM e JOIN reach r ON r.src = e.child AND r.dst = e.parent"""))
def lineage_cycles(spark, folder):
    edges = role(spark, folder, "lineage_edges").select("parent", "child")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    back = table(spark, folder, "nation").where("n_nationkey % 5 = 0").select(
        name("nation-", "n_nationkey").alias("parent"), name("region-", "n_regionkey").alias("child"))
    more = table(spark, folder, "customer").where("c_custkey % 41 = 0").select(
        name("customer-", "c_custkey").alias("parent"), name("nation-", "c_nationkey").alias("child"))
    deep = table(spark, folder, "orders").where("o_orderkey % 83 = 0").select(
        name("order-", "o_orderkey").alias("parent"), name("customer-", "o_custkey").alias("child"))
    return L.cycle_edges(edges.union(back).union(more).union(deep))


_REACH = """
+ e AS (SELECT DISTINCT parent, child FROM lineage_edges),
reach(src, dst) AS (SELECT parent, child FROM e WHERE parent LIKE 'region-%' OR parent LIKE 'nation-%'
  UNION SELECT r.src, e.child FROM reach r JOIN e ON r.dst = e.parent),
node AS (SELECT id, node_type FROM lineage_nodes UNION SELECT parent, parent_type FROM lineage_edges WHERE parent NOT IN (SELECT id FROM lineage_nodes))
"""


@query("downstream_of", with_roles("lineage_edges", "lineage_nodes", recursive=True, body=_REACH + """
SELECT src AS source, node_type, count(*) AS reached FROM reach JOIN node ON dst = id GROUP BY ALL"""))
def downstream_of(spark, folder):
    edges, _, nodes = _graph(spark, folder)
    sources = nodes.where("id like 'region-%' or id like 'nation-%'")
    graph = condense(edges)
    pairs = L.reach(graph, sources).join(nodes.select(F.col("id").alias("node"), "node_type"), "node")
    return L.named(graph, pairs.groupBy("source", "node_type").agg(F.count(F.lit(1)).alias("reached")), "source")


@query("ancestors_of", with_roles("lineage_edges", recursive=True, body="""
+ e AS (SELECT DISTINCT parent, child FROM lineage_edges),
up(node, anc) AS (SELECT child, parent FROM e UNION SELECT u.node, e.parent FROM up u JOIN e ON u.anc = e.child)
SELECT node, anc AS ancestor FROM up"""))
def ancestors_of(spark, folder):
    edges, _, _ = _graph(spark, folder)
    return L.ancestors_of(edges)


@query("blast_radius", with_roles("lineage_edges", "lineage_nodes", recursive=True, body=_REACH + """
SELECT src AS source, count(*) FILTER (node_type = 'model') AS models, count(*) FILTER (node_type = 'dataset') AS datasets,
  count(*) FILTER (node_type = 'inference') AS inference_records, count(*) AS total
FROM reach JOIN node ON dst = id WHERE node_type IN ('model', 'dataset', 'inference') GROUP BY src"""))
def blast_radius(spark, folder):
    edges, _, nodes = _graph(spark, folder)
    graph = condense(edges)
    sources = nodes.where("id like 'region-%' or id like 'nation-%'")
    pairs = L.reach(graph, sources, itself=False)
    return L.named(graph, L.blast_radius(pairs, settle(nodes.select("id", "node_type")), apart=True), "source")


@query("blast_consumers", with_roles("lineage_edges", "lineage_nodes", recursive=True, body=_REACH + """
SELECT src AS source, 'flag-' || l_returnflag AS consumer_id, count(*) AS records FROM reach JOIN (
  SELECT 'line-' || TEXT(l_orderkey) || '.' || TEXT(l_linenumber) AS id, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1) ON dst = id
WHERE l_returnflag <> 'N' GROUP BY ALL"""))
def blast_consumers(spark, folder):
    edges, _, nodes = _graph(spark, folder)
    graph = condense(edges)
    pairs = L.reach(graph, nodes.where("id like 'region-%' or id like 'nation-%'"))
    line = F.concat(F.lit("line-"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    records = table(spark, folder, "lineitem").groupBy(line.alias("id")).agg(F.min("l_returnflag").alias("flag")).select(
        "id", F.when(F.col("flag") != "N", F.concat(F.lit("flag-"), F.col("flag"))).alias("consumer_id"))
    return L.named(graph, L.consumers_hit(pairs, records), "source")


@query("propagate_confidence", with_roles("lineage_edges", "lineage_findings", recursive=True, body="""
+ e AS (SELECT DISTINCT parent, child FROM lineage_edges),
up(node, anc) AS (SELECT child, parent FROM e UNION SELECT u.node, e.parent FROM up u JOIN e ON u.anc = e.child),
every AS (SELECT parent AS id FROM e UNION SELECT child FROM e),
cap AS (SELECT node, min(confidence) AS confidence FROM up JOIN lineage_findings ON anc = asset_id GROUP BY node)
SELECT id, least(CAST(0.45 AS DOUBLE), coalesce(confidence, 0.45)) AS confidence FROM every LEFT JOIN cap ON id = node"""))
def propagate_confidence(spark, folder):
    edges, _, _ = _graph(spark, folder)
    every = edges.select(F.col("parent").alias("id")).union(edges.select("child")).distinct()
    return L.propagate_confidence(edges, role(spark, folder, "lineage_findings"), every.withColumn("confidence", F.lit(0.45)))


@query("resolve_scope", with_roles("lineage_edges", "lineage_nodes", recursive=True, body="""
+ e AS (SELECT DISTINCT parent, child FROM lineage_edges),
node AS (SELECT id, node_type FROM lineage_nodes UNION SELECT parent, parent_type FROM lineage_edges WHERE parent NOT IN (SELECT id FROM lineage_nodes)),
ask AS (SELECT id FROM node),
up(id, anc) AS (SELECT id, id FROM ask UNION SELECT u.id, e.parent FROM up u JOIN e ON u.anc = e.child),
cand AS (SELECT up.id, anc, node_type FROM up JOIN node ON node.id = anc WHERE node_type <> 'asset'),
tops AS (SELECT c.id, c.anc, c.node_type FROM cand c WHERE NOT EXISTS (
  SELECT 1 FROM e JOIN cand p ON p.anc = e.parent AND p.id = c.id WHERE e.child = c.anc)),
best AS (SELECT id, min(anc) AS anc, arg_min(node_type, anc) AS node_type FROM tops GROUP BY id)
SELECT ask.id AS asset_id, CASE coalesce(node_type, '') WHEN 'contributor' THEN 'contributor' WHEN 'dataset' THEN 'batch' WHEN 'model' THEN 'model'
  WHEN 'inference' THEN 'inference_record' ELSE 'sample' END AS scope, coalesce(anc, ask.id) AS scope_asset_id,
  best.id IS NULL AS fallback
FROM ask LEFT JOIN best USING (id)"""))
def resolve_scope(spark, folder):
    edges, _, nodes = _graph(spark, folder)
    nodes = settle(nodes.select("id", "node_type"))
    asked = nodes.select(F.col("id").alias("asset_id"), F.lit(None).cast("string").alias("quarantine_scope"))
    out = E.resolve_scope(asked, L.scope_tops(nodes, edges))
    return out.select("asset_id", "scope", "scope_asset_id", F.col("scope_note").isNotNull().alias("fallback"))
