"""A whole assessment of vectors with planted relatives and unreadable rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions import fingerprints as FP
from attest.operators import assessment as A
from attest.operators import duplicates as D
from attest.operators import evidence as E
from attest.operators import neighbours as N
from attest.operators import outliers as O
from attest.plans.evidence import _CONVERGE_CTE, SQL_VERDICT
from attest.plans.registry import query, r
from attest.plans.roles import ROLES, role, with_roles

# Labels as texts, some of which are none, and vectors of which some are missing or short.
ROLES["raw_vectors"] = """
SELECT ord, 'v' || TEXT(ord) AS sample_id, CASE WHEN ord % 41 = 0 THEN 'n/a' ELSE TEXT(label) END AS label_text,
       CASE WHEN ord % 43 = 0 THEN NULL WHEN ord % 47 = 0 THEN ARR(CAST(1 AS DOUBLE)) ELSE vec END AS vec
FROM (SELECT CAST(vec_id AS BIGINT) * 4 AS ord, label, DARR(embedding) AS vec FROM {embeddings}
  UNION ALL SELECT CAST(vec_id AS BIGINT) * 4 + 1, label, BUMP(DARR(embedding), 0.02) FROM {embeddings} WHERE vec_id % 7 = 0
  UNION ALL SELECT CAST(vec_id AS BIGINT) * 4 + 2, label, BUMP(DARR(embedding), 0.09) FROM {embeddings} WHERE vec_id % 21 = 0) AS x"""

_NO_VECTOR = A.Rule("the vector is missing", "vec is null")
_SHORT = A.Rule("the vector has another length", "size(vec) <> 64")
_LABEL = A.Rule("the label is no whole number", "try_cast(label_text as int) is null")
_ALL = ("ord", "sample_id", "label_text", "vec")


def _perceptual(t):
    rows = t["samples"].withColumn("fp", FP.vector_fingerprint(F.col("vec")))
    return D.perceptual_duplicate_findings(D.hamming_near_duplicates(rows, "sample_id", "ord", "fp", 4), 4)


def _semantic(t):
    rows = t["samples"]
    return D.semantic_duplicate_findings(rows, "sample_id", "ord", D.cosine_clusters(rows, "ord", "vec", 0.995))


def _far(t):
    halves = lambda k: F.aggregate(F.filter("vec", lambda x, i: i % 2 == k), F.lit(0.0), lambda s, x: s + x)
    rows = t["samples"].select("ord", "sample_id", F.col("label_text").cast("int").alias("label"), F.array(halves(0), halves(1)).alias("vec"))
    return O.ood_mahalanobis(rows, "sample_id", "ord", "label", "vec", threshold=2.0)


def _labels(t):
    rows = t["samples"].withColumn("label", F.col("label_text").cast("int"))
    near = N.knn(rows, "ord", "vec", "label", 5)
    return N.label_disagreement_findings(rows, "sample_id", "ord", N.label_disagreement(near, 0.6), 0.6)


def _broken(t):
    raise ValueError("this check always fails")


def checks() -> list[A.Check]:
    samples = lambda *rules: [A.Input("samples", _ALL, "sample_id", rules)]
    return [
        A.Check("perceptual", "cheap", samples(_NO_VECTOR, _SHORT), _perceptual),
        A.Check("semantic", "cheap", samples(_NO_VECTOR, _SHORT), _semantic),
        A.Check("ood", "cheap", samples(_NO_VECTOR, _SHORT, _LABEL), _far),
        A.Check("mislabeling", "expensive", samples(_NO_VECTOR, _SHORT, _LABEL), _labels),
        A.Check("broken", "cheap", samples(), _broken),
        A.Check("logits", "cheap", [A.Input("samples", ("sample_id", "logits"), "sample_id")], _broken),
        A.Check("pictures", "expensive", [A.Input("images", ("image_id",), "image_id")], _broken),
    ]


def _tables(spark, folder):
    return {"samples": role(spark, folder, "raw_vectors")}


_FOUND = """
+ v AS (SELECT * FROM raw_vectors WHERE len(vec) = 64),
l AS (SELECT ord, sample_id, vec, TRY_CAST(label_text AS INT) AS label FROM v WHERE TRY_CAST(label_text AS INT) IS NOT NULL),
fp AS (SELECT ord, CAST(list_sum([CASE WHEN vec[i + 2] > vec[i + 1] THEN 1::BIGINT << i ELSE 0 END FOR i IN range(63)]) AS BIGINT) AS fp FROM v),
fg AS (SELECT fp, min(ord) AS first FROM fp GROUP BY fp),
f1 AS (SELECT a.ord, 0.9 - 0.2 * bit_count(xor(a.fp, g.fp)) / 63 AS confidence FROM fp a JOIN fg g ON a.ord > g.first AND bit_count(xor(a.fp, g.fp)) <= 4),
pair AS (SELECT a.ord AS u, b.ord AS v FROM v a JOIN v b ON a.ord <> b.ord AND list_cosine_similarity(a.vec, b.vec) >= 0.995),
reach(u, v) AS (SELECT u, v FROM pair UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
f2 AS (SELECT u AS ord FROM reach GROUP BY u HAVING min(v) < u),
samples_2d AS (SELECT ord, label, [list_sum(vec[1:64:2]), list_sum(vec[2:64:2])] AS vec FROM l),
p AS (SELECT ord, label, vec[1] AS x, vec[2] AS y FROM samples_2d),
c AS (SELECT label, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM p GROUP BY label),
d AS (SELECT p.ord, label, n, x - mx AS x, y - my AS y FROM p JOIN c USING (label)),
s AS (SELECT label, sum(x * x) AS sxx, sum(x * y) AS sxy, sum(y * y) AS syy FROM d GROUP BY label),
lo AS (SELECT ord, n, x * n / (n - 1) AS dx, y * n / (n - 1) AS dy,
  (sxx - x * x * n / (n - 1)) / (n - 2) AS a, (sxy - x * y * n / (n - 1)) / (n - 2) AS b, (syy - y * y * n / (n - 1)) / (n - 2) AS e FROM d JOIN s USING (label)),
q AS (SELECT *, 1e-6 * greatest((a + e) / 2, 1) AS ridge FROM lo),
m AS (SELECT ord, sqrt(((e + ridge) * dx * dx - 2 * b * dx * dy + (a + ridge) * dy * dy) / ((a + ridge) * (e + ridge) - b * b)) AS distance FROM q),
f3 AS (SELECT ord, least(0.95, 0.5 + 0.45 * (1 - 2.0 / distance)) AS confidence FROM m WHERE distance > 2.0),
risky AS (SELECT ord FROM f1 UNION SELECT ord FROM f3),
k AS (SELECT a.ord, a.label, b.ord AS n_ord, b.label AS n_label,
    row_number() OVER (PARTITION BY a.ord ORDER BY list_distance(a.vec, b.vec), b.ord) AS rank
  FROM l a JOIN l b ON a.ord <> b.ord WHERE a.ord IN (FROM risky) AND b.ord IN (FROM risky) QUALIFY rank <= 5),
w AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY votes DESC, first_rank) AS place
  FROM (SELECT ord, label, n_label, count(*) AS votes, min(rank) AS first_rank, max(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY ord) AS c FROM k) GROUP BY ALL)),
f4 AS (SELECT ord, votes / c AS confidence FROM w WHERE place = 1 AND n_label <> label AND votes / c >= 0.6),
findings AS (
  SELECT ord, 'perceptual_duplicate' AS finding_type, 'duplicates' AS detector_id, 'PIXEL' AS modality, 0.5::DOUBLE AS severity, confidence FROM f1
  UNION ALL SELECT ord, 'semantic_near_duplicate', 'duplicates', 'EMBEDDING', 0.4, 0.55 FROM f2
  UNION ALL SELECT ord, 'out_of_distribution', 'ood', 'EMBEDDING', 0.7, confidence FROM f3
  UNION ALL SELECT ord, 'label_disagreement', 'mislabeling', 'ANNOTATION', 0.65, confidence FROM f4)
"""
# The columns that the shared convergence SQL reads.
_AS_FINDINGS = _FOUND.replace("findings AS (", "found AS (", 1).rstrip() + """,
findings AS (SELECT *, 'v' || TEXT(ord) AS asset_id, 'review' AS recommended_action, 'sample' AS quarantine_scope, 'black_box' AS access_assumptions,
  CAST(NULL AS VARCHAR) AS signal_id, '' AS evidence_text, '' AS counter_text FROM found)
"""


@query("assessment", with_roles("raw_vectors", recursive=True, body=_AS_FINDINGS + "," + _CONVERGE_CTE.strip().removeprefix("+") + f"""
, every AS (SELECT asset_id, 'composite_' || family AS finding_type, severity, comp.confidence, modality, TEXT(members) AS members FROM comp JOIN head USING (asset_id, family) JOIN lead_ USING (asset_id, family)
UNION ALL
SELECT f.asset_id, f.finding_type, f.severity, f.confidence, f.modality, ''
FROM f LEFT JOIN comp ON f.asset_id = comp.asset_id AND f.family = comp.family WHERE comp.asset_id IS NULL OR NOT f.eligible)
SELECT asset_id, finding_type, severity, round(confidence, 6) AS confidence, modality, members, {SQL_VERDICT} AS verdict FROM every"""))
def assessment(spark, folder):
    out = A.assess(_tables(spark, folder), checks(), "run-1").verdicts
    return out.select("asset_id", "finding_type", "severity", r("confidence").alias("confidence"), "modality",
                      F.coalesce(F.col("provenance.attrs")["members"], F.lit("")).alias("members"), "verdict")


_LOG_SQL = """
SELECT t.provider, tier, status, reason, CAST(rows_read AS BIGINT) AS rows_read, CAST(aside AS BIGINT) AS rows_set_aside, CAST(n AS BIGINT) AS findings, worst, ran AS timed FROM (
  SELECT 'perceptual' AS provider, 'cheap' AS tier, 'ran' AS status, 'cheap checks run on every asset' AS reason, true AS ran, (SELECT count(*) FROM v) AS rows_read, (SELECT count(*) FROM raw_vectors) - (SELECT count(*) FROM v) AS aside, (SELECT count(*) FROM f1) AS n, 0.5::DOUBLE AS worst
  UNION ALL SELECT 'semantic', 'cheap', 'ran', 'cheap checks run on every asset', true, (SELECT count(*) FROM v), (SELECT count(*) FROM raw_vectors) - (SELECT count(*) FROM v), (SELECT count(*) FROM f2), 0.4
  UNION ALL SELECT 'ood', 'cheap', 'ran', 'cheap checks run on every asset', true, (SELECT count(*) FROM l), (SELECT count(*) FROM raw_vectors) - (SELECT count(*) FROM l), (SELECT count(*) FROM f3), 0.7
  UNION ALL SELECT 'mislabeling', 'expensive', 'ran', 'runs on the assets a cheap finding calls risky', true, (SELECT count(*) FROM l WHERE ord IN (FROM risky)), (SELECT count(*) FROM raw_vectors) - (SELECT count(*) FROM l), (SELECT count(*) FROM f4), 0.65
  UNION ALL SELECT 'broken', 'cheap', 'failed', 'failed', true, (SELECT count(*) FROM raw_vectors), 0, 0, NULL
  UNION ALL SELECT 'logits', 'cheap', 'skipped', 'Missing input: samples.logits', false, 0, 0, 0, NULL
  UNION ALL SELECT 'pictures', 'expensive', 'skipped', 'Missing input: images, images.image_id', false, 0, 0, 0, NULL) AS t"""


@query("assessment_log", with_roles("raw_vectors", recursive=True, body=_FOUND + _LOG_SQL))
def assessment_log(spark, folder):
    """Seconds differ from run to run; the query says which checks have them."""
    log = A.assess(_tables(spark, folder), checks(), "run-1").log
    reason = F.when(F.col("status") == "failed", F.lit("failed")).otherwise(F.col("reason"))
    return log.select("provider", "tier", "status", reason.alias("reason"), "rows_read", "rows_set_aside", "findings", "worst",
                      (F.col("seconds") > 0).alias("timed"))


@query("rows_set_aside", with_roles("raw_vectors", body="""
+ b AS (SELECT sample_id AS "row", concat_ws('; ', CASE WHEN vec IS NULL THEN 'the vector is missing' END, CASE WHEN len(vec) <> 64 THEN 'the vector has another length' END) AS a,
  CASE WHEN TRY_CAST(label_text AS INT) IS NULL THEN 'the label is no whole number' END AS label FROM raw_vectors)
SELECT p AS provider, "row", a AS reasons FROM b, (VALUES ('perceptual'), ('semantic')) t(p) WHERE a <> ''
UNION ALL SELECT p, "row", CASE WHEN a = '' THEN label ELSE concat_ws('; ', a, label) END FROM b, (VALUES ('ood'), ('mislabeling')) t(p) WHERE a <> '' OR label IS NOT NULL"""))
def rows_set_aside(spark, folder):
    out = A.set_aside(_tables(spark, folder), checks())
    return out.select("provider", "row", F.array_join("reasons", "; ").alias("reasons"))


@query("run_coverage", with_roles("raw_vectors", recursive=True, body=_FOUND + """
SELECT 'run-1' AS assessment_id, count(*) AS requested, count(*) FILTER (status = 'ran') AS ran, count(*) FILTER (status = 'skipped') AS skipped,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'ran' AND rows_set_aside > 0) AS degraded,
  round(count(*) FILTER (status = 'ran') / count(*), 6) AS coverage FROM (""" + _LOG_SQL + ")"))
def run_coverage(spark, folder):
    done = A.assess(_tables(spark, folder), checks(), "run-1")
    return A.run_coverage(done.log).withColumn("coverage", r("coverage"))
