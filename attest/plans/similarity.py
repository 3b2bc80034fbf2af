"""Near-duplicate and neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.functions import fingerprints as FP
from attest.operators import duplicates as D
from attest.operators import neighbours as N
from attest.plans.registry import query, r, table
from attest.plans.roles import role, with_roles

_VOTES = ", ".join(
    f"CASE WHEN 2 * sum(({'lo' if i < 32 else 'hi'} >> {i % 32}) & 1) > count(*) THEN {1 << i}::BIGINT ELSE 0 END" for i in range(63)
)
_FP_SQL = f"""
fp AS (SELECT doc_id, CAST(list_sum([{_VOTES}]) AS BIGINT) AS fp FROM (
  SELECT doc_id, CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(md5(word), 9, 8) AS BIGINT) AS lo
  FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n\\r]+')) AS word FROM documents) WHERE word <> '') GROUP BY doc_id)
"""


def _fingerprints(spark, folder):
    return FP.text_fingerprints(table(spark, folder, "documents"), "doc_id", "text")


@query("text_fingerprints", "WITH " + _FP_SQL + "SELECT doc_id, fp FROM fp")
def text_fingerprints(spark, folder):
    return _fingerprints(spark, folder)


@query("vector_fingerprint", with_roles("samples", body="""
SELECT ord, CAST(list_sum([CASE WHEN vec[i + 2] > vec[i + 1] THEN 1::BIGINT << i ELSE 0 END FOR i IN range(63)]) AS BIGINT) AS fp FROM samples"""))
def vector_fingerprint(spark, folder):
    return role(spark, folder, "samples").select("ord", FP.vector_fingerprint(F.col("vec")).alias("fp"))


@query("hamming_near_duplicates", "WITH " + _FP_SQL + """,
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(fp, 0) AS fp FROM documents LEFT JOIN fp USING (doc_id)),
g AS (SELECT fp, text, min(doc_id) AS first, count(*) AS n FROM d GROUP BY fp, text)
SELECT a.doc_id AS asset_id, g.first AS match_id, CAST(bit_count(xor(a.fp, g.fp)) AS INT) AS distance, g.n AS match_rows,
  round(0.9 - 0.2 * bit_count(xor(a.fp, g.fp)) / 63, 6) AS confidence
FROM d a JOIN g ON a.doc_id > g.first AND bit_count(xor(a.fp, g.fp)) <= 6""")
def hamming_near_duplicates(spark, folder):
    """Every document takes part, with fingerprint zero where it has no word; only equal texts are copies."""
    texts = table(spark, folder, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    rows = texts.join(_fingerprints(spark, folder), "doc_id", "left").withColumn("fp", F.coalesce("fp", F.lit(0).cast("bigint")))
    out = D.hamming_near_duplicates(rows, "doc_id", "doc_id", "fp", 6, content="content")
    return out.select("asset_id", "match_id", "distance", "match_rows", r("confidence").alias("confidence"))


@query("cosine_clusters", with_roles("near_vectors", recursive=True, body="""
+ pair AS (SELECT a.ord AS u, b.ord AS v FROM near_vectors a JOIN near_vectors b ON a.ord <> b.ord AND list_cosine_similarity(a.vec, b.vec) >= 0.995),
reach(u, v) AS (SELECT u, v FROM pair UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u),
root AS (SELECT u AS ord, least(u, min(v)) AS root, count(DISTINCT v) AS n FROM reach GROUP BY u)
SELECT ord, root, count(*) OVER (PARTITION BY root) AS size FROM root"""))
def cosine_clusters(spark, folder):
    return D.cosine_clusters(role(spark, folder, "near_vectors"), "ord", "vec", 0.995)


@query("semantic_duplicate_findings", with_roles("near_vectors", recursive=True, body="""
+ pair AS (SELECT a.ord AS u, b.ord AS v FROM near_vectors a JOIN near_vectors b ON a.ord <> b.ord AND list_cosine_similarity(a.vec, b.vec) >= 0.995),
reach(u, v) AS (SELECT u, v FROM pair UNION SELECT reach.u, pair.v FROM reach JOIN pair ON reach.v = pair.u)
SELECT 'v' || TEXT(u) AS asset_id, 0.4::DOUBLE AS severity, 0.55::DOUBLE AS confidence FROM reach GROUP BY u HAVING min(v) < u"""))
def semantic_duplicate_findings(spark, folder):
    rows = role(spark, folder, "near_vectors").withColumn("id", F.concat(F.lit("v"), F.col("ord").cast("string")))
    clusters = D.cosine_clusters(rows, "ord", "vec", 0.995)
    return D.semantic_duplicate_findings(rows, "id", "ord", clusters).select("asset_id", "severity", "confidence")


_KNN = """
+ p AS (SELECT a.ord, a.label, b.ord AS n_ord, b.label AS n_label, list_distance(a.vec, b.vec) AS distance FROM samples a JOIN samples b ON a.ord <> b.ord),
k AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY distance, n_ord) AS rank FROM p QUALIFY rank <= 5)
"""


@query("knn", with_roles("samples", body=_KNN + """
SELECT ord, CAST(rank AS INT) AS rank, n_ord, round(distance, 6) AS distance FROM k"""))
def knn(spark, folder):
    near = N.knn(role(spark, folder, "samples"), "ord", "vec", "label", 5)
    return near.select("ord", F.posexplode("neighbours").alias("pos", "n")).select(
        "ord", (F.col("pos") + 1).alias("rank"), F.col("n.n_ord").alias("n_ord"), r("n.distance").alias("distance"))


@query("knn_label_disagreement", with_roles("samples", body=_KNN + """,
v AS (SELECT ord, label, n_label, count(*) AS votes, min(rank) AS first_rank FROM k GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY votes DESC, first_rank) AS place FROM v)
SELECT ord, TEXT(label) AS label, TEXT(n_label) AS predicted, CAST(votes AS INT) AS votes, round(votes / 5, 6) AS share
FROM w WHERE place = 1 AND n_label <> label AND votes / 5 >= 0.6"""))
def knn_label_disagreement(spark, folder):
    near = N.knn(role(spark, folder, "samples"), "ord", "vec", "label", 5)
    return N.label_disagreement(near, 0.6).select("ord", "label", "predicted", "votes", r("share").alias("share"))


@query("content_hash", """
SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1""")
def content_hash(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    return FP.exact_duplicates(docs, "doc_id", "h")


@query("vector_hash")
def vector_hash(spark, folder):
    return role(spark, folder, "near_vectors").select("ord", FP.vector_hash(F.col("vec")).alias("content_hash"))


@query("lookup_joins", """
SELECT l.quality, d.lang, count(*) AS documents, count(*) FILTER (l.doc_id IS NULL) AS unlabelled
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL""")
def lookup_joins(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    joined = docs.select("doc_id", "lang").join(labels.select("doc_id", "quality", F.lit(1).alias("found")), "doc_id", "left")
    return joined.groupBy("quality", "lang").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("found").isNull()).alias("unlabelled"))
