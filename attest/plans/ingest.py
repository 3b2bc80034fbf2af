"""Source, manifest and registry queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.canonical import canonical_row, digest
from attest.operators import manifests as M
from attest.plans.evidence import findings
from attest.plans.registry import query, r, table
from attest.plans.roles import role, with_roles
from attest.session import scratch
from attest.sources import files, sinks


def _text(c: str):
    return F.col(c).cast("string")


def _coco(spark, folder):
    """Orders as images, lines as annotations, part brands as categories; some rows broken."""
    orders, lines, parts = (table(spark, folder, t) for t in ("orders", "lineitem", "part"))
    images = orders.where("o_orderkey % 40 > 0").select(
        F.when(F.col("o_orderkey") % 500 == 1, F.lit("1")).otherwise(_text("o_orderkey")).alias("id"),
        F.when(F.col("o_orderkey") % 300 == 7, F.lit("../up.jpg")).otherwise(F.concat(_text("o_orderkey"), F.lit(".jpg"))).alias("file_name"))
    box = F.when(F.col("l_partkey") % 90 == 0, F.array(*[F.lit(1.0)] * 3)).otherwise(
        F.array(F.lit(0.0), F.lit(0.0), F.when(F.col("l_partkey") % 70 == 0, -1.0).otherwise(F.col("l_quantity")), F.lit(2.0)))
    annotations = lines.select(
        F.concat(_text("l_orderkey"), F.lit("0"), _text("l_linenumber")).alias("id"), _text("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 25).cast("string").alias("category_id"),
        F.when(F.col("l_partkey") % 110 > 0, box).alias("bbox"))
    categories = parts.select((F.col("p_partkey") % 24).cast("string").alias("id")).distinct().withColumn(
        "name", F.when(F.col("id") == "3", "").otherwise(F.concat(F.lit("class "), F.col("id"))))
    return images, annotations, categories


_COCO_SQL = """
WITH images AS (SELECT CASE WHEN o_orderkey % 500 = 1 THEN '1' ELSE CAST(o_orderkey AS VARCHAR) END AS id,
  CASE WHEN o_orderkey % 300 = 7 THEN '../up.jpg' ELSE o_orderkey || '.jpg' END AS file_name FROM orders WHERE o_orderkey % 40 > 0),
ann AS (SELECT l_orderkey || '0' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS image_id, CAST(l_partkey % 25 AS VARCHAR) AS category_id, l_partkey AS pk FROM lineitem),
cat AS (SELECT DISTINCT CAST(p_partkey % 24 AS VARCHAR) AS id FROM part),
v AS (SELECT 'duplicate_image_id' AS violation, id AS subject FROM images GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_annotation_id', id FROM ann GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_image_path', file_name FROM images GROUP BY file_name HAVING count(*) > 1
UNION ALL SELECT 'empty_category_name', id FROM cat WHERE id = '3'
UNION ALL SELECT 'unknown_image', id FROM ann WHERE image_id NOT IN (SELECT id FROM images)
UNION ALL SELECT 'unknown_category', id FROM ann WHERE category_id NOT IN (SELECT id FROM cat)
UNION ALL SELECT 'malformed_bbox', id FROM ann WHERE pk % 110 > 0 AND pk % 90 = 0
UNION ALL SELECT 'negative_bbox', id FROM ann WHERE pk % 110 > 0 AND pk % 90 > 0 AND pk % 70 = 0
UNION ALL SELECT 'unsafe_path', file_name FROM images WHERE file_name = '../up.jpg')
SELECT violation, subject FROM v"""


@query("coco_violations", _COCO_SQL)
def coco_violations(spark, folder):
    return M.coco_violations(*_coco(spark, folder))


@query("read_coco", """
WITH o AS (SELECT *, o_orderkey // 1000 AS shard FROM orders), good AS (SELECT * FROM o WHERE shard % 7 < 5)
SELECT 'annotations' AS part, l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS owner, CAST(l_partkey % 2 AS VARCHAR) AS detail, round(l_quantity * 4, 6) AS amount
  FROM lineitem JOIN good ON l_orderkey = o_orderkey
UNION ALL SELECT 'images', CAST(o_orderkey AS VARCHAR), CAST(shard AS VARCHAR), o_orderkey || '.jpg', NULL FROM good
UNION ALL SELECT DISTINCT 'documents', CAST(shard AS VARCHAR), 'batch-1', '1', NULL FROM good
UNION ALL SELECT DISTINCT 'categories', id, CAST(shard AS VARCHAR), name, NULL FROM good, (VALUES ('0', 'even'), ('1', 'odd')) c(id, name)
UNION ALL SELECT DISTINCT 'broken', CAST(shard AS VARCHAR), CASE WHEN shard % 7 = 5 THEN 'the file is no JSON' ELSE 'the file''s fields have other types than an annotation document''s' END, NULL, NULL FROM o WHERE shard % 7 >= 5""")
def read_coco(spark, folder):
    """Writes one annotation document per thousand order keys, some cut off or with other types, then reads them all back."""
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    shard = F.floor(F.col("o_orderkey") / 1000).alias("shard")
    images = orders.select(shard, _text("o_orderkey").alias("id"), F.concat(_text("o_orderkey"), F.lit(".jpg")).alias("file_name"))
    owner = orders.select(shard, F.col("o_orderkey").alias("l_orderkey"))
    notes = lines.join(owner, "l_orderkey").select(
        "shard", F.concat_ws("-", _text("l_orderkey"), _text("l_linenumber")).alias("id"), _text("l_orderkey").alias("image_id"),
        (F.col("l_partkey") % 2).cast("string").alias("category_id"), F.array(*[F.col("l_quantity")] * 4).alias("bbox"))
    # A COCO document is one JSON object by format; a thousand orders bound its size.
    pack = lambda df, name: df.groupBy("shard").agg(F.collect_list(F.struct(*[c for c in df.columns if c != "shard"])).alias(name))
    docs = pack(images, "images").join(pack(notes, "annotations"), "shard", "left").select(
        "shard", F.lit("batch-1").alias("batch_id"), "images", F.coalesce("annotations", F.array()).alias("annotations"),
        F.array(F.struct(F.lit("0").alias("id"), F.lit("even").alias("name")), F.struct(F.lit("1").alias("id"), F.lit("odd").alias("name"))).alias("categories"))
    whole = F.to_json(F.struct(*[c for c in docs.columns if c != "shard"]))
    text = F.when(F.col("shard") % 7 == 5, F.substring(whole, F.lit(1), F.length(whole) - 20)).when(
        F.col("shard") % 7 == 6, F.lit('{"images": "none", "annotations": 3}')).otherwise(whole)
    path = scratch(spark, "coco")
    docs.select("shard", text.alias("value")).write.options(**sinks.MANY_FILES).partitionBy("shard").text(path)
    parts = files.read_coco(spark, f"{path}/*/*.txt")
    # The folder names the document.
    named = {k: df.withColumn("shard", F.regexp_extract("document_id", "shard=([0-9]+)", 1)) for k, df in parts.items()}
    row = lambda part, df, *c: df.select(F.lit(part).alias("part"), *[x.alias(n) for x, n in zip(c, ("id", "owner", "detail", "amount"))])
    none, no_sum = F.lit(None).cast("string"), F.lit(None).cast("double")
    total = F.aggregate("bbox", F.lit(0.0), lambda a, x: a + x)
    return reduce(DataFrame.unionByName, [
        row("annotations", named["annotations"], F.col("id"), F.col("image_id"), F.col("category_id"), F.round(total, 6)),
        row("images", named["images"], F.col("id"), F.col("shard"), F.col("file_name"), no_sum),
        row("documents", named["documents"], F.col("shard"), F.col("batch_id"), F.col("dataset_version"), no_sum),
        row("categories", named["categories"], F.col("id"), F.col("shard"), F.col("name"), no_sum),
        row("broken", named["broken"], F.col("shard"), F.col("reason"), none, no_sum)])


def _yolo(spark, folder):
    """Orders as images, lines as label rows; some rows, files and names broken."""
    orders, lines, parts = (table(spark, folder, t) for t in ("orders", "lineitem", "part"))
    images = orders.where("o_orderkey % 50 > 0").select(F.concat(F.lit("images/"), _text("o_orderkey"), F.lit(".png")).alias("path")) \
        .union(orders.where("o_orderkey % 400 = 3").select(F.concat(F.lit("images/"), _text("o_orderkey"), F.lit(".jpg"))))
    labels = orders.where("o_orderkey % 60 > 0").select(F.concat(F.lit("labels/"), _text("o_orderkey"), F.lit(".txt")).alias("label_path"))
    unit = lambda c, m: (F.col(c) % m / m).cast("string")
    text = F.when(F.col("l_partkey") % 80 == 0, "1 0.5 0.5").when(F.col("l_partkey") % 85 == 0, "x 0.5 0.5 0.1 0.1").otherwise(
        F.concat_ws(" ", (F.col("l_partkey") % 6).cast("string"), unit("l_suppkey", 8),
                    F.when(F.col("l_partkey") % 95 == 0, "1.5").otherwise(unit("l_partkey", 16)), F.lit("0.25"),
                    F.when(F.col("l_partkey") % 75 == 0, "0").otherwise("0.125")))
    rows = lines.select(F.concat(F.lit("labels/"), _text("l_orderkey"), F.lit(".txt")).alias("label_path"),
                        F.col("l_linenumber").alias("line"), text.alias("text"))
    # Every part row is read; the class file lists the first five part keys with their names.
    classes = parts.select((F.col("p_partkey") % 5).cast("bigint").alias("class_id")).distinct().withColumn(
        "name", F.when(F.col("class_id") < 2, "same").when(F.col("class_id") == 2, " ").otherwise(_text("class_id")))
    metadata = orders.select(F.concat(F.lit("images/"), _text("o_orderkey"), F.lit(".png")).alias("path"))
    return rows, images, labels, classes, metadata


@query("yolo_violations", """
WITH t AS (SELECT 'labels/' || l_orderkey || '.txt:' || l_linenumber AS place, l_partkey AS k FROM lineitem),
img AS (SELECT 'images/' || o_orderkey || '.png' AS path, 'labels/' || o_orderkey || '.txt' AS label FROM orders WHERE o_orderkey % 50 > 0
  UNION ALL SELECT 'images/' || o_orderkey || '.jpg', 'labels/' || o_orderkey || '.txt' FROM orders WHERE o_orderkey % 400 = 3),
lab AS (SELECT 'labels/' || o_orderkey || '.txt' AS label FROM orders WHERE o_orderkey % 60 > 0)
SELECT 'invalid_row' AS violation, place AS subject FROM t WHERE k % 80 = 0 OR k % 85 = 0
UNION ALL SELECT 'unknown_class', place FROM t WHERE k % 80 > 0 AND k % 85 > 0 AND k % 6 = 5
UNION ALL SELECT 'coordinate_out_of_range', place FROM t WHERE k % 80 > 0 AND k % 85 > 0 AND k % 95 = 0
UNION ALL SELECT 'empty_box', place FROM t WHERE k % 80 > 0 AND k % 85 > 0 AND k % 95 > 0 AND k % 75 = 0
UNION ALL SELECT 'shared_label_file', label FROM img GROUP BY label HAVING count(*) > 1
UNION ALL SELECT 'missing_label_file', path FROM img WHERE label NOT IN (SELECT label FROM lab)
UNION ALL SELECT 'orphan_label_file', label FROM lab WHERE label NOT IN (SELECT label FROM img)
UNION ALL SELECT 'unknown_metadata', 'images/' || o_orderkey || '.png' FROM orders WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'blank_class', '2' UNION ALL SELECT 'duplicate_class', 'same'""")
def yolo_violations(spark, folder):
    return M.yolo_violations(*_yolo(spark, folder))


@query("read_yolo", """
SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS files, CAST(sum(l_partkey % 3) AS BIGINT) AS class_sum FROM lineitem""")
def read_yolo(spark, folder):
    """Writes label text derived from all lines in label-file form and reads it back."""
    lines = table(spark, folder, "lineitem")
    row = F.concat_ws(" ", (F.col("l_partkey") % 3).cast("string"), F.lit("0.5 0.5 0.25 0.25"))
    # One file per thousand order keys keeps files bounded; a file per order would be needlessly many.
    path = scratch(spark, "yolo")
    lines.select(F.floor(F.col("l_orderkey") / 1000).alias("shard"), F.concat(_text("l_orderkey"), F.lit(" "), row).alias("value")) \
        .repartition("shard").write.partitionBy("shard").text(f"{path}/labels")
    spark.createDataFrame([("cat\ndog\nbird",)], "value string").coalesce(1).write.text(f"{path}/classes.txt")
    spark.createDataFrame([("x",)], "value string").coalesce(1).write.text(f"{path}/images")
    tree = files.read_yolo(spark, path)
    tokens = F.split("text", " ")
    full = tree["rows"].where("text <> ''")
    return full.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(F.get(tokens, 0)).alias("files"),
                    F.sum(F.get(tokens, 1).cast("bigint")).alias("class_sum"))


@query("class_distribution", """
WITH c AS (SELECT DISTINCT lang AS class FROM documents UNION SELECT 'unused')
SELECT class, count(doc_id) AS n FROM c LEFT JOIN (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id)) ON lang = class GROUP BY class""")
def class_distribution(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    classes = docs.select(F.col("lang").alias("class")).distinct().union(spark.createDataFrame([("unused",)], "class string"))
    notes = docs.join(labels, "doc_id").select(F.col("lang").alias("class"))
    return M.class_distribution(classes, notes, "class")


@query("sample_metadata", """
SELECT d.doc_id AS sample_id, CASE WHEN d.doc_id % 3 = 0 THEN d.source ELSE 'lang-' || d.lang END AS contributor_id,
  CASE WHEN d.doc_id % 4 = 0 THEN 'own' WHEN d.lang <> 'en' THEN 'batch-' || d.lang ELSE 'default' END AS batch_id FROM documents d""")
def sample_metadata(spark, folder):
    docs = table(spark, folder, "documents")
    samples = docs.select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("document_id"),
                          F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("contributor_id"),
                          F.when(F.col("doc_id") % 4 == 0, "own").alias("batch_id"))
    heads = docs.select(F.col("lang").alias("document_id")).distinct().select(
        "document_id", F.concat(F.lit("lang-"), F.col("document_id")).alias("contributor_id"),
        F.when(F.col("document_id") != "en", F.concat(F.lit("batch-"), F.col("document_id"))).alias("batch_id"))
    return M.sample_metadata(samples, heads, contributor="nobody", batch="default")


@query("file_inventory", """
SELECT 'part=' || CAST(doc_id % 4 AS VARCHAR) || '/doc=' || CAST(doc_id AS VARCHAR) AS path, sha256(replace(replace(text, chr(10), ' '), chr(13), ' ') || chr(10)) AS sha256,
  CAST(strlen(replace(replace(text, chr(10), ' '), chr(13), ' ')) + 1 AS BIGINT) AS bytes
FROM documents WHERE text IS NOT NULL""")
def file_inventory(spark, folder):
    """Documents as files of a tree, one folder each; hashed from what lies on disk."""
    docs = table(spark, folder, "documents").where("text is not null")
    line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    path = scratch(spark, "tree")
    # Dealt by id: a file per document takes its time, so no task may hold many more of them than others. The
    # lots on top are what the tree is listed by: a task each, in place of one for every document's folder.
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1024)).alias("lot")
    dealt = docs.select(lot, (F.col("doc_id") % 4).alias("part"), F.col("doc_id").alias("doc"), line.alias("value")).repartition("doc")
    sinks.write_tree(dealt, path, ["lot", "part", "doc"], "value")
    found = files.file_inventory(spark, path).where(F.col("path").endswith(".txt"))
    return found.withColumn("path", F.regexp_extract("path", "^lot=[^/]*/(.*)/[^/]*$", 1))


@query("unsafe_paths", """
WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/abs/' || page_id WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN 'a\\' || page_id WHEN 3 THEN 'dir/com1.txt'
  WHEN 4 THEN 'x/name.' WHEN 5 THEN substr(url, 8) ELSE 'ok/' || page_id || '.html' END AS path FROM pages)
SELECT page_id, path FROM p WHERE page_id % 7 < 5 OR (page_id % 7 = 5 AND regexp_matches(path, '^/|[?<>:"|*]|//|/$|^$|\\.$|\\./'))""")
def unsafe_paths(spark, folder):
    k, text = F.col("page_id") % 7, _text("page_id")
    path = (F.when(k == 0, F.concat(F.lit("/abs/"), text)).when(k == 1, F.concat(F.lit("a/../"), text)).when(k == 2, F.concat(F.lit("a\\"), text))
            .when(k == 3, "dir/com1.txt").when(k == 4, "x/name.").when(k == 5, F.expr("substring(url, 8)"))
            .otherwise(F.concat(F.lit("ok/"), text, F.lit(".html"))))
    return M.unsafe_paths(table(spark, folder, "pages").select("page_id", path.alias("path")), "path")


_ROW = """sha256('{"c_acctbal":' || replace(printf('%.6f', c_acctbal), '-0.000000', '0.000000') || ',"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment
  || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}')"""


@query("canonical_digest", f"SELECT c_custkey, {_ROW} AS digest FROM customer")
def canonical_digest(spark, folder):
    return M.canonical_digest(table(spark, folder, "customer")).select("c_custkey", "digest")


@query("canonical_text", """
SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"text":"' || replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r') || '"}') AS digest FROM documents""")
def canonical_text(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return docs.select("doc_id", digest(canonical_row(docs.schema)).alias("digest"))


@query("table_digest", f"""
WITH RECURSIVE d AS (SELECT digest, count(*) AS c FROM (SELECT {_ROW} AS digest FROM customer UNION ALL SELECT {_ROW} FROM customer WHERE c_custkey % 9 = 0) GROUP BY digest),
lv(l) AS (SELECT list(sha256(digest || ':' || c) ORDER BY digest) FROM d
  UNION ALL SELECT [sha256(unhex(l[2 * i + 1]) || unhex(coalesce(l[2 * i + 2], l[2 * i + 1]))) FOR i IN range((len(l) + 1) // 2)] FROM lv WHERE len(l) > 1)
SELECT l[1] AS digest, (SELECT count(*) FROM d) AS distinct_rows, (SELECT CAST(sum(c) AS BIGINT) FROM d) AS total_rows FROM lv WHERE len(l) = 1""")
def table_digest(spark, folder):
    customers = table(spark, folder, "customer")
    return M.table_digest(customers.union(customers.where("c_custkey % 9 = 0")))


def _manifests(spark, folder):
    parts = table(spark, folder, "part")
    path = F.concat(F.lit("parts/"), _text("p_partkey"))
    base = parts.where("p_partkey % 31 > 0").select(
        path.alias("path"), F.sha2("p_name", 256).alias("sha256"), F.col("p_brand").alias("contributor_id"), F.lit("b1").alias("batch_id"))
    now = parts.where("p_partkey % 37 > 0").select(
        path.alias("path"), F.when(F.col("p_partkey") % 41 == 0, F.sha2(F.concat("p_name", F.lit("!")), 256)).otherwise(F.sha2("p_name", 256)).alias("sha256"),
        F.when(F.col("p_partkey") % 43 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("contributor_id"), F.lit("b1").alias("batch_id"))
    return M.manifest_build(base, "parts"), M.manifest_build(now, "parts")


_MANIFEST_SQL = """
WITH s AS (SELECT 'parts/' || p_partkey AS path, p_partkey % 31 > 0 AS a, p_partkey % 37 > 0 AS b, p_partkey % 41 = 0 OR p_partkey % 43 = 0 AS ch FROM part),
x AS (SELECT path, CASE WHEN a AND NOT b THEN 'missing' WHEN b AND NOT a THEN 'added' WHEN a AND b AND ch THEN 'changed' END AS status FROM s)
"""


@query("manifest_build", """
SELECT 'parts' AS dataset_id, p_brand AS contributor_id, count(*) AS files FROM part WHERE p_partkey % 31 > 0 GROUP BY ALL""")
def manifest_build(spark, folder):
    base, _ = _manifests(spark, folder)
    return base.groupBy("dataset_id", "contributor_id").agg(F.count(F.lit(1)).alias("files"))


@query("manifest_diff", _MANIFEST_SQL + "SELECT path, status FROM x WHERE status IS NOT NULL")
def manifest_diff(spark, folder):
    return M.manifest_diff(*_manifests(spark, folder))


@query("manifest_verify", _MANIFEST_SQL + "SELECT count(status) AS differences, count(status) = 0 AS verified FROM x")
def manifest_verify(spark, folder):
    return M.manifest_verify(*_manifests(spark, folder))


@query("artifact_identity", """
WITH x AS (SELECT 'model-' || p_partkey AS artifact_id, CASE WHEN p_partkey % 5 = 0 THEN 'unverified' WHEN p_partkey % 7 = 0 THEN 'mismatch' ELSE 'match' END AS status FROM part)
SELECT artifact_id, status, CASE status WHEN 'mismatch' THEN 1::DOUBLE ELSE 0 END AS severity, CASE status WHEN 'unverified' THEN 0::DOUBLE ELSE 1 END AS confidence,
  CASE status WHEN 'match' THEN 'accept' WHEN 'mismatch' THEN 'quarantine' ELSE 'review' END AS action FROM x""")
def artifact_identity(spark, folder):
    parts = table(spark, folder, "part")
    key = F.concat(F.lit("model-"), _text("p_partkey"))
    reference = parts.select(key.alias("artifact_id"), F.sha2("p_name", 256).alias("digest"))
    supplied = parts.where("p_partkey % 5 > 0").select(
        key.alias("artifact_id"), F.sha2(F.when(F.col("p_partkey") % 7 == 0, F.lit("other")).otherwise(F.col("p_name")), 256).alias("digest"))
    return M.artifact_identity(reference, supplied).select("artifact_id", "status", "severity", "confidence", "action")


@query("read_audit_jsonl", """
SELECT coalesce(event_type, '(all)') AS operation, coalesce(operator, '(all)') AS operator, count(*) AS entries
FROM (SELECT event_type, 'user-' || user_id % 5 AS operator FROM events) GROUP BY ROLLUP (event_type, operator)""")
def read_audit_jsonl(spark, folder):
    """Events written as audit lines, read back with the audit schema and counted."""
    events = table(spark, folder, "events")
    path = scratch(spark, "audit")
    events.select(F.col("ts").cast("string").alias("timestamp"), F.col("event_type").alias("operation"),
                  F.create_map(F.lit("value"), F.col("value").cast("string")).alias("details"),
                  F.concat(F.lit("user-"), (F.col("user_id") % 5).cast("string")).alias("operator")).write.json(path)
    counts = M.audit_counts(files.read_audit_jsonl(spark, path))
    return counts.select(F.coalesce("operation", F.lit("(all)")).alias("operation"),
                         F.coalesce("operator", F.lit("(all)")).alias("operator"), "entries")


@query("registry_page", """
SELECT 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS id, c_mktsegment AS asset_type FROM customer ORDER BY id LIMIT 50 OFFSET 20""")
def registry_page(spark, folder):
    assets = table(spark, folder, "customer").select(
        F.concat(F.lit("customer-"), F.lpad(_text("c_custkey"), 8, "0")).alias("id"), F.col("c_mktsegment").alias("asset_type"))
    return M.registry_page(assets, 20, 50)


@query("duplicate_asset_ids", "SELECT l_orderkey AS id, count(*) AS copies FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_asset_ids(spark, folder):
    assets = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("id"))
    return M.duplicate_asset_ids(assets)


@query("validate_samples", with_roles("samples", body="""
SELECT count(*) AS rows, count(*) FILTER (ord % 50 = 1) AS invalid_vectors, CAST(0 AS BIGINT) AS duplicate_ids,
  CAST(0 AS BIGINT) AS ragged_rows, count(*) FILTER (ord % 60 = 2) AS missing_labels, count(DISTINCT label) AS classes, false AS valid FROM samples"""))
def validate_samples(spark, folder):
    nan = F.transform("vec", lambda v, i: F.when(i == 3, F.lit(float("nan"))).otherwise(v))
    rows = role(spark, folder, "samples").withColumn("vec", F.when(F.col("ord") % 50 == 1, nan).otherwise(F.col("vec"))) \
        .withColumn("label", F.when(F.col("ord") % 60 != 2, F.col("label")))
    return M.validate_samples(rows, "sample_id", "vec", "label", 10)


@query("sinks", with_roles("findings", body="""
SELECT 'run-' || TEXT(ord % 3) AS assessment_id, count(*) AS findings, round(sum(severity), 6) AS severity FROM findings GROUP BY 1"""))
def sinks_round_trip(spark, folder):
    """Findings written per assessment twice (an idempotent retry) and read back."""
    stored = findings(spark, folder).withColumn("provenance", F.col("provenance").withField("attrs", F.create_map(
        F.lit("assessment_id"), F.concat(F.lit("run-"), (F.col("ord") % 3).cast("string")))))
    path = scratch(spark, "findings")
    sinks.write_findings(stored, path)
    sinks.write_findings(stored.where(F.col("provenance.attrs")["assessment_id"] == "run-1"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("assessment_id").cast("string").alias("assessment_id")).agg(
        F.count(F.lit(1)).alias("findings"), r(F.sum("severity")).alias("severity"))
