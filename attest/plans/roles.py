"""Roles: the benchmark tables shaped as the inputs of the operators.

A role is SQL that both Spark and the checking engine run. The few functions that
differ between the two are written as upper-case macros and expanded per engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from attest.plans.registry import TABLES, table

_MACROS = {
    # macro: (Spark SQL, checking SQL)
    "DARR": ("CAST({0} AS ARRAY<DOUBLE>)", "CAST({0} AS DOUBLE[])"),
    "EACH": ("explode(sequence(CAST({0} AS BIGINT), CAST({1} AS BIGINT)))", "unnest(range({0}, {1} + 1))"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "TEXT": ("CAST({0} AS STRING)", "CAST({0} AS VARCHAR)"),
    "ITEM": ("{0}[{1} - 1]", "{0}[{1}]"),
    "EVERY": (
        "aggregate(filter({0}, (x, i) -> i % 2 = {1} - 1), CAST(0 AS DOUBLE), (s, x) -> s + x)",
        "list_sum(({0})[{1}:len({0}):2])",
    ),
    "BUMP": (
        "transform({0}, (x, i) -> CASE WHEN i = 0 THEN x + CAST({1} AS DOUBLE) ELSE x END)",
        "list_concat([{0}[1] + CAST({1} AS DOUBLE)], {0}[2:])",
    ),
    "TIMES": ("transform({0}, x -> x * CAST({1} AS DOUBLE))", "list_transform({0}, lambda x: x * CAST({1} AS DOUBLE))"),
    "AT_US": ("timestamp_micros({0})", "make_timestamp({0})"),
    "US_OF": (
        "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', CAST({0} AS timestamp_ntz))",
        "epoch_us({0})",
    ),
    "ARR": ("array({*})", "[{*}]"),
}


def _split(text: str) -> list[str]:
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += ch in "([" 
        depth -= ch in ")]"
        if ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return parts + [text[start:].strip()]


def expand(text: str, dialect: int) -> str:
    pattern = re.compile(r"\b(" + "|".join(_MACROS) + r")\(")
    while True:
        found = list(pattern.finditer(text))
        if not found:
            return text
        hit = found[-1]  # innermost last: its arguments hold no further macro
        depth, end = 1, hit.end()
        while depth:
            depth += (text[end] == "(") - (text[end] == ")")
            end += 1
        inner = text[hit.end():end - 1]
        form = _MACROS[hit.group(1)][dialect]
        args = _split(inner)
        done = form.replace("{*}", ", ".join(args))
        for i, arg in enumerate(args):
            done = done.replace("{%d}" % i, arg)
        text = text[:hit.start()] + done + text[end:]


ROLES: dict[str, str] = {}

ROLES["samples"] = """
SELECT CAST(vec_id AS BIGINT) AS ord, 'v' || TEXT(vec_id) AS sample_id, DARR(embedding) AS vec,
       CAST(label AS INT) AS label FROM {embeddings}"""

# Two fixed projections of the whole vector: its odd and its even coordinates, added up.
ROLES["samples_2d"] = """
SELECT CAST(vec_id AS BIGINT) AS ord, 'v' || TEXT(vec_id) AS sample_id, ARR(EVERY(DARR(embedding), 1), EVERY(DARR(embedding), 2)) AS vec,
       CAST(label AS INT) AS label FROM {embeddings}"""

# Embeddings with planted relatives: a nudged copy, a second nudge and a scaled copy.
ROLES["near_vectors"] = """
SELECT CAST(vec_id AS BIGINT) * 4 AS ord, DARR(embedding) AS vec FROM {embeddings}
UNION ALL SELECT CAST(vec_id AS BIGINT) * 4 + 1, BUMP(DARR(embedding), 0.02) FROM {embeddings} WHERE vec_id % 7 = 0
UNION ALL SELECT CAST(vec_id AS BIGINT) * 4 + 2, BUMP(DARR(embedding), 0.09) FROM {embeddings} WHERE vec_id % 21 = 0
UNION ALL SELECT CAST(vec_id AS BIGINT) * 4 + 3, TIMES(DARR(embedding), 2) FROM {embeddings} WHERE vec_id % 35 = 0"""

# Two batches of vectors: labels below five are the reference.
ROLES["batches"] = """
SELECT CASE WHEN label < 5 THEN 'reference' ELSE 'current' END AS side, CAST(vec_id AS BIGINT) AS ord,
       DARR(embedding) AS vec FROM {embeddings}"""

# Findings of eleven detectors on every document, scores derived from the rows.
ROLES["findings"] = """
SELECT doc_id * 16 + no AS ord, 'doc-' || TEXT(doc_id) AS asset_id,
  CASE no WHEN 1 THEN 'perceptual_duplicate' WHEN 2 THEN 'semantic_near_duplicate' WHEN 3 THEN 'label_disagreement'
    WHEN 4 THEN 'out_of_distribution' WHEN 5 THEN 'spectral_signature' WHEN 6 THEN 'activation_clustering'
    WHEN 7 THEN 'strip_low_entropy' WHEN 8 THEN 'candidate_backdoor_trigger' WHEN 9 THEN 'fine_pruning_verification'
    WHEN 10 THEN 'perceptual_duplicate' ELSE 'model_identity_mismatch' END AS finding_type,
  CASE no WHEN 1 THEN 'duplicates' WHEN 2 THEN 'duplicates' WHEN 3 THEN 'mislabeling' WHEN 4 THEN 'ood'
    WHEN 5 THEN 'spectral_signature' WHEN 6 THEN 'activation_clustering' WHEN 7 THEN 'strip'
    WHEN 8 THEN 'trigger_reconstruction' WHEN 9 THEN 'fine_pruning' WHEN 10 THEN 'image_hash'
    ELSE 'model_identity' END AS detector_id,
  CASE WHEN no IN (1, 10) THEN 'PIXEL' WHEN no IN (2, 4) THEN 'EMBEDDING' WHEN no IN (3, 11) THEN 'ANNOTATION'
    WHEN no IN (5, 6, 9) THEN 'ACTIVATION' ELSE 'BEHAVIORAL' END AS modality,
  CASE WHEN no IN (8, 9) THEN 'white_box' WHEN no IN (5, 6) THEN 'gray_box' ELSE 'black_box' END AS access_assumptions,
  CAST((doc_id * 7 + n_chars * 3 + no * 11) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS severity,
  CAST((doc_id * 13 + n_chars * 5 + no * 17) % 101 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence,
  CASE WHEN (doc_id + no) % 9 = 0 THEN 'accept' WHEN (doc_id + no) % 7 = 0 THEN 'quarantine' ELSE 'review' END
    AS recommended_action,
  CASE (doc_id + no) % 4 WHEN 0 THEN 'sample' WHEN 1 THEN 'batch' WHEN 2 THEN 'contributor' END AS quarantine_scope,
  CASE WHEN (doc_id + no) % 3 > 0 THEN 'cause ' || TEXT(no % 3) END AS counter_text,
  'signal ' || TEXT(no % 4) || ' on ' || source AS evidence_text,
  CASE WHEN doc_id % 11 = 0 THEN 'shared-scan' END AS signal_id,
  'cfg-' || TEXT(no) AS config_hash
FROM (SELECT doc_id, n_chars, source, EACH(1, 11) AS no FROM {documents}) AS d
WHERE (doc_id * 5 + no * 3 + n_chars) % 4 = 0"""

ROLES["sample_meta"] = """
SELECT 'doc-' || TEXT(doc_id) AS asset_id, CASE WHEN doc_id % 53 > 0 THEN source END AS contributor_id,
       CASE WHEN doc_id % 47 > 0 THEN 'b' || TEXT(doc_id % 7) END AS batch_id
FROM {documents} WHERE doc_id % 29 > 0"""

ROLES["batch_order"] = """
SELECT DISTINCT 'b' || TEXT(doc_id % 7) AS batch_id, CAST(doc_id % 7 AS BIGINT) AS pos FROM {documents}"""

ROLES["truth"] = """
SELECT CASE WHEN doc_id % 2 = 0 AND toxic = 1 THEN 'ood' END AS detector_id, 'doc-' || TEXT(doc_id) AS asset_id
FROM {labels} WHERE quality = 0 OR toxic = 1"""

# Scores with a binary outcome.
ROLES["scored"] = """
SELECT CAST((d.doc_id * 37 + d.n_chars * 3) % 401 AS DOUBLE) / CAST(400 AS DOUBLE) AS score,
       CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS truth
FROM {documents} AS d JOIN {labels} AS l ON d.doc_id = l.doc_id"""

# An unlinked inference log per conversation.
ROLES["log"] = """
SELECT CAST(conv_id AS BIGINT) AS log_id, CAST(turn AS BIGINT) AS pos, SHA(text) AS input_hash, md5(role) AS model_digest,
       'cfg-' || TEXT(conv_id % 5) AS config_hash, SHA(role || text) AS output_hash,
       'n' || TEXT(conv_id) || '-' || TEXT(turn) AS nonce,
       AT_US(1700000000000000 + conv_id * 1000000 + turn * 1234) AS timestamp,
       CASE WHEN turn % 3 > 0 THEN SHA('m' || text) END AS merkle_root, 'c' || TEXT(conv_id % 7) AS consumer_id
FROM {conversations}"""

# Sequence numbers and nonces with planted regressions, repeats and blanks.
ROLES["replay"] = """
SELECT CAST(user_id AS BIGINT) AS log_id, CAST(event_id AS BIGINT) AS pos,
       CAST(CASE WHEN event_id % 97 = 0 THEN event_id - 5000 ELSE event_id END AS BIGINT) AS sequence_number,
       CASE WHEN event_id % 211 = 0 THEN '' ELSE event_type || '-' || TEXT(event_id % 4001) END AS nonce
FROM {events}"""

# Five-unit boxes per order; the image size depends on the order.
ROLES["boxes"] = """
SELECT 'o' || TEXT(o_orderkey) AS image_id, CAST(o_orderkey AS BIGINT) AS ord,
  CAST(100 + (o_orderkey % 3) * 20 AS DOUBLE) AS width, CAST(100 + (o_orderkey % 2) * 20 AS DOUBLE) AS height,
  CAST(l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS BIGINT) AS line_no,
  CAST((l_partkey % 16) * 5 - CASE WHEN l_partkey % 61 = 0 THEN 10 ELSE 0 END AS DOUBLE) AS x,
  CAST((l_suppkey % 16) * 5 AS DOUBLE) AS y,
  CAST(CASE WHEN l_partkey % 67 = 0 THEN 0 ELSE 5 * (1 + CAST(l_quantity AS INT) % 8) END AS DOUBLE) AS w,
  CAST(5 * (1 + l_linenumber % 6) - CASE WHEN l_suppkey % 71 = 0 THEN 60 ELSE 0 END AS DOUBLE) AS h
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey"""

# The same with images that have no box at all, for the operator that looks for them.
ROLES["sparse_boxes"] = ROLES["boxes"] + " WHERE o_orderkey % 13 > 0"

ROLES["images"] = """
SELECT 'o' || TEXT(o_orderkey) AS image_id, CAST(o_orderkey AS BIGINT) AS ord,
  CAST(100 + (o_orderkey % 3) * 20 AS DOUBLE) AS width, CAST(100 + (o_orderkey % 2) * 20 AS DOUBLE) AS height
FROM {orders}"""

# Three equal boxes per order, some layouts displaced.
ROLES["layouts"] = """
SELECT 'o' || TEXT(o_orderkey) AS image_id, CAST(o_orderkey AS BIGINT) AS ord,
  CAST(100 + (o_orderkey % 3) * 20 AS DOUBLE) AS width, CAST(100 AS DOUBLE) AS height,
  CAST(no AS BIGINT) AS line_no,
  CAST(20 * no - 10 + CASE WHEN o_orderkey % 10 = 3 THEN 10 WHEN o_orderkey % 10 = 6 THEN 3 ELSE 0 END AS DOUBLE) AS x,
  CAST(10 + CASE WHEN o_orderkey % 10 = 3 THEN 10 WHEN o_orderkey % 30 = 7 AND no = 2 THEN 20 ELSE 0 END AS DOUBLE) AS y,
  CAST(10 AS DOUBLE) AS w, CAST(10 + o_orderkey % 2 AS DOUBLE) AS h
FROM (SELECT o_orderkey, EACH(1, 3) AS no FROM {orders}) AS q"""

ROLES["lineage_edges"] = """
SELECT 'region-' || TEXT(n_regionkey) AS parent, 'nation-' || TEXT(n_nationkey) AS child, 'contributor' AS parent_type FROM {nation}
UNION ALL SELECT 'nation-' || TEXT(c_nationkey), 'customer-' || TEXT(c_custkey), 'contributor' FROM {customer}
UNION ALL SELECT 'nation-' || TEXT(s_nationkey), 'supplier-' || TEXT(s_suppkey), 'contributor' FROM {supplier}
UNION ALL SELECT 'customer-' || TEXT(o_custkey), 'order-' || TEXT(o_orderkey), 'dataset' FROM {orders}
UNION ALL SELECT DISTINCT 'order-' || TEXT(l_orderkey), 'line-' || TEXT(l_orderkey) || '.' || TEXT(l_linenumber), 'model' FROM {lineitem}
UNION ALL SELECT DISTINCT 'supplier-' || TEXT(l_suppkey), 'line-' || TEXT(l_orderkey) || '.' || TEXT(l_linenumber), 'dataset' FROM {lineitem}"""

# Declared nodes: some customers were never registered, regions are plain assets.
ROLES["lineage_nodes"] = """
SELECT 'region-' || TEXT(r_regionkey) AS id, 'asset' AS node_type, md5(r_name) AS hash FROM {region}
UNION ALL SELECT 'nation-' || TEXT(n_nationkey), 'contributor', md5(n_name) FROM {nation}
UNION ALL SELECT 'customer-' || TEXT(c_custkey), 'dataset', md5(c_name) FROM {customer} WHERE c_custkey % 97 > 0
UNION ALL SELECT 'supplier-' || TEXT(s_suppkey), 'dataset', md5(s_name) FROM {supplier}
UNION ALL SELECT 'order-' || TEXT(o_orderkey), 'model', md5(TEXT(o_orderkey)) FROM {orders}
UNION ALL SELECT DISTINCT 'line-' || TEXT(l_orderkey) || '.' || TEXT(l_linenumber), 'inference', md5(TEXT(l_orderkey)) FROM {lineitem}"""

ROLES["lineage_findings"] = """
SELECT 'customer-' || TEXT(c_custkey) AS asset_id, CAST(c_custkey % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
FROM {customer} WHERE c_custkey % 3 = 0
UNION ALL SELECT 'nation-' || TEXT(n_nationkey), CAST(50 + n_nationkey AS DOUBLE) / CAST(100 AS DOUBLE) FROM {nation}"""

# Predictions of one sample under sixteen overlays.
ROLES["predictions"] = """
SELECT ord, overlay, ARR(p, (CAST(1 AS DOUBLE) - p) * CAST(0.75 AS DOUBLE), (CAST(1 AS DOUBLE) - p) * CAST(0.25 AS DOUBLE)) AS probs
FROM (SELECT vec_id AS ord, CAST(no AS INT) AS overlay,
        CASE WHEN vec_id % 6 = 0 THEN CAST(1 AS DOUBLE) - CAST(no AS DOUBLE) / CAST(2000 AS DOUBLE)
             ELSE CAST((vec_id * 31 + no * 7) % 90 + 5 AS DOUBLE) / CAST(100 AS DOUBLE) END AS p
      FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, EACH(0, 15) AS no FROM {embeddings}) AS e) AS q"""

ROLES["timings"] = """
SELECT event_type AS detector_id, value / CAST(10 AS DOUBLE) AS seconds, event_id % 5 > 0 AS ran FROM {events}"""


def role(spark: SparkSession, folder: str, name: str, repeats: bool = False) -> DataFrame:
    """With ``repeats`` equal rows of a role may come more than once: for readers that group or make distinct themselves."""
    text = expand(ROLES[name], 0)
    if repeats:
        text = text.replace("SELECT DISTINCT ", "SELECT ")
    used = {t: table(spark, folder, t) for t in TABLES if "{" + t + "}" in text}
    return spark.sql(text, **used)


def with_roles(*names: str, body: str, recursive: bool = False) -> str:
    """Checking SQL that defines the named roles ahead of ``body`` (which may start with more CTEs)."""
    parts = []
    for name in names:
        text = expand(ROLES[name], 1)
        for t in TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    lead = "WITH RECURSIVE " if recursive else "WITH "
    body = expand(body, 1).strip()
    glue = ",\n" if body.startswith("+") and parts else "\n"
    return lead + ",\n".join(parts) + glue + body.removeprefix("+").strip()
