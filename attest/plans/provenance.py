"""Log, Merkle and spot-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attest.operators import chain as C
from attest.operators import merkle as M
from attest.operators import spotcheck as S
from attest.operators.evaluation import tamper_log
from attest.plans.registry import query, table
from attest.plans.roles import ROLES, role, with_roles
from attest.session import settle


def _json(prev: str, seq: str) -> str:
    quoted = lambda c: f"coalesce('\"' || {c} || '\"', 'null')"
    return ("sha256('{\"config_hash\":' || " + quoted("config_hash") + " || ',\"consumer_id\":' || " + quoted("consumer_id")
            + " || ',\"input_hash\":' || " + quoted("input_hash") + " || ',\"merkle_root\":' || " + quoted("merkle_root")
            + " || ',\"model_digest\":' || " + quoted("model_digest") + " || ',\"nonce\":' || " + quoted("nonce")
            + " || ',\"output_hash\":' || " + quoted("output_hash") + f" || ',\"previous_record_hash\":\"' || {prev} || '\"'"
            + f" || ',\"sequence_number\":' || {seq} || ',\"timestamp\":' || printf('%d.%06d', epoch_us(timestamp) // 1000000, epoch_us(timestamp) % 1000000) || '}}')")


_CHAIN = "\n+ chained AS (SELECT *, '' AS previous_record_hash, pos AS sequence_number, " + _json("''", "TEXT(pos)") + """ AS record_hash FROM log WHERE pos = 0
UNION ALL SELECT log.*, c.record_hash, log.pos, """ + _json("c.record_hash", "TEXT(log.pos)").replace("config_hash", "log.config_hash").replace('"log.config_hash"', '"config_hash"').replace(
    "|| input_hash", "|| log.input_hash") + " FROM log JOIN chained c ON c.log_id = log.log_id AND log.pos = c.pos + 1)"
# The recursive step reads unqualified columns of two tables: qualify all of them.
for _c in ("consumer_id", "input_hash", "merkle_root", "model_digest", "nonce", "output_hash"):
    _head, _tail = _CHAIN.split("UNION ALL")
    _CHAIN = _head + "UNION ALL" + _tail.replace(f"'\"' || {_c} ||", f"'\"' || log.{_c} ||")
_CHAIN = _CHAIN.replace("epoch_us(timestamp)", "epoch_us(log.timestamp)")
# Broken copy: some outputs changed, some links blanked, signatures missing or wrong.
_BROKEN = _CHAIN + """,
broken AS (SELECT * REPLACE (CASE WHEN (log_id + pos) % 23 = 0 THEN sha256('5|' || log_id || '|' || pos) ELSE output_hash END AS output_hash,
  CASE WHEN (log_id + pos) % 31 = 0 THEN 'cut' ELSE previous_record_hash END AS previous_record_hash),
  CASE WHEN (log_id + pos) % 37 = 0 THEN NULL ELSE (log_id + pos) % 29 > 0 END AS signature_ok FROM chained),
rehash AS (SELECT *, """ + _json("previous_record_hash", "TEXT(sequence_number)").replace("epoch_us(timestamp)", "epoch_us(log.timestamp)").replace("log.timestamp", "timestamp") + """ AS h FROM broken),
integ AS (SELECT a.log_id, a.pos FROM broken a LEFT JOIN rehash p ON p.log_id = a.log_id AND p.pos = a.pos - 1 WHERE a.previous_record_hash <> coalesce(p.h, ''))
"""


def _linked(spark, folder, name="log"):
    return C.chain_append(role(spark, folder, name))


def _broken(spark, folder, name="log"):
    key = F.col("log_id") + F.col("pos")
    hit = tamper_log(_linked(spark, folder, name), key % 23 == 0, 5).drop("affected")
    # Linking is sequential: keep the log as a table, as a real one would be.
    return settle(hit.withColumn(
        "previous_record_hash", F.when(key % 31 == 0, "cut").otherwise(F.col("previous_record_hash"))
    ).withColumn("signature_ok", F.when(key % 37 == 0, F.lit(None).cast("boolean")).otherwise(key % 29 > 0)))


@query("record_hash", with_roles("log", body="SELECT log_id, pos, " + _json("'genesis'", "TEXT(pos * 3)") + " AS record_hash FROM log"))
def record_hash(spark, folder):
    rows = role(spark, folder, "log").withColumn("previous_record_hash", F.lit("genesis")).withColumn("sequence_number", F.col("pos") * 3)
    return rows.select("log_id", "pos", C.record_hash().alias("record_hash"))


@query("chain_append", with_roles("log", recursive=True, body=_CHAIN + """
SELECT log_id, pos, sequence_number, previous_record_hash, record_hash FROM chained"""))
def chain_append(spark, folder):
    return _linked(spark, folder).select("log_id", "pos", "sequence_number", "previous_record_hash", "record_hash")


@query("chain_integrity", with_roles("log", recursive=True, body=_BROKEN + "SELECT log_id, pos, 'chain break' AS reason FROM integ"))
def chain_integrity(spark, folder):
    return C.chain_integrity(_broken(spark, folder)).select("log_id", "pos", "reason")


@query("chain_authenticity", with_roles("log", body="""
SELECT log_id, pos, CASE WHEN (log_id + pos) % 37 = 0 THEN 'missing signature' ELSE 'signature invalid' END AS reason
FROM log WHERE (log_id + pos) % 37 = 0 OR (log_id + pos) % 29 = 0"""))
def chain_authenticity(spark, folder):
    return C.chain_authenticity(_broken(spark, folder)).select("log_id", "pos", "reason")


_FRESH = """
+ s AS (SELECT *, row_number() OVER (PARTITION BY log_id, nonce ORDER BY pos) AS use,
  coalesce(max(sequence_number) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS top FROM replay),
f AS (SELECT log_id, pos, CASE WHEN use > 1 THEN 'Nonce replay detected' WHEN sequence_number <= top THEN 'Sequence number regression or replay'
  WHEN nonce = '' THEN 'Missing nonce' END AS reason FROM s)
SELECT log_id, pos, reason FROM f WHERE reason IS NOT NULL
"""


@query("freshness", with_roles("replay", body=_FRESH))
def freshness(spark, folder):
    return C.freshness(role(spark, folder, "replay")).select("log_id", "pos", "reason")


@query("freshness_with_state", with_roles("replay", body="""
+ old AS (SELECT * FROM replay WHERE pos % 2 = 0 AND log_id % 2 = 0), new AS (SELECT * FROM replay WHERE pos % 2 = 1 OR log_id % 2 = 1),
st AS (SELECT log_id, max(sequence_number) AS last FROM old GROUP BY log_id), seen AS (SELECT DISTINCT log_id, nonce FROM old),
s AS (SELECT new.*, seen.nonce IS NOT NULL OR row_number() OVER (PARTITION BY log_id, new.nonce ORDER BY pos) > 1 AS replayed,
  greatest(coalesce(last, -1), coalesce(max(sequence_number) OVER (PARTITION BY log_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)) AS top
  FROM new LEFT JOIN st USING (log_id) LEFT JOIN seen USING (log_id, nonce)),
f AS (SELECT log_id, pos, CASE WHEN replayed THEN 'Nonce replay detected' WHEN sequence_number <= top THEN 'Sequence number regression or replay'
  WHEN nonce = '' THEN 'Missing nonce' END AS reason FROM s)
SELECT log_id, pos, reason FROM f WHERE reason IS NOT NULL"""))
def freshness_with_state(spark, folder):
    rows = role(spark, folder, "replay")
    old = rows.where("pos % 2 = 0 and log_id % 2 = 0")
    none = old.where("false").select("log_id", "pos")
    last, seen = C.committed_state(old, none)
    return C.freshness(rows.where("pos % 2 = 1 or log_id % 2 = 1"), last, seen).select("log_id", "pos", "reason")


# The log with nonces of earlier records: some logs with a sound chain and signatures are replays.
ROLES["replayed_log"] = ROLES["log"].replace(
    "'n' || TEXT(conv_id) || '-' || TEXT(turn) AS nonce",
    "'n' || TEXT(conv_id) || '-' || TEXT(CASE WHEN (conv_id * 7 + turn) % 9 = 0 THEN 0 ELSE turn END) AS nonce")


@query("verify_chain", with_roles("replayed_log", recursive=True, body=_BROKEN + """,
auth AS (SELECT log_id, pos FROM broken WHERE signature_ok IS NULL OR NOT signature_ok),
sound AS (SELECT log_id FROM broken EXCEPT (SELECT log_id FROM integ UNION SELECT log_id FROM auth)),
stale AS (SELECT log_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY log_id, nonce ORDER BY pos) AS use FROM broken) WHERE use > 1 AND log_id IN (FROM sound))
SELECT log_id, count(*) AS records, (SELECT count(*) FROM integ i WHERE i.log_id = b.log_id) AS integrity,
  (SELECT count(*) FROM auth i WHERE i.log_id = b.log_id) AS authenticity, (SELECT count(*) FROM stale i WHERE i.log_id = b.log_id) AS freshness,
  log_id IN (FROM sound) AS freshness_checked, log_id IN (FROM sound) AND log_id NOT IN (SELECT log_id FROM stale) AS passed
FROM broken b GROUP BY log_id""").replace("replayed_log AS (", "log AS ("))
def verify_chain(spark, folder):
    return C.verify_chain(_broken(spark, folder, "replayed_log")).select(
        "log_id", "records", "integrity", "authenticity", "freshness", "freshness_checked", "passed")


_ROOT = """
+ leaf AS (SELECT conv_id AS tree, turn AS idx, sha256(text) AS h FROM conversations),
lv(tree, l, n) AS (SELECT tree, list(h ORDER BY idx), count(*) FROM leaf GROUP BY tree
  UNION ALL SELECT tree, [sha256(unhex(l[2 * i + 1]) || unhex(coalesce(l[2 * i + 2], l[2 * i + 1]))) FOR i IN range((len(l) + 1) // 2)], n FROM lv WHERE len(l) > 1)
"""


def _leaves(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("tree"), F.col("turn").alias("idx"), M.leaf_hash(F.col("text")).alias("hash"))


@query("merkle_root", with_roles(recursive=True, body=_ROOT + "SELECT tree, l[1] AS root, n AS leaves FROM lv WHERE len(l) = 1"))
def merkle_root(spark, folder):
    return M.merkle_root(_leaves(spark, folder)).select("tree", "root", "leaves")


def _one_tree(spark, folder):
    """All orders as one tree in key order; order keys are dense."""
    leaf = M.leaf_hash(F.col("o_orderkey").cast("string"))
    return table(spark, folder, "orders").select(
        M.single_tree("orders", leaf).alias("tree"), F.col("o_orderkey").alias("idx"), leaf.alias("hash"))


@query("merkle_root_single", """
WITH RECURSIVE lv(l, n) AS (SELECT list(sha256(CAST(o_orderkey AS VARCHAR)) ORDER BY o_orderkey), count(*) FROM orders
  UNION ALL SELECT [sha256(unhex(l[2 * i + 1]) || unhex(coalesce(l[2 * i + 2], l[2 * i + 1]))) FOR i IN range((len(l) + 1) // 2)], n FROM lv WHERE len(l) > 1)
SELECT 'orders' AS tree, l[1] AS root, n AS leaves FROM lv WHERE len(l) = 1""")
def merkle_root_single(spark, folder):
    return M.merkle_root(_one_tree(spark, folder)).select("tree", "root", "leaves")


@query("merkle_proof", with_roles(recursive=True, body="""
+ leaf AS (SELECT conv_id AS tree, turn AS idx, sha256(text) AS h FROM conversations),
lv(tree, lvl, l) AS (SELECT tree, 0, list(h ORDER BY idx) FROM leaf GROUP BY tree
  UNION ALL SELECT tree, lvl + 1, [sha256(unhex(l[2 * i + 1]) || unhex(coalesce(l[2 * i + 2], l[2 * i + 1]))) FOR i IN range((len(l) + 1) // 2)] FROM lv WHERE len(l) > 1),
p AS (SELECT leaf.tree, idx, h, lvl, idx >> lvl AS at, l FROM leaf JOIN lv USING (tree) WHERE len(l) > 1)
SELECT leaf.tree, leaf.idx, leaf.h AS leaf, coalesce(string_agg(CASE WHEN p.at % 2 = 0 THEN 'right ' || coalesce(p.l[p.at + 2], p.l[p.at + 1]) ELSE 'left ' || p.l[p.at] END, ',' ORDER BY p.lvl), '') AS proof
FROM leaf LEFT JOIN p ON p.tree = leaf.tree AND p.idx = leaf.idx GROUP BY ALL"""))
def merkle_proof(spark, folder):
    out = M.merkle_proof(_leaves(spark, folder))
    steps = F.transform("proof", lambda s: F.concat(s["position"], F.lit(" "), s["hash"]))
    return out.select("tree", "idx", "leaf", F.array_join(steps, ",").alias("proof"))


@query("verify_proof", """
SELECT conv_id AS tree, turn AS idx, (conv_id + turn) % 5 > 0 AS verified FROM conversations""")
def verify_proof(spark, folder):
    leaves = _leaves(spark, folder)
    joined = M.merkle_proof(leaves).join(M.merkle_root(leaves).select("tree", "root"), "tree")
    shown = F.when((F.col("tree") + F.col("idx")) % 5 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf"))
    return joined.select("tree", "idx", M.verify_proof(shown, F.col("proof"), F.col("root")).alias("verified"))


@query("activation_leaves", with_roles("samples", body="""
+ f AS (SELECT ord, pos, vec[pos + 1] AS v FROM (SELECT ord, vec, unnest(range(64)) AS pos FROM samples))
SELECT ord AS tree, CAST(pos AS BIGINT) AS idx, sha256('{"index":' || pos || ',"layer":"dense","shape":[64],"value":'
  || replace(printf('%.6f', v), '-0.000000', '0.000000') || '}') AS hash FROM f"""))
def activation_leaves(spark, folder):
    rows = role(spark, folder, "samples").withColumn("layer", F.lit("dense"))
    return M.activation_leaves(rows, "ord", "layer", "vec")


@query("spot_sample", with_roles("log", body="""
SELECT log_id, pos FROM log WHERE CAST('0x' || substr(md5('3|' || nonce), 1, 8) AS BIGINT) / 4294967296.0 < 0.3"""))
def spot_sample(spark, folder):
    return S.spot_sample(role(spark, folder, "log"), "nonce", 0.3, 3).select("log_id", "pos")


def _reports(spark, folder):
    log = role(spark, folder, "log")
    key = F.col("log_id") + F.col("pos")
    again = log.where(key % 13 > 0).select(
        "nonce", F.when(key % 7 == 0, F.lit("x")).otherwise(F.col("input_hash")).alias("input_hash"),
        F.when(key % 5 == 0, F.lit("x")).otherwise(F.col("output_hash")).alias("output_hash"),
        F.when(key % 11 == 0, F.lit("x")).otherwise(F.col("merkle_root")).alias("merkle_root"))
    return S.spot_check(S.spot_sample(log, "nonce", 0.6, 3), again, "nonce")


_SPOT = """
+ s AS (SELECT *, log_id + pos AS k FROM log WHERE CAST('0x' || substr(md5('3|' || nonce), 1, 8) AS BIGINT) / 4294967296.0 < 0.6),
x AS (SELECT nonce, k % 13 > 0 AND k % 5 > 0 AS output_match, k % 13 > 0 AND k % 11 > 0 AND merkle_root IS NOT NULL AS merkle_match,
  concat_ws(',', CASE WHEN k % 13 = 0 THEN 're-execution error' END, CASE WHEN k % 13 > 0 AND k % 7 = 0 THEN 'input_hash' END,
    CASE WHEN k % 13 > 0 AND k % 5 = 0 THEN 'output_hash' END,
    CASE WHEN k % 13 > 0 AND merkle_root IS NULL THEN 'missing_merkle_root' WHEN k % 13 > 0 AND k % 11 = 0 THEN 'merkle_root' END) AS mismatches FROM s)
"""


@query("spot_check", with_roles("log", body=_SPOT + "SELECT nonce, output_match, merkle_match, mismatches FROM x"))
def spot_check(spark, folder):
    return _reports(spark, folder).select("nonce", "output_match", "merkle_match", F.array_join("mismatches", ",").alias("mismatches"))


@query("computation_status", with_roles("log", body=_SPOT + """
SELECT count(*) AS checked, CASE WHEN count(*) = 0 THEN 'not checked' WHEN bool_and(output_match AND merkle_match AND mismatches = '') THEN 'partial assurance' ELSE 'mismatch' END AS status,
  false AS fully_assured FROM x"""))
def computation_status(spark, folder):
    return S.computation_status(_reports(spark, folder))
