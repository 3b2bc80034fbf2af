import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.operators import chain as C
from attest.operators import evidence as E
from attest.operators import lineage as L
from attest.operators import merkle as M
from attest.operators import spotcheck as S
from attest.operators.condensed import condense
from tests.helpers import make_findings, rows_of


@pytest.fixture()
def graph(spark):
    edges = spark.createDataFrame(
        [("who", "data", "contributor"), ("data", "model", "dataset"), ("model", "record", "model"), ("data", "record", "dataset")],
        "parent string, child string, parent_type string")
    declared = spark.createDataFrame(
        [("who", "contributor", "h"), ("data", "dataset", "h"), ("model", "model", "h"), ("record", "inference", "h")],
        "id string, node_type string, hash string")
    return edges, L.build_nodes(declared, edges)


def test_blast_radius(spark, graph):
    edges, nodes = graph
    pairs = L.closure(edges, nodes.select("id"))
    got = {r.source: (r.models, r.inference_records, r.datasets, r.total) for r in L.blast_radius(pairs, nodes).collect()}
    assert got["who"] == (1, 1, 1, 3) and got["model"] == (0, 1, 0, 1) and "record" not in got


def test_propagation_ignores_siblings(spark, graph):
    edges, _ = graph
    found = spark.createDataFrame([("data", 0.4), ("who", 0.6), ("sibling", 0.1)], "asset_id string, confidence double")
    more = edges.union(spark.createDataFrame([("who", "sibling", "contributor")], edges.schema))
    own = spark.createDataFrame([("record", 0.9), ("model", 0.2), ("elsewhere", 0.8)], "id string, confidence double")
    assert rows_of(L.propagate_confidence(more, found, own), "id", "confidence") == [("elsewhere", 0.8), ("model", 0.2), ("record", 0.4)]


def test_scope_is_the_highest_ancestor(spark, graph):
    edges, nodes = graph
    found = make_findings(spark, [dict(asset_id="record", severity=0.9, confidence=0.9), dict(asset_id="loose", scope="batch")])
    out = {r.asset_id: r for r in E.resolve_scope(E.decide(found), L.scope_tops(nodes, edges)).collect()}
    assert (out["record"].verdict, out["record"].scope, out["record"].scope_asset_id) == ("QUARANTINE", "contributor", "who")
    assert out["loose"].scope == "batch" and out["loose"].scope_note


def test_orphans_and_conflicts(spark):
    models = spark.createDataFrame([("m1",), ("m2",)], "id string")
    known = spark.createDataFrame([("m2", "d")], "model_id string, dataset_id string")
    assert rows_of(L.model_parents(models, known), "parent", "child") == [("d", "m2"), ("unknown-training-dataset:m1", "m1")]
    declared = spark.createDataFrame([("x", "asset", None), ("x", "model", "h"), ("y", "model", "h"), ("y", "dataset", "h")],
                                     "id string, node_type string, hash string")
    assert [r.id for r in L.type_conflicts(declared).collect()] == ["y"]
    edges = spark.createDataFrame([("gone", "x", "dataset")], "parent string, child string, parent_type string")
    nodes = {r.id: (r.node_type, r.orphan) for r in L.build_nodes(declared, edges).collect()}
    assert nodes["x"] == ("model", False) and nodes["gone"] == ("dataset", True)


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "a"), ("s", "s")], "parent string, child string")
    assert rows_of(L.cycle_edges(edges), "parent", "child") == [("a", "b"), ("b", "c"), ("c", "a"), ("s", "s")]
    assert L.cycle_edges(edges.where("parent = 'x'")).count() == 0


def random_graph(seed, n, m, loops):
    r = np.random.default_rng(seed)
    pairs = {(f"n{a:02d}", f"n{b:02d}") for a, b in r.integers(0, n, (m, 2)).tolist() if loops or a < b}
    return sorted(pairs)


@pytest.mark.parametrize("seed,n,m,loops", [(1, 30, 40, False), (2, 30, 90, False), (3, 30, 28, True), (4, 30, 60, True), (5, 12, 60, True), (6, 40, 44, True)])
def test_graph_results_against_walking_every_path(spark, seed, n, m, loops):
    """Cycles, ancestors, minima and scopes of small graphs with and without cycles."""
    pairs = random_graph(seed, n, m, loops)
    kids = {}
    for a, b in pairs:
        kids.setdefault(a, set()).add(b)
    every = sorted({x for p in pairs for x in p})
    below = {}
    for x in every:
        seen, todo = set(), [x]
        while todo:
            for y in kids.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        below[x] = seen
    edges = spark.createDataFrame(pairs * 2, "parent string, child string")
    graph = condense(edges)
    assert rows_of(L.cycle_edges(edges, graph), "parent", "child") == sorted((a, b) for a, b in pairs if a in below[b])
    assert rows_of(L.ancestors_of(edges, graph=graph), "node", "ancestor") == sorted((y, x) for x in every for y in below[x])
    some = spark.createDataFrame([(x,) for x in every[::3]] * 2, "id string")
    assert rows_of(L.closure(edges, some, graph), "source", "node") == sorted((x, y) for x in every[::3] for y in below[x])
    value = {x: (i * 7) % 11 for i, x in enumerate(every) if i % 2}
    seeds = spark.createDataFrame(list(value.items()), "id string, value int")
    want = {y: min(value[x] for x in value if y in below[x]) for y in every if any(y in below[x] for x in value)}
    assert dict(rows_of(L.propagate_min(edges, seeds, graph), "id", "value")) == want
    kinds = {x: ("asset", "dataset", "model")[i % 3] for i, x in enumerate([*every, "apart", "alone"])}
    nodes = spark.createDataFrame(list(kinds.items()), "id string, node_type string")
    below |= {"apart": set(), "alone": set()}
    tops = {x for x in kinds if kinds[x] != "asset" and not any(x in below[y] for y in kinds if kinds[y] != "asset")}
    want = {}
    for x in kinds:
        able = [t for t in tops if t == x or x in below[t]]
        if able:
            want[x] = (min(able), kinds[min(able)])
    assert {r.id: (r.top_id, r.top_type) for r in L.scope_tops(nodes, edges).collect()} == want


def test_graph_without_edges(spark):
    none = spark.createDataFrame([], "parent string, child string")
    nodes = spark.createDataFrame([("a", "model"), ("b", "asset")], "id string, node_type string")
    assert L.cycle_edges(none).count() == 0 and L.ancestors_of(none).count() == 0
    assert rows_of(L.scope_tops(nodes, none), "id", "top_id") == [("a", "a")]


def test_finding_nodes_are_content_addressed(spark):
    found = make_findings(spark, [dict(ord=1), dict(ord=1)])
    assert L.finding_nodes(found).count() == 1


def log(spark, n=5, logs=2):
    rows = [(f"l{k}", i, f"in{i}", "model", "cfg", f"out{i}", f"n{k}-{i}", 1_700_000_000_000_000 + i * 1234567, None, "c") for k in range(logs) for i in range(n)]
    df = spark.createDataFrame(rows, "log_id string, pos bigint, input_hash string, model_digest string, config_hash string, output_hash string, "
                                     "nonce string, us bigint, merkle_root string, consumer_id string")
    return C.chain_append(df.withColumn("timestamp", F.timestamp_micros("us")).drop("us").repartition(3)).withColumn("signature_ok", F.lit(True))


def python_hash(r):
    body = {k: r[k] for k in ("input_hash", "model_digest", "config_hash", "output_hash", "sequence_number", "nonce", "previous_record_hash", "merkle_root", "consumer_id")}
    us = 1_700_000_000_000_000 + r.pos * 1234567
    text = "{" + ",".join(f'"{k}":' + (f"{us / 1e6:.6f}" if k == "timestamp" else json.dumps(body[k]))
                          for k in sorted([*body, "timestamp"])) + "}"
    return hashlib.sha256(text.encode()).hexdigest()


def test_chain_append_and_hash(spark):
    linked = log(spark).withColumn("again", C.record_hash()).orderBy("log_id", "pos").collect()
    last = {}
    for r in linked:
        assert r.record_hash == r.again == python_hash(r)
        assert r.previous_record_hash == last.get(r.log_id, "") and r.sequence_number == r.pos
        last[r.log_id] = r.record_hash


def test_tampering_is_localised(spark):
    clean = log(spark)
    assert all(r.passed for r in C.verify_chain(clean).collect())
    hit = (F.col("log_id") == "l0") & (F.col("pos") == 1)
    changed = clean.withColumn("output_hash", F.when(hit, "x").otherwise(F.col("output_hash"))) \
        .withColumn("signature_ok", ~hit)
    assert rows_of(C.chain_integrity(changed), "log_id", "pos") == [("l0", 2)]
    assert rows_of(C.chain_authenticity(changed), "log_id", "pos", "reason") == [("l0", 1, "signature invalid")]
    cut = clean.withColumn("previous_record_hash", F.when(hit, "cut").otherwise(F.col("previous_record_hash")))
    assert ("l0", 1) in rows_of(C.chain_integrity(cut), "log_id", "pos")
    unsigned = clean.withColumn("signature_ok", F.when(~hit, True))
    out = {r.log_id: r for r in C.verify_chain(unsigned).collect()}
    assert (out["l0"].authenticity, out["l0"].freshness_checked, out["l0"].passed, out["l1"].passed) == (1, False, False, True)


def replay_brute(rows, last=-1, seen=()):
    seen, out = set(seen), []
    for pos, number, nonce in rows:
        if nonce in seen:
            out.append((pos, "Nonce replay detected"))
        elif number <= last:
            out.append((pos, "Sequence number regression or replay"))
        elif not nonce:
            out.append((pos, "Missing nonce"))
        seen.add(nonce)
        last = max(last, number)
    return out


def test_freshness_equals_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(C, "CHUNK", 7)
    rng = np.random.default_rng(0)
    rows = [(i, int(i + rng.integers(-3, 2)), "" if i % 17 == 3 else f"n{rng.integers(0, 60)}") for i in range(80)]
    df = spark.createDataFrame([("a", *r) for r in rows], "log_id string, pos bigint, sequence_number bigint, nonce string").repartition(6)
    assert rows_of(C.freshness(df), "pos", "reason") == replay_brute(rows)
    last = spark.createDataFrame([("a", 10)], "log_id string, last bigint")
    seen = spark.createDataFrame([("a", "n5"), ("a", "n7"), ("b", "n1")], "log_id string, nonce string")
    assert rows_of(C.freshness(df, last, seen), "pos", "reason") == replay_brute(rows, 10, {"n5", "n7"})


def root_of(leaves):
    level = [hashlib.sha256(x).digest() for x in leaves]
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [hashlib.sha256(level[i] + level[i + 1]).digest() for i in range(0, len(level), 2)]
    return level[0].hex()


@pytest.mark.parametrize("levels", [8, 2, 1])
def test_merkle_roots_and_proofs(spark, monkeypatch, levels):
    monkeypatch.setattr(M, "LEVELS", levels)
    sizes = [1, 2, 3, 5, 8, 13, 33]
    rows = [(f"t{n}", i, f"leaf{i}") for n in sizes for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, idx bigint, text string").select("tree", "idx", M.leaf_hash(F.col("text")).alias("hash"))
    roots = {r.tree: r.root for r in M.merkle_root(leaves.repartition(5)).collect()}
    assert roots == {f"t{n}": root_of([f"leaf{i}".encode() for i in range(n)]) for n in sizes}
    proofs = M.merkle_proof(leaves).join(M.merkle_root(leaves), "tree")
    bad = F.sha2("leaf", 256)
    out = proofs.select(M.verify_proof(F.col("leaf"), F.col("proof"), F.col("root")).alias("ok"),
                        M.verify_proof(bad, F.col("proof"), F.col("root")).alias("forged"),
                        M.verify_proof(F.lit("zz"), F.col("proof"), F.col("root")).alias("malformed")).collect()
    assert len(out) == sum(sizes) and all(r.ok and not r.forged and not r.malformed for r in out)


def test_empty_tree(spark):
    trees = spark.createDataFrame([("empty",)], "tree string")
    none = spark.createDataFrame([], "tree string, idx bigint, hash string")
    assert M.merkle_roots_of(trees, none).first().root == hashlib.sha256(b"").hexdigest()


def test_spot_checks(spark):
    rows = [(f"r{i}", "i", "o", "m" if i else None) for i in range(12)]
    records = spark.createDataFrame(rows, "id string, input_hash string, output_hash string, merkle_root string")
    assert S.spot_sample(records, "id", 1.0).count() == 12 and S.spot_sample(records, "id", 0.0).count() == 0
    half = rows_of(S.spot_sample(records, "id", 0.5, 3), "id")
    assert half == rows_of(S.spot_sample(records.repartition(5), "id", 0.5, 3), "id") and 0 < len(half) < 12
    assert S.computation_status(S.spot_check(records.where("id <> 'r0'"), records, "id")).first().status == "partial assurance"
    wrong = records.select("id", F.lit("x").alias("input_hash"), F.lit("y").alias("output_hash"), F.lit("z").alias("merkle_root"))
    reports = {r.id: r.mismatches for r in S.spot_check(records, wrong, "id").collect()}
    assert reports["r1"] == ["input_hash", "output_hash", "merkle_root"] and reports["r0"][-1] == "missing_merkle_root"
    assert S.computation_status(S.spot_check(records, wrong, "id")).first().status == "mismatch"
    assert S.computation_status(S.spot_check(records.where("false"), wrong, "id")).first().status == "not checked"
