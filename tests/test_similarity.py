import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from attest.functions.fingerprints import vector_hash
from attest.operators import duplicates as D
from attest.operators import metric_join as M
from attest.operators import neighbours as N
from attest.operators.components import connected_components
from tests.helpers import rows_of


def brute_pairs(values, limit):
    return sorted((min(a, b), max(a, b), (a ^ b).bit_count()) for i, a in enumerate(values) for b in values[:i]
                  if (a ^ b).bit_count() <= limit)


@pytest.mark.parametrize("threshold,bands,hot", [(6, 7, 5000), (6, 3, 5000), (6, 4, 5000), (6, 7, 3), (6, 3, 3), (0, 1, 5000), (2, 3, 1)])
def test_fingerprint_pairs_are_exact(spark, threshold, bands, hot):
    rng = np.random.default_rng(threshold + bands)
    values = {int(x) for x in rng.integers(0, 2**62, 20)}
    for v in list(values):
        for _ in range(4):
            values.add(v ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(1, 8)), replace=False)))
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    got = rows_of(D.fingerprint_pairs(df, "fp", threshold, bands, hot), "a", "b", "distance")
    assert got == brute_pairs(values, threshold)


def test_hamming_reports_later_rows(spark):
    rows = [("first", 0, 0b1011), ("near", 1, 0b1010), ("copy", 2, 0b1011), ("far", 3, 2**60 - 1)]
    df = spark.createDataFrame(rows, "id string, ord bigint, fp bigint")
    out = rows_of(D.hamming_near_duplicates(df, "id", "ord", "fp", 6), "asset_id", "match_id", "distance", "match_rows")
    assert out == [("copy", "first", 0, 2), ("copy", "near", 1, 1), ("near", "first", 1, 2)]


@pytest.mark.parametrize("bands,hot,lot", [(7, 8192, 64), (8, 5, 3), (9, 2, 1)])
def test_hamming_pairs_leave_tasks_once_and_verified(spark, monkeypatch, bands, hot, lot):
    """Candidates and probes with flipped bits were rows of a shuffle: 696 for a fingerprint, and every pair was joined twice."""
    monkeypatch.setattr(D, "HOT_BUCKET", hot)
    monkeypatch.setattr(D, "LOT_ROWS", lot)
    rng = np.random.default_rng(bands)
    seeds = [0, 2**63 - 1, *(int(x) for x in rng.integers(0, 2**62, 12))]
    fps = [s ^ sum(1 << int(b) for b in rng.choice(63, int(rng.integers(0, 7)), replace=False)) for s in seeds for _ in range(12)] + seeds * 4
    fps = [fps[i] for i in rng.permutation(len(fps))]
    df = spark.createDataFrame([(f"r{i}", i, f) for i, f in enumerate(fps)] + [("none", 5, None)], "id string, ord bigint, fp bigint").repartition(5)
    got = rows_of(D.hamming_near_duplicates(df, "id", "ord", "fp", 6, bands), "asset_id", "match_id", "distance", "match_rows")
    first = {f: fps.index(f) for f in set(fps)}
    want = sorted((f"r{i}", f"r{at}", (f ^ g).bit_count(), fps.count(g)) for i, f in enumerate(fps) for g, at in first.items()
                  if at < i and (f ^ g).bit_count() <= 6)
    assert got == want
    assert [D.choose_bands(n, 6) for n in (1000, 10**6, 10**7, 10**9)] == [7, 7, 8, 9]
    plan = D.hamming_near_duplicates(df, "id", "ord", "fp", 6, bands)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "SortMergeJoin" not in plan.split("MapInArrow")[0]


@pytest.mark.parametrize("hot,lot", [(8192, 64), (4, 2)])
def test_hamming_links_different_contents_of_one_fingerprint(spark, monkeypatch, hot, lot):
    """Rows of one fingerprint were copies, whatever they held: only the first of them was anyone's match."""
    monkeypatch.setattr(D, "HOT_BUCKET", hot)
    monkeypatch.setattr(D, "LOT_ROWS", lot)
    rng = np.random.default_rng(5)
    rows = [(f"r{i}", i, f, f"{f} {int(rng.integers(3))}") for i, f in enumerate(int(x) for x in rng.choice([0, 1, 3, 2**62, 2**63 - 1], 60))]
    df = spark.createDataFrame(rows, "id string, ord bigint, fp bigint, text string").repartition(4)
    got = rows_of(D.hamming_near_duplicates(df, "id", "ord", "fp", 6, content="text"), "asset_id", "match_id", "distance", "match_rows")
    texts = [r[3] for r in rows]
    first = {t: texts.index(t) for t in texts}
    assert got == sorted((r[0], f"r{at}", (r[2] ^ rows[at][2]).bit_count(), texts.count(t))
                         for r in rows for t, at in first.items() if at < r[1] and (r[2] ^ rows[at][2]).bit_count() <= 6)


def test_hamming_query_has_documents_without_words(spark, tmp_path):
    texts = ["a b", "b a", "b a", None, "", " \n", "one two three four five", "a b"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.asset_id, r.match_id) for r in queries()["hamming_near_duplicates"](spark, str(tmp_path)).collect()}
    # Equal bags of words have one fingerprint, texts without a word have zero.
    assert {(1, 0), (2, 0), (2, 1), (7, 0), (7, 1), (4, 3), (5, 3)} <= got and (2, 2) not in got


def test_one_fingerprint_for_a_third_of_all_rows(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.col("id").alias("ord"),
                                  F.when(F.col("id") % 3 == 0, 5).otherwise(F.xxhash64("id").bitwiseAND(F.lit(2**62 - 1))).alias("fp"))
    out = D.hamming_near_duplicates(df, "id", "ord", "fp", 3)
    assert out.where("distance = 0").count() == 999  # one row per copy, not one per pair


def brute_clusters(vectors, s):
    n = len(vectors)
    norm = np.linalg.norm(vectors, axis=1)
    label = list(range(n))

    def sim(i, j):
        if norm[i] == 0 or norm[j] == 0:
            return float(norm[i] == norm[j])
        return vectors[i] @ vectors[j] / norm[i] / norm[j]
    for i in range(n):
        for j in range(i):
            if sim(i, j) >= s and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return {i: label[i] for i in range(n) if label.count(label[i]) > 1}


@pytest.mark.parametrize("seed,s,top,cells", [(0, 0.995, 256, 4), (1, 0.98, 3, 30), (2, 0.9, 5, 60)])
def test_cosine_clusters_equal_brute_force(spark, monkeypatch, seed, s, top, cells):
    """With few top pivots and many cells the second level does the work."""
    monkeypatch.setattr(M, "TOP", top)
    monkeypatch.setattr(M, "pivot_count", lambda rows: cells)
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 6))
    near = base[rng.integers(0, 40, 60)] + rng.normal(size=(60, 6)) * 0.08
    vectors = np.vstack([base, near, base[:5] * 3, np.zeros((3, 6))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "ord bigint, vec array<double>")
    got = {r.ord: r.root for r in D.cosine_clusters(df.repartition(6), "ord", "vec", s).collect()}
    assert got == brute_clusters(vectors, s)


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    got = dict(rows_of(connected_components(df), "node", "root"))
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def brute_knn(vectors, k):
    out = {}
    for i, v in enumerate(vectors):
        d = np.linalg.norm(vectors - v, axis=1)
        d[i] = np.inf
        out[i] = np.argsort(d, kind="stable")[: min(k, len(vectors) - 1)].tolist()
    return out


@pytest.mark.parametrize("seed,dims,block,top,cells", [(0, 2, 1024, 256, 5), (1, 8, 7, 2, 25), (2, 3, 16, 4, 40)])
def test_knn_equals_brute_force_with_many_copies(spark, monkeypatch, seed, dims, block, top, cells):
    monkeypatch.setattr(M, "TOP", top)
    monkeypatch.setattr(M, "pivot_count", lambda rows: cells)
    monkeypatch.setattr(M.join_blocks, "__defaults__", (block,))
    rng = np.random.default_rng(seed)
    vectors = np.round(rng.normal(size=(120, dims)), 1)
    vectors[rng.choice(120, 40, replace=False)] = vectors[0]  # a third of the rows are one vector
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vectors)], "ord bigint, vec array<double>, label int")
    got = {r.ord: [n.n_ord for n in r.neighbours] for r in N.knn(df.repartition(7), "ord", "vec", "label", 4).collect()}
    want = brute_knn(vectors, 4)
    exact = lambda i, ids: [round(float(np.linalg.norm(vectors[i] - vectors[j])), 9) for j in ids]
    for i in want:
        assert exact(i, got[i]) == exact(i, want[i])
    copies = [i for i in want if (vectors[i] == vectors[0]).all()]
    assert all(got[i] == want[i] for i in copies)  # ties follow the input order


def test_label_disagreement_fixtures(spark):
    make = lambda rows: spark.createDataFrame([(i, [float(v)], l) for i, (v, l) in enumerate(rows)], "ord bigint, vec array<double>, label int")
    near = N.knn(make([(0.0, 0), (0.1, 1), (0.2, 1)]), "ord", "vec", "label", 2)
    assert [r.ord for r in N.label_disagreement(near).collect()] == [0]
    assert N.label_disagreement(N.knn(make([(0.0, 0), (0.1, 1)]), "ord", "vec", "label", 5)).count() == 0


def test_planted_flip(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (np.full(27, 0.2 + 0.6 * (i % 2)) + rng.uniform(-0.01, 0.01, 27)).tolist(), i % 2) for i in range(16)]
    rows.append((16, (np.full(27, 0.2) + rng.uniform(-0.01, 0.01, 27)).tolist(), 1))
    df = spark.createDataFrame(rows, "ord bigint, vec array<double>, label int")
    assert [r.ord for r in N.label_disagreement(N.knn(df, "ord", "vec", "label")).collect()] == [16]
    assert N.label_disagreement(N.knn(df.where("ord < 16"), "ord", "vec", "label")).count() == 0


@pytest.mark.parametrize("kind", ["double", "float"])
def test_vector_hash_is_the_digest_of_the_bytes(spark, kind):
    nan = float("nan")
    vectors = [None, [], [1.5], [0.0], [-0.0], [nan, 2.0], [None, 2.0], [], None, [1.5], *[[float(i), i / 4] * (i % 5) for i in range(300)]]
    rows = spark.createDataFrame(list(enumerate(vectors)), f"i int, vec array<{kind}>").repartition(3)
    for r in rows.select("i", vector_hash(F.col("vec")).alias("h")).collect():
        v = vectors[r.i]
        want = None if v is None else hashlib.sha256(struct.pack(f"<{len(v)}d", *[nan if x is None else x for x in v])).hexdigest()
        assert r.h == want, v
    assert rows.where("false").select(vector_hash(F.col("vec"))).count() == 0
