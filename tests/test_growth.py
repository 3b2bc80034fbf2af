"""Steps whose cost once grew faster than their input, on small inputs."""

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from attest.operators import drift as D
from attest.operators import lineage as L
from attest.operators import metric_join as M
from attest.operators import neighbours as N
from attest.operators.condensed import condense
from attest.plans.roles import role
from attest.session import discard, settle
from attest.sources import files, sinks


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tree_of_many_files_has_no_checksum_files(spark, tmp_path):
    rows = spark.range(12).select(F.col("id").alias("doc"), F.concat(F.lit("text "), "id").alias("value"))
    rows.repartition("doc").write.options(**sinks.MANY_FILES).partitionBy("doc").text(f"{tmp_path}/t")
    assert not glob.glob(f"{tmp_path}/t/*/.*.crc")
    found = files.file_inventory(spark, f"{tmp_path}/t").where("path like '%.txt'")
    want = {(f"doc={i}", len(f"text {i}\n")) for i in range(12)}
    assert {(r["path"].split("/")[0], r["bytes"]) for r in found.collect()} == want


def test_tree_is_written_by_tasks_as_sparks_writer_does(spark, tmp_path, monkeypatch):
    """A file of Spark's writer took several processes for its modes, 36 s for 10,000 documents."""
    rows = spark.range(12).select((F.col("id") % 3).alias("lot"), F.col("id").alias("doc"), F.concat(F.lit("täxt\t"), "id").alias("value"))
    sinks.write_tree(rows, f"file:{tmp_path}/t", ["lot", "doc"], "value")
    sinks.write_tree(rows, f"file:{tmp_path}/t", ["lot", "doc"], "value")  # as a task that runs again
    assert sorted(glob.glob(f"{tmp_path}/t/*/*/*")) == sorted(f"{tmp_path}/t/lot={i % 3}/doc={i}/part-00000.txt" for i in range(12))
    monkeypatch.setattr(sinks, "_arrow_files", lambda root: None)
    sinks.write_tree(rows, f"{tmp_path}/u", ["lot", "doc"], "value")
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    one, two = (sorted(files.file_inventory(spark, f"{tmp_path}/{t}").where("path like '%.txt'").withColumn("path", folder).collect()) for t in "tu")
    assert one == two and len(one) == 12
    monkeypatch.undo()
    assert sinks._arrow_files("nowhere://host/x") is None and sinks._arrow_files("/a/b")[1] == sinks._arrow_files("file:///a/b")[1] == "/a/b"


def test_annotation_files_are_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"batch_id": "b", "images": [{"id": "1", "file_name": "x.jpg"}], "annotations": [], "categories": []}')
    parts = files.read_coco(spark, str(tmp_path))
    assert [r["id"] for r in parts["images"].collect()] == ["1"]
    assert not any("from_json" in _plan(df) or "jsontostructs" in _plan(df) for df in parts.values())


def test_copies_of_asked_rows_leave_in_slices():
    rows = pa.RecordBatch.from_pydict({"vid": list(range(50))})
    who, cell = np.nonzero(np.ones((50, 40), bool))
    out = list(M.copies(rows, who, "cell", cell, 64))
    assert max(b.num_rows for b in out) == 64
    got = [(v, c) for b in out for v, c in zip(b.column("vid").to_pylist(), b.column("cell").to_pylist())]
    assert got == [(v, c) for v in range(50) for c in range(40)]


def test_kernel_blocks_grow_with_the_rows_and_are_bounded(spark):
    copies = lambda n: 3 * -(-n // D.tile_rows(n))
    assert copies(250_000) <= 3 * D.SIDE_BLOCKS and D.tile_rows(10**9) == D.MOST_ROWS
    rng = np.random.default_rng(3)
    data = [("reference" if i % 3 else "current", rng.normal(size=4).tolist()) for i in range(2600)]
    data += data[:40]
    x = np.array([v for _, v in data])
    ref = np.array([s == "reference" for s, _ in data])
    k = np.exp(-0.25 * ((x[:, None, :] - x[None]) ** 2).sum(2))
    np.fill_diagonal(k, 0.0)
    want = {"rr": k[np.ix_(ref, ref)].sum(), "cc": k[np.ix_(~ref, ~ref)].sum(), "rc": k[np.ix_(ref, ~ref)].sum()}
    rows = spark.createDataFrame(data, "side string, vec array<double>")
    for size in (None, 1500):  # blocks beyond the rows compared at a time
        got = {r["pair"]: r["total"] for r in D.kernel_sums(rows, "side", "vec", 0.25, size).collect()}
        assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 * want[p] for p in want)


def test_leaves_are_not_numbered(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "a"), ("c", "x"), ("a", "x"), ("c", "y"), ("c", "y"), ("q", None)], "parent string, child string")
    graph = condense(edges)
    assert {r["id"] for r in graph.members.collect()} == {"a", "b", "c"}
    assert {r["id"] for r in graph.leaves.collect()} == {"x", "y"}
    sources = spark.createDataFrame([("a",), ("c",), ("y",)], "id string")
    got = sorted(tuple(r) for r in L.closure(edges, sources, graph).collect())
    assert got == [("a", n) for n in "abcxy"] + [("c", "x"), ("c", "y")]


def _shuffle_bytes(folder):
    return sum(os.path.getsize(f) for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True))


def test_rounds_leave_no_shuffle_files(spark, tmp_path):
    """They stayed till the driver's garbage was collected: resolve_scope had 290 MB of them for 13.5 MB of tables."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: sum(_shuffle_bytes(d.getPath()) for d in manager.localDirs())
    before, keys = held(), spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    keys.distinct().count()
    assert held() - before > 1_000_000  # an action of its own leaves them
    before = held()
    done = settle(keys.distinct())
    sinks.publish({"keys": keys.distinct()}, f"{tmp_path}/release")
    assert done.count() == 50_000 and held() - before < 500_000
    discard(done)
    assert not os.path.exists(done._settled.removeprefix("file:"))


def test_sources_travel_to_the_leaves_in_lots(spark, monkeypatch):
    monkeypatch.setattr(L, "LOT", 2)
    pairs = [(f"a{i}", f"b{i % 3}") for i in range(7)] + [(f"b{i}", f"b{(i + 1) % 3}") for i in range(2)] + [
        (f"b{i % 3}", f"c{j}") for i in range(3) for j in range(4)] + [("loop", "loop"), ("loop", "c0")]
    edges = spark.createDataFrame(pairs + pairs[:5], "parent string, child string")
    below = {p: {c for q, c in pairs if q == p} for p, _ in pairs}
    for _ in below:
        below = {p: s | {x for c in s for x in below.get(c, ())} for p, s in below.items()}
    want = sorted((p, c) for p, s in below.items() for c in s)
    assert sorted(tuple(r) for r in L.closure(edges, edges.select(F.col("parent").alias("id"))).collect()) == want
    assert sorted((r.ancestor, r.node) for r in L.ancestors_of(edges).collect()) == want
    graph = condense(edges)
    apart = L.named(graph, L.reach(graph, graph.members, itself=False), "source")
    assert sorted(tuple(r) for r in apart.collect()) == [(a, b) for a, b in want if a != b]
    plan = L.ancestors_of(edges)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sources" in plan


def test_roles_with_repeats_hold_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("lineage_edges", "lineage_nodes"):
        once, more = role(spark, folder, name), role(spark, folder, name, repeats=True)
        assert "Aggregate" in _plan(once) and "Aggregate" not in _plan(more)
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, more.distinct().collect()))


def test_nearest_of_a_block_are_merged_in_place():
    rng = np.random.default_rng(8)
    left, right = rng.integers(0, 4, (30, 3)).astype(float), rng.integers(0, 4, (200, 3)).astype(float)
    names = rng.permutation(200)
    distance, near = np.full((30, 4), np.inf), np.full((30, 4), np.iinfo(np.int64).max)
    for at in range(0, 200, 37):
        M._merge_nearest(left, right[at:at + 37], names[at:at + 37], np.full(30, np.inf), distance, near, size=50)
    far = np.linalg.norm(left[:, None] - right[None], axis=2)
    want = [[n for _, n in sorted(zip(f, names))[:4]] for f in far]
    assert near.tolist() == want


def test_asked_points_are_not_copied_to_every_cell(spark, monkeypatch):
    """In 64 dimensions bounds prune little: 20,000 vectors of 5 MB took 1.3 GB of shuffle files."""
    monkeypatch.setattr(M, "BLOCK_ROWS", 64)
    monkeypatch.setattr(M, "pivot_count", lambda rows: 40)
    monkeypatch.setattr(M, "target_cells", None)
    rng = np.random.default_rng(9)
    for dims, copies in ((16, 9), (1, 3)):
        vectors = np.round(rng.normal(size=(400, dims)), 1)
        vectors[::copies] = vectors[0]
        df = spark.createDataFrame([(i, v.tolist(), f"l{i % 7}") for i, v in enumerate(vectors)], "ord bigint, vec array<double>, label string")
        near = N.knn(df.repartition(5), "ord", "vec", "label", 5)
        got = {r.ord: [(n.n_ord, n.n_label) for n in r.neighbours] for r in near.collect()}
        for i, v in enumerate(vectors):
            gap = np.sqrt(((vectors - v) ** 2).sum(1))
            best = [j for j in np.lexsort((np.arange(400), gap)) if j != i][:5]
            assert got[i] == [(j, f"l{j % 7}") for j in best]
    blocks = spark.range(3).select(F.col("id").alias("block"), *[F.lit(b"").alias(c) for c in ("vid", "vec", "reach")], F.lit(1.0).alias("most"),
                                   *[F.array(F.col("id") * 10.0).alias(c) for c in ("low", "high")])
    assert "CartesianProduct" in M.nearest(blocks, 6)._jdf.queryExecution().executedPlan().toString()
