import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from attest.functions import canonical as K
from attest.functions.paths import is_unsafe_path
from attest.functions.scale import numbered, order_statistics, prefix_totals, salted_join
from attest.operators import evaluation as X
from attest.operators import manifests as M
from attest.sources import files, sinks
from attest.streaming import freshness as S
from attest.streaming import windows as W
from tests.helpers import make_findings, rows_of
from tests.test_lineage_provenance import replay_brute


def test_detector_metrics(spark):
    rows = [dict(asset_id=a, detector_id=d, action=k) for d, a, k in
            (("a", "0", "review"), ("a", "0", "review"), ("a", "2", "review"), ("b", "1", "review"), ("b", "2", "accept"))]
    truth = spark.createDataFrame([(None, "0"), (None, "1")], "detector_id string, asset_id string")
    silent = spark.createDataFrame([("silent",)], "detector_id string")
    got = {r.detector_id: r for r in X.detector_metrics(make_findings(spark, rows), truth, silent).collect()}
    assert (got["a"].tp, got["a"].fp, got["a"].fn, got["a"].f1) == (1, 1, 1, 0.5)
    assert (got["b"].precision, got["b"].recall, got["silent"].recall) == (1.0, 0.5, 0.0)
    own = truth.union(spark.createDataFrame([("a", "2")], truth.schema))
    assert {r.detector_id: r.tp for r in X.detector_metrics(make_findings(spark, rows), own, silent).collect()}["a"] == 1


def test_curves(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score double, truth int")
    assert [(r.fpr, r.tpr) for r in X.roc_points(df).orderBy(F.desc("threshold")).collect()] == [(0, 0), (0, 0.5), (0.5, 1), (1, 1)]
    assert X.pr_points(df).orderBy(F.desc("threshold")).collect()[2].precision == pytest.approx(2 / 3)
    assert all(r.fpr is None for r in X.roc_points(df.where("truth = 1")).collect())


def test_calibration(spark):
    df = spark.createDataFrame([(0.0, 0), (0.5, 1), (1.0, 1)], "confidence double, correct int")
    assert X.brier_score(df).first().brier == pytest.approx(1 / 12)
    assert X.brier_score(df.where("false")).first().brier is None
    bins = X.reliability_diagram(df, 2).orderBy("bin").collect()
    assert [b.n for b in bins] == [1, 2] and (bins[1].mean_confidence, bins[1].accuracy) == (0.75, 1.0)
    edge = spark.createDataFrame([(0.3, 1)], "confidence double, correct int")
    assert [b.bin for b in X.reliability_diagram(edge, 10).where("n > 0").collect()] == [2]  # edge 3 is 0.30000000000000004
    found = make_findings(spark, [dict(confidence=0.5)])
    once = X.apply_calibration(found, {0: 0.1, 1: 0.7})
    assert once.first().confidence == pytest.approx(0.4)
    assert X.apply_calibration(once, {0: 0.1, 1: 0.7}).first().confidence == pytest.approx(0.4)


def test_ablation_and_cost(spark):
    found = make_findings(spark, [dict(asset_id="1", detector_id="a"), dict(asset_id="2", detector_id="b")])
    truth = spark.createDataFrame([("1",), ("2",)], "asset_id string")
    assert {r.module: (r.recall_delta, r.precision_delta) for r in X.ablation(found, truth, ["a", "b"]).collect()} == {
        "a": (-0.5, 0.0), "b": (-0.5, 0.0)}
    for total, flagged in ((20, False), (10, True)):
        variants = spark.range(total).select(F.col("id").alias("variant"))
        verdicts = spark.createDataFrame([(0, "REVIEW"), (1, "ACCEPT")], "variant bigint, verdict string")
        row = X.false_positive_cost(verdicts, variants).first()
        assert (row.rate, row.flag) == (1 / total, flagged)
    assert X.false_positive_cost(verdicts, variants.where("false")).first().rate is None


def test_runtime_cost(spark):
    df = spark.createDataFrame([("a", 1.0, True), ("a", 3.0, True), ("a", 2.0, True), ("skipped", 0.0, False)], "detector_id string, seconds double, ran boolean")
    out = X.runtime_cost(df).collect()
    assert [(r.detector_id, r.runs, r.mean, r.p50, r.longest) for r in out] == [("a", 3, 2.0, 2.0, 3.0)]
    assert out[0].p95 == pytest.approx(2.9)
    with pytest.raises(Exception, match="nonnegative"):
        X.runtime_cost(df.withColumn("seconds", F.lit(-1.0))).collect()


def test_corruption_truth(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], i % 2) for i in range(20)], "id bigint, vec array<double>, label int")
    for mode in ("label_flip", "duplicate_flood", "ood_insert"):
        out = X.corrupt_table(df, "id", "vec", "label", 0.4, 7, mode)
        changed = {r.id for r in out.collect() if (list(r.vec), r.label) != ([float(r.id), 1.0], r.id % 2)}
        assert changed == {r.id for r in out.where("affected").collect()} and 7 <= len(changed) <= 8
        assert rows_of(out, "id", "label") == rows_of(X.corrupt_table(df.repartition(5), "id", "vec", "label", 0.4, 7, mode), "id", "label")
        assert X.corrupt_table(df, "id", "vec", "label", 0.0, 7, mode).where("affected").count() == 0


def test_order_statistics_on_large_and_skewed_groups(spark):
    rng = np.random.default_rng(0)
    groups = {"big": rng.normal(size=60_001), "ties": np.repeat([1.0, 2.0], [40_000, 30_000]), "small": rng.normal(size=4)}
    values = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v], "k string, x double")
    got = {r.k: r for r in order_statistics(values, ["k"], "x", {"mid": 0.5, "p95": 0.95, "low": 0.0, "top": 1.0}).collect()}
    for k, v in groups.items():
        want = np.percentile(v, [50, 95, 0, 100])
        assert [got[k].mid, got[k].p95, got[k].low, got[k].top] == pytest.approx(want.tolist(), abs=1e-12)


def test_prefix_totals_and_salted_join(spark):
    df = spark.range(1000).select((F.col("id") / 7).alias("s"), F.lit(1).alias("n"))
    out = prefix_totals(df, "s", ["n"], 8).orderBy(F.desc("s")).collect()
    assert [r.cum_n for r in out] == list(range(1, 1001))
    left = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k bigint, w string")
    for how in ("inner", "left"):
        want = rows_of(left.join(right, "k", how).na.fill("-"), "k", "v", "w")
        assert rows_of(salted_join(left, right, ["k"], how, hot_rows=10).na.fill("-"), "k", "v", "w") == want


def test_floats_round_by_their_binary_value(spark):
    r = np.random.default_rng(4)
    values = [0.0, -0.0, 0.5e-6, 1.5e-6, 2.5e-6, -0.5e-6, 1e-7, -1e-7, 0.1, 2.675, 0.9999995, 0.99999949999, 1e15 + 0.5, 2.0 ** 53, 2.0 ** 63, -(2.0 ** 63), 3e37, 1.0000005, 12345678.0000005,
              5e-324, 1.7e-6, *(r.integers(0, 4_000_000, 300) / 2_000_000).tolist(), *(r.integers(0, 1 << 30, 300) / 2.0 ** 21).tolist(),
              *np.exp(r.uniform(-20, 80, 300)).tolist(), *(-np.exp(r.uniform(-20, 40, 300))).tolist(), *(r.integers(0, 1 << 22, 300) / 64 / 15625).tolist()]
    want = [f"{v:.6f}" for v in values]
    want = ["0.000000" if w == "-0.000000" else w for w in want]
    df = spark.createDataFrame([(i, v, [v, 1.0]) for i, v in enumerate(values)], "i int, v double, a array<double>")
    out = df.select("i", K.canonical_float(F.col("v")).alias("t"), K.canonical_float_array(F.col("a")).alias("a")).orderBy("i").collect()
    assert [r.t for r in out] == want and [r.a for r in out] == [f"[{w},1.000000]" for w in want]
    for bad in (float("inf"), float("nan"), 1e38):
        with pytest.raises(Exception, match="no canonical form"):
            spark.createDataFrame([(bad,)], "v double").select(K.canonical_float(F.col("v"))).collect()


def test_nested_canonical_text(spark):
    df = spark.sql("""select named_struct('b', 1, 'a', named_struct('z', 'x"y', 'm', map('k2', array(1.5D, null), 'k1', array(-0.25D)))) as s,
      cast(1.50 as decimal(10,4)) as d, cast(100 as decimal(10,0)) as e, cast(0 as decimal(9,3)) as z, date'2024-02-29' as day, unhex('00ff') as b,
      timestamp_ntz'2024-01-01 00:00:01.5' as t, cast(null as map<string,int>) as n, map_from_entries(array(struct('b', 2), struct('a', 1))) as m,
      array(named_struct('q', true)) as l, named_struct('p', cast(null as int)) as h""")
    assert df.select(K.canonical_row(df.schema)).first()[0] == (
        '{"b":"00ff","d":1.5,"day":"2024-02-29","e":100,"h":{"p":null},"l":[{"q":true}],"m":{"a":1,"b":2},"n":null,'
        '"s":{"a":{"m":{"k1":[-0.250000],"k2":[1.500000,null]},"z":"x\\"y"},"b":1},"t":"2024-01-01 00:00:01.5","z":0}')


def test_canonical_text(spark):
    text = 'quote " slash \\ line\nbell\x07 tab\t é'
    df = spark.createDataFrame([(text, -0.0000001, 0.1234565, True, 3, None)], "s string, z double, f double, b boolean, i int, n string")
    got = df.select(K.canonical_row(df.schema)).first()[0]
    want = '{"b":true,"f":0.123456,"i":3,"n":null,"s":' + json.dumps(text, ensure_ascii=False) + ',"z":0.000000}'
    assert got == want
    with pytest.raises(Exception, match="non-finite"):
        spark.createDataFrame([(float("nan"),)], "f double").select(K.canonical_float(F.col("f"))).collect()


def test_paths(spark):
    bad = ["/abs", "a/../b", "a\\b", "a//b", "", "con", "dir/COM1.txt", "x. ", "a:b", "tail.", "nul\x00", "./a", None]
    good = ["a/b.txt", "ünï/é.png", "common.txt", "a b/c"]
    df = spark.createDataFrame([(p,) for p in bad + good], "p string")
    assert [r[0] for r in df.select(is_unsafe_path(F.col("p"))).collect()] == [True] * len(bad) + [False] * len(good)


def test_coco_tree(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "images" / "a.jpg").write_bytes(b"a")
    (tmp_path / "b.jpg").write_bytes(b"b")
    doc = {"images": [{"id": 1, "file_name": "a.jpg", "contributor_id": "alice"}, {"id": 2, "file_name": "b.jpg", "batch_id": "batch-2"}],
           "categories": [{"id": 1, "name": "cat"}, {"id": 2, "name": "dog"}],
           "annotations": [{"id": 1, "image_id": 1, "category_id": 1, "bbox": [0, 0, 2, 2]}, {"id": 2, "image_id": 2, "category_id": 1}],
           "contributor_id": "team", "batch_id": "batch-1", "version": "v1"}
    (tmp_path / "annotations.json").write_text(json.dumps(doc))
    parts = files.read_coco(spark, str(tmp_path / "annotations.json"))
    assert M.coco_violations(parts["images"], parts["annotations"], parts["categories"]).count() == 0
    counts = M.class_distribution(parts["categories"].select(F.col("id").alias("category_id"), "name"), parts["annotations"], "category_id")
    assert rows_of(counts, "name", "n") == [("cat", 2), ("dog", 0)]
    meta = M.sample_metadata(parts["images"].withColumn("sample_id", F.col("id")), parts["documents"])
    assert rows_of(meta, "sample_id", "contributor_id", "batch_id") == [("1", "alice", "batch-1"), ("2", "team", "batch-2")]
    inventory = files.file_inventory(spark, str(tmp_path))
    assert rows_of(inventory, "path") == [("annotations.json",), ("b.jpg",), ("images/a.jpg",)]
    assert rows_of(files.resolve_images(parts["images"], inventory), "id", "path", "candidates") == [("1", "images/a.jpg", 1), ("2", "b.jpg", 1)]
    broken = parts["annotations"].union(parts["annotations"].where("id = '1'")).withColumn(
        "category_id", F.when(F.col("id") == "2", "9").otherwise(F.col("category_id")))
    assert rows_of(M.coco_violations(parts["images"], broken, parts["categories"]), "violation") == [("duplicate_annotation_id",), ("unknown_category",)]


def test_yolo_tree(spark, tmp_path):
    for name, text in {"classes.txt": "cat\ndog\n", "images/train/a.jpg": "x", "images/val/b.png": "y", "labels/val/b.txt": "",
                       "labels/train/a.txt": "0 0.5 0.5 0.2 0.2\n\n1 0.1 0.1 0.1 0.1\n",
                       "metadata.json": json.dumps({"contributor_id": "team", "samples": {"images/train/a.jpg": {"batch_id": "b7"}}})}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    tree = files.read_yolo(spark, str(tmp_path))
    check = lambda **kw: rows_of(M.yolo_violations(*[kw.get(k, tree[k]) for k in ("rows", "images", "label_files", "classes", "metadata")]), "violation", "subject")
    assert check() == [] and rows_of(tree["classes"], "class_id", "name") == [(0, "cat"), (1, "dog")]
    assert rows_of(tree["metadata"], "path", "batch_id") == [("images/train/a.jpg", "b7")]
    bad = spark.createDataFrame([("labels/train/a.txt", i, t) for i, t in enumerate(["0 0.5", "7 0.5 0.5 0.1 0.1", "0 2 0 0.1 0.1", "0 0.5 0.5 0 0.1"])],
                                "label_path string, line int, text string")
    assert [v for v, _ in check(rows=bad)] == ["coordinate_out_of_range", "empty_box", "invalid_row", "unknown_class"]
    twin = tree["images"].union(spark.createDataFrame([("images/train/a.png",)], "path string"))
    assert check(images=twin) == [("shared_label_file", "labels/train/a.txt")]
    orphan = tree["label_files"].union(spark.createDataFrame([("labels/x.txt",)], "label_path string"))
    assert check(label_files=orphan) == [("orphan_label_file", "labels/x.txt")]


def test_manifest_and_identity(spark):
    cols = "path string, sha256 string, contributor_id string, batch_id string"
    old = spark.createDataFrame([("a", "1", "c", "b"), ("b", "2", "c", "b"), ("c", "3", "c", "b")], cols)
    new = spark.createDataFrame([("a", "1", "c", "b"), ("b", "9", "c", "b"), ("d", "4", "c", "b")], cols)
    assert rows_of(M.manifest_diff(old, new), "path", "status") == [("b", "changed"), ("c", "missing"), ("d", "added")]
    assert M.manifest_verify(old, old).first().verified
    reference = spark.createDataFrame([("m", "x"), ("n", "y"), ("o", "z")], "artifact_id string, digest string")
    supplied = spark.createDataFrame([("m", "x"), ("n", "q")], "artifact_id string, digest string")
    assert rows_of(M.artifact_identity(reference, supplied), "artifact_id", "status", "severity", "confidence") == [
        ("m", "match", 0.0, 1.0), ("n", "mismatch", 1.0, 1.0), ("o", "unverified", 0.0, 0.0)]


def test_table_digest_ignores_order_but_not_copies(spark):
    df = spark.range(500).select("id", (F.col("id") % 3).cast("string").alias("s"))
    value = lambda d: M.table_digest(d).first().digest
    assert value(df) == value(df.repartition(7)) == value(df.orderBy(F.desc("id")))
    assert value(df) != value(df.union(df.limit(1))) and value(df) != value(df.where("id > 0"))


def test_validate_samples(spark):
    rows = [("a", [1.0, 2.0], 0), ("a", [1.0], 1), ("b", [float("nan"), 1.0], None)]
    out = M.validate_samples(spark.createDataFrame(rows, "id string, vec array<double>, label int"), "id", "vec", "label", 2).first()
    assert (out.invalid_vectors, out.duplicate_ids, out.ragged_rows, out.missing_labels, out.valid) == (1, 1, 1, 1, False)


def test_sinks_replace_only_their_assessment(spark, tmp_path):
    run = lambda name, n: make_findings(spark, [dict(asset_id=str(i)) for i in range(n)]).withColumn(
        "provenance", F.col("provenance").withField("attrs", F.create_map(F.lit("assessment_id"), F.lit(name))))
    path = str(tmp_path / "out")
    sinks.write_findings(run("r1", 3), path)
    sinks.write_findings(run("r2", 2), path)
    sinks.write_findings(run("r1", 3), path)
    back = spark.read.parquet(path).groupBy("assessment_id").count()
    assert rows_of(back, "assessment_id", "count") == [("r1", 3), ("r2", 2)]


def test_a_release_is_read_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "out")
    assert sinks.published(spark, path) == {}
    nodes = spark.createDataFrame([("a", 1.5), ("b", None)], "id string, weight double")
    lines = spark.createDataFrame([("# one",), ("",)], "line string")
    got = sinks.publish({"nodes": nodes, "lines": lines, "none": nodes.where("false")}, path, {"lines": "text", "none": "json"})
    assert {n: t["rows"] for n, t in got["tables"].items()} == {"nodes": 2, "lines": 2, "none": 0}

    broken = nodes.select("id", F.when(F.col("id") == "b", F.raise_error(F.lit("lost"))).otherwise(F.lit(2.0)).cast("double").alias("weight"))
    with pytest.raises(Exception, match="lost"):
        sinks.publish({"lines": lines, "nodes": broken}, path)
    back = sinks.published(spark, path)
    assert rows_of(back["nodes"].fillna(0), "id", "weight") == [("a", 1.5), ("b", 0.0)]
    assert sorted(r.line for r in back["lines"].collect()) == ["", "# one"]
    assert back["none"].schema == nodes.schema and back["none"].count() == 0
    assert len([f for f in os.listdir(path) if f.startswith("release-")]) == 1  # the failed one is gone

    sinks.publish({"nodes": nodes.where("id = 'a'")}, path)
    assert set(sinks.published(spark, path)) == {"nodes"} and sinks.published(spark, path)["nodes"].count() == 1
    with open(f"{path}/_manifests/000000000003.json", "w") as half:
        half.write('{"folder": "rel')
    assert sinks.published(spark, path)["nodes"].count() == 1  # an unfinished manifest is passed over
    assert len(sinks.retire(spark, path, keep=1)) == 1
    assert sinks.published(spark, path)["nodes"].count() == 1
    with pytest.raises(ValueError):
        sinks.retire(spark, path, keep=0)


def test_stream_over_several_files_equals_the_batch_rule(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(f"l{i % 3}", i, int(i + rng.integers(0, 3)), f"n{i}") for i in range(90)]
    rows[70] = ("l1", 70, 5, "n70")      # regression
    rows[80] = ("l2", 80, 80, rows[5][3])  # nonce of an earlier file
    schema = "log_id string, pos bigint, sequence_number bigint, nonce string"
    for part in range(3):
        spark.createDataFrame(rows[part * 30:part * 30 + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    W.run_to_files(S.freshness_stream(stream), str(tmp_path / "run"), "append")
    out = spark.read.schema("log_id string, pos bigint, property string, reason string, batch int").parquet(str(tmp_path / "run" / "out"))
    want = {(log, *hit) for log in ("l0", "l1", "l2") for hit in replay_brute([r[1:] for r in rows if r[0] == log])}
    got = {tuple(r) for r in out.select("log_id", "pos", "reason").collect()}
    assert {("l1", 70, "Sequence number regression or replay"), ("l2", 80, "Nonce replay detected")} <= got
    clean = {w for w in want if w[1] < 60}
    assert clean <= got


class _State:
    """Value and map state that count their calls."""

    def __init__(self):
        self.value, self.map, self.calls = None, {}, 0

    def _call(self, out=None):
        self.calls += 1
        return out

    def get(self):
        return self._call(self.value)

    def exists(self):
        return self._call(self.value is not None)

    def update(self, value):
        self.value = self._call(value)

    def getValue(self, key):
        return self._call(self.map.get(key))

    def containsKey(self, key):
        return self._call(key in self.map)

    def updateValue(self, key, value):
        self.map[key] = self._call(value)

    def iterator(self):
        return self._call(iter(list(self.map.items())))


@pytest.mark.parametrize("ttl", [None, 1000])
def test_replay_state_takes_few_calls(ttl):
    """Each nonce took two calls to the JVM."""
    import pandas as pd

    last, nonces, clock = _State(), _State(), [0]
    processor = S._Replay(ttl)
    processor.init(type("H", (), {"getValueState": lambda *a: last, "getMapState": lambda *a: nonces}))
    times = type("T", (), {"getCurrentProcessingTimeInMs": lambda *a: clock[0]})()

    def push(rows):
        frames = [pd.DataFrame(rows[i::2], columns=["pos", "sequence_number", "nonce"]) for i in (0, 1) if rows[i::2]]
        return [tuple(r) for f in processor.handleInputRows(("log",), iter(frames), times) for r in f[["pos", "reason"]].itertuples(index=False)]

    assert push([(i, i, f"n{i}") for i in range(60)]) == []
    assert last.calls + nonces.calls <= 4
    assert push([(60, 60, "n60"), (61, 61, "n7"), (62, 60, "n62"), (63, 70, None), (64, 71, "n64"), (65, 72, "n64")]) == [
        (61, "Nonce replay detected"), (62, "Sequence number regression or replay"), (63, "Missing nonce"), (65, "Nonce replay detected")]
    for k in range(1, 60):
        assert push([(i, i, f"n{i}") for i in range(60 * k, 60 * k + 60)]) == []
    assert len(nonces.map) == 16 and max(len(v[0]) for v in nonces.map.values()) < 2 * S.BUCKET_NONCES
    assert {r[0] for r in push([(9000 + i, 9000 + i, f"n{i}") for i in range(3600)])} == set(range(9000, 12600))
    clock[0] = 5000
    assert len(push([(9000, 9000, "n7")])) == (ttl is None)


def test_late_rows_go_aside(spark, tmp_path):
    base = 1_700_000_000
    for offset in (0, 10_000, 5_000):
        spark.createDataFrame([(i, base + offset + i) for i in range(5)], "id int, s bigint").select("id", F.timestamp_seconds("s").alias("ts")) \
            .coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        import time
        time.sleep(1.1)
    stream = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    W.split_late(stream, "ts", 600, str(tmp_path / "run"))
    count = lambda side: spark.read.schema("id int, ts timestamp").parquet(str(tmp_path / "run" / side)).count()
    assert (count("in_time"), count("late")) == (10, 5)


@pytest.mark.parametrize("partitions", [1, 7])
def test_dense_numbers_by_ranges(spark, partitions):
    values = [(i * 37) % 101 for i in range(101)] + [5, 5]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int").repartition(partitions)
    out = numbered(df, ["v", "i"], "no").collect()
    assert sorted((r.v, r.i, r.no) for r in out) == [(v, i, n) for n, (v, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))]
    assert numbered(df.where("false"), ["v"], "no").count() == 0


def test_unreadable_annotation_files_have_a_reason(spark, tmp_path):
    texts = {"good": '{"batch_id": "b", "images": [{"id": "1", "file_name": "a.jpg"}], "annotations": [], "categories": []}',
             "cut": '{"batch_id": "b", "images": [{"id": "1"', "other": '{"images": 3}', "empty": "", "list": "[1]"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    parts = files.read_coco(spark, f"{tmp_path}/*.json")
    assert [r.file_name for r in parts["images"].collect()] == ["a.jpg"] and parts["documents"].count() == 1
    broken = {r.document_id.rsplit("/", 1)[1]: r.reason for r in parts["broken"].collect()}
    assert {"cut.json", "other.json"} <= set(broken) and "good.json" not in broken and "no JSON" in broken["cut.json"]
