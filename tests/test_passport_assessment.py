"""Whole passports, and assessments whose checks are skipped, fail, or lose rows."""

import pytest
from pyspark.sql import functions as F

from attest.operators import assessment as A
from attest.operators import evidence as E
from attest.operators import passport as P
from attest.schemas import as_findings
from tests.helpers import make_findings, rows_of


def body(spark, change=None):
    change = change or {}
    found = [dict(asset_id="a", ord=1, severity=0.9, confidence=0.8, evidence="seen <b>|x"), dict(asset_id="a", ord=2, counter=None)]
    found[0].update(change.get("finding", {}))
    verdicts = E.decide(make_findings(spark, found))
    pick = lambda name, row: {**row, **change.get(name, {})}
    asset, manifest = pick("asset", dict(asset_id="a", node_type="dataset", hash="h")), pick("manifest", dict(asset_id="a", kind="dataset", digest="d", path="/p"))
    owed = pick("debt", dict(asset_id="a", check="c", gap="g", recommendation="r"))
    frame = lambda rows, names: spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"`{n}` string" for n in names))
    assets = frame([asset, dict(asset_id="bare", node_type=None, hash=None)], ["asset_id", "node_type", "hash"])
    manifests, debt = frame([manifest], ["asset_id", "kind", "digest", "path"]), frame([owed], ["asset_id", "check", "gap", "recommendation"])
    rows = P.passport_rows(verdicts, assets, manifests, debt)
    at = F.lit(change.get("issued", "2024-01-01 00:00:00")).cast("timestamp")
    return verdicts, manifests, debt, rows, P.passport_headers(verdicts, rows, assets, P.coverage_statement(debt, change.get("evaluated", ())), at)


def digests(spark, change=None):
    return {r.asset_id: r.digest for r in body(spark, change)[-1].select("asset_id", "digest").collect()}


def test_any_changed_field_changes_the_digest(spark):
    base = digests(spark)
    assert set(base) == {"a", "bare"} and digests(spark) == base
    changes = [{"finding": {k: v}} for k, v in dict(severity=0.91, counter="y", signal="s", ord=7).items()]
    changes += [{"asset": {"hash": "i"}}, {"manifest": {"path": None}}, {"debt": {"gap": "h"}}, {"issued": "2024-01-01 00:00:01"}, {"evaluated": ("ablation",)}]
    seen = {base["a"]}
    for change in changes:
        new = digests(spark, change)["a"]
        assert new not in seen, change
        seen.add(new)


def test_verification_and_text(spark):
    verdicts, manifests, debt, rows, heads = body(spark)
    assert rows_of(P.verify_passports(heads, rows), "asset_id", "valid") == [("a", True), ("bare", True)]
    assert rows_of(P.verify_passports(heads, rows.where("section <> 'debt'")), "asset_id", "valid") == [("a", False), ("bare", True)]
    assert rows_of(P.verify_passports(heads.withColumn("findings", F.lit(3).cast("bigint")), rows), "asset_id", "valid") == [("a", False), ("bare", False)]
    lines = {(r.asset_id, r.section, r.ord, r.part): r.line for r in P.passport_lines(heads, verdicts, manifests, debt).collect()}
    assert lines["a", 1, 1, 3] == "- seen &lt;b&gt;\\|x" and lines["bare", 1, 0, 0] == P.NO_FINDINGS
    with pytest.raises(Exception, match="unknown kind"):
        P.passport_rows(verdicts, heads.select("asset_id", "node_type", "hash"), manifests.withColumn("kind", F.lit("other")), debt).collect()


def found(rows, severity):
    return as_findings(rows, asset_id=F.col("id"), finding_type="label_disagreement", severity=severity, confidence=0.9, modality="ANNOTATION", detector_id="d",
                       ord=F.lit(1))


def test_one_bad_check_does_not_stop_the_others(spark):
    table = spark.createDataFrame([("a", "1"), ("b", "x"), ("c", None), ("d", "7")], "id string, n string")
    seen = {}

    def dear(t):
        seen["dear"] = sorted(r.id for r in t["t"].collect())
        return found(t["t"], 0.9)

    rule = A.Rule("no number", "try_cast(n as int) is null")
    given = lambda *rules: [A.Input("t", ("id", "n"), "id", rules)]
    checks = [
        A.Check("reads", "cheap", given(rule), lambda t: found(t["t"].where("n > 5"), 0.5)),
        A.Check("dies", "cheap", given(), lambda t: found(t["t"].select(F.raise_error(F.lit("boom")).alias("id")), 0.9)),
        A.Check("absent", "cheap", [A.Input("u", ("id",), "id")], None), A.Check("dear", "expensive", given(), dear)]
    out = A.assess({"t": table}, checks, "run")
    log = {r.provider: r for r in out.log.collect()}
    assert {k: (r.status, r.rows_read, r.rows_set_aside, r.findings) for k, r in log.items()} == {
        "reads": ("ran", 2, 2, 1), "dies": ("failed", 4, 0, 0), "absent": ("skipped", 0, 0, 0), "dear": ("ran", 1, 0, 1)}
    assert log["dies"].seconds > 0 and log["absent"].seconds == 0 and "boom" in log["dies"].reason and seen["dear"] == ["d"]
    assert rows_of(out.set_aside.withColumn("reasons", F.array_join("reasons", ";")), "provider", "row", "reasons") == [("reads", "b", "no number"), ("reads", "c", "no number")]
    assert rows_of(out.verdicts, "asset_id", "severity", "verdict") == [("d", 0.5, "REVIEW"), ("d", 0.9, "QUARANTINE")]
    assert rows_of(A.run_debt(out.log), "check") == [("absent",), ("dies",), ("reads",)]
    assert A.run_coverage(out.log).drop("assessment_id").first().asDict() == dict(requested=4, ran=2, skipped=1, failed=1, degraded=1, coverage=0.5)


def test_nothing_risky_skips_the_dear_checks(spark):
    table = spark.createDataFrame([("a", "1")], "id string, n string")
    given = [A.Input("t", ("id", "n"), "id")]
    out = A.assess({"t": table}, [A.Check("mild", "cheap", given, lambda t: found(t["t"], 0.4)), A.Check("dear", "expensive", given, None)], "run")
    assert rows_of(out.log, "provider", "status") == [("dear", "skipped"), ("mild", "ran")]
    empty = A.assess({"t": table.where("false")}, [A.Check("mild", "cheap", given, lambda t: found(t["t"], 0.9))], "run")
    assert rows_of(empty.log, "provider", "status", "findings") == [("mild", "ran", 0)] and empty.verdicts.count() == 0
