"""One assessment: registered checks over given tables, from row quarantine to verdicts and their log.

Cheap checks run on all rows, dear ones on the rows of assets that a cheap check finds
risky. A check without its tables or columns is skipped, and one that raises is recorded
as failed; the others go on. Rows that a check cannot read are set aside with their reasons
before it runs. Findings of every check are settled once; their number, worst severity and
the rows read are observed while they are written, and the clock of the driver gives the seconds.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from attest.operators.evidence import converge, decide, prepare_detectors, risky_assets, union_findings
from attest.schemas import FINDING
from attest.session import settle

LOG = ("assessment_id string, provider string, tier string, status string, reason string, rows_read bigint, "
       "rows_set_aside bigint, findings bigint, worst double, seconds double")
SET_ASIDE = "provider string, input string, row string, reasons array<string>"


@dataclass(frozen=True)
class Rule:
    """Rows for which the SQL condition ``bad`` holds are set aside; write it with ``try_`` functions."""

    reason: str
    bad: str


@dataclass(frozen=True)
class Input:
    """A table of a check: its columns, what makes a row unreadable, and the column that names the asset."""

    table: str
    columns: Sequence[str]
    asset: str
    rules: Sequence[Rule] = ()


@dataclass(frozen=True)
class Check:
    """``run`` maps the readable rows of each input, by table name, to findings."""

    name: str
    tier: str
    inputs: Sequence[Input]
    run: Callable[[Mapping[str, DataFrame]], DataFrame]


@dataclass
class Assessment:
    findings: DataFrame
    verdicts: DataFrame
    log: DataFrame
    set_aside: DataFrame
    seconds: dict[str, float] = field(default_factory=dict)


def split_rows(rows: DataFrame, rules: Sequence[Rule], out: str = "_reasons") -> tuple[DataFrame, DataFrame]:
    """(readable rows, rows that are set aside with all their reasons); a condition without a value doesn't hold."""
    if not rules:
        return rows, rows.withColumn(out, F.array().cast("array<string>")).where("false")
    held = [F.when(F.coalesce(F.expr(r.bad), F.lit(False)), F.lit(r.reason)) for r in rules]
    marked = rows.withColumn(out, F.array_compact(F.array(*held)))
    return marked.where(F.size(out) == 0).drop(out), marked.where(F.size(out) > 0)


def set_aside(tables: Mapping[str, DataFrame], checks: Sequence[Check]) -> DataFrame:
    """Every row that some check cannot read: (provider, input, row, reasons)."""
    spark = next(iter(tables.values())).sparkSession
    parts = [spark.createDataFrame([], SET_ASIDE)]
    for check in checks:
        for i in check.inputs:
            if i.rules and i.table in tables and set(i.columns) <= set(tables[i.table].columns):
                bad = split_rows(tables[i.table], i.rules)[1]
                parts.append(bad.select(F.lit(check.name).alias("provider"), F.lit(i.table).alias("input"),
                                        F.col(i.asset).cast("string").alias("row"), F.col("_reasons").alias("reasons")))
    return reduce(DataFrame.unionByName, parts)


def _short(error: Exception) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:200]


def _run(spark: SparkSession, check: Check, tables: Mapping[str, DataFrame], risky: DataFrame | None):
    """(findings, log fields) of one check; its failure is a row of the log."""
    row = {"provider": check.name, "tier": check.tier, "rows_read": 0, "rows_set_aside": 0, "findings": 0, "worst": None, "seconds": 0.0}
    started = time.monotonic()
    try:
        given = {}
        watched = []
        for i in check.inputs:
            good, bad = split_rows(tables[i.table].select(*i.columns), i.rules)
            row["rows_set_aside"] += bad.count() if i.rules else 0
            if risky is not None:
                good = good.join(risky.withColumnRenamed("asset_id", i.asset), i.asset, "left_semi")
            seen = Observation()
            # Written, so that rows are counted where they are read, and checks may read them often.
            given[i.table] = settle(good.observe(seen, F.count(F.lit(1)).alias("rows")))
            watched.append(seen)
        row["rows_read"] = sum(w.get.get("rows") or 0 for w in watched)
        seen = Observation()
        found = settle(check.run(given).select(*FINDING.fieldNames()).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.max("severity").alias("worst")))
        row |= {"status": "ran", "findings": seen.get.get("rows") or 0, "worst": seen.get.get("worst")}
        row["reason"] = "cheap checks run on every asset" if risky is None else "runs on the assets a cheap finding calls risky"
    except Exception as error:  # noqa: BLE001  whatever a check raises is its own failure
        found = spark.createDataFrame([], FINDING)
        row |= {"status": "failed", "reason": _short(error)}
    row["seconds"] = time.monotonic() - started
    return found, row


def assess(tables: Mapping[str, DataFrame], checks: Sequence[Check], assessment_id: str, threshold: float = 0.4) -> Assessment:
    """Run ``checks`` over ``tables``; the driver sees one row per check and no finding."""
    spark = next(iter(tables.values())).sparkSession
    needs = {c.name: [x for i in c.inputs for x in [i.table, *(f"{i.table}.{n}" for n in i.columns)]] for c in checks}
    ready, skipped = prepare_detectors(tables, needs)
    why = dict(skipped)
    log = [{"provider": c.name, "tier": c.tier, "status": "skipped", "reason": why[c.name], "rows_read": 0, "rows_set_aside": 0,
            "findings": 0, "worst": None, "seconds": 0.0} for c in checks if c.name in why]
    found = []
    for check in (c for c in checks if c.name in ready and c.tier == "cheap"):
        got, row = _run(spark, check, tables, None)
        found.append(got)
        log.append(row)
    risky = settle(risky_assets(union_findings(spark, found), threshold))
    fired = not risky.isEmpty()
    for check in (c for c in checks if c.name in ready and c.tier != "cheap"):
        if fired:
            got, row = _run(spark, check, tables, risky)
            found.append(got)
        else:
            row = {"provider": check.name, "tier": check.tier, "status": "skipped", "reason": f"no cheap finding exceeds {threshold}",
                   "rows_read": 0, "rows_set_aside": 0, "findings": 0, "worst": None, "seconds": 0.0}
        log.append(row)
    findings = union_findings(spark, found)
    rows = spark.createDataFrame([(assessment_id, *[r[k] for k in ("provider", "tier", "status", "reason", "rows_read", "rows_set_aside", "findings", "worst", "seconds")])
                                  for r in log], LOG)
    return Assessment(findings, decide(converge(findings)), rows, set_aside(tables, checks))


def run_coverage(log: DataFrame) -> DataFrame:
    """(assessment_id, requested, ran, skipped, failed, degraded, coverage): degraded checks ran without some of their rows."""
    is_ = lambda s: F.col("status") == s
    return log.groupBy("assessment_id").agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(is_("ran")).alias("ran"), F.count_if(is_("skipped")).alias("skipped"),
        F.count_if(is_("failed")).alias("failed"), F.count_if(is_("ran") & (F.col("rows_set_aside") > 0)).alias("degraded"),
    ).withColumn("coverage", F.col("ran") / F.col("requested"))


def run_debt(log: DataFrame) -> DataFrame:
    """(assessment_id, check, gap) for every check that did not run, or not on all rows."""
    gap = F.when(F.col("status") != "ran", F.concat("status", F.lit(": "), "reason")).when(
        F.col("rows_set_aside") > 0, F.concat(F.col("rows_set_aside").cast("string"), F.lit(" rows could not be read")))
    return log.select("assessment_id", F.col("provider").alias("check"), gap.alias("gap")).where("gap is not null")
