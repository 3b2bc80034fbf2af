"""Passports: all that is known of an asset as rows, one header with a digest over all of it, and the report text.

A passport is its header row and its body rows; no array holds the findings of an asset, so
one with a third of all findings is no larger value than any other. The digest covers every
field of every row and of the header: rows are hashed in their canonical form, and the hashes
are added up per asset in four numbers of 60 bits each, which is combined before the shuffle
and does not depend on the order. It stands where a signature would.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.functions.canonical import canonical_row, canonical_value
from attest.functions.scale import with_row
from attest.operators.behaviour import CAPABILITIES
from attest.operators.evidence import passport_findings
from attest.schemas import FINDING

VERSION = "1.0.0"
KINDS = ("dataset", "model", "pipeline")
NO_FINDINGS = "Nothing was found or looked for; that is no proof of safety."
PRECISION = "Numbers are covered to six decimals."

# The documented attack classes and the entries of a public taxonomy they are near to.
ATTACK_CLASSES = {
    "label-flip": "MITRE ATLAS: Poison Training Data",
    "near-duplicate flooding": "MITRE ATLAS: Poison Training Data",
    "OOD insertion": "MITRE ATLAS: Evade ML Model",
    "model substitution": "MITRE ATLAS: ML Supply Chain Compromise",
    "candidate backdoors": "MITRE ATLAS: Backdoor ML Model",
    "inference tampering & replay": "MITRE ATLAS: AI Model Inference API Access",
}
LIMITATIONS = (
    "A listed attack class has checks; they can miss cases and prove no absence.",
    "A candidate backdoor stays a guess, and a trigger nobody has shown stays unseen.",
    "Sampled recomputation vouches for the samples only.",
    "A replay shows only to a verifier that remembers what it has seen.",
    "Findings of one asset may share a cause that merging them does not correct for.",
)
FALLBACK = "With outputs only: compare with a trusted reference battery; checks of weights and activations are owed."


def coverage_statement(debt: DataFrame, evaluated: Sequence[str] = ()) -> DataFrame:
    """Rows ``(section, item, status)``: attack classes with their taxonomy, capabilities, the fallback,
    limitations, evaluations, and what is owed; without any debt one row says so."""
    spark = debt.sparkSession
    fixed = [("attack_class", name, f"near to {entry}; its checks may miss cases") for name, entry in ATTACK_CLASSES.items()]
    fixed += [("capability", f"{check} / {level}", status) for check, levels in CAPABILITIES.items() for level, status in levels.items()]
    fixed += [("fallback", "black_box", FALLBACK)] + [("limitation", f"{i:02d}", text) for i, text in enumerate(LIMITATIONS, 1)]
    fixed += [("evaluation", name, "reported for the data given" if name in evaluated else "not evaluated")
              for name in ("ablation", "adaptive_attacker")]
    static = spark.createDataFrame(fixed, "section string, item string, status string")
    owed = debt.select(F.lit("assurance_debt").alias("section"), F.col("check").alias("item"), F.col("gap").alias("status")).distinct()
    counted = owed.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(
        F.lit("assurance_debt").alias("section"), F.lit("none").alias("item"), F.lit("no debt is recorded").alias("status"))
    return static.unionByName(owed).unionByName(counted)


def passport_rows(verdicts: DataFrame, assets: DataFrame, manifests: DataFrame, debt: DataFrame) -> DataFrame:
    """Body rows ``(asset_id, section, ord, content)``, content being the whole row in canonical form.

    ``assets(asset_id, node_type, hash)``, ``manifests(asset_id, kind, digest, path)``,
    ``debt(asset_id, check, gap, recommendation)``; kinds are dataset, model and pipeline.
    """
    body = passport_findings(verdicts)
    names = [*FINDING.fieldNames(), "verdict", "warning", "reason", "disposition"]
    checked = manifests.withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise(
        F.raise_error(F.concat(F.lit("unknown kind of manifest: "), F.coalesce("kind", F.lit("null")))).cast("string")))
    part = lambda df, section, order, columns: df.select(
        "asset_id", F.lit(section).alias("section"), order.alias("ord"), canonical_row(df.schema, columns).alias("content"))
    none = F.lit(0).cast("bigint")
    return reduce(DataFrame.unionByName, [
        part(body, "finding", F.col("ord"), names),
        part(assets, "asset", none, ["asset_id", "node_type", "hash"]),
        part(checked, "manifest", none, ["asset_id", "kind", "digest", "path"]),
        part(debt, "debt", none, ["asset_id", "check", "gap", "recommendation"]),
    ])


def _sums(content: Column) -> list[Column]:
    """Four sums over 60 bits each of the row hashes, as text."""
    row = F.sha2(content, 256)
    return [F.coalesce(F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string"), F.lit("0")).alias(f"_h{i}")
            for i in range(4)]


def _joined_sums() -> Column:
    return F.concat_ws(":", *[F.coalesce(f"_h{i}", F.lit("0")) for i in range(4)])


HEADER = ("asset_id", "node_type", "hash", "version", "issued_at", "findings", "quarantine", "review", "accept", "manifests", "debts",
          "access_used", "limitations", "coverage_digest")


def passport_headers(verdicts: DataFrame, rows: DataFrame, assets: DataFrame, statement: DataFrame, issued_at: Column) -> DataFrame:
    """One row per asset with ``digest`` over itself and the body rows; an asset without findings has one as well."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    judged = verdicts.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("findings"), count("QUARANTINE").alias("quarantine"), count("REVIEW").alias("review"),
        count("ACCEPT").alias("accept"), F.array_sort(F.collect_set("access_assumptions")).alias("access_used"))
    held = rows.groupBy("asset_id").agg(
        F.count_if(F.col("section") == "manifest").alias("manifests"), F.count_if(F.col("section") == "debt").alias("debts"),
        *_sums(F.concat("section", F.lit(":"), F.col("content"))))
    covered = statement.agg(*_sums(canonical_row(statement.schema))).select(F.sha2(_joined_sums(), 256).alias("coverage_digest"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    notes = F.concat(F.array(*[F.lit(x) for x in LIMITATIONS]), F.when(F.coalesce("findings", F.lit(0)) == 0, F.array(F.lit(NO_FINDINGS))).otherwise(
        F.array().cast("array<string>")), F.array(F.lit(PRECISION)))
    joined = with_row(assets.select("asset_id", "node_type", "hash").join(judged, "asset_id", "left").join(held, "asset_id", "left"), covered)
    heads = joined.select(
        "asset_id", "node_type", "hash", F.lit(VERSION).alias("version"), issued_at.alias("issued_at"),
        *[zero(c) for c in ("findings", "quarantine", "review", "accept", "manifests", "debts")],
        F.coalesce("access_used", F.array().cast("array<string>")).alias("access_used"), notes.alias("limitations"), "coverage_digest",
        _joined_sums().alias("_rows"))
    return heads.withColumn("digest", _digest(heads)).drop("_rows")


def _digest(heads: DataFrame) -> Column:
    kinds = {f.name: f.dataType for f in heads.schema.fields}
    fields = [canonical_value(F.col(c), kinds[c]) for c in HEADER]
    return F.sha2(F.concat_ws("\n", "_rows", *fields), 256)


def verify_passports(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """``(asset_id, valid)``: whether the digest is that of the header's fields and the rows now given."""
    held = rows.groupBy("asset_id").agg(*_sums(F.concat("section", F.lit(":"), F.col("content"))))
    again = headers.join(held, "asset_id", "left").withColumn("_rows", _joined_sums())
    return again.select("asset_id", (F.col("digest") == _digest(again)).alias("valid"))


def _clean(value: Column) -> Column:
    """Markup and Markdown signs as plain text."""
    safe = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.regexp_replace(safe, r"([\\`*_{}\[\]()#+\-.!|])", r"\\$1"), F.lit("\n"), F.lit("<br>"))


def passport_lines(headers: DataFrame, verdicts: DataFrame, manifests: DataFrame, debt: DataFrame) -> DataFrame:
    """Markdown lines ``(asset_id, section, ord, part, line)``; written sorted by the first four, never collected."""
    text = lambda title, value: F.concat(F.lit(title), _clean(value))
    counts = F.concat(*[x for name in ("quarantine", "review", "accept") for x in (F.lit(f"{name} "), F.col(name).cast("string"), F.lit(", "))],
                      F.lit("findings "), F.col("findings").cast("string"))

    def lines(df: DataFrame, section: int, order: Column, parts: Column) -> DataFrame:
        return df.select("asset_id", F.lit(section).alias("section"), order.cast("bigint").alias("ord"), F.posexplode(parts).alias("part", "line"))

    zero = F.lit(0)
    bullets = lambda c: F.transform(c, lambda x: F.concat(F.lit("- "), _clean(x)))
    head = lines(headers, 0, zero, F.array(
        F.lit("# Passport"), text("Asset: ", F.col("asset_id")), text("Type: ", F.coalesce("node_type", F.lit("unknown"))),
        text("Hash: ", F.coalesce("hash", F.lit("none"))), text("Version: ", F.col("version")),
        text("Issued: ", F.date_format("issued_at", "yyyy-MM-dd HH:mm:ss")), counts))
    body = lines(passport_findings(verdicts), 1, F.col("ord"), F.concat(
        F.array(F.concat(F.lit("### "), _clean(F.col("finding_type"))), F.concat(F.lit("Disposition: "), F.col("disposition")), F.lit("Evidence:")),
        bullets(F.col("evidence")), F.array(F.lit("Counter-evidence:")), bullets(F.col("counter_evidence")),
        F.array(text("Modality: ", F.col("modality")), text("Access: ", F.col("access_assumptions")))))
    empty = lines(headers.where("findings = 0"), 1, zero, F.array(F.lit(NO_FINDINGS)))
    bound = lines(manifests, 2, F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")), F.array(
        F.concat(F.lit("- "), F.col("kind"), F.lit(" manifest "), _clean(F.col("digest")), F.coalesce(F.concat(F.lit(" of "), _clean(F.col("path"))), F.lit("")))))
    owed = lines(debt, 3, F.xxhash64("check", "gap"), F.array(F.concat(F.lit("- "), _clean(F.col("recommendation")))))
    limits = lines(headers, 4, zero, bullets(F.col("limitations")))
    foot = lines(headers, 5, zero, F.array(F.concat(F.lit("Coverage statement: "), F.col("coverage_digest")), F.concat(F.lit("Digest: "), F.col("digest"))))
    return reduce(DataFrame.unionByName, [head, body, empty, bound, owed, limits, foot])
