"""Dataset tables: annotation checks, inventories, digests, manifests, registries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions import vectors as V
from attest.functions.canonical import canonical_row, digest
from attest.functions.paths import is_unsafe_path
from attest.functions.scale import with_row
from attest.operators.merkle import leaf_hash, merkle_root, single_tree
from attest.schemas import as_findings


def _violations(parts: list[tuple[DataFrame, str, Column]]) -> DataFrame:
    """Union of ``(violation, subject)`` rows."""
    rows = [df.select(F.lit(name).alias("violation"), subject.cast("string").alias("subject")) for df, name, subject in parts]
    return reduce(lambda a, b: a.unionByName(b), rows)


def _row_checks(df: DataFrame, subject: Column, checks: dict[str, Column]) -> DataFrame:
    """Several row-local rules in one pass over ``df``."""
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in checks.items()]))
    return df.select(F.explode(named).alias("violation"), subject.cast("string").alias("subject"))


def _repeated(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")


def _not_identifier(c: str) -> Column:
    return F.col(c).isNull() | ~F.col(c).cast("string").rlike("^[0-9]+$")


def coco_violations(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Every broken rule of a COCO-style data set as ``(violation, subject)``.

    ``images(id, file_name)``, ``annotations(id, image_id, category_id, bbox)``,
    ``categories(id, name)``. A null bbox is allowed, a wrong one is not.
    """
    box = F.col("bbox")
    malformed = (F.size(box) != 4) | F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    negative = (F.size(box) == 4) & ((F.get(box, 2) < 0) | (F.get(box, 3) < 0))
    return _violations([
        (_repeated(images, "id"), "duplicate_image_id", F.col("id")),
        (_repeated(annotations, "id"), "duplicate_annotation_id", F.col("id")),
        (_repeated(categories, "id"), "duplicate_category_id", F.col("id")),
        (_repeated(images, "file_name"), "duplicate_image_path", F.col("file_name")),
        (categories.where(F.coalesce("name", F.lit("")) == ""), "empty_category_name", F.col("id")),
        (images.where(_not_identifier("id")), "invalid_image_id", F.col("id")),
        (categories.where(_not_identifier("id")), "invalid_category_id", F.col("id")),
        (annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti"), "unknown_image", F.col("id")),
        (annotations.join(categories.select(F.col("id").alias("category_id")), "category_id", "left_anti"),
         "unknown_category", F.col("id")),
        (images.where(is_unsafe_path(F.col("file_name"))), "unsafe_path", F.col("file_name")),
    ]).unionByName(_row_checks(annotations, F.col("id"), {
        "invalid_annotation_id": _not_identifier("id"),
        "malformed_bbox": box.isNotNull() & malformed,
        "negative_bbox": box.isNotNull() & ~malformed & negative,
    }))


def label_path_of(image_path: Column) -> Column:
    """``images/x/y.png`` -> ``labels/x/y.txt``."""
    return F.regexp_replace(F.regexp_replace(image_path, "^images/", "labels/"), "\\.[^./]*$", ".txt")


def yolo_violations(rows: DataFrame, images: DataFrame, label_files: DataFrame, classes: DataFrame,
                    metadata: DataFrame) -> DataFrame:
    """Every broken rule of a YOLO-style data set as ``(violation, subject)``.

    ``rows(label_path, line, text)``, ``images(path)``, ``label_files(label_path)``,
    ``classes(class_id, name)``, ``metadata(path)``.
    """
    tokens = F.split(F.trim(F.regexp_replace("text", "[ \\t]+", " ")), " ")
    parsed = rows.where(F.trim("text") != "").select(
        F.concat("label_path", F.lit(":"), F.col("line").cast("string")).alias("at"), tokens.alias("t"),
    ).select(
        "at", ((F.size("t") == 5) & F.coalesce(F.get("t", 0).rlike("^[0-9]+$"), F.lit(False))).alias("shaped"),
        F.get("t", 0).try_cast("bigint").alias("class_id"),
        F.transform(F.slice("t", 2, 4), lambda v: v.try_cast("double")).alias("c"),
    ).join(classes.select("class_id").distinct().withColumn("known", F.lit(True)), "class_id", "left")
    outside = F.exists("c", lambda v: v.isNull() | F.isnan(v) | (v < 0) | (v > 1))
    labelled = images.withColumn("label_path", label_path_of(F.col("path")))
    return _violations([
        (_repeated(labelled, "label_path"), "shared_label_file", F.col("label_path")),
        (labelled.join(label_files, "label_path", "left_anti"), "missing_label_file", F.col("path")),
        (label_files.join(labelled, "label_path", "left_anti"), "orphan_label_file", F.col("label_path")),
        (metadata.join(images, "path", "left_anti"), "unknown_metadata", F.col("path")),
        (classes.where(F.trim(F.coalesce("name", F.lit(""))) == ""), "blank_class", F.col("class_id")),
        (_repeated(classes, "name"), "duplicate_class", F.col("name")),
    ]).unionByName(_row_checks(parsed, F.col("at"), {
        "invalid_row": ~F.col("shaped"),
        "unknown_class": F.col("shaped") & F.col("known").isNull(),
        "coordinate_out_of_range": F.col("shaped") & outside,
        "empty_box": F.col("shaped") & ~outside & ((F.get("c", 2) <= 0) | (F.get("c", 3) <= 0)),
    }))


def class_distribution(classes: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """Annotations per class; classes without any count zero."""
    counted = annotations.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return classes.join(counted, key, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))


def sample_metadata(samples: DataFrame, documents: DataFrame, contributor: str | None = None,
                    batch: str | None = None) -> DataFrame:
    """Contributor and batch of a sample: its own, else its document's, else the build option."""
    parent = documents.select(
        "document_id", F.col("contributor_id").alias("d_contributor"), F.col("batch_id").alias("d_batch")
    )
    return samples.join(parent, "document_id", "left").select(
        "sample_id",
        F.coalesce("contributor_id", "d_contributor", F.lit(contributor)).alias("contributor_id"),
        F.coalesce("batch_id", "d_batch", F.lit(batch)).alias("batch_id"),
    )


def unsafe_paths(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(is_unsafe_path(F.col(path)))


def canonical_digest(rows: DataFrame, columns: list[str] | None = None, name: str = "digest") -> DataFrame:
    return rows.withColumn(name, digest(canonical_row(rows.schema, columns)))


def dense_positions(rows: DataFrame, key: str) -> DataFrame:
    """``idx`` from 0 in the order of a distinct, uniformly spread hex ``key``.

    The first four hex digits split the keys into 65536 even slots; slot counts
    give offsets, and ranking only happens inside a slot.
    """
    slotted = rows.withColumn("_slot", F.substring(key, 1, 4))
    counts = slotted.groupBy("_slot").agg(F.count(F.lit(1)).alias("_c"))
    order = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)  # 65536 rows at most
    offsets = counts.select("_slot", F.coalesce(F.sum("_c").over(order), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(Window.partitionBy("_slot").orderBy(key)) - 1
    return slotted.join(F.broadcast(offsets), "_slot").withColumn("idx", F.col("_offset") + rank).drop("_slot", "_offset")


def table_digest(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Digest of a whole table, whatever the row order: ``(digest, distinct_rows, total_rows)``.

    Equal rows are counted, distinct row digests with their counts become the sorted
    leaves of a Merkle tree, and its root is the digest.
    """
    counted = canonical_digest(rows, columns, "_d").groupBy("_d").agg(F.count(F.lit(1)).alias("copies"))
    leaves = dense_positions(counted, "_d").select(
        single_tree("table", F.col("_d")).alias("tree"), "idx",
        leaf_hash(F.concat("_d", F.lit(":"), F.col("copies").cast("string"))).alias("hash"),
    )
    total = rows.agg(F.count(F.lit(1)).alias("total_rows"))
    return with_row(
        merkle_root(leaves).select(F.col("root").alias("digest"), F.col("leaves").alias("distinct_rows")), total
    )


def manifest_build(files: DataFrame, dataset_id: str) -> DataFrame:
    """``files(path, sha256, contributor_id, batch_id)`` -> the long manifest table."""
    return files.select(F.lit(dataset_id).alias("dataset_id"), "path", "sha256", "contributor_id", "batch_id")


def manifest_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """``(path, status)`` with status missing, added or changed; no row means the same.

    A changed contributor or batch counts as a change, as a changed file does.
    """
    old = baseline.select("path", F.struct("sha256", "contributor_id", "batch_id").alias("old"))
    new = current.select("path", F.struct("sha256", "contributor_id", "batch_id").alias("new"))
    status = (
        F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added")
        .when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    )
    return old.join(new, "path", "full_outer").select("path", status.alias("status")).where(F.col("status").isNotNull())


def manifest_verify(baseline: DataFrame, current: DataFrame) -> DataFrame:
    return manifest_diff(baseline, current).agg(F.count(F.lit(1)).alias("differences")).withColumn(
        "verified", F.col("differences") == 0
    )


def artifact_identity(reference: DataFrame, supplied: DataFrame) -> DataFrame:
    """``(artifact_id, status, severity, confidence, action)``; missing supply is unverified."""
    given = supplied.select("artifact_id", F.col("digest").alias("_given"), F.lit(True).alias("_there"))
    joined = reference.join(given, "artifact_id", "left")
    status = (
        F.when(F.col("_there").isNull() | F.col("_given").isNull(), "unverified")
        .when(F.col("digest") == F.col("_given"), "match").otherwise("mismatch")
    )
    return joined.select("artifact_id", "digest", status.alias("status")).select(
        "artifact_id", "digest", "status",
        F.when(F.col("status") == "mismatch", 1.0).otherwise(0.0).alias("severity"),
        F.when(F.col("status") == "unverified", 0.0).otherwise(1.0).alias("confidence"),
        F.when(F.col("status") == "match", "accept").when(F.col("status") == "mismatch", "quarantine")
        .otherwise("review").alias("action"),
    )


def artifact_findings(identity: DataFrame) -> DataFrame:
    return as_findings(
        identity,
        asset_id=F.col("artifact_id"),
        finding_type=F.concat(F.lit("model_identity_"), F.col("status")),
        severity=F.col("severity"),
        confidence=F.col("confidence"),
        modality="ANNOTATION",
        detector_id="model_identity",
        evidence=[F.concat(F.lit("Digest comparison: "), F.col("status"))],
        counter_evidence=["A matching digest does not show that the reference itself is benign."],
        action=F.col("action"),
        scope="model",
        input_hashes=F.array("digest"),
    )


def registry_page(assets: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of assets in id order."""
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("offset must be >= 0 and limit in 1..200")
    return assets.orderBy("id").offset(offset).limit(limit)


def duplicate_asset_ids(assets: DataFrame) -> DataFrame:
    return _repeated(assets, "id").select("id", F.col("_n").alias("copies"))


def validate_samples(rows: DataFrame, ident: str, vec: str, label: str, num_classes: int | None = None) -> DataFrame:
    """One row of violation counts over a sample table."""
    ids = rows.groupBy(ident).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum((F.col("_n") > 1).cast("bigint")), F.lit(0)).alias("duplicate_ids")
    )
    lengths = rows.groupBy(F.size(vec).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    ragged = lengths.agg((F.coalesce(F.sum("_n"), F.lit(0)) - F.coalesce(F.max("_n"), F.lit(0))).alias("ragged_rows"))
    classes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum(F.when(F.col(label).isNull(), F.col("_n"))), F.lit(0)).alias("missing_labels"),
        F.count(label).alias("classes"),
    )
    bad = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(V.invalid_vector(F.col(vec).cast("array<double>")).cast("bigint")), F.lit(0)).alias("invalid_vectors"),
    )
    out = with_row(with_row(with_row(bad, ids), ragged), classes)
    limit = F.lit(num_classes) if num_classes is not None else F.col("classes")
    ok = (
        (F.col("invalid_vectors") + F.col("duplicate_ids") + F.col("ragged_rows") + F.col("missing_labels") == 0)
        & (F.col("classes") <= limit)
    )
    return out.withColumn("valid", ok)


def require_valid(rows: DataFrame, vec: str) -> DataFrame:
    """Strict mode: the job fails on the first invalid vector."""
    bad = V.invalid_vector(F.col(vec).cast("array<double>"))
    return rows.withColumn(vec, F.when(bad, F.raise_error(F.lit("invalid feature vector")).cast(rows.schema[vec].dataType))
                           .otherwise(F.col(vec)))


def audit_counts(audit: DataFrame) -> DataFrame:
    """Rows per operation and operator with subtotals."""
    return audit.rollup("operation", "operator").agg(F.count(F.lit(1)).alias("entries"))
