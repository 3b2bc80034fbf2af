"""Readers of data-set trees and logs. Schemas are explicit, nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.session import settle

IMAGE_SUFFIXES = ["jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff"]

COCO_SCHEMA = """
    contributor_id string, batch_id string, dataset_version string, version string,
    images array<struct<id: string, file_name: string, width: double, height: double,
                        contributor_id: string, batch_id: string>>,
    annotations array<struct<id: string, image_id: string, category_id: string, bbox: array<double>>>,
    categories array<struct<id: string, name: string>>
"""

AUDIT_SCHEMA = "timestamp timestamp, operation string, details map<string,string>, operator string"


def _plain(root: str) -> str:
    return root.rstrip("/").removeprefix("file://")


def relative_path(root: str, full: Column) -> Column:
    """The part of a file URI below ``root``."""
    decoded = F.try_url_decode(F.replace(full, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.coalesce(decoded, full), "^.*?" + _quote(_plain(root)) + "/", "")


def _quote(text: str) -> str:
    return "\\Q" + text + "\\E"


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """``(path, sha256, bytes)`` of every file below ``root``; one task per group of files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select(
        relative_path(root, F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes")
    )


def read_coco(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Documents, images, annotations and categories of one or many annotation files, and the
    ``broken(document_id, batch_id, reason, characters)`` files: no JSON, or JSON of another form; the batch
    is there as far as it could be read."""
    raw = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("document_id"), "value")
    parsed = F.from_json("value", COCO_SCHEMA + ", _raw string", {"columnNameOfCorruptRecord": "_raw"})
    # Settled: five tables come from a document, which is parsed once.
    read = settle(raw.withColumn("d", parsed).select(
        "document_id", "d.*", F.length("value").alias("characters"), F.get_json_object("value", "$").isNull().alias("no_json")))
    bad = F.col("_raw").isNotNull() | F.col("no_json")
    reason = F.when(F.col("no_json"), "the file is no JSON").otherwise("the file's fields have other types than an annotation document's")
    broken = read.where(bad).select("document_id", "batch_id", reason.alias("reason"), "characters")
    docs = read.where(~bad).drop("_raw", "characters", "no_json")
    head = docs.select(
        "document_id", "contributor_id", "batch_id",
        F.coalesce("dataset_version", "version", F.lit("1")).alias("dataset_version"),
    )
    return {
        "documents": head,
        "images": docs.select("document_id", F.inline("images")),
        "annotations": docs.select("document_id", F.inline("annotations")),
        "categories": docs.select("document_id", F.inline("categories")),
        "broken": broken,
    }


def resolve_images(images: DataFrame, inventory: DataFrame) -> DataFrame:
    """Adds ``path`` and ``candidates``: the file itself or the one below images/.

    Exactly one candidate is right; none or two is a violation.
    """
    options = images.select("id", "file_name", F.explode(F.array(
        F.col("file_name"), F.concat(F.lit("images/"), F.col("file_name"))
    )).alias("path"))
    there = options.join(inventory.select("path"), "path", "left_semi").groupBy("id").agg(
        F.count(F.lit(1)).alias("candidates"), F.min("path").alias("path")
    )
    return images.join(there, "id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("bigint")))


def read_yolo(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Label rows with line numbers, images, label files, classes and metadata of a tree."""
    root = _plain(root)
    found = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(f"{root}/labels", wholetext=True)
    labels = found.select(relative_path(root, F.col("_metadata.file_path")).alias("label_path"), F.col("value"))
    lines = labels.select("label_path", F.posexplode(F.split("value", "\\r?\\n")).alias("line", "text")) \
        .withColumn("line", F.col("line") + 1)
    # Scans skip empty files, but an empty label file is a valid one: take the names
    # from the file index that the scan keeps on the driver anyway.
    listed = spark.createDataFrame([(f,) for f in found.inputFiles()], "file string").select(
        relative_path(root, F.col("file")).alias("label_path"))
    names = spark.read.text(f"{root}/classes.txt", wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", "(^\\uFEFF)|(\\r?\\n$)", ""), "\\r?\\n")).alias("class_id", "name")
    ).select(F.col("class_id").cast("bigint").alias("class_id"), F.trim("name").alias("name"))
    images = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/images")
        .select(relative_path(root, F.col("path")).alias("path"))
        .where(F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).isin(IMAGE_SUFFIXES))
    )
    schema = ("contributor_id string, batch_id string, dataset_version string, "
              "samples map<string, struct<contributor_id: string, batch_id: string>>")
    metadata = (
        spark.read.schema(schema).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metadata.json").json(root)
        .where(relative_path(root, F.col("_metadata.file_path")) == "metadata.json")
    )
    samples = metadata.select(F.explode("samples").alias("path", "m")).select("path", "m.contributor_id", "m.batch_id")
    return {
        "rows": lines, "images": images, "label_files": listed, "classes": names,
        "document": metadata.select("contributor_id", "batch_id", F.coalesce("dataset_version", F.lit("1")).alias("dataset_version")),
        "metadata": samples,
    }


def read_audit_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Audit entries; lines that do not parse keep a null operation."""
    return spark.read.schema(AUDIT_SCHEMA).json(path)
