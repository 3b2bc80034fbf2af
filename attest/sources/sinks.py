"""Writers. Every write replaces exactly the assessment it belongs to, so a retry is safe.

``publish`` writes several tables as one release: each goes to a folder of its own that no
reader looks at, and a release is there once its manifest is, a small file created last
under the next number. Readers follow the highest complete manifest. A failed write leaves
no manifest, so the release before stays what is read, and its folder is removed. Of two
writers with the same number one fails at creating the file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attest.session import shuffled_once

# Writer options for scratch trees of very many small files. Tasks move their own files in place of the driver moving
# all of them one by one; on a local file system no checksum file is written beside each, whose modes are set by
# three more processes a file.
MANY_FILES = {
    "mapreduce.fileoutputcommitter.algorithm.version": "2",
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}


def _arrow_files(root: str) -> tuple[pyarrow.fs.FileSystem, str] | None:
    """Arrow's file system of a folder, and the folder's path in it; None where Arrow has none for the scheme."""
    scheme, colon, rest = root.partition(":")
    if not colon or "/" in scheme or scheme == "file":
        path = rest if scheme == "file" and colon else root
        return pyarrow.fs.LocalFileSystem(), "/" + path.lstrip("/") if path.startswith("/") else path
    try:
        return pyarrow.fs.FileSystem.from_uri(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None


def write_tree(df: DataFrame, root: str, folders: list[str], value: str) -> None:
    """One text file for each row in a folder of its own, ``column=number/`` by ``folders``, as Spark's text writer makes them.

    Tasks write through Arrow: Spark's writer opens, moves and sets the modes of each file on its own, on a local file
    system with more processes than files. A file's name and content follow from its row, so a task that runs
    again replaces what it left. Spark's writer does it where Arrow does not know the file system.
    """
    if _arrow_files(root) is None:
        df.select(*folders, value).write.options(**MANY_FILES).partitionBy(*folders).text(root)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = _arrow_files(root)
        for batch in batches:
            for place, text in zip(batch.column("place").to_pylist(), batch.column("text")):
                system.create_dir(f"{top}/{place}", recursive=True)
                with system.open_output_stream(f"{top}/{place}/part-00000.txt") as out:
                    if text.is_valid:
                        out.write(text.as_buffer())
                    out.write(b"\n")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    place = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in folders])
    rows = df.select(place.alias("place"), F.col(value).alias("text"))
    rows.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


def write_partitioned(df: DataFrame, path: str, key: str = "assessment_id", fmt: str = "parquet") -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).format(fmt).save(path)
    )


def write_findings(findings: DataFrame, path: str, fmt: str = "parquet") -> None:
    keyed = findings.withColumn("assessment_id", F.coalesce(F.col("provenance.attrs")["assessment_id"], F.lit("none")))
    write_partitioned(keyed, path, "assessment_id", fmt)


def write_passports(headers: DataFrame, body: DataFrame, path: str) -> None:
    """Header and finding rows as JSON lines in two folders; joined by asset_id when read."""
    headers.write.mode("overwrite").json(f"{path}/headers")
    body.write.mode("overwrite").json(f"{path}/findings")


def write_passport_text(lines: DataFrame, path: str) -> None:
    """Markdown text, each asset's lines in order inside one range partition."""
    ordered = lines.repartitionByRange("asset_id", "section", "ord").sortWithinPartitions("asset_id", "section", "ord")
    ordered.select("line").write.mode("overwrite").text(path)


def write_lineage(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def _files(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the class of its paths."""
    kind = spark._jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark._jsc.hadoopConfiguration()), kind


def _manifests(spark: SparkSession, path: str) -> list[str]:
    """Paths of manifests, the newest first; one for each release that is kept."""
    files, kind = _files(spark, path)
    folder = kind(f"{path}/_manifests")
    if not files.exists(folder):
        return []
    names = [f.getPath().getName() for f in files.listStatus(folder)]
    return [f"{path}/_manifests/{n}" for n in sorted(names, reverse=True) if n.endswith(".json") and not n.startswith((".", "_"))]


def _load(spark: SparkSession, manifest: str) -> dict | None:
    """A manifest's content; None for one whose writer stopped in the middle."""
    files, kind = _files(spark, manifest)
    stream = files.open(kind(manifest))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def publish(tables: Mapping[str, DataFrame], path: str, formats: Mapping[str, str] | None = None) -> dict:
    """Write all tables as the next release below ``path`` and return its manifest.

    ``formats`` names another format than parquet for a table (``json``, or ``text`` for one string column).
    Rows are counted while they are written and stand in the manifest.
    """
    if not tables:
        raise ValueError("a release needs a table")
    spark = next(iter(tables.values())).sparkSession
    files, kind = _files(spark, path)
    folder = f"{path}/release-{uuid.uuid4().hex}"
    manifest: dict = {"folder": folder.rsplit("/", 1)[1], "tables": {}}
    before = _manifests(spark, path)
    number = int(before[0].rsplit("/", 1)[1].removesuffix(".json")) + 1 if before else 1
    try:
        for name, df in tables.items():
            counted, how = Observation(), (formats or {}).get(name, "parquet")
            with shuffled_once(spark):
                df.observe(counted, F.count(F.lit(1)).alias("rows")).write.format(how).save(f"{folder}/{name}")
            manifest["tables"][name] = {"format": how, "rows": counted.get["rows"], "schema": df.schema.jsonValue()}
        stream = files.create(kind(f"{path}/_manifests/{number:012d}.json"), False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
    except Exception:
        files.delete(kind(folder), True)
        raise
    return manifest


def published(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of the newest complete release; none without one."""
    for place in _manifests(spark, path):
        found = _load(spark, place)
        if found is not None:
            return {
                name: spark.read.schema(StructType.fromJson(t["schema"])).format(t["format"]).load(f"{path}/{found['folder']}/{name}")
                for name, t in found["tables"].items()
            }
    return {}


def retire(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all complete releases but the newest ``keep``, manifests first; returns their folders."""
    if keep < 1:
        raise ValueError("keep at least the newest release")
    files, kind = _files(spark, path)
    complete = [(m, found) for m in _manifests(spark, path) if (found := _load(spark, m)) is not None]
    gone = []
    for place, found in complete[keep:]:
        files.delete(kind(place), False)
        files.delete(kind(f"{path}/{found['folder']}"), True)
        gone.append(found["folder"])
    return gone
