"""Session settings and lineage cutting."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings the library relies on or profits from. All are public Spark options;
# a cluster submits its own values for memory, parallelism and checkpoint folder.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def local_session(cores: str = "8", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("attest")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        # Python workers do small dense products; one BLAS thread each avoids
        # running cores x cores threads.
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; only a local master may fall back."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(folder)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application.

    Workers do not share the driver's module path, on one machine or on many.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "attest_package")
    context.addPyFile(shutil.make_archive(base, "zip", root, "attest"))
    _shipped.add(context.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffled_once(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that runs inside are removed when it ends; for queries whose plans run once.

    Otherwise they stay until the driver's garbage is collected, those of all rounds beside each other.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and continue from the files.

    Used between rounds of iterative operators: the plan stays short, each round is
    computed once, and a lost executor re-reads files in place of replaying every
    earlier round. What the round shuffled is removed with it.
    """
    path = scratch(df.sparkSession, "settled")
    with shuffled_once(df.sparkSession):
        df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._settled = path
    return found


def discard(settled: DataFrame) -> None:
    """Remove the files of a settled table that nothing reads again."""
    spark = settled.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(settled._settled)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
