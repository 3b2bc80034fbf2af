"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.session import scratch

# Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z,
# that is digits, small letters and everything beyond ASCII. On UTF-8 bytes this is
# one table lookup per byte, since all bytes of other characters are above 0x7F.
WORD_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
# A-Z to a-z only; white space stays for ``bytes.split``, which splits at
# 0x20 and 0x09-0x0D as the space-separated word definition asks.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


# One object that outlives a task in its worker process (an encoder with its cache).
_KEPT: dict[Hashable, Any] = {}


def kept(key: Hashable, make: Callable[[], Any]) -> Any:
    """The worker's kept object if it has this key, else a new one in its place."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def _give_back() -> None:
    """Free pages of Arrow's pool, and of the C library where it can, go back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """``run`` for ``mapInArrow``, giving memory back: at its end what Arrow's pool and the C library hold, and at its
    start the kept object of an earlier stage, unless it ``keeps`` one itself."""
    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            _KEPT.clear()
        try:
            yield from run(batches)
        finally:
            _give_back()

    return inner


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of digits, ASCII letters and characters beyond ASCII."""
    return text.translate(WORD_BYTES).split()


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words between ASCII white space."""
    return text.translate(LOWER_BYTES).split()


def utf8(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of a string column, null as empty; no str objects are made."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under fixed names, so that extra or clashing columns play no part."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` behind as many underscores as it takes for none of them to be a column."""
    taken, front = {c.lower() for c in columns}, "_"
    while any((front + n).lower() in taken for n in names):
        front += "_"
    return [front + n for n in names]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read from there, and its path for ``forget``."""
    path = scratch(df.sparkSession, "round")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Remove a folder that ``written`` made and nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: str = "4m") -> Iterator[None]:
    """Jobs inside send at most about ``size`` of rows to Python at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, size)
    try:
        yield
    finally:
        spark.conf.set(key, before)
