"""Exact deduplication as a Grace hash join of the table with itself.

1. Each input task collapses equal texts in an open-addressing table that compares the
   complete content, and empties it whenever it holds TASK_BYTES. It writes group rows
   (one text per group) and small member rows to spill files in the shared folder, so a
   hot text leaves a task once per filling, not once per row.
2. Group rows are partitioned into buckets by hash. Distinct content per bucket is
   measured on hashes and lengths alone; buckets beyond the bound are written to new
   spill files and partitioned again by the next hash, until all fit.
3. Each bucket passes through one table; every group learns its final group. Member rows
   find theirs by group number, which no key can make hot: a group is local to one task.

Defined results: null counts as the empty text; the row with the largest doc_id stays
(null ids rank lowest); of equal rows with that id exactly one has kept = true; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.llm.common import only, tidy
from attest.session import settle

TASK_BYTES = 24 << 20  # content held by one input task before it writes its groups
BUCKET_BYTES = 48 << 20  # distinct content a bucket may hold
TASK_ROWS_BYTES = 128 << 20  # group rows sent to one task, on average
ROWS = 100_000  # group rows of a bucket, on average at most
_NO_ID = -(1 << 63)


class ContentTable:
    """Open addressing over 64-bit hashes; equal hashes are told apart by complete content."""

    def __init__(self, slots: int = 1 << 10):
        self.slots = np.full(slots, -1, np.int64)
        self.hashes: list[int] = []
        self.content: list[bytes] = []
        self.held = 0

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, np.int64)
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def find_or_add(self, h: int, content: bytes) -> tuple[int, bool]:
        """Number of the entry with this content, and whether it is new."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.hashes[entry] == h and self.content[entry] == content:
                return entry, False
            at = (at + 1) & mask
        entry = len(self.hashes)
        self.slots[at] = entry
        self.hashes.append(h)
        self.content.append(content)
        self.held += len(content)
        if 2 * len(self.hashes) > len(self.slots):
            self._grow()
        return entry, True


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _spill_schema(payload: list[T.StructField]) -> T.StructType:
    longs = [T.StructField(n, T.LongType()) for n in ("gid", "id", "row", "h", "n", "size")]
    return T.StructType([T.StructField("is_group", T.BooleanType()), *longs, T.StructField("text", T.StringType()), *payload])


def _collapse(payload: list[T.StructField], task_bytes: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = _spill_schema(payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        base = TaskContext.get().partitionId() << 33
        row = gid = base

        def flush(table: ContentTable, members: list, groups: list) -> Iterator[pa.RecordBatch]:
            if not members:
                return
            yield pa.RecordBatch.from_pylist(
                [{"is_group": False, "gid": g, "id": i, "row": r} for g, i, r in members], schema=arrow)
            rows = [{"is_group": True, "gid": g, "id": i, "row": r, "h": _signed(h), "n": n, "size": len(text),
                     "text": text.decode(), **extra}
                    for (g, i, r, n, extra), h, text in zip(groups, table.hashes, table.content, strict=True)]
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist(rows[at:at + 1024], schema=arrow)

        table, members, groups = ContentTable(), [], []
        for batch in batches:
            ids = batch.column(0).to_pylist()
            extras = batch.select(list(range(2, batch.num_columns))).to_pylist() if payload else None
            for at, value in enumerate(batch.column(1)):
                text = (value.as_py() or "").encode()
                entry, new = table.find_or_add(xxhash.xxh3_64_intdigest(text), text)
                extra = extras[at] if payload else {}
                if new:
                    groups.append([gid, ids[at], row, 1, extra])
                    gid += 1
                else:
                    g = groups[entry]
                    g[3] += 1
                    if ids[at] is not None and (g[1] is None or ids[at] > g[1]):
                        g[1], g[2], g[4] = ids[at], row, extra
                members.append((groups[entry][0], ids[at], row))
                row += 1
                if table.held > task_bytes or len(members) > 200_000:
                    yield from flush(table, members, groups)
                    table, members, groups = ContentTable(), [], []
        yield from flush(table, members, groups)

    return run, schema


def spill(docs: DataFrame, key: str, text: str, payload: list[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Step 1: group rows and member rows, written to the shared folder."""
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("_k"), F.col(f"`{text}`").alias("_t"),
                       *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(payload)])
    fields = [T.StructField(f.name, f.dataType, True) for f in base.schema.fields[2:]]
    run, schema = _collapse(fields, task_bytes)
    return settle(base.mapInArrow(tidy(run), schema))


def _bucket(level: int, fan: int):
    return F.pmod(F.xxhash64("h", F.lit(level)), F.lit(fan)).cast("int")


def _merge_bucket(groups: DataFrame, n_partitions: int, rows_too: list[T.StructField] | None) -> DataFrame:
    """Step 3 on rows with a column ``bucket``: the final group of every group row, or the rows that stay."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if rows_too is None:
        out = T.StructType([T.StructField("gid", T.LongType()), T.StructField("keep_id", T.LongType()),
                            T.StructField("keep_row", T.LongType()), T.StructField("n", T.LongType()),
                            T.StructField("sha", T.StringType())])
    else:
        out = T.StructType([T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), *rows_too])
    names = ["bucket", "gid", "id", "row", "n", "h", "text", *[f.name for f in rows_too or []]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)

        def finish(table: ContentTable, finals: list, gids: list) -> Iterator[pa.RecordBatch]:
            if rows_too is None:
                rows = [{"gid": g, "keep_id": None if f[0] == _NO_ID else f[0], "keep_row": f[1], "n": f[2],
                         "sha": hashlib.sha256(text).hexdigest()}
                        for f, gs, text in zip(finals, gids, table.content, strict=True) for g in gs]
            else:
                rows = [{"id": None if f[0] == _NO_ID else f[0], "text": text.decode(), **f[3]}
                        for f, text in zip(finals, table.content, strict=True)]
            for at in range(0, len(rows), 2048):
                yield pa.RecordBatch.from_pylist(rows[at:at + 2048], schema=arrow)

        table, finals, gids, current = ContentTable(), [], [], None
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            extras = batch.select(list(range(7, batch.num_columns))).to_pylist() if rows_too else None
            for at, value in enumerate(batch.column(6)):
                bucket, gid, key, row, n, h = (c[at] for c in cols)
                if bucket != current:
                    yield from finish(table, finals, gids)
                    table, finals, gids, current = ContentTable(), [], [], bucket
                entry, new = table.find_or_add(h & ((1 << 64) - 1), value.as_py().encode())
                key = _NO_ID if key is None else key
                extra = extras[at] if rows_too else None
                if new:
                    finals.append([key, row, n, extra])
                    gids.append([gid])
                else:
                    f = finals[entry]
                    f[2] += n
                    gids[entry].append(gid)
                    if (key, -row) > (f[0], -f[1]):
                        f[0], f[1], f[3] = key, row, extra
        yield from finish(table, finals, gids)

    dealt = groups.select(*names).repartition(n_partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(run), out)


def merge(spilled: DataFrame, rows_too: list[T.StructField] | None = None, bucket_bytes: int = BUCKET_BYTES,
          load: float = 2.0, max_levels: int = 64) -> DataFrame:
    """Steps 2 and 3. Buckets over the bound go to new spill files and the next hash.

    Buckets are 1 / load full on average; at the default, chance alone seldom overfills one.
    """
    pending = spilled.where("is_group")
    done = []
    for level in range(max_levels):
        total = pending.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
        fan = max(2, math.ceil(load * total[0] / bucket_bytes), total[1] // ROWS)
        dealt = pending.withColumn("bucket", _bucket(level, fan))
        per_text = dealt.groupBy("bucket", "h").agg(F.max("size").alias("size"))
        held = per_text.groupBy("bucket").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("texts"))
        # A single text is held once however often it comes, so it always fits.
        over = held.where((F.col("bytes") > bucket_bytes) & (F.col("texts") > 1)).select("bucket")
        # Buckets pass one after the other, so a task may take several.
        width = max(total[0] // TASK_ROWS_BYTES, int(spilled.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        if over.isEmpty():
            done.append(_merge_bucket(dealt, width, rows_too))
            break
        over = settle(over)
        done.append(_merge_bucket(dealt.join(over, "bucket", "left_anti"), width, rows_too))
        pending = settle(dealt.join(over, "bucket", "left_semi").drop("bucket"))
    else:
        raise RuntimeError("texts of one bucket share all their hashes")
    return reduce(DataFrame.unionByName, done)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES,
          bucket_bytes: int = BUCKET_BYTES, load: float = 2.0) -> DataFrame:
    """One row per document: (key, keep_id, group_size, kept, text_sha256)."""
    spilled = spill(only(docs, **{key: key, text: text}), key, text, [], task_bytes)
    finals = merge(spilled, None, bucket_bytes, load)
    members = spilled.where("not is_group").select("gid", "id", "row")
    return members.join(finals, "gid").select(
        F.col("id").alias(key), "keep_id", F.col("n").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", task_bytes: int = TASK_BYTES,
             bucket_bytes: int = BUCKET_BYTES, load: float = 2.0) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; null texts come back empty."""
    payload = [c for c in docs.columns if c not in (key, text)]
    spilled = spill(docs, key, text, payload, task_bytes)
    fields = [f for f in spilled.schema.fields if f.name.startswith("p") and f.name[1:].isdigit()]
    kept = merge(spilled, fields, bucket_bytes, load)
    back = {key: F.col("id"), text: F.col("text")} | {c: F.col(f"p{i}") for i, c in enumerate(payload)}
    return kept.select(*[back[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


