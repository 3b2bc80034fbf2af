"""Replay protection over an endless log: the batch rules with state per log."""

from __future__ import annotations

import zlib
from typing import Any, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attest.operators.chain import REGRESSED, REPLAYED, UNNAMED

_LAST = T.StructType([T.StructField("last", T.LongType()), T.StructField("nonces", T.LongType()), T.StructField("bits", T.IntegerType())])
_BUCKET = T.StructType([T.StructField("bucket", T.LongType())])
_NAMES = T.StructType([T.StructField("names", T.ArrayType(T.StringType())), T.StructField("times", T.ArrayType(T.LongType()))])
# Nonces of a bucket on average; a log's buckets double beyond that.
BUCKET_NONCES = 256
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Replay(StatefulProcessor):
    """Largest sequence number and seen nonces of one log.

    State moves on only when the log's rows of a micro-batch are all clean, which
    is the per-batch commit rule of the batch form. Every access to state is a call to the
    JVM, so nonces lie in buckets by their CRC, as many as the log's nonces ask for: rows of
    a new log ask one thing, rows of a long one the buckets of their own nonces.
    """

    def __init__(self, nonce_ttl_ms: int | None):
        self._ttl = nonce_ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getValueState("last", _LAST)
        self._nonces = handle.getMapState("nonces", _BUCKET, _NAMES, self._ttl)

    def _dealt(self, names: dict[str, int], bits: int) -> dict[int, dict[str, int]]:
        out: dict[int, dict[str, int]] = {}
        for n, time in names.items():
            out.setdefault(zlib.crc32(n.encode()) & ((1 << bits) - 1), {})[n] = time
        return out

    def _held(self, value: Any, now: int) -> dict[str, int]:
        """Names of a bucket with their times, without those whose time is up."""
        if value is None:
            return {}
        return {n: t for n, t in zip(value[0], value[1]) if self._ttl is None or t + self._ttl > now}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """All rules over the log's rows of the micro-batch, in order of position.

        The source's limit of files per micro-batch bounds these rows.
        """
        parts = list(rows)
        column = lambda name: np.concatenate([p[name].to_numpy() for p in parts]) if len(parts) > 1 else parts[0][name].to_numpy()
        pos = column("pos")
        order = np.argsort(pos, kind="stable")
        number = column("sequence_number")[order]
        nonces = ["" if n is None or n != n else n for n in column("nonce")[order]]
        state = self._last.get()
        start, count, bits = state if state is not None else (-1, 0, 0)
        now = timerValues.getCurrentProcessingTimeInMs() if self._ttl is not None else 0
        fresh = self._dealt(dict.fromkeys(nonces, now), bits)
        held = {b: self._held(self._nonces.getValue((b,)), now) for b in fresh} if count else {}
        seen = {n for b, names in fresh.items() for n in names if n in held.get(b, ())}
        again = np.zeros(len(nonces), bool)
        for i, n in enumerate(nonces):
            again[i] = n in seen
            seen.add(n)
        peaks = np.maximum.accumulate(np.concatenate([[start], number]))  # peaks[i]: the largest number before row i
        reason = np.select([again, number <= peaks[:-1], np.array([n == "" for n in nonces])], [REPLAYED, REGRESSED, UNNAMED], "")
        bad = reason != ""
        if bad.any():
            failed = pos[order][bad]
            yield pd.DataFrame({"log_id": [key[0]] * len(failed), "pos": failed, "property": "freshness", "reason": reason[bad]})
            return
        count += len(nonces)
        wanted = max(bits, (count // BUCKET_NONCES).bit_length())
        if wanted > bits:
            # Every doubling reads a log's nonces once, so a nonce is moved once on average.
            known = {n: t for _, value in self._nonces.iterator() for n, t in self._held(value, now).items()}
            fresh, held = self._dealt(known | dict.fromkeys(nonces, now), wanted), {}
        for b, names in fresh.items():
            names = held.get(b, {}) | names
            self._nonces.updateValue((b,), (list(names), list(names.values())))
        self._last.update((int(peaks[-1]), count, wanted))

    def close(self) -> None:
        pass


def freshness_stream(records: DataFrame, nonce_ttl_ms: int | None = None) -> DataFrame:
    """Streaming ``records(log_id, pos, sequence_number, nonce)`` -> failures in append mode.

    Needs the RocksDB state store, so state lives on executor disks and in the
    checkpoint, not in the heap. ``nonce_ttl_ms`` forgets nonces by processing time. A
    stream needs a checkpoint of its own: state written before nonces lay in buckets is not read.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    log = records.schema["log_id"].dataType.simpleString()
    pos = records.schema["pos"].dataType.simpleString()
    return (
        records.select("log_id", "pos", "sequence_number", "nonce").groupBy("log_id")
        .transformWithStateInPandas(
            _Replay(nonce_ttl_ms),
            outputStructType=f"log_id {log}, pos {pos}, property string, reason string",
            outputMode="Append",
            timeMode="ProcessingTime" if nonce_ttl_ms else "None",
        )
    )


def distinct_nonces(records: DataFrame, time: str, delay: str) -> DataFrame:
    """Nonce-only variant: first use of a nonce inside the watermark delay passes, repeats drop."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["log_id", "nonce"])
