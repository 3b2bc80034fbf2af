"""Class means and scatter matrices in one pass, merged pairwise-stably."""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attest.functions.scale import pack_blocks
from attest.operators.metric_join import bound_arrow_batches, matrix_of
from attest.session import settle

# Labels held at once while scanning a partition; beyond it partials are emitted.
_OPEN_LABELS = 256
_FAN_IN = 64
# Models up to this many bytes travel to the workers with the task.
MODEL_BYTES = 64 * 1024 * 1024

_PARTIAL = "label string, part int, n bigint, mean array<double>, scatter array<double>"
MODEL = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.ArrayType(T.DoubleType())),
    T.StructField("eigenvalues", T.ArrayType(T.DoubleType())),
    T.StructField("basis", T.ArrayType(T.DoubleType())),
])


def _merge(a, b):
    """Combine (count, mean, scatter about the mean) of two disjoint row sets."""
    n = a[0] + b[0]
    shift = b[1] - a[1]
    mean = a[1] + shift * (b[0] / n)
    return n, mean, a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)


def _moments(rows: np.ndarray):
    mean = rows.mean(0)
    centred = rows - mean
    return len(rows), mean, centred.T @ centred


def _split_by_label(labels: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
    order = np.argsort(labels, kind="stable")
    names, starts = np.unique(labels[order], return_index=True)
    for name, lines in zip(names, np.split(order, starts[1:])):
        yield str(name), lines


def class_models(rows: DataFrame, label: str, vec: str) -> DataFrame:
    """One row per class: count, mean and eigen-decomposed scatter matrix.

    Vectors are never shuffled: each scan task emits one partial per class, and
    partials merge in two bounded steps.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, tuple] = {}
        # Spreads merging; fixed per partition, so a repeated task emits the same rows.
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({
                "label": list(open_),
                "part": pa.array([part % _FAN_IN] * len(open_), pa.int32()),
                "n": [v[0] for v in open_.values()],
                "mean": [v[1].tolist() for v in open_.values()],
                "scatter": [v[2].ravel().tolist() for v in open_.values()],
            })
            open_.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            values = matrix_of(batch.column("vec"))
            for name, lines in _split_by_label(batch.column("label").to_numpy(zero_copy_only=False).astype(str)):
                new = _moments(values[lines])
                open_[name] = _merge(open_[name], new) if name in open_ else new
                if len(open_) >= _OPEN_LABELS:
                    yield flush()
        if open_:
            yield flush()

    def fold(pdf: pd.DataFrame) -> tuple:
        parts = [
            (int(r.n), np.asarray(r.mean), np.asarray(r.scatter).reshape(len(r.mean), -1))
            for r in pdf.sort_values("n").itertuples()
        ]
        result = parts[0]
        for other in parts[1:]:
            result = _merge(result, other)
        return result

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = fold(pdf)
        return pd.DataFrame([{"label": pdf.label.iloc[0], "part": 0, "n": n,
                              "mean": mean, "scatter": scatter.ravel()}])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        n, mean, scatter = fold(pdf)
        values, vectors = np.linalg.eigh(scatter)
        return pd.DataFrame([{"label": pdf.label.iloc[0], "n": n, "mean": mean,
                              "eigenvalues": np.maximum(values, 0.0), "basis": vectors.ravel()}])

    source = rows.select(F.col(label).cast("string").alias("label"),
                         F.col(vec).cast("array<double>").alias("vec"))
    partial = source.mapInArrow(scan, _PARTIAL)
    merged = partial.groupBy("label", "part").applyInPandas(combine, _PARTIAL)
    return merged.groupBy("label").applyInPandas(finish, MODEL)


class Model:
    """A class model as numpy arrays."""

    def __init__(self, n, mean, eigenvalues, basis):
        self.n = int(n)
        self.mean = np.asarray(mean, dtype=np.float64)
        self.eigenvalues = np.asarray(eigenvalues, dtype=np.float64)
        self.basis = np.asarray(basis, dtype=np.float64).reshape(len(self.mean), -1)


def score_rows(
    rows: DataFrame, models: DataFrame, ord: str, label: str, vec: str,
    score: Callable[[np.ndarray, Model], np.ndarray],
) -> DataFrame:
    """Apply ``score`` to every row with its class model: ``(ord, label, score)``.

    NaN means "not assessed" and is dropped. Small model tables go along with the
    tasks and vectors stay in place; large ones are joined to bounded row blocks.
    """
    source = rows.select(
        F.col(ord).cast("bigint").alias("ord"),
        F.col(label).cast("string").alias("label"),
        F.col(vec).cast("array<double>").alias("vec"),
    )
    schema = "ord bigint, label string, score double"
    models = settle(models)
    size = models.agg(F.count(F.lit(1)), F.max(F.size("basis"))).first()
    if (size[0] or 0) * (size[1] or 0) * 8 <= MODEL_BYTES:
        held = {r["label"]: Model(r["n"], r["mean"], r["eigenvalues"], r["basis"]) for r in models.collect()}

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                values = matrix_of(batch.column("vec"))
                out = np.full(batch.num_rows, np.nan)
                for name, lines in _split_by_label(batch.column("label").to_numpy(zero_copy_only=False).astype(str)):
                    out[lines] = score(values[lines], held[name])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("ord"), batch.column("label"), pa.array(out)], names=["ord", "label", "score"]
                )

        return source.mapInArrow(scan, schema).where(~F.isnan("score"))

    bound_arrow_batches(rows.sparkSession)
    blocks = pack_blocks(source, ["label"], "ord", ["vec"]).join(models, "label")

    def scan_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                inner = batch.column("rows")[i].values
                model = Model(*[batch.column(c)[i].as_py() for c in ("n", "mean", "eigenvalues", "basis")])
                out = score(matrix_of(inner.field("vec")), model)
                name = batch.column("label")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [inner.field("ord"), pa.array([name] * len(out), pa.string()), pa.array(out)],
                    names=["ord", "label", "score"],
                )

    return blocks.select("label", "n", "mean", "eigenvalues", "basis", "rows").mapInArrow(
        scan_blocks, schema
    ).where(~F.isnan("score"))
