"""Quality classifier: document evidence with host and path posteriors by empirical Bayes.

1. A logistic model on a few style features of the whole text gives each document's
   evidence (log odds). It is fitted on a bounded, hash-ordered sample of labelled rows.
2. Labels are counted by host and by (host, path) with grouped aggregation. A host's
   rate is shrunk toward the global rate, a path's toward its host's; the strength of
   each prior comes from the spread of the observed rates (method of moments), so sites
   with few labels stay near the prior above them.
3. quality = sigmoid(evidence + logit(path rate) - logit(global rate)).

Defined results: null counts as empty text; a text without words has quality 0 and is
rejected; null host or path is a value of its own; documents without a label, or all of
them when no label exists, get the prior (0.5 with no labels at all) and their evidence;
several labels of one document count once, the best of them; repeated rows give repeated
results; at the threshold a document is kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import only, spare, tidy
from attest.session import settle

# At most this many labelled rows fit the model; the smallest hashes of doc_id are taken.
MAX_FIT = 20_000
THRESHOLD = 0.5
# Pseudo-labels of a prior: at least, and where the groups say nothing.
MIN_STRENGTH, DEFAULT_STRENGTH = 3.0, 10.0
FEATURES = ("upper", "digit", "mark", "rare_mark", "beyond_ascii", "space", "newline", "word_length", "log_words",
            "variety", "repeated_lines", "longest_word")
_UPPER, _DIGIT, _SPACE = range(0x41, 0x5B), range(0x30, 0x3A), b" \t\n\r\x0b\x0c"
# Marks that prose uses.
_PROSE_MARKS = b".,;:'\"-()?"


def _classes() -> np.ndarray:
    """One row per byte: which of the character shares it adds to."""
    table = np.zeros((256, 7))
    for b in range(256):
        letter = 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
        mark = b < 0x80 and not letter and b not in _DIGIT and b not in _SPACE
        table[b] = [b in _UPPER, b in _DIGIT, mark, mark and b not in _PROSE_MARKS, b >= 0x80, b == 0x20, b == 0x0A]
    return table


_TABLE = _classes()


def features(text: bytes) -> list[float] | None:
    """Style features of a whole text; None without words."""
    words = text.split()
    if not words:
        return None
    shares = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / len(text)
    lines = [x for x in text.split(b"\n") if x.strip()]
    distinct = len(set(words))
    return [
        *(float(x) for x in np.sqrt(shares)),
        math.log(len(text) / len(words)), math.log(len(words)),
        math.log(distinct) / math.log(len(words)) if len(words) > 1 else 1.0,
        1 - len(set(lines)) / len(lines), math.log(max(map(len, words))),
    ]


@dataclass
class Evidence:
    """Standardised logistic model; ``weights`` has the intercept last."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))]) @ self.weights


def fit(rows: np.ndarray, good: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> Evidence:
    """Newton steps on the penalised likelihood; one label only, or no row, gives zero evidence."""
    n = len(FEATURES)
    if len(rows) == 0 or len(np.unique(good)) < 2:
        return Evidence(np.zeros(n), np.ones(n), np.zeros(n + 1))
    mean, scale = rows.mean(0), rows.std(0) + 1e-6
    z = np.hstack([np.clip((rows - mean) / scale, -8, 8), np.ones((len(rows), 1))])
    w, penalty = np.zeros(n + 1), np.diag([ridge] * n + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (good - p) - penalty @ w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return Evidence(mean, scale, w)


def _texts(column: pa.Array) -> Iterator[bytes]:
    for v in column:
        yield (v.as_py() or "").encode()


def with_evidence(docs: DataFrame, model: Evidence | None, text: str, out: str = "_evidence",
                  keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` and the evidence (null without words), or the features when there is no model."""
    kind = "double" if model else "array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in _texts(batch.column(text))]
            if model:
                has = [f is not None for f in found]
                odds = model.log_odds(np.array([f for f in found if f is not None]).reshape(-1, len(FEATURES)))
                put = iter(odds)
                column = pa.array([float(next(put)) if h else None for h in has], pa.float64())
            else:
                column = pa.array(found, pa.list_(pa.float64()))
            kept = [c for c in batch.schema.names if keep_text or c != text]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], column], names=[*kept, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep_text or f.name != text)
    return docs.mapInArrow(tidy(run), f"{fields}, `{out}` {kind}")


def _strength(found: float | None, expected: float | None, room: float | None, spread: float | None) -> float:
    """Pseudo-labels of a prior: what the groups' rates vary beyond chance, against a label's own variance.

    found, expected: sum of n * (rate - prior rate)^2 as it is and by chance alone; room: its
    growth per unit of variance between groups; spread: variance of one label.
    """
    if not room or not spread or room <= 0 or spread <= 0:
        return DEFAULT_STRENGTH
    share = max((found - expected) / room / spread, 1e-3)
    return max(MIN_STRENGTH, (1 - min(share, 1.0)) / share)


def site_rates(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(host, path, host_rate, path_rate) of labelled(host, path, good), and the global rate."""
    paths = settle(labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("k")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("k").alias("hk"), F.count(F.lit(1)).alias("paths"),
                                      F.sum(F.col("n") * F.col("n")).alias("n2"))
    n, k = hosts.agg(F.coalesce(F.sum("hn"), F.lit(0)), F.coalesce(F.sum("hk"), F.lit(0))).first()
    mean = (k + 1) / (n + 2)
    rate = F.col("hk") / F.col("hn")
    found, groups, n2 = hosts.agg(F.sum(F.col("hn") * (rate - mean) ** 2), F.count(F.lit(1)), F.sum(F.col("hn") * F.col("hn"))).first()
    over_host = _strength(found, (groups - 1) * mean * (1 - mean), n - n2 / n if n else 0, mean * (1 - mean))
    by_path = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h")))
    own, chance, room, spread = by_path.agg(
        F.sum(F.col("n") * (F.col("k") / F.col("n") - rate) ** 2),
        F.sum((F.col("paths") - 1) * rate * (1 - rate) / F.col("paths")),
        F.sum(F.col("n") - F.col("n2") / F.col("hn") * F.col("n") / F.col("hn")),
        F.sum(F.col("n") * rate * (1 - rate)) / F.sum("n")).first()
    over_path = _strength(own, chance, room, spread)
    host_rate = (F.col("hk") + over_host * mean) / (F.col("hn") + over_host)
    path_rate = (F.col("k") + over_path * F.col("host_rate")) / (F.col("n") + over_path)
    rates = by_path.withColumn("host_rate", host_rate)
    # Written, so that the join with documents is planned by their true size.
    return settle(rates.select("host", "path", "host_rate", path_rate.alias("path_rate"))), mean


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def added_names(columns: list[str]) -> list[str]:
    """Names of the evidence, host rate, path rate, quality and kept columns of ``score``."""
    return spare(columns, "evidence", "host_rate", "path_rate", "quality", "kept")


def score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
          path: str = "lang", label: str = "quality", max_fit: int = MAX_FIT, threshold: float = THRESHOLD,
          keep_text: bool = True) -> DataFrame:
    """``docs`` (without their text if asked) with _evidence, _host_rate, _path_rate, _quality and _kept.

    Where a column of ``docs`` has one of these names, all five take more underscores (``added_names``).
    """
    truth = only(labels, key=key, good=label).where("key is not null and good is not null")
    truth = truth.groupBy("key").agg(F.max(F.col("good").cast("int")).alias("good"))
    sites = only(docs, key=key, host=host, path=path).where("key is not null")
    labelled = sites.join(truth, "key").select("key", "host", "path", "good")
    chosen = truth.orderBy(F.xxhash64("key"), "key").limit(max_fit)
    texts = only(docs, key=key, text=text).join(F.broadcast(chosen), "key").groupBy("key", "good").agg(F.max("text").alias("text"))
    sample = with_evidence(texts, None, "text").where("_evidence is not null").select("key", "good", "_evidence")
    fitted = sample.orderBy("key").toPandas()
    model = fit(np.array(fitted["_evidence"].tolist()).reshape(-1, len(FEATURES)), fitted["good"].to_numpy(float))
    rates, mean = site_rates(labelled)
    evidence, *others = added_names(docs.columns)
    rh, rp, pr, hh, hr = spare([*docs.columns, evidence], "rh", "rp", "pr", "hh", "hr")
    judged = with_evidence(docs, model, text, out=evidence, keep_text=keep_text)
    same = F.col(f"`{host}`").eqNullSafe(F.col(rh)) & F.col(f"`{path}`").eqNullSafe(F.col(rp))
    hosts = settle(rates.select(F.col("host").alias(hh), F.col("host_rate").alias(hr)).distinct())
    full = rates.select(F.col("host").alias(rh), F.col("path").alias(rp), F.col("path_rate").alias(pr))
    joined = judged.join(full, same, "left").join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(hh)), "left")
    host_rate = F.coalesce(hr, F.lit(mean))
    path_rate = F.coalesce(pr, host_rate)
    odds = F.col(evidence) + _logit(path_rate) - math.log(mean / (1 - mean))
    quality = F.coalesce(1 / (1 + F.exp(-odds)), F.lit(0.0))
    added = (host_rate, path_rate, quality, quality >= threshold)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns if keep_text or c != text], evidence,
                         *[c.alias(n) for n, c in zip(others, added)])
