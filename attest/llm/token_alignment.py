"""Alignment of two tokenizers over the same bytes by pointer jumping.

A text is encoded by a byte-level vocabulary (A, on space + text) and by a SentencePiece
vocabulary (B, which puts the space in front itself). Every token points to the
farthest-right token of the other side that overlaps it; a B token that ends where an A
token ends points to itself. All tokens of some texts are one flat array, and its
successors are doubled (``s = s[s]``) until nothing moves: each token then names the
terminal token of its component, and components are the groups.

``report`` adds how often a linked id pair is linked in the whole corpus. Pairs are
counted in two steps (per task, then by pair). At most 2^20 pairs can reach a count of
total / 2^20; those travel to the tasks as one table (17 MB at most), so no frequent pair
is a join key. All other pairs meet their counts in a join.

Defined results: texts that are null or empty, or whose tokens do not spell space + text
(one with U+2581, which B reads as a space), have no tokens: zeros and an empty string;
repeated rows and null ids are rows of their own and count as often as they stand; long
texts are aligned whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.bpe_count import byte_letters
from attest.llm.common import kept, only, tidy
from attest.session import settle

SPACE = "▁"
# Fixed value: how byte_bpe vocabularies cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FREQUENT = 1 << 20  # pairs with at least 1 / FREQUENT of all links travel to the tasks
_BYTES, _TEXTS = 2 << 20, 256  # texts that are aligned together
_HELD = 1 << 20  # pairs a task adds up before it passes them on
_SIDE = 20  # bits of a B id in a pair's code


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of each A token and of each B token, from ascending byte ends of non-empty tokens.

    Both sides must end at the same byte; texts laid one behind the other do, so no group
    spans two of them.
    """
    na, nb = len(ends_a), len(ends_b)
    if not na:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    over = np.searchsorted(ends_a, ends_b)  # the A token under the last byte of each B token
    own = ends_a[over] == ends_b
    after = np.concatenate([na + np.searchsorted(ends_b, ends_a), np.where(own, na + np.arange(nb), over)])
    while True:
        further = after[after]
        if (further == after).all():
            break
        after = further
    number = np.cumsum(own) - 1
    group = number[after - na]
    return group[:na], group[na:]


class Pair:
    """Both encoders, the bytes of their tokens and their numbers as text."""

    def __init__(self, byte_vocabulary: str, piece_model: bytes):
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        spec = json.loads(byte_vocabulary)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            self.bytes_a[i] = t
        pieces = self.b.id_to_piece(list(range(self.b.get_piece_size())))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
                        for i, p in enumerate(pieces)]
        self.size_a = np.array([len(t) for t in self.bytes_a])
        self.size_b = np.array([len(t) for t in self.bytes_b])
        # Numbers with the mark behind them, filled up with zero bytes that are taken out at the end.
        top = max(len(self.bytes_a), len(self.bytes_b))
        self.said = np.array([f"{i}{mark}" for mark in ",|;" for i in range(top)], "S7").reshape(3, top)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none where they don't spell space + text."""
        a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        b = self.b.encode([t or "" for t in texts], num_threads=1)
        for i, t in enumerate(texts):
            want = (" " + t).encode() if t else None
            if (want is None or b"".join(map(self.bytes_b.__getitem__, b[i])) != want
                    or b"".join(map(self.bytes_a.__getitem__, a[i])) != want):
                a[i], b[i] = [], []
        return a, b

    def groups(self, texts: list[str | None]) -> Groups:
        a, b = self.encode(texts)
        flat = [np.fromiter((x for ids in side for x in ids), np.int64) for side in (a, b)]
        return Groups(self, flat[0], flat[1], [len(x) for x in a], [len(x) for x in b])


class Groups:
    """Aligned texts: flat ids of both sides, their group numbers, and where each text starts."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, sizes_a: list[int], sizes_b: list[int]):
        self.pair, self.a, self.b = pair, a, b
        self.at_a, self.at_b = np.cumsum([0, *sizes_a]), np.cumsum([0, *sizes_b])
        self.of_a, self.of_b = align(np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b]))
        self.many_a = np.bincount(self.of_a) if len(a) else np.zeros(0, np.int64)
        self.many_b = np.bincount(self.of_b, minlength=len(self.many_a)) if len(b) else np.zeros(0, np.int64)
        filled = np.append(self.of_b, len(self.many_a))
        self.at_group = filled[self.at_b]  # the first group of each text

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the A and the B token that end each group."""
        return self.a[np.cumsum(self.many_a) - 1], self.b[np.cumsum(self.many_b) - 1]

    def written(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        end_a, end_b = np.cumsum(self.many_a), np.cumsum(self.many_b)
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        if len(end_a):
            mark_a[end_a - 1], mark_b[end_b - 1] = 1, 2
        out = np.zeros(len(self.a) + len(self.b), "S7")
        out[np.arange(len(self.a)) + (end_b - self.many_b)[self.of_a]] = self.pair.said[mark_a, self.a]
        out[np.arange(len(self.b)) + end_a[self.of_b]] = self.pair.said[mark_b, self.b]
        at = self.at_a + self.at_b
        return [out[x:y].tobytes().replace(b"\0", b"")[:-1] for x, y in zip(at, at[1:])]


def _portions(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with bounded rows and bytes (one longer text is a slice of its own)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and (held + n > _BYTES or i - start >= _TEXTS):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _mapped(docs: DataFrame, columns: DataFrame, paths: tuple[str, str], schema: str, shape) -> DataFrame:
    """``shape(Groups)`` gives the arrays behind those of ``columns`` (the text, which comes last, is dropped)."""
    with open(paths[0], encoding="utf-8") as f, open(paths[1], "rb") as g:
        # Two files of a fixed size, about 3 MB.
        files = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = kept(("token_alignment", hash(files.value)), lambda: Pair(*files.value))
        for batch in batches:
            for part in _portions(batch, "text"):
                found = shape(pair.groups(part.column("text").to_pylist()))
                same = [part.column(c) for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*same, *found.values()],
                                                 names=[*[c for c in part.schema.names if c != "text"], *found])

    return columns.mapInArrow(tidy(run, keeps=True), schema)


def groups(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, a_ids, b_ids, a_sizes, b_sizes), the last two with the tokens of each group."""
    def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, pa.int32()))

    def shape(g: Groups) -> dict[str, pa.Array]:
        return {"a_ids": lists(g.a, g.at_a), "b_ids": lists(g.b, g.at_b),
                "a_sizes": lists(g.many_a, g.at_group), "b_sizes": lists(g.many_b, g.at_group)}

    rows = only(docs, key=key, text=text)
    kind = dict(rows.dtypes)["key"]
    schema = f"key {kind}, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
    return _mapped(docs, rows, (byte_vocabulary, piece_model), schema, shape).withColumnRenamed("key", key)


def _digested(g: Groups) -> dict[str, pa.Array]:
    """Counts, the digest of the groups, and the text's distinct linked pairs with their times."""
    a, b = g.links()
    codes = a << _SIDE | b
    pairs = [np.unique(codes[x:y], return_counts=True) for x, y in zip(g.at_group, g.at_group[1:])]
    n_groups = pa.array(np.diff(g.at_group), pa.int64())
    return {
        "n_a": pa.array(np.diff(g.at_a), pa.int64()), "n_b": pa.array(np.diff(g.at_b), pa.int64()),
        "n_groups": n_groups, "n_links": n_groups,
        "groups_sha256": pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in g.written()], pa.string()),
        "codes": pa.array([c.tobytes() for c, _ in pairs], pa.binary()),
        "times": pa.array([t.astype("<i4").tobytes() for _, t in pairs], pa.binary())}


def _of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Codes and times of a batch, flat, and the number of pairs of each row."""
    codes, times = batch.column("codes"), batch.column("times")
    flat = [np.frombuffer(b"".join(v.as_py() for v in c), kind).astype(np.int64) for c, kind in ((codes, "<i8"), (times, "<i4"))]
    return flat[0], flat[1], [len(v.as_buffer()) // 8 for v in codes]


def pair_counts(records: DataFrame) -> DataFrame:
    """(code, n): how many links of the corpus hold each pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            codes, at = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([t for _, t in held]), minlength=len(codes))
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n.astype(np.int64))], names=["code", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                codes, times, _ = _of(batch.slice(at, _TEXTS))
                held.append((codes, times))
                size += len(codes)
                if size >= _HELD:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    found = records.select("codes", "times").mapInArrow(tidy(run), "code bigint, n bigint")
    return found.groupBy("code").agg(F.sum("n").alias("n"))


def report(docs: DataFrame, byte_vocabulary: str, piece_model: str, key: str = "doc_id", text: str = "text",
           frequent: int = FREQUENT) -> DataFrame:
    """One row per document: (key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = dict(rows.dtypes)["key"]
    counts = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
    # Written once: row numbers stay as they are, and both passes read the pairs.
    records = settle(_mapped(docs, rows, (byte_vocabulary, piece_model),
                             f"row bigint, key {kind}, {counts}, codes binary, times binary", _digested))
    pairs = settle(pair_counts(records))
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    b = F.col("code").bitwiseAND((1 << _SIDE) - 1)
    # One row per B id, so no more than its vocabulary has.
    best = F.broadcast(pairs.groupBy(b.alias("b")).agg(F.max("n").alias("most")))
    ranked = pairs.join(best, b == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    least = max(1, -(-total // frequent))
    top = ranked.where(F.col("n") >= least).toArrow().sort_by("code")
    often = docs.sparkSession.sparkContext.broadcast(
        tuple(top.column(c).to_numpy() for c in ("code", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, is_best = often.value
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                part = batch.slice(at, _TEXTS)
                codes, times, many = _of(part)
                owner = np.repeat(np.arange(part.num_rows), many)
                spot = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
                hit = known[spot] == codes if len(known) else np.zeros(len(codes), bool)
                # Sums stay whole numbers: np.add.at, not weights in floating point.
                n_best, n_sum = np.zeros((2, part.num_rows), np.int64)
                np.add.at(n_sum, owner[hit], times[hit] * n[spot[hit]])
                np.add.at(n_best, owner[hit], times[hit] * is_best[spot[hit]])
                row = part.column("row").to_numpy(zero_copy_only=False)
                rest = ~hit
                blank = int(rest.sum())
                # A head row per document, under a code of its own that no pair has, and its other pairs.
                heads = [part.column(c) for c in part.schema.names if c not in ("row", "codes", "times")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row), pa.array(-1 - row), pa.nulls(len(row), pa.int64()), *heads, pa.array(n_best), pa.array(n_sum)], names=names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row[owner[rest]]), pa.array(codes[rest]), pa.array(times[rest]),
                     *[pa.nulls(blank, c.type) for c in heads], *[pa.nulls(blank, pa.int64())] * 2], names=names)

    schema = f"row bigint, code bigint, times bigint, key {kind}, {counts}, n_best bigint, count_sum bigint"
    names = [f.split()[0] for f in schema.split(", ")]
    asked = records.mapInArrow(tidy(run), schema)
    rare = ranked.where(F.col("n") < least).select("code", "n", "best")
    met = asked.join(rare, "code", "left")
    heads = [c for c in names if c not in ("row", "code", "times", "n_best", "count_sum")]
    return met.groupBy("row").agg(
        *[F.max(c).alias(c) for c in heads],
        F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("times")), F.lit(0))).alias("n_best"),
        F.sum(F.coalesce("count_sum", F.col("times") * F.col("n"), F.lit(0))).alias("count_sum"),
    ).select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
