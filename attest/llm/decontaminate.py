"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

Items are cut into windows of consecutive words; all windows of a block of items form one
automaton. A document is normalised once (words with one space around each), scanned
once, and the ends of matches are mapped to word numbers and, where asked for, to byte
spans of the original text. The benchmark is a stated query set: it passes in blocks of
bounded text, so memory does not grow with it. Items are first cut into pieces of bounded
text that overlap by a window less a word, so that a block is bounded whatever one item has. One
block is the usual case. With several, the corpus is written once with row numbers; every
block reads it and gives the hits it finds, and one aggregation puts them together.

Defined results: null and wordless texts have no words and no hits; items without words
and null items have no window; items shorter than a window are one window of their own;
several rows with one item_id are one item; null item ids are left out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import WORD_BYTES, only, spare, tidy, utf8, words_of
from attest.session import settle

WINDOW = 10
BLOCK_BYTES = 2 << 20  # normalised benchmark text behind one automaton


def windows(words: list[bytes], size: int = WINDOW) -> Iterator[bytes]:
    """Space-framed windows of ``size`` words; a shorter text is one window."""
    for i in range(max(1, len(words) - size + 1) if words else 0):
        yield b" " + b" ".join(words[i:i + size]) + b" "


def build(items: list[tuple[int, str | None]], size: int = WINDOW) -> ahocorasick.Automaton | None:
    """Automaton over all windows; the value of each is (words in it, item ids that have it)."""
    of: dict[bytes, set[int]] = defaultdict(set)
    for item, text in items:
        for w in windows(words_of((text or "").encode()), size):
            of[w].add(item)
    if not of:
        return None
    automaton = ahocorasick.Automaton()
    for w, ids in of.items():
        automaton.add_word(w.decode("latin-1"), (w.count(b" ") - 1, tuple(ids)))
    automaton.make_automaton()
    return automaton


def scan(automaton: ahocorasick.Automaton, normalised: bytes) -> tuple[list[tuple[int, int]], set[int]]:
    """Word ranges [first, last) of matches, and the items they belong to.

    ``normalised``: words with a space before, between and after.
    """
    hits = list(automaton.iter(normalised.decode("latin-1")))
    if not hits:
        return [], set()
    ends = np.fromiter((e for e, _ in hits), np.int64, len(hits))
    spaces = np.flatnonzero(np.frombuffer(normalised, np.uint8) == 0x20)
    # The space that closes a match has as many spaces before it as words up to there.
    last = np.searchsorted(spaces, ends)
    spans = [(int(w) - n, int(w)) for w, (_, (n, _)) in zip(last, hits, strict=True)]
    return spans, {i for _, (_, ids) in hits for i in ids}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges of word ranges in the text as it was; normalising keeps byte positions."""
    flat = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 0x20
    edges = np.diff(np.concatenate([[False], flat, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    return [(int(starts[a]), int(ends[b - 1])) for a, b in spans]


def pieces(benchmark: DataFrame, item: str, text: str, size: int, piece_bytes: int) -> DataFrame:
    """(item, text): normalised items in pieces of at most about ``piece_bytes`` that have all windows between them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column("item").to_pylist(), utf8(batch.column("text"))):
                words = words_of(t)
                ends = np.cumsum([len(w) + 1 for w in words])
                at = 0
                while at < len(words):
                    done = ends[at - 1] if at else 0
                    end = max(at + size, int(np.searchsorted(ends, done + piece_bytes)))
                    ids.append(i)
                    texts.append(b" ".join(words[at:end]).decode())
                    if end >= len(words):
                        break
                    at = end - size + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["item", "text"])

    base = only(benchmark, item=item, text=text).where("item is not null and text is not null")
    return base.select(F.col("item").cast("bigint").alias("item"), "text").mapInArrow(tidy(run), "item bigint, text string")


def item_blocks(benchmark: DataFrame, item: str, text: str, size: int, block_bytes: int) -> list[DataFrame]:
    """The pieces of items in blocks of at most twice ``block_bytes`` of text."""
    cut = settle(pieces(benchmark, item, text, size, max(1, block_bytes // 16)).distinct())
    total = cut.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        largest = cut.groupBy(block.alias("b")).agg(F.sum(F.octet_length("text")).alias("s"), F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.max("s")).first()[0]
        if n == 1 or not largest or largest <= 2 * block_bytes:
            return [cut.where(block == b) for b in range(n)]
        n *= 2


def _scanned(rows: DataFrame, text: str, part: DataFrame, names: tuple[str, str, str], size: int, all_rows: bool) -> DataFrame:
    """``rows`` without their text, or with it where ``all_rows``, and the words, spans and items of one block."""
    # At most twice BLOCK_BYTES of text.
    items = [(r["item"], r["text"]) for r in part.collect()]
    shared = rows.sparkSession.sparkContext.broadcast(pickle.dumps(items))
    kept = [c for c in rows.columns if all_rows or c != text]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    added = "`{}` bigint, `{}` array<struct<a:bigint,b:bigint>>, `{}` array<bigint>".format(*names)
    span = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build(pickle.loads(shared.value), size)
        for batch in batches:
            n_words, spans, found = [], [], []
            for t in utf8(batch.column(text)):
                flat = b" ".join(words_of(t))
                n_words.append(flat.count(b" ") + 1 if flat else 0)
                s, ids = scan(automaton, b" " + flat + b" ") if automaton and flat else ([], set())
                spans.append([{"a": a, "b": b} for a, b in merged(s)])
                found.append(sorted(ids))
            out = pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(n_words, pa.int64()), pa.array(spans, span),
                 pa.array(found, pa.list_(pa.int64()))], names=[*kept, *names])
            yield out if all_rows else out.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return rows.mapInArrow(tidy(run), f"{fields}, {added}")


def _together(found: DataFrame, names: tuple[str, str, str], row: str) -> DataFrame:
    """The hits of several blocks as one row for each row number, spans merged."""
    _, spans, items = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [[(x["a"], x["b"]) for x in s] for s in batch.column(spans).to_pylist()]
            done = [[{"a": a, "b": b} for a, b in merged(s)] for s in lists]
            yield pa.RecordBatch.from_arrays([batch.column(row), pa.array(done, batch.column(spans).type), batch.column(items)], names=[row, spans, items])

    grouped = found.groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(spans), F.array_sort(F.array_distinct(F.flatten(F.collect_list(items)))).alias(items))
    return grouped.mapInArrow(tidy(run), f"`{row}` bigint, `{spans}` array<struct<a:bigint,b:bigint>>, `{items}` array<bigint>")


def added_names(columns: list[str]) -> list[str]:
    """Names of the words, spans and items columns of ``find_hits``, and of its row number."""
    return spare(columns, "words", "spans", "items", "row")


def find_hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
              item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with _words (number), _spans (word ranges that are hit, merged) and _items.

    Where a column of ``docs`` has one of these names, all take more underscores (``added_names``).
    """
    *names, row = added_names(docs.columns)
    parts = item_blocks(benchmark, item, item_text, size, block_bytes)
    if len(parts) == 1:
        return _scanned(docs, text, parts[0], names, size, True)
    base = settle(_scanned(docs.withColumn(row, F.monotonically_increasing_id()), text, parts[0], names, size, True))
    words, spans, items = names
    found = base.where(F.size(items) > 0).select(row, *names)
    for part in parts[1:]:
        found = found.union(_scanned(base.select(row, F.col(f"`{text}`")), text, part, names, size, False))
    hits = _together(found, names, row)
    none = lambda c: F.coalesce(c, F.array().cast(base.schema[c].dataType)).alias(c)
    own = [F.col(f"`{c}`") for c in docs.columns]
    return base.drop(spans, items).join(hits, row, "left").select(*own, words, none(spans), none(items))


def report(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
           size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: (key, n_words, n_hit, n_items, items_sha256, contaminated)."""
    hits = find_hits(only(docs, key=key, text=text), benchmark, "text", item, "text", size, block_bytes)
    names = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    n_hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda s, x: s + x["b"] - x["a"])
    return hits.select(
        F.col("key").alias(key), F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("bigint").alias("n_items"), F.sha2(names, 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id") -> DataFrame:
    """The documents without any hit, with their own columns."""
    spans = added_names(docs.columns)[1]
    return find_hits(docs, benchmark, text, item).where(F.size(spans) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def item_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
