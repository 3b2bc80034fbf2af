"""Token counts of a word-level BPE vocabulary by rank-synchronous merging of ragged arrays.

All distinct pre-tokens of an Arrow batch are laid out as one flat symbol array with row
numbers. A step looks up the rank of every adjacent pair, takes each row's lowest rank,
and merges it in all rows at once; rows without a ranked pair are finished and leave the
arrays. What survives per row is its token count, kept in a bounded cache for the next
batches. Only counts are needed, so tokens are never turned into strings.

Defined results: null counts as empty and has 0 tokens; special strings inside a text
count as one token, as the library does by default; long pre-tokens are merged whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from attest.llm.common import only, kept, tidy

SCHEMA = "key bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
CACHE_WORDS = 500_000  # about 75 MB
# Small letters the library knows from a newer Unicode than Python's.
NEW_SMALL = {0xA7CB: "\u0264", 0xA7DC: "\u019b"}


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free one above 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def character_class(kind: str) -> str:
    """The code points below 0x10000 of a general category (L, N), as ranges inside a bracket expression."""
    out, start = [], None
    for c in range(0x10001):
        inside = c <= 0xFFFF and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


# What the library takes for white space.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def pretoken_pattern(stated: str) -> re.Pattern:
    """The vocabulary's pattern with its classes written out as tables, which the standard module
    reads faster; for texts without characters from 0x10000 on."""
    letters, numbers = character_class("L"), character_class("N")
    inside = {r"\s": _SPACE, r"\p{L}": letters, r"\p{N}": numbers}
    return re.compile(re.sub(r"\\s|\\p\{[LN]\}", lambda m: inside[m[0]], stated))


class RankMerger:
    """Counts the tokens of pre-tokens, many at a time."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        self.specials = [t["content"] for t in model["added_tokens"]]
        kinds = [p for p in model["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        stated = kinds[0]["pattern"]["Regex"]
        self.far, self.far_pattern = re.compile("[\U00010000-\U0010ffff]"), regex.compile(stated)
        self.pattern = pretoken_pattern(stated)
        bpe = model["model"]
        vocab, end = bpe["vocab"], bpe["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
        self.size = 1 + max(vocab.values())
        left, right, made = (np.array([vocab[x] for x in col], np.int64) for col in
                             zip(*[(a, b, a + b) for a, b in merges], strict=True))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = made.astype(np.int32)
        self.none = len(merges)
        # A pair may be merged everywhere in a row at once if no merge of its product ranks before it.
        first = np.full(self.size, len(merges), np.int64)
        for side in (left, right):
            np.minimum.at(first, side, np.arange(len(merges)))
        self.everywhere = first[made] > np.arange(len(merges))
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        self.cache: dict[str, int] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, pair)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == pair, self.ranks[at], self.none)

    def _merge(self, sym: np.ndarray, row: np.ndarray, n_rows: int) -> np.ndarray:
        """Symbols left in each row; ``row`` ascends. rank[i] belongs to the pair (i, i + 1)."""
        left = np.zeros(n_rows, np.int64)
        none = self.none
        rank = np.full(len(sym), none, np.int32)
        inside = np.flatnonzero(row[:-1] == row[1:])
        rank[inside] = self._ranks(sym[inside], sym[inside + 1])
        while len(sym):
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lengths = np.diff(np.append(starts, len(row)))
            low = np.minimum.reduceat(rank, starts)
            over = low == none
            if over.any():
                left[row[starts[over]]] = lengths[over]
                stay = np.repeat(~over, lengths)
                sym, row, rank = sym[stay], row[stay], rank[stay]
                low, lengths = low[~over], lengths[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lengths))
            # Of overlapping places the left one goes first: every second one of a run.
            new_run = np.append(True, np.diff(hit) != 1)
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            alone = (np.arange(len(hit)) - run_start) % 2 == 0
            first = np.append(True, row[hit[1:]] != row[hit[:-1]])
            hit = hit[np.where(self.everywhere[rank[hit]], alone, first)]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, row, rank = sym[keep], row[keep], rank[keep]
            # Only the pairs beside a new symbol have a new rank.
            made = hit - np.arange(len(hit))
            beside = np.zeros(len(sym), bool)
            beside[made] = True
            beside[made[made > 0] - 1] = True
            near = np.flatnonzero(beside[:-1])
            same = row[near] == row[near + 1]
            rank[made] = none
            near = near[same]
            rank[near] = self._ranks(sym[near], sym[near + 1])
        return left

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(lengths) - 1
        sym = self.inner[flat]
        sym[ends] = self.last[flat[ends]]
        return self._merge(sym, np.repeat(np.arange(len(words)), lengths), len(words))

    def pretokens(self, text: str) -> tuple[int, list[str]]:
        """Special strings counted, and the pre-tokens between them."""
        parts, specials = [text], 0
        for s in self.specials:
            if s in text:
                parts = [q for p in parts for q in p.split(s)]
        specials = len(parts) - 1
        found: list[str] = []
        for part in parts:
            pattern = self.pattern
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # no final sigma rule
                if self.far.search(part):
                    pattern = self.far_pattern
                part = part.translate(NEW_SMALL)
            part = part.lower()
            found += pattern.findall(part)
        return specials, found

    def count_texts(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        here = set().union(*[words for _, words in cut])
        if len(self.cache) > CACHE_WORDS:
            # What this batch uses stays: the frequent words are among it.
            self.cache = {w: self.cache[w] for w in here if w in self.cache}
        cache = self.cache
        new = list(here.difference(cache))
        if new:
            cache.update(zip(new, self.count(new).tolist(), strict=True))
        known = cache.__getitem__
        return [n + sum(map(known, words)) for n, words in cut]


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text",
                 limit: int = 2048) -> DataFrame:
    """One row per document: bytes, tokens, and whether there are more than ``limit``.

    ``vocabulary`` is the path of the vocabulary file on the driver; its content (about
    2 MB, a fixed size) travels to the tasks, which need no shared folder.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = kept(("bpe_count", hash(spec.value)), lambda: RankMerger(spec.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                n = np.array(merger.count_texts(texts), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n), pa.array(n > limit)], names=["key", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, key=key, text=text).mapInArrow(tidy(run, keeps=True), SCHEMA).withColumnRenamed("key", key)
