"""SentencePiece encoding and decoding for merge-type vocabularies with a score-ordered agenda.

A text is escaped (space to U+2581, one in front) and cut where no piece of the vocabulary
can reach across: between two characters that stand side by side in no piece. Each cut part
is encoded by an agenda: adjacent symbol pairs that form a piece wait in a heap ordered by
score, then place; the best is merged, its new neighbours join the agenda, stale entries
are skipped. Characters without a piece fall back to byte pieces. Parts are cached in a
bounded table. In every Arrow batch the library encodes the same new parts, and one whole
text, and any difference stops the job.

Decoding joins piece by piece, byte pieces as UTF-8, and takes off the space in front.
Defined results: null counts as empty, which has the two ids of begin and end.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from attest.llm.common import only, kept, tidy

SPACE = "▁"
CACHE_PARTS = 350_000  # about 80 MB
# Numbers beyond any id, for a character without a piece, and a merged symbol.
UNKNOWN, GONE = 0xFFFFF, 0xFFFFE
SCHEMA = "key bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _each_byte(error: UnicodeError) -> tuple[str, int]:
    return "\ufffd" * (error.end - error.start), error.end


codecs.register_error("each_byte", _each_byte)


class AgendaEncoder:
    """Encoder and decoder of one model, given as bytes."""

    def __init__(self, model: bytes, check: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.check = check
        sp = self.library
        n = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.rank: dict[str, tuple[float, int]] = {}
        self.surface: list[bytes] = []
        self.by_byte: dict[int, int] = {}
        raw = set()
        beside: dict[str, set[str]] = defaultdict(set)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            elif sp.is_byte(i):
                self.by_byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
                raw.add(i)
            else:
                self.rank[piece] = (-sp.get_score(i), i)
                self.surface.append(piece.replace(SPACE, " ").encode())
                for a, b in zip(piece, piece[1:]):
                    beside[a].add(b)
        self.raw = np.zeros(n, bool)
        self.raw[list(raw)] = True
        self.silent = np.array([sp.is_control(i) for i in range(n)])
        self.leads = [not self.silent[i] and i not in raw and not sp.is_unknown(i) and sp.id_to_piece(i)[0] == SPACE
                      for i in range(n)]
        self.cut = self._cut_pattern(beside)
        # left id << 20 | right id -> order of the joined piece's score << 20 | its id, for all
        # ways to halve a piece; equal scores have one order.
        self.number = {p: i for p, (_, i) in self.rank.items()}
        order = {cost: o for o, cost in enumerate(sorted({cost for cost, _ in self.rank.values()}))}
        self.pairs = {}
        for p, (cost, i) in self.rank.items():
            for at in range(1, len(p)):
                left, right = self.number.get(p[:at]), self.number.get(p[at:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = order[cost] << 20 | i
        self.newline_alone = "\n" not in set(beside).union(*beside.values())
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _cut_pattern(beside: dict[str, set[str]]) -> re.Pattern:
        """Runs of characters inside which a piece may reach from each to the next.

        Spaces lead pieces only, so a part is a run of them and one run of joined characters:
        of letters and other marks that join some piece behind another character, or one
        character alone.
        """
        known = (set(beside).union(*beside.values()) if beside else set()) - {SPACE}
        letters = {c for c in known if c.isalpha()}
        if any(SPACE in beside[a] for a in beside if a != SPACE) or not letters:
            return re.compile(r"(?s).+")
        # Marks that meet letters in a piece belong to the same run; the others are runs of their own.
        met = {c for c in known - letters if letters & beside.get(c, set()) or any(c in beside.get(a, ()) for a in letters)}
        loose = known - letters - met
        if any(met & beside.get(c, set()) for c in loose) or any(loose & beside.get(c, set()) for c in met):
            met, loose = met | loose, set()
        runs = ["[" + "".join(map(re.escape, sorted(part))) + "]+" for part in (letters | met, loose) if part]
        return re.compile(f"{SPACE}*(?:{'|'.join(runs)})|{SPACE}+|.", re.DOTALL)

    def encode_part(self, part: str) -> list[int]:
        """Agenda over one part, which no piece outreaches.

        An entry is one number, place in its low bits and the pair's order above them, so
        the heap compares order first and place next.
        """
        known, pairs = self.number.get, self.pairs.get
        symbols = [known(c, UNKNOWN) for c in part]
        n = len(symbols)
        found = map(pairs, [a << 20 | b for a, b in zip(symbols, symbols[1:])])
        agenda = [made >> 20 << 32 | i for i, made in enumerate(found) if made is not None]
        if agenda:
            before, after = list(range(-1, n - 1)), list(range(1, n + 1))
            symbols.append(UNKNOWN)
            heapify(agenda)
            while agenda:
                entry = heappop(agenda)
                i = entry & 0xFFFFFFFF
                j = after[i]
                made = pairs(symbols[i] << 20 | symbols[j])
                # Symbols have changed since: the entry is stale.
                if made is None or made >> 20 != entry >> 32:
                    continue
                new = made & 0xFFFFF
                symbols[i], symbols[j] = new, GONE
                after[i] = k = after[j]
                if k < n:
                    before[k] = i
                    made = pairs(new << 20 | symbols[k])
                    if made is not None:
                        heappush(agenda, made >> 20 << 32 | i)
                h = before[i]
                if h >= 0:
                    made = pairs(symbols[h] << 20 | new)
                    if made is not None:
                        heappush(agenda, made >> 20 << 32 | h)
            symbols.pop()
            if GONE in symbols:
                part = "".join([c for s, c in zip(symbols, part) if s != GONE])
                symbols = [s for s in symbols if s != GONE]
        if UNKNOWN not in symbols:
            return symbols
        ids: list[int] = []
        for s, c in zip(symbols, part, strict=True):
            ids += [s] if s != UNKNOWN else [self.by_byte[b] for b in c.encode()]
        return ids

    def parts(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def _verify(self, parts: list[str], encoded: list[list[int]]) -> None:
        """The library on the same parts, each behind a line end, which joins no piece."""
        if not self.newline_alone:
            return
        first = self.library.encode("\n")
        given = self.library.encode(["\n" + p for p in parts], num_threads=1)
        for p, got, want in zip(parts, encoded, given, strict=True):
            if first + got != want:
                raise ValueError(f"part {p!r}: {got} but the library gives {want[len(first):]}")

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text with begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.parts(t) for t in texts]
        here = set().union(*cut) if cut else set()
        if len(self.cache) > CACHE_PARTS:
            # What this batch uses stays: the frequent parts are among it.
            self.cache = {p: self.cache[p] for p in here if p in self.cache}
        cache = self.cache
        new = list(here.difference(cache))
        if new:
            encoded = [self.encode_part(p) for p in new]
            if self.check:
                self._verify(new, encoded)
            cache.update((p, np.array(ids, "<u4").tobytes()) for p, ids in zip(new, encoded, strict=True))
        head, tail = (np.array([x], "<u4").tobytes() for x in (self.begin, self.end))
        known = cache.__getitem__
        out = [head + b"".join(map(known, parts)) + tail for parts in cut]
        if self.check and texts:
            # One whole text a batch as well: that the cuts are where no piece reaches across.
            at = min(range(len(texts)), key=lambda i: (abs(len(texts[i]) - 2000), i))
            want = self.library.encode(texts[at], add_bos=True, add_eos=True)
            if np.frombuffer(out[at], "<u4").tolist() != want:
                raise ValueError(f"text of {len(texts[at])} characters differs from the library's encoding")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 text of ids: pieces joined, the space in front taken off."""
        surface = self.surface
        said = ids[~self.silent[ids]].tolist() if len(ids) else []
        whole = b"".join([surface[i] for i in said])
        if said and self.leads[said[0]]:
            whole = whole[1:]
        if said and self.raw[said].any():
            # One replacement character for each byte that is no part of a character.
            whole = whole.decode(errors="each_byte").encode()
        return whole


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """One row per document: ids, and the text decoded from them."""
    return _run(docs, model_path, key, text, check, "key bigint, ids array<bigint>, decoded string", lambda ids, decoded: (
        [np.frombuffer(i, "<u4").tolist() for i in ids], [d.decode() for d in decoded]), ("ids", "decoded"),
        (pa.list_(pa.int64()), pa.string()))


def digest(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", check: bool = True) -> DataFrame:
    """One row per document: (key, n_tokens, ids_sha256, decoded_sha256)."""
    return _run(docs, model_path, key, text, check, SCHEMA, lambda ids, decoded: (
        [len(i) // 4 for i in ids], [hashlib.sha256(i).hexdigest() for i in ids],
        [hashlib.sha256(d).hexdigest() for d in decoded]), ("n_tokens", "ids_sha256", "decoded_sha256"),
        (pa.int64(), pa.string(), pa.string()))


def _run(docs, model_path, key, text, check, schema, shape, names, kinds) -> DataFrame:
    # The model file (about 0.5 MB, fixed) is read on the driver and travels to the tasks.
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("sentencepiece", hash(model.value), check), lambda: AgendaEncoder(model.value, check))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = encoder.encode_batch([t or "" for t in part.column(1).to_pylist()])
                decoded = [encoder.decode(np.frombuffer(i, "<u4")) for i in ids]
                arrays = [pa.array(c, k) for c, k in zip(shape(ids, decoded), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *arrays], names=["key", *names])

    return only(docs, key=key, text=text).mapInArrow(tidy(run, keeps=True), schema).withColumnRenamed("key", key)
