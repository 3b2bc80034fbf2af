"""License scan with a positional index of rare licence words.

Templates are short licence sentences with mandatory key phrases. Corpus-wide document
frequencies of the template vocabulary give each word's IDF. The ANCHORS highest-IDF words of
every template and of each mandatory phrase are posted as (template, position). In a file,
every occurrence of a posted word votes for the offset that its relative position gives
each of its templates; an offset is a candidate when all anchors of the mandatory phrases
agree on it. There the phrases are verified word by word, and the IDF share of template
words standing at the offset is the score; the other anchors add to a template's first share, and an
offset whose votes leave less than MIN_SHARE within reach is not looked at.

Defined results: null and wordless texts have zero words, no places and no labels, score
0; ties between templates give one label each; order and repeats of rows play no part.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import only, utf8, words_of, tidy

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Fixed values: (label, sentence, mandatory phrases of it).
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that",
     ["redistribution and use in source and binary forms"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nc", "creative commons attribution noncommercial", ["creative commons attribution noncommercial"]),
    ("cc-by", "creative commons attribution 4 0 international", ["creative commons attribution 4 0"]),
]
ANCHORS = 3
# Share of a template's IDF weight that has to stand at the offset besides its phrases.
MIN_SHARE = 0.5

SCHEMA = ("key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, places array<struct<label:string,start:bigint,share:double>>")


def _all_templates() -> list[tuple[str, list[bytes], list[list[bytes]], bool]]:
    base = [(label, p.encode().split(), [p.encode().split()], True) for p, label in BASE.items()]
    return base + [(label, t.encode().split(), [p.encode().split() for p in need], False)
                   for label, t, need in TEMPLATES]


def vocabulary() -> list[bytes]:
    return sorted({w for _, words, _, _ in _all_templates() for w in words})


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Documents, and documents with each template word; counted over all rows.

    The result has one row per template word, so its size does not depend on the data.
    """
    vocab = frozenset(vocabulary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()
        for batch in batches:
            for t in utf8(batch.column(0)):
                found.update(vocab.intersection(words_of(t)))
                found[b""] += 1
        yield pa.RecordBatch.from_pydict({"word": [w.decode() for w in found], "n": list(found.values())})

    rows = only(docs, text=text).mapInArrow(tidy(count), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    freq = {r["word"].encode(): r["n"] for r in rows.collect()}
    return freq.pop(b"", 0), freq


class Index:
    """Postings of the anchors, with IDF weights."""

    def __init__(self, n_docs: int, freq: dict[bytes, int], anchors: int = ANCHORS):
        self.templates = _all_templates()
        self.idf = {w: math.log((n_docs + 1) / (freq.get(w, 0) + 1)) + 1.0 for w in vocabulary()}
        # word -> (template, position in it, its anchor's bit)
        self.postings: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
        self.phrases: list[list[tuple[int, list[bytes]]]] = []
        self.needed: list[int] = []  # bits of the mandatory phrases' anchors
        self.absent: list[list[tuple[int, float]]] = []  # of the other anchors: bit and IDF
        self.weight = [sum(self.idf[w] for w in t[1]) for t in self.templates]
        for number, (_, words, needed, _) in enumerate(self.templates):
            spans = []
            for phrase in needed:
                start = next(i for i in range(len(words)) if words[i:i + len(phrase)] == phrase)
                spans.append((start, phrase))
            self.phrases.append(spans)
            rarest = lambda places: sorted(places, key=lambda i: (-self.idf[words[i]], i))[:anchors]
            inside = sorted({i for start, phrase in spans for i in rarest(range(start, start + len(phrase)))})
            other = [i for i in rarest(range(len(words))) if i not in inside]
            for bit, at in enumerate(inside + other):
                self.postings[words[at]].append((number, at, 1 << bit))
            self.needed.append((1 << len(inside)) - 1)
            self.absent.append([(1 << len(inside) + n, self.idf[words[at]]) for n, at in enumerate(other)])

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start of its first phrase, IDF share) of every verified place."""
        votes: dict[tuple[int, int], int] = defaultdict(int)
        postings = self.postings
        for i in [i for i, w in enumerate(words) if w in postings]:
            for number, at, bit in postings[words[i]]:
                votes[number, i - at] |= bit
        out = []
        for (number, offset), got in votes.items():
            needed = self.needed[number]
            if got & needed != needed:
                continue
            _, template, _, base = self.templates[number]
            missed = sum(w for bit, w in self.absent[number] if not got & bit)
            if not base and self.weight[number] - missed < MIN_SHARE * self.weight[number]:
                continue
            if all(offset + s >= 0 and words[offset + s:offset + s + len(p)] == p for s, p in self.phrases[number]):
                stand = sum(self.idf[w] for j, w in enumerate(template) if 0 <= offset + j < len(words) and words[offset + j] == w)
                out.append((number, offset + self.phrases[number][0][0], stand / self.weight[number]))
        return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: base places, labels, score and all verified places."""
    index = Index(*document_frequencies(docs, text))
    arrow = pa.schema([
        ("key", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
        ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, k in zip(utf8(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                words = words_of(t)
                found = index.scan(words)
                base = [(index.templates[n][0], s) for n, s, _ in found if index.templates[n][3]]
                kept = [(index.templates[n][0], s, x) for n, s, x in found if index.templates[n][3] or x >= MIN_SHARE]
                rows.append({
                    "key": k, "n_words": len(words), "n_base": len(base),
                    "first_word": min((s for _, s in base), default=None),
                    "last_word": max((s for _, s in base), default=None),
                    "base_labels": ",".join(sorted({label for label, _ in base})),
                    "labels": ",".join(sorted({label for label, _, _ in kept})),
                    "score": min(1.0, max((x for _, _, x in kept), default=0.0)),
                    "places": [{"label": label, "start": s, "share": x} for label, s, x in kept],
                })
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return only(docs, key=key, text=text).mapInArrow(tidy(run), SCHEMA).withColumnRenamed("key", key)
