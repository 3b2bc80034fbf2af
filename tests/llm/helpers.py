"""Small tables and brute-force versions."""

import hashlib
import os
import re
from itertools import combinations

import pytest
import xxhash

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def documents(spark, texts, first=1):
    """A documents table; extra columns carry names the operators use inside."""
    rows = [(first + i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def clashing(df):
    from pyspark.sql import functions as F

    names = ["key", "gid", "row", "fp", "id", "words", "_k", "h", "n", "word", "code", "bucket", "path", "host", "rule",
             "verdict", "keep_id", "kept", "good", "size"]
    return df.select("*", *[F.lit("x").alias(n) for n in names if n not in df.columns])


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def simhash(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not tokens:
        return 0
    grams = [" ".join(tokens[i:i + 4]) for i in range(max(1, len(tokens) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
