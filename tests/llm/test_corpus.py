import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from attest.llm import context_tree as C
from attest.llm import exact_dedup as E
from attest.llm import quality as Q
from attest.llm import simhash as S
from attest.llm.queries import ORACLES, QUERIES, load

from .helpers import DOC_SCHEMA, SF, by_id, clashing, documents, needs_tables, roots, sha, simhash

rng = random.Random(5)
TEXTS = [None, "", "", "a", "a ", "A", "a", "é" * 9, "é" * 9, "x" * 70000] + ["hot text"] * 60 + [f"t{i % 13}" * 40 for i in range(80)]


# Exact deduplication.

def brute_groups(texts):
    groups = {}
    for i, t in enumerate(texts, 1):
        groups.setdefault(t or "", []).append(i)
    return {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}


@pytest.mark.parametrize("task_bytes,bucket_bytes,load", [(1 << 20, 1 << 20, 2.0), (50, 1000, 0.3)])
def test_exact_dedup_through_all_levels(spark, monkeypatch, task_bytes, bucket_bytes, load):
    """With a low load buckets overfill and pass through spill files of further levels."""
    levels = []
    real = E._bucket
    monkeypatch.setattr(E, "_bucket", lambda level, fan: levels.append(level) or real(level, fan))
    texts = TEXTS
    df = clashing(documents(spark, texts)).repartition(5)
    got = by_id(E.dedup(df, task_bytes=task_bytes, bucket_bytes=bucket_bytes, load=load))
    assert (max(levels) > 0) == (load < 1)
    want = brute_groups(texts)
    assert {i: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for i, r in got.items()} == want
    kept = {r.doc_id: r for r in E.keep_one(df, task_bytes=task_bytes, bucket_bytes=bucket_bytes, load=load).collect()}
    assert set(kept) == {i for i, w in want.items() if w[2]}
    assert all(r.n_chars == len(r.text) and r.source == f"s{(i - 1) % 3}" for i, r in kept.items())


def test_equal_rows_and_null_ids(spark):
    rows = [(4, "a"), (4, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    out = E.dedup(df).collect()
    assert sorted((r.keep_id, r.group_size) for r in out) == [(2, 3)] * 3 + [(4, 3)] * 3
    assert sorted(r.doc_id for r in out if r.kept) == [2, 4]
    assert E.dedup(df.where("false")).count() == 0 and E.keep_one(df.where("false")).count() == 0
    alone = spark.createDataFrame([(None, "z")] * 3, "doc_id bigint, text string")
    assert [r.keep_id for r in E.dedup(alone).where("kept").collect()] == [None]


def test_table_tells_equal_hashes_apart():
    t = E.ContentTable(4)
    assert [t.find_or_add(7, c) for c in (b"a", b"b", b"a", b"c")] == [(0, True), (1, True), (0, False), (2, True)]
    assert [t.find_or_add(h, b"%d" % h)[1] for h in range(100)] == [True] * 100 and t.find_or_add(7, b"b") == (1, False)


# SimHash.

def test_fingerprints_and_components(spark):
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(150)) for _ in range(8)]
    near = [b.replace(" " + b.split()[k] + " ", " changed ", 1) for b in base for k in (3, 70, 120)]
    texts = [None, "", " \n", "A b", "a  B", "one two three"] + base + near + base[:2] * 5
    out = by_id(S.near_duplicates(clashing(documents(spark, texts, first=10))))
    prints = {i: simhash(t) for i, t in enumerate(texts, 10)}
    assert {i: int(r["fingerprint"], 16) for i, r in out.items()} == prints
    want = roots(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {i: r["component_id"] for i, r in out.items()} == want
    kept = [r.doc_id for r in S.keep_one(documents(spark, texts, first=10)).collect()]
    assert sorted(kept) == sorted(set(want.values()))


@pytest.mark.parametrize("posting_rows", [4096, 4])
def test_links_of_many_fingerprints(spark, posting_rows):
    gen = np.random.default_rng(2)
    centre = gen.integers(0, 1 << 63, 12, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in gen.choice(64, int(gen.integers(1, 6)), replace=False)) for c in centre for _ in range(15)]
    values = sorted({*map(int, centre), *near, 0, 15, 31})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    prints = spark.createDataFrame(list(enumerate(signed)), "id bigint, fp bigint")
    got = {r.fp: r.component_id for r in S.components(prints, posting_rows=posting_rows).collect()}
    want = roots(range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count() <= 4)
    assert got == {signed[i]: c for i, c in want.items()}


def test_every_set_of_shared_bytes_has_a_posting():
    from itertools import combinations
    for width, size in ((2, 7), (3, 20), (4, 70)):
        sets = S.position_sets(4, width)
        assert len(sets) == size
        assert all(any(set(s) <= set(c) for s in sets) for c in combinations(range(8), 4))
    assert [S.key_width(n, 4) for n in (1, 1 << 24, (1 << 24) + 1, 1 << 32, 1 << 40)] == [2, 2, 3, 3, 4]


def test_simhash_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "zz yy xx")],
                               "doc_id bigint, text string")
    out = S.near_duplicates(df).collect()
    assert sorted(str(r.component_id) for r in out) == ["3", "3", "3", "3", "None"]
    assert sorted(str(r.doc_id) for r in S.keep_one(df).collect()) == ["3", "None"]
    assert S.near_duplicates(df.where("false")).count() == 0 and S.keep_one(df.where("false")).count() == 0


# Quality.

@needs_tables
def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    out = Q.score(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").select("quality", "_kept").collect()
    good = [r for r in out if r.quality == 1]
    bad = [r for r in out if r.quality == 0]
    assert sum(r._kept for r in good) / len(good) > 0.98
    assert sum(not r._kept for r in bad) / len(bad) > 0.9


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [("big", "p", int(i < 90)) for i in range(100)] + [("bad", "p", int(i < 10)) for i in range(100)] + [("tiny", "p", 0), (None, None, 1)]
    rates, mean = Q.site_rates(spark.createDataFrame(rows, "host string, path string, good int"))
    by = {r.host: r for r in rates.collect()}
    assert by["big"].path_rate > 0.8 and by["bad"].path_rate < 0.2
    assert 0 < by["tiny"].path_rate < mean < by[None].path_rate < 1
    # A path with one label stays near its host, the host of a hundred labels near its own rate.
    more, _ = Q.site_rates(spark.createDataFrame([*rows, ("big", "q", 0)], "host string, path string, good int"))
    q = next(r for r in more.collect() if r.host == "big" and r.path == "q")
    assert q.path_rate > 0.3


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [None, "", "  ", "Some plain words here.", "x" * 50000, "Some plain words here."])
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0), (5, None, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    out = by_id(Q.score(clashing(docs), labels))
    assert [out[i]["_kept"] for i in (1, 2, 3)] == [False] * 3 and out[1]["_quality"] == 0
    assert out[4]["_kept"]
    assert all(r["_kept"] for i, r in by_id(Q.score(docs, labels.where("false"))).items() if i > 3)
    assert Q.score(docs.where("false"), labels).count() == 0
    twice = docs.union(docs)
    assert Q.score(twice, labels).count() == 12


# Context-tree weighting.

def kt_sequence(bits):
    p, n = 1.0, [0, 0]
    for b in bits:
        p *= (n[b] + 0.5) / (sum(n) + 1)
        n[b] += 1
    return p


class Definition:
    """Trees of all nodes over whole contexts; a prediction is the quotient of two weighted probabilities."""

    def __init__(self, history):
        self.counts, self.children = {}, {}
        for ctx, byte in history:
            for k in range(8):
                node, bit = 1 << k | byte >> (8 - k), byte >> (7 - k) & 1
                for d in range(C.BEFORE + 1):
                    self.counts.setdefault((node, ctx[:d]), [0, 0])[bit] += 1
                    if d:
                        self.children.setdefault((node, ctx[:d - 1]), set()).add(ctx[:d])
        self.known = {}

    @staticmethod
    def kt(z, o):
        return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)

    def below(self, node, ctx):
        return sum(self.weighted(node, c) for c in self.children.get((node, ctx), ()))

    def weighted(self, node, ctx):
        if (node, ctx) not in self.counts:
            return 0.0
        if (node, ctx) not in self.known:
            own = self.kt(*self.counts[node, ctx])
            self.known[node, ctx] = own if len(ctx) == C.BEFORE else math.log(0.5) + np.logaddexp(own, self.below(node, ctx))
        return self.known[node, ctx]

    def bit(self, node, ctx, bit):
        new = None
        for d in range(C.BEFORE, -1, -1):
            z, o = self.counts.get((node, ctx[:d]), (0, 0))
            own = self.kt(z + (bit == 0), o + (bit == 1))
            if new is not None:
                own = math.log(0.5) + np.logaddexp(own, self.below(node, ctx[:d]) - self.weighted(node, ctx[:d + 1]) + new)
            new = own
        return new - self.weighted(node, b"")

    def byte(self, ctx, byte):
        return sum(self.bit(1 << k | byte >> (8 - k), ctx, byte >> (7 - k) & 1) for k in range(8))


def contexts_of(text):
    s = b"\xff" * C.BEFORE + text + b"\xff"
    return [(s[i - C.BEFORE:i][::-1], s[i]) for i in range(C.BEFORE, len(s))]


def test_codes_of_texts():
    texts = [b"", b"abcdefgh", b"", "é".encode(), b"xyz"]
    code, starts = C.laid_out(texts)
    want = [int.from_bytes(ctx + bytes([b]), "big") for t in texts for ctx, b in contexts_of(t)]
    assert code.tolist() == want and starts.tolist() == [0, 1, 10, 11, 14]


def test_log_kt(spark):
    cases = [(0, 0), (1, 0), (3, 5), (40, 2), (1000, 3000), (10 ** 9, 7)]
    for r in spark.createDataFrame(cases, "a bigint, b bigint").select("a", "b", C.log_kt(F.col("a"), F.col("b")).alias("got")).collect():
        # Near 10^9 both sides are differences of numbers of 2 x 10^10.
        assert r.got == pytest.approx(Definition.kt(r.a, r.b), rel=1e-7 if r.a > 10 ** 6 else 1e-12, abs=1e-9)
        assert C.log_kt_array(np.array([r.a]), np.array([r.b]))[0] == pytest.approx(r.got, rel=1e-7, abs=1e-9)
        if r.a + r.b < 100:
            assert r.got == pytest.approx(math.log(kt_sequence([0] * r.a + [1] * r.b)), abs=1e-9)


def test_contexts_grow_with_the_text(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(40)]
    def size(t):
        return C.count(C.in_chunks(documents(spark, t).select(F.col("doc_id").alias("id"), "text"))).where("word is null").select("code").distinct().count()
    assert size(texts) > 3.5 * size(texts[:10])


def test_codes_and_words_travel_packed(spark, monkeypatch):
    """There was a row for every code of a chunk, and one for every rare word of a document."""
    monkeypatch.setattr(C, "CHUNK", 20_000)
    r = random.Random(4)
    texts = ["".join(r.choice("abcdefgh é") for _ in range(300)) for _ in range(200)] + ["", None, " \t"]
    base = documents(spark, texts).repartition(2).select(F.col("doc_id").alias("id"), "text")
    rows = C.counted(base, C.LEAST_BITS).collect()
    codes, words = ([r for r in rows if r[c] is not None] for c in ("codes", "words"))
    every = Counter(c for t in texts for c in contexts_of((t or "").encode()))
    found = {int(c) for r in codes for c in C.unpack_codes(r["codes"], r["size"])}
    assert found == {int.from_bytes(ctx + bytes([b]), "big") for ctx, b in every} and len(rows) < len(found) / 10
    assert all(len(set(C.bucket_of(C.unpack_codes(r["codes"], r["size"]) >> C._GROUP_SHIFT, C.LEAST_BITS)) - {r["bucket"]}) == 0 for r in codes)
    learnt = Counter(w for i, t in enumerate(texts, 1) if zlib.crc32(str(i).encode()) % 10 for w in (t or "").encode().split())
    told = Counter()
    for r in words:
        for w, n in zip(C.unpack_words(r["words"]), C.unpack(r["counts"], r["size"], np.int32).tolist()):
            told[w] += n
    assert +told == learnt and b"" not in told


def lm_case():
    r = random.Random(8)
    words = [f"{a}{b}" for a in "kltr" for b in ("a", "é", "Io", "U")]
    return [None, "", " \t ", "hapax legomenon"] + [" ".join(r.choice(words) for _ in range(r.randrange(40))) for _ in range(120)] + ["kA " * 4000]


@pytest.mark.parametrize("frequent,chunk,piece", [(1 << 18, 16 << 20, 4 << 20), (20, 500, 200)])
def test_scores_against_brute_force(spark, monkeypatch, frequent, chunk, piece):
    monkeypatch.setattr(C, "FREQUENT", frequent)
    monkeypatch.setattr(C, "CHUNK", chunk)
    monkeypatch.setattr(C, "_PIECE", piece)
    monkeypatch.setattr(C, "_AT_ONCE", piece)
    texts = lm_case()
    out = by_id(C.score(clashing(documents(spark, texts))))
    low = [(t or "").encode().translate(C.LOWER_BYTES) for t in texts]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(1, len(texts) + 1)]
    tokens = [[*t.split(), None] for t in low]
    c = Counter(w for w_, h in zip(tokens, held) if not h for w in w_)
    n, v = sum(c.values()), len(c)
    model = Definition([x for t, h in zip(low, held) if not h for x in contexts_of(t)])
    price = {}

    for i, (t, s) in enumerate(zip(tokens, low), 1):
        got = out[i]
        assert (got["held_out"], got["n_tokens"], got["train_tokens"]) == (held[i - 1], len(t), n)
        assert got["n_known"] == sum(c[w] > 0 for w in t)
        assert got["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        for pair in contexts_of(s):
            if pair not in price:
                price[pair] = model.byte(*pair) / math.log(10)
        assert got["score"] == pytest.approx(sum(price[pair] for pair in contexts_of(s)), rel=1e-6)
        assert got["bits_per_byte"] == pytest.approx(-got["score"] / math.log10(2) / (len(s) + 1))


def test_scores_of_odd_tables(spark):
    docs = documents(spark, ["a b", None])
    assert C.score(docs.where("false")).count() == 0
    null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id bigint, text string")
    out = C.score(null).collect()  # held out, nothing to learn from
    assert [(r.held_out, r.n_known, r.train_tokens) for r in out] == [(True, 0, 0)] * 2
    assert out[0].score == pytest.approx(4 * 8 * math.log10(0.5), rel=1e-5) and out[0].base_score == pytest.approx(0.0)


# Registered queries and the pipeline.

def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(r[i] for i in order)) for r in rows)


@needs_tables
def test_queries_with_sql(spark):
    load()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in ORACLES.items():
        df = QUERIES[name](spark, SF)
        cur = con.execute(sql)
        assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in cur.description], cur.fetchall()), name


@needs_tables
def test_pipeline_against_its_parts(spark):
    """Brute-force stages from the classifier's decisions on; each works on what the one before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert first.columns == docs.columns
    left = {r.doc_id: r.text for r in first.collect()}
    assert len(left) > 0.6 * docs.count()
    last = {}
    for i, t in sorted(left.items()):
        last[t or ""] = i
    left = {i: t for i, t in left.items() if last[t or ""] == i}
    from .test_shingle_join import alike, grams
    sets = {i: grams(t) for i, t in left.items()}
    root = roots(list(left), lambda a, b: alike(sets[a], sets[b]))
    left = {i: t for i, t in left.items() if root[i] == i}
    from .test_url_and_text import brute_hits
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {i for i, t in left.items() if not brute_hits(t, items)[4]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == want


def test_pipeline_of_empty_and_repeated_rows(spark, tmp_path):
    text = "The quick brown fox jumps over the lazy dog and runs away from it."
    for name, rows in (("none", []), ("twice", [(1, text, None, None, None)] * 3 + [(2, None, None, None, 0), (None, text + " x", "en", "s", 1)])):
        d = str(tmp_path / name)
        spark.createDataFrame(rows, DOC_SCHEMA).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
        out = [r.doc_id for r in corpus_pipeline.run(spark, d).collect()]
        assert sorted(map(str, out)) == ([] if not rows else ["1", "None"]) or (rows and sorted(map(str, out)) == ["1"])
