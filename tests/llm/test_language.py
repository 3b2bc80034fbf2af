"""Language identification: the kernel by sets, the solution by its definition, accuracy on rows held out."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from attest.llm import language_kernel as K

from .helpers import LOWER, SF, by_id, clashing, documents, needs_tables


def spectrum(text):
    b = text.translate(LOWER).encode()
    return {b[i:i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}


def pair_kernel(x, y):
    return len(x & y) / (max(1, len(x)) * len(y)) ** 0.5


def some_texts():
    r = random.Random(2)
    return ["", "A", "aa", "aAa", "é", "日本語", "x" * 3000, *["".join(r.choice("abc dE.é\n") for _ in range(r.randrange(300))) for _ in range(30)]]


def test_spectra_and_kernel_by_sets():
    spectra = K.Spectra()
    texts = some_texts()
    for t in texts * 2:  # what one text leaves in the scratch table plays no part for the next
        codes = spectra.of(t.encode())
        assert len(codes) == len(set(codes.tolist())) == len(spectrum(t))
    marks = [t for t in texts if t][:9]
    sets = [spectra.of(t.encode()) for t in marks]
    columns = K.Columns(np.unique(np.concatenate(sets)))
    z = columns.presence([t.encode() for t in marks])[0].T
    rows, size = columns.presence([t.encode() for t in texts])
    got = K.kernel(rows, size, z, np.array([len(s) for s in sets], float))
    want = [[pair_kernel(spectrum(t), spectrum(m)) for m in marks] for t in texts]
    assert np.allclose(got, want)


def test_solution_minimises_the_penalised_error():
    g = np.random.default_rng(0)
    base = g.random((40, 6))
    k, language = base @ base[:6].T, g.integers(0, 3, 40)
    kzz = base[:6] @ base[:6].T
    beta = K.solve(k, language, kzz, 3, ridge=0.5)
    target = (language[:, None] == np.arange(3)).astype(float)
    cost = lambda b: ((k @ b - target) ** 2).sum() + 0.5 * np.trace(b.T @ kzz @ b)
    assert all(cost(beta) <= cost(beta + 1e-3 * g.standard_normal(beta.shape)) + 1e-9 for _ in range(50))


def langs(spark, n=240):
    r = random.Random(9)
    words = {"aa": ["the", "of", "and", "thing"], "bb": ["der", "und", "straße", "ging"], "cc": ["ñu", "que", "el", "cañón"]}
    rows = []
    for i in range(n):
        x = r.choice(list(words))
        rows.append((i, " ".join(r.choice(words[x]) for _ in range(r.randrange(3, 30))), x))
    return rows


def test_scores_are_those_of_the_kernel_expansion(spark):
    """The multiplied-out matrix gives the same as summing kernels with the landmarks."""
    rows = langs(spark)
    df = spark.createDataFrame([(t, x, False) for _, t, x in rows], "text string, lang string, held boolean")
    model = K.fit(df, landmarks=12)
    out = {r.text: (r.lang_pred, r.score) for r in K.apply(df.select("text", F.col("text").alias("again")), model)
           .withColumnRenamed("again", "text").collect()}
    first = {x: sorted({t for _, t, y in rows if y == x}) for x in model.languages}
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    marks = [(i, t) for i, x in enumerate(model.languages) for t in sorted(first[x], key=hashes.get)[:4]]
    texts = [(i, t) for i, x in enumerate(model.languages) for t in first[x]]
    k = np.array([[pair_kernel(spectrum(t), spectrum(m)) for _, m in marks] for _, t in texts])
    kzz = np.array([[pair_kernel(spectrum(a), spectrum(b)) for _, b in marks] for _, a in marks])
    scores = k @ K.solve(k, np.array([i for i, _ in texts]), kzz, 3)
    for (_, t), s in zip(texts, scores):
        assert out[t][0] == model.languages[s.argmax()]
        assert abs(out[t][1] - min(1, max(0, s.max()))) < 1e-3


def test_held_out_labels_play_no_part(spark):
    rows = langs(spark)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows}
    make = lambda change: clashing(spark.createDataFrame([(i, t, change(i, x)) for i, t, x in rows], "doc_id bigint, text string, lang string"))
    out = by_id(K.identify(make(lambda i, x: x)))
    assert {i: r["held_out"] for i, r in out.items()} == held and any(held.values())
    assert all(out[i]["lang_pred"] == x and 0 <= out[i]["score"] <= 1 for i, _, x in rows if held[i])
    assert by_id(K.identify(make(lambda i, x: "zz" if held[i] else x))) == out


def test_odd_rows(spark):
    rows = [(i, t, x, None, 0) for i, t, x in langs(spark, 60)]
    odd = [None, "", " 12 .", "日", "é", "q" * 300000, "the of"]
    more = [(1000 + i, t, None, "s", 1) for i, t in enumerate(odd)] + [(None, "the and", "aa", None, None)] * 2
    df = spark.createDataFrame(rows + more, documents(spark, []).schema)
    out = K.identify(df).collect()
    assert len(out) == len(rows + more)
    by = {r.doc_id: r for r in out}
    assert [(by[i].lang_pred, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1006].lang_pred == "aa" and all(by[i].lang_pred in ("aa", "bb", "cc") for i in (1003, 1004, 1005))
    assert [r.held_out for r in out if r.doc_id is None] == [False] * 2
    nothing = K.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert K.identify(df.where("false")).count() == 0


@needs_tables
def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = K.identify(docs).where("held_out").join(docs, "doc_id").collect()
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
