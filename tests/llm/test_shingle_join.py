import random
from itertools import combinations

import pytest
import xxhash

import corpus_pipeline
from attest.llm import shingle_join as J

from .helpers import LOWER, by_id, clashing, documents, roots


def grams(text):
    tokens = (text or "").translate(LOWER).split()
    return {" ".join(tokens[i:i + 5]) for i in range(max(1, len(tokens) - 4))}


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def near_texts():
    """Copies around the bound: changed words cost five shingles each; a passage that is in many texts; a large group."""
    r = random.Random(3)
    word = lambda: f"w{r.randrange(5000)}"
    passage = " ".join(word() for _ in range(30))
    out = [None, "", " \n", "A b", "a  B", "one two three"]
    for k in range(25):
        words = [word() for _ in range(r.randrange(60, 300))]
        out.append(" ".join(words) + (" " + passage if k % 2 else ""))
        for changed in range(1, 9):
            near = list(words)
            for at in r.sample(range(len(near)), changed):
                near[at] = word()
            out.append(" ".join(near) + (" " + passage if k % 3 else ""))
    base = [word() for _ in range(120)]
    for _ in range(60):
        near = list(base)
        near[r.randrange(120)] = word()
        near[r.randrange(120)] = word()
        out.append(" ".join(near))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("common,compact,small,block,cells", [(4096, 1 << 21, 16, 256, 1 << 23), (3, 4, 1, 7, 5000), (4096, 1 << 21, 4, 30, 1)])
def test_stage_against_brute_force_jaccard(spark, monkeypatch, common, compact, small, block, cells):
    """Fingerprints of at most four differing bits kept most copies between 0.8 and 0.95, and linked some below."""
    monkeypatch.setattr(J, "COMMON", common)
    monkeypatch.setattr(J, "_COMPACT", compact)
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "_CELLS", cells)
    texts = near_texts()
    sets = {i: grams(t) for i, t in enumerate(texts, 1)}
    pairs = [(a, b) for a, b in combinations(sets, 2) if alike(sets[a], sets[b])]
    assert any(len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b]) for a, b in pairs)
    want = roots(list(sets), lambda a, b: alike(sets[a], sets[b]))
    docs = clashing(documents(spark, texts)).repartition(5)
    stage = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert stage.columns == docs.columns
    assert sorted(by_id(stage)) == sorted(set(want.values()))


def set_print(text):
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams(text)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_gives_the_first_candidates(spark, monkeypatch):
    """The stage went by shared shingles alone."""
    asked, met = [], []
    real, check = J.candidates, J.verified
    monkeypatch.setattr(J, "candidates", lambda prints: asked.append((prints, real(prints))) or asked[-1][1])
    monkeypatch.setattr(J, "verified", lambda pairs, *a: met.append({(r.u, r.v) for r in pairs.collect()}) or check(pairs, *a))
    texts = near_texts()
    kept = corpus_pipeline.drop_near_copies(spark, documents(spark, texts), "").count()
    prints = {r.id: r.fp & (1 << 64) - 1 for r in asked[0][0].collect()}
    assert sorted(prints.values()) == sorted(set_print(t) for t in {frozenset(grams(t)): t for t in texts}.values())
    pairs = {(r.u, r.v) for r in asked[0][1].collect()}
    assert met[0] == pairs and len(pairs) > 10
    assert all((prints[u] ^ prints[v]).bit_count() <= 4 and u < v for u, v in pairs)
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4
    assert roots(list(prints), near) == roots(list(prints), lambda a, b: (a, b) in pairs)
    assert not any(pairs & more for more in met[1:])  # prefixes only add to it
    sets = {i: grams(t) for i, t in enumerate(texts, 1)}
    assert kept == len(set(roots(list(sets), lambda a, b: alike(sets[a], sets[b])).values()))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, "zz yy xx")],
                               "doc_id bigint, text string")
    assert sorted(str(r.doc_id) for r in J.keep_one(df).collect()) == ["3", "None"]
    assert J.keep_one(df.where("false")).count() == 0
