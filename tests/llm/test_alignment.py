"""Cross-tokenizer alignment against a plain version with the two libraries."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attest.llm import token_alignment as T
from attest.llm.bpe_count import byte_letters

from .helpers import by_id, clashing, documents, sha

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """Per text: the groups as id lists, or None where the tokens don't spell space + text."""
    a_side, b_side = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_side.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = a_side.encode(" " + t, add_special_tokens=False).ids, b_side.encode(t)
        bytes_a = [bytes(byte_of[c] for c in a_side.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_side.id_to_piece(i)[3:5], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
            out.append(None)
            continue
        groups, i, j = [], 0, 0
        while i < len(a):
            g, x, y = ([a[i]], [b[j]]), len(bytes_a[i]), len(bytes_b[j])
            i, j = i + 1, j + 1
            while x != y:
                if x < y:
                    g[0].append(a[i]); x += len(bytes_a[i]); i += 1
                else:
                    g[1].append(b[j]); y += len(bytes_b[j]); j += 1
            groups.append(g)
        out.append(groups)
    return out


def texts_of():
    r = random.Random(4)
    words = ["the", "Straße", "naïve", "日本語", "🙂🙂", "x86_64", "<|endoftext|>", "</s>", "<0x41>", "\n\n", "\t", "don't", "1234567", "ﬃ", "é", "\x00"]
    some = [" ".join(r.choice(words) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return [None, "", " ", "a", "a", "with ▁ mark", "▁", *some, "long " * 30000, "z" * 20000, some[0], some[0]]


@pytest.mark.parametrize("frequent", [1 << 20, 40, 1])
def test_report_against_the_libraries(spark, frequent):
    texts = texts_of()
    want = plain(texts)
    count = Counter((g[0][-1], g[1][-1]) for groups in want for g in groups or ())
    most = defaultdict(int)
    for (a, b), n in count.items():
        most[b] = max(most[b], n)
    out = by_id(T.report(clashing(documents(spark, texts)).repartition(3), A, B, frequent=frequent))
    assert len(out) == len(texts) and want[5] is None and want[6] is None
    for i, groups in enumerate(want, 1):
        groups = groups or []
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        assert out[i] == {
            "doc_id": i, "n_a": sum(len(g[0]) for g in groups), "n_b": sum(len(g[1]) for g in groups), "n_groups": len(groups),
            "n_links": len(groups), "n_best": sum(count[x] == most[x[1]] for x in links), "count_sum": sum(count[x] for x in links),
            "groups_sha256": sha(text) if groups else ""}, texts[i - 1][:40]


def test_groups_as_lists(spark):
    texts = texts_of()
    out = by_id(T.groups(clashing(documents(spark, texts)), A, B))
    for i, groups in enumerate(plain(texts), 1):
        groups = groups or []
        assert out[i]["a_sizes"] == [len(g[0]) for g in groups] and out[i]["b_sizes"] == [len(g[1]) for g in groups]
        assert out[i]["a_ids"] == [x for g in groups for x in g[0]] and out[i]["b_ids"] == [x for g in groups for x in g[1]]


def test_pointers_against_common_ends():
    r = np.random.default_rng(1)
    for _ in range(300):
        n = int(r.integers(1, 60))
        ends = [np.union1d(r.choice(np.arange(1, n + 1), int(r.integers(0, n)), replace=False), [n]) for _ in range(2)]
        common = np.intersect1d(*ends)
        for got, side in zip(T.align(*ends), ends):
            assert got.tolist() == np.searchsorted(common, side).tolist()
    # A chain as long as the text: no common end before the last.
    got = T.align(np.append(np.arange(1, 9999, 2), 10000), np.arange(2, 10001, 2))
    assert all((g == 0).all() for g in got)


def test_odd_tables(spark):
    none = documents(spark, ["a"]).where("false")
    assert T.report(none, A, B).count() == 0 and T.groups(none, A, B).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (7, "a b"), (7, None)], "doc_id bigint, text string")
    out = sorted((r.doc_id is None, r.n_links, r.count_sum) for r in T.report(rows, A, B).collect())
    assert out == [(False, 0, 0), (False, 2, 6), (True, 2, 6), (True, 2, 6)]
