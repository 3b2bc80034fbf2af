import json
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attest.llm import bpe_count as B
from attest.llm import sentencepiece_bpe as S

from .helpers import by_id, clashing, documents, sha

rng = random.Random(1)
ODD = [None, "", " ", "\n", "▁", "a▁b", "  a  b ", "aaaa" * 700, "ab" * 3000, "<|endoftext|>" * 3, "x<|startoftext|><|endoftext|>",
       "it's we'LL İΣΑΣ ß ①½ ٣", "ȩ́ 가", "\x00\x1c\x85　", "𐍈😀é", "<s>hi</s><unk><0x41>",
       "".join(rng.choice("abcdefgh") for _ in range(20000))]
ODD += ["".join(rng.choice("aaab a eè\n\t<ßΣİi_(){}=;.,--0x123😀𐍈▁中文'") for _ in range(rng.randrange(200))) for _ in range(300)]
EVERY = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]


@pytest.fixture(scope="module")
def merger():
    return B.RankMerger(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


@pytest.fixture(scope="module")
def encoder():
    return S.AgendaEncoder(open(P.path("piece_bpe_32k.model"), "rb").read())


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    out = by_id(B.count_tokens(clashing(documents(spark, ODD)), P.path("word_bpe_49k.json")))
    for i, t in enumerate(ODD, 1):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 2048)
    assert B.count_tokens(documents(spark, ["a"]).where("false"), P.path("word_bpe_49k.json")).count() == 0


def test_counts_of_every_character(merger):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [f"a{c}1{c} b{c}" for c in EVERY]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert merger.count_texts(texts) == want


def test_merging_in_order_where_a_product_ranks_first():
    # "ab"+"c" is made by two ways; a merge of the product ranks before the merge that makes it.
    vocab = {c: i for i, c in enumerate([*B.byte_letters(), *[c + "$" for c in B.byte_letters()]])}
    merges = [["abc", "d"], ["b", "c"], ["a", "bc"], ["a", "a"], ["aa", "a"]]
    for a, b in merges[1:] + merges[:1]:
        vocab[a + b] = len(vocab)
    split = {"type": "Split", "pattern": {"Regex": r"[\p{L}]+"}}
    m = B.RankMerger(json.dumps({"added_tokens": [], "pre_tokenizer": {"pretokenizers": [split]},
                                 "model": {"vocab": vocab, "end_of_word_suffix": "$", "merges": merges}}))

    def brute(word):
        letters = B.byte_letters()
        s = [letters[b] for b in word.encode()]
        s[-1] += "$"
        rank = {tuple(p): i for i, p in enumerate(merges)}
        while True:
            best = min(((rank.get((a, b), 99), i) for i, (a, b) in enumerate(zip(s, s[1:]))), default=(99, 0))
            if best[0] == 99:
                return len(s)
            s[best[1]:best[1] + 2] = [s[best[1]] + s[best[1] + 1]]

    some = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["a" * n for n in range(1, 20)]
    assert m.count(some).tolist() == [brute(w) for w in some]


def test_pieces_and_text_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    path = P.path("piece_bpe_32k.model")
    out = by_id(S.digest(clashing(documents(spark, ODD)), path))
    full = by_id(S.encode(documents(spark, ODD), path))
    for i, t in enumerate(ODD, 1):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        text = library.decode(ids)
        assert out[i]["n_tokens"] == len(ids) and full[i]["ids"] == ids and full[i]["decoded"] == text
        assert out[i]["decoded_sha256"] == sha(text)
    assert S.digest(documents(spark, ["a"]).where("false"), path).count() == 0


def test_pieces_of_every_character(encoder):
    texts = ["".join(EVERY[i:i + 40]) for i in range(0, len(EVERY), 40)]
    want = encoder.library.encode(texts, add_bos=True, add_eos=True)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode_batch(texts)] == want


def test_decoding_of_any_ids(encoder):
    for _ in range(2000):
        ids = [rng.randrange(32000) if rng.random() < 0.7 else rng.randrange(260) for _ in range(rng.randrange(8))]
        assert encoder.decode(np.array(ids, np.int64)).decode() == encoder.library.decode(ids), ids


def test_a_wrong_part_stops_the_job(encoder):
    with pytest.raises(ValueError, match="library gives"):
        encoder._verify(["▁word"], [[1, 2, 3]])
