"""Columns that bear the names operators use inside stay as they are, and results don't change."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from attest.llm import bpe_count, context_tree, decontaminate, exact_dedup, language_kernel, license_scan, phrases, quality
from attest.llm import sentencepiece_bpe, shingle_join, simhash, token_alignment
from attest.llm.common import spare

from .helpers import documents

INSIDE = ("id none sign items words spans row evidence host_rate path_rate quality kept rh rp pr hh hr key text_ fp h node "
          "label good host path lang_ rank n code bucket gid component_id root keep_id size_ span doc").split()
TEXTS = ["Some words that are here to be read by all of them now and then.", "Some words that are here to be read by all of them now and then.",
         "a b c d e f g h i j k l m n o p q r s t u v w x y z", "a b c d e f g h i j k l m n o p q r s t u v w x y", None, "", "Plain. Text, here"]


def tables(spark):
    plain = documents(spark, TEXTS)
    extra = [x for n in INSIDE for x in (n, "_" + n) if x not in plain.columns]
    loud = plain.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in extra])
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(5, "a b c d e f g h i j k l"), (6, "nothing of it")], "item_id bigint, text string")
    return plain, loud, extra, labels, bench


def rows(df, columns):
    return sorted(map(repr, df.select(*[F.col(f"`{c}`") for c in columns]).collect()))


def test_stages_give_back_every_column(spark):
    plain, loud, extra, labels, bench = tables(spark)
    stages = [lambda d: exact_dedup.keep_one(d), lambda d: shingle_join.keep_one(d), lambda d: simhash.keep_one(d),
              lambda d: decontaminate.clean(d, bench)]
    for stage in stages:
        out = stage(loud)
        assert out.columns == loud.columns
        assert rows(out, plain.columns) == rows(stage(plain), plain.columns)
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in extra)


def test_added_columns_take_free_names(spark):
    plain, loud, extra, labels, bench = tables(spark)
    for run, names in ((lambda d: quality.score(d, labels), quality.added_names), (lambda d: decontaminate.find_hits(d, bench), decontaminate.added_names)):
        a, b = run(plain), run(loud)
        assert b.columns[:len(loud.columns)] == loud.columns and len(set(b.columns)) == len(b.columns)
        mine, theirs = names(plain.columns), names(loud.columns)
        assert not set(theirs) & set(loud.columns)
        mine, theirs = [c for c in mine if c in a.columns], [c for c in theirs if c in b.columns]
        assert sorted(map(str, a.select("doc_id", *mine).toPandas().values.tolist())) == sorted(map(str, b.select("doc_id", *theirs).toPandas().values.tolist()))
    assert spare(["_a", "__b"], "a", "b") == ["___a", "___b"] and spare(["_A"], "a") == ["__a"]


def test_pipeline_stages_with_loud_columns(spark, tmp_path):
    plain, loud, extra, labels, bench = tables(spark)
    for name, docs in (("plain", plain), ("loud", loud)):
        d = str(tmp_path / name)
        docs.write.parquet(f"{d}/documents.parquet")
        labels.write.parquet(f"{d}/labels.parquet")
        bench.write.parquet(f"{d}/benchmark.parquet")
    out = [sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path / n)).collect())) for n in ("plain", "loud")]
    assert out[0] == out[1]


import public_tokenizers  # noqa: E402

REPORTS = {
    "licenses": lambda d, b: license_scan.scan(d), "tokens": lambda d, b: bpe_count.count_tokens(d, public_tokenizers.path("word_bpe_49k.json")),
    "copies": lambda d, b: exact_dedup.dedup(d), "hits": lambda d, b: decontaminate.report(d, b),
    "pieces": lambda d, b: sentencepiece_bpe.digest(d, public_tokenizers.path("piece_bpe_32k.model")), "prints": lambda d, b: simhash.near_duplicates(d),
    "model": lambda d, b: context_tree.score(d), "phrases": lambda d, b: phrases.collocations(d, least=1), "languages": lambda d, b: language_kernel.identify(d),
    "groups": lambda d, b: token_alignment.report(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, name):
    plain, loud, extra, labels, bench = tables(spark)
    a, b = REPORTS[name](plain, bench), REPORTS[name](loud, bench.withColumn("_item", F.lit("x")).withColumn("item", F.lit("y")))
    columns = [c for c in a.columns if c in b.columns]
    assert columns and rows(a, columns) == rows(b, columns)


def test_items_of_any_size_make_bounded_blocks(spark):
    """One item has a third of all rows, another is one long text."""
    long = " ".join(f"w{i % 700}" for i in range(3000))
    items = [(1, f"hot row number {i} with some more words in it to make windows of ten") for i in range(40)] + [(2, long)] + [
        (i, f"item {i} " * 8) for i in range(3, 60)]
    texts = ["x " + long[50:300] + " y", items[7][1], "item 9 " * 20, "w1 w2 w3", None, long]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    blocks = decontaminate.item_blocks(bench, "item_id", "text", 10, 400)
    sizes = [sum(len(r.text) for r in b.collect()) for b in blocks]
    assert len(blocks) > 5 and max(sizes) <= 800
    docs = documents(spark, texts)
    assert rows(decontaminate.report(docs, bench, block_bytes=400), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]) == \
        rows(decontaminate.report(docs, bench), ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
