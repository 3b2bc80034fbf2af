import math
import random

import pytest
from pyspark.sql import functions as F

from attest.llm import decontaminate as D
from attest.llm import html_text as H
from attest.llm import license_scan as L
from attest.llm import url_filter as U
from attest.llm.registered import RULES

from .helpers import by_id, clashing, documents, needs_tables, SF, sha, words

URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "http://example.net", "http://example.net/", "http://b.net?x=/",
    "http://x.org/fr/1", "http://x.org/de/1", "http://m.spam.example.org/p.html?utm_source=a&b=2&a=1#top",
    "https://spam.example.org/p/?a=1&ref=z&b=2", "https://spam.example.org/p/?a=1", "http://notexample.com/de/", "http://example.com/de/",
    "http://xexample.net/en/", "http://a.b.example.com/de", "http://m.spam.example.org/p.html?utm_source=a&b=2&a=1#top",
]
RULE_SCHEMA = "host string, path string, action string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id bigint, url string, html string")


def brute(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [(len(h + p), h + p, a) for h, p, a in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fit)[1:] if fit else (None, "block" if url in listed else "allow")
    return host, path, *rule


def test_urls_follow_rules_and_list(spark):
    listed = pages(spark, ["https://www.spam.example.org/p?b=2&a=1", None, "x", "https://www.spam.example.org/p?b=2&a=1"])
    out = by_id(U.judge(clashing(pages(spark, URLS)), listed, spark.createDataFrame(RULES, RULE_SCHEMA)), "page_id")
    known = {URLS[10], URLS[11]}
    for i, u in enumerate(URLS):
        got = out[i]
        assert (got["host"], got["path"], got["rule"], got["verdict"]) == brute(u, known), u
        assert got["listed"] == (u in known)


def test_filter_has_no_false_negative_and_join_takes_the_rest(spark):
    keys = spark.range(5000).select(F.concat(F.lit("U|k"), "id").alias("key"))
    asked = spark.range(0, 20000, 2).select(F.concat(F.lit("U|k"), "id").alias("key"))
    for n_blocks in (1, 16, 1024):
        passed = U.possible_hits(asked, U.build_filter(keys, n_blocks), n_blocks)
        assert passed.join(keys, "key").count() == 2500
    assert passed.count() < 2600
    assert U.blocks_for(0) == 16 and U.blocks_for(10**12) == U.MAX_BLOCKS


def test_url_filter_without_rows_or_entries(spark):
    none = pages(spark, []).where("false")
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    assert U.judge(none, none, rules).count() == 0
    out = by_id(U.judge(pages(spark, URLS), none, rules.where("false")), "page_id")
    assert {r["verdict"] for r in out.values()} == {"allow"} and len(out) == len(URLS)


def test_url_plan_is_native(spark, capsys):
    U.judge(pages(spark, URLS), pages(spark, URLS), spark.createDataFrame(RULES, RULE_SCHEMA)).explain()
    assert "Python" not in capsys.readouterr().out.replace("python", "")


LICENSES = [
    None, "", "...", "Released under the MIT License.", "under the mit-license; UNDER THE MIT LICENSE under the mit licens",
    "licensed under CC BY-NC 4.0. " * 3, "Apache License, Version 2.0 and under the MIT license",
    "This work is licensed under the GNU General Public License, version 3.", "mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "word " * 20000 + "under the mit license " + "end " * 20000,
]


def test_licenses_against_brute_force(spark):
    out = by_id(L.scan(clashing(documents(spark, LICENSES))))
    for i, t in enumerate(LICENSES, 1):
        w = words(t)
        places = sorted((s, label) for phrase, label in L.BASE.items() for s in range(len(w))
                        if w[s:s + len(phrase.split())] == phrase.split())
        got = out[i]
        assert (got["n_words"], got["n_base"]) == (len(w), len(places)), t
        assert (got["first_word"], got["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert got["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, got["base_labels"].split(","))) <= set(filter(None, got["labels"].split(",")))
        assert 0 <= got["score"] <= 1
    assert out[8]["labels"] == "gpl-3" and out[10]["labels"] == "mit" and out[9]["labels"] == ""
    assert L.scan(documents(spark, LICENSES).where("false")).count() == 0


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=x>Menu</a></nav><header>Top</header>
<div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>The one <b>and  the</b> only<br>line of it all.<p>Short
<div id=comments><p>First! the best of the comments is in the page and it is that of the one</div><script>var a="</p>";</script>
<form><input>Name</form><aside>See also</aside><p>End.</article><div class=ad>Buy</div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    assert H.main_text(PAGE) == "A & B\nThe one and the only line of it all.\nShort\nEnd."


def test_text_without_a_container_goes_by_density():
    body = ("<body><div><p>" + "The cat is in the house and the dog was out of it for the day and so on. " * 4 + "</p><p>Short one.</p>"
            "<div><a href=1>Link one of the many</a> <a href=2>Link two of the many</a></div></div></body>")
    assert H.main_text(body).split("\n")[1:] == ["Short one."]


@pytest.mark.parametrize("page,text", [
    ("", ""), ("<p>", ""), ("plain", "plain"), ("<article>a&nbsp;b &#233; <p", "a b é"), ("<!-- <article>x</article> -->", ""),
    ("<article><script>x", ""), ("<article>1 < 2 and 3</article>", "1 < 2 and 3"), ("<main>a<hr>b</main>c", "a\nb"),
    ("<article class='post with-sidebar'>a<article class='comment even'>b</article></article><article class=related>c</article>", "a"),
    ("<article>" + "<p>x" * 30000 + "</article>", "\n".join(["x"] * 30000)),
])
def test_odd_pages(page, text):
    assert H.main_text(page) == text


def test_extract_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (2, None, None)], "page_id bigint, url string, html string")
    rows = sorted(tuple(r) for r in H.extract(clashing(df)).select("page_id", "n_chars").collect())
    assert rows == [(1, len(H.main_text(PAGE))), (2, 0), (2, 0)]
    assert H.extract(df.where("false")).count() == 0


def brute_hits(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        iw = words(t)
        n = min(10, len(iw))
        wins = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if n else set()
        for i in range(len(w)):
            if n and tuple(w[i:i + n]) in wins:
                hit.update(range(i, i + n))
                found.add(item)
    return len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def contaminated_case():
    rng = random.Random(3)
    items = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.choice([0, 1, 2, 3, 9, 10, 11, 30])))) for i in range(40)]
    items += [(7, "Ä b, c"), (99, None), (100, "..."), (5, "zz Yy")]
    texts = [None, "", ". ,", "zz-yy", "x ä B c x", "x" * 50] + [
        " ".join(rng.choice("abcdef") for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["w " * 3000 + (items[3][1] or "a") + " w" * 3000, "q " + " ".join(t or "" for _, t in items)]
    return items, texts


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination_against_brute_force(spark, block_bytes):
    items, texts = contaminated_case()
    bench = spark.createDataFrame([*items, (None, "a a a a a")], "item_id bigint, text string")
    out = by_id(D.report(clashing(documents(spark, texts)), clashing(bench), block_bytes=block_bytes))
    for i, t in enumerate(texts, 1):
        assert tuple(out[i][c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) == brute_hits(t, items), t
    kept = {r.doc_id for r in D.clean(documents(spark, texts), bench).collect()}
    assert kept == {i for i in out if not out[i]["contaminated"]}


def test_decontamination_of_empty_tables(spark):
    docs, bench = documents(spark, ["a b"]), spark.createDataFrame([], "item_id bigint, text string")
    assert not by_id(D.report(docs, bench))[1]["contaminated"]
    assert D.report(docs.where("false"), bench).count() == 0


def test_spans_point_into_the_original():
    text = "Hé, One  TWO--three! four".encode()
    a = D.build([(1, "one two three")])
    spans, ids = D.scan(a, b" " + b" ".join(D.words_of(text)) + b" ")
    assert ids == {1} and [text[x:y].decode() for x, y in D.original_spans(text, D.merged(spans))] == ["One  TWO--three"]


@needs_tables
def test_pages_of_the_tables_keep_their_articles(spark):
    rows = H.extract(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    assert rows and all("©" not in r["text"] and "track(" not in r["text"] for r in rows)


PROSE = "It is one of the things that they had to see for it was not as good as this one was."
PAGES = {
    # Names around an article tell of its layout.
    f'<div class="page with-sidebar"><article><p>{PROSE}</p></article></div>': PROSE,
    f'<div class="content header-fixed"><article><p>{PROSE}</p></article></div>': PROSE,
    f'<div class="sidebar"><main><p>{PROSE}</p></main></div>': PROSE,
    f'<div class="comments"><article><p>{PROSE}</p></article></div><article><p>Mine. {PROSE}</p></article>': f"Mine. {PROSE}",
    f'<article><p data-id="share-1">{PROSE}</p><p class="share-list">Share it</p><p id="grid">and so on</p></article>': f"{PROSE}\nand so on",
    # Without an article: names, notices, word lists, long blocks without stop words.
    f'<div class="content header-fixed"><p>{PROSE}</p></div><div class="site-header"><p>{PROSE}</p></div>': PROSE,
    f'<p>{PROSE}</p><p>Copyright 2020 Some People. All rights reserved.</p>': PROSE,
    f'<ul><li>Alpha</li><li>Beta</li><li>Gamma</li></ul><p>{PROSE}</p>': PROSE,
    f'<p>{PROSE}</p><p>{"Widget gadget sprocket " * 12}</p><p>So it is.</p>': PROSE,
    # Inside an article all of these stay.
    f'<article><p>{PROSE}</p><p>All rights reserved.</p><ul><li>Alpha</li><li>Beta</li><li>Gamma</li></ul></article>':
        f"{PROSE}\nAll rights reserved.\nAlpha\nBeta\nGamma",
}


@pytest.mark.parametrize("page", PAGES)
def test_zones_and_block_rules(page):
    assert H.main_text(page) == PAGES[page]


def test_license_labels_and_scores_by_trying_every_offset(spark):
    r = random.Random(7)
    vocab = [w.decode() for w in L.vocabulary()]
    texts = list(LICENSES)
    for _, sentence, _ in L.TEMPLATES * 3:
        w = sentence.split()
        for i in range(len(w)):
            if r.random() < 0.15:
                w[i] = r.choice(vocab)
        cut = r.randrange(4)
        texts.append(" ".join(r.choice(vocab) for _ in range(r.randrange(9))) + " " + " ".join(w[cut:] if r.random() < 0.3 else w) + " end " * r.randrange(3))
    split = [words(t) for t in texts]
    freq = {w: sum(w in s for s in split) for w in vocab}
    idf = {w: math.log((len(texts) + 1) / (freq[w] + 1)) + 1.0 for w in vocab}
    templates = [(label, p.split(), [p.split()], True) for p, label in L.BASE.items()] + [(label, t.split(), [p.split() for p in need], False) for label, t, need in L.TEMPLATES]
    out = by_id(L.scan(documents(spark, texts)))
    some = 0
    for i, w in enumerate(split, 1):
        want = []
        for label, t, needed, base in templates:
            for at in range(-len(t), len(w)):
                here = [0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(t)]
                starts = [next(k for k in range(len(t)) if t[k:k + len(p)] == p) for p in needed]
                if all(all(here[s:s + len(p)]) for s, p in zip(starts, needed)):
                    share = sum(idf[x] for x, h in zip(t, here) if h) / sum(idf[x] for x in t)
                    if base or share >= L.MIN_SHARE:
                        want.append((label, at + starts[0], round(share, 9)))
        got = sorted((p["label"], p["start"], round(p["share"], 9)) for p in out[i]["places"])
        assert got == sorted(want), texts[i - 1]
        assert out[i]["labels"] == ",".join(sorted({x[0] for x in want})) and out[i]["score"] == pytest.approx(min(1.0, max((x[2] for x in want), default=0.0)))
        some += len(want)
    assert some > 30  # that there is something to find
