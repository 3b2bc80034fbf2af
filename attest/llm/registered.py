"""The queries of the numbered operators over their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import (bpe_count, context_tree, decontaminate, exact_dedup, html_text, language_kernel, license_scan, phrases, quality,
                        sentencepiece_bpe, simhash, token_alignment, url_filter)
from attest.llm.queries import query, table

# The rules (host, path, action) and the host labels whose pages form the block list.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
LISTED_LABELS = ["adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
_LISTED = r"(^|\.)(" + "|".join(LISTED_LABELS) + r")\."

_CANON_SQL = r"""
    select *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)\.', '') as h0,
           regexp_replace(path, '(\.html|/+)$', '') as p0,
           list_sort([x for x in string_split(substr(q, 2), '&')
                      if x <> '' and not regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid)(=|$)')]) as kept
    from (select page_id, url,
                 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 1), ''),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 2), '') as path,
                 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '') as q
          from pages)
"""
_RULES_SQL = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
_OP1_SQL = f"""
with c as (
  select page_id, url, host, path,
         case when h0 <> '' then h0 || p0 || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canon
  from ({_CANON_SQL})),
listed as (select distinct canon from c where regexp_matches(host, '{_LISTED}') and canon is not null),
rules(rh, rp, action) as (values {_RULES_SQL}),
best as (
  select u.url, min(struct_pack(l := -length(rh || rp), rule := rh || rp, action := action)) as b
  from (select distinct url, host, path from c where url is not null and host <> '') u
  join rules on (u.host = rh or ends_with(u.host, '.' || rh)) and starts_with(u.path, rp)
  group by 1)
select c.page_id, c.host, c.path, b.rule as rule, listed.canon is not null as listed,
       coalesce(b.action, case when listed.canon is not null then 'block' else 'allow' end) as verdict
from c left join best using (url) left join listed using (canon)
"""


@query("op1_url_filter", _OP1_SQL)
def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(_LISTED)).select("url")
    return url_filter.judge(pages, listed, rules)


@query("op2_license_scan")
def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.score(docs, table(spark, folder, "labels"), keep_text=False)
    return judged.select("doc_id", F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"),
                         F.col("_path_rate").alias("path_rate"), F.col("_quality").alias("quality"), F.col("_kept").alias("kept"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_count.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


_OP5_SQL = """
select doc_id, max(doc_id) over t as keep_id, count(*) over t as group_size, doc_id = max(doc_id) over t as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window t as (partition by coalesce(text, ''))
"""


@query("op5_exact_dedup", _OP5_SQL)
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, folder, "documents"))


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


# Words as lists; an item's windows and a document's windows of the same length meet in a join,
# and a word is hit when it stands within the reach of a window that starts at or before it.
_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP7_SQL = f"""
with iw as (select item_id, {_WORDS_SQL} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as window_text
  from (select item_id, w, unnest(range(1, greatest(2, len(w) - 8))) as i from iw where len(w) > 0)),
sizes as (select distinct n from win),
dw as (select doc_id, row_number() over () as r, {_WORDS_SQL} as w from documents),
places as (
  select r, n, i, array_to_string(w[i:i + n - 1], ' ') as window_text
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
found as (select p.r, p.i, p.n, win.item_id from places p join win using (n, window_text)),
words as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from found) group by r),
items as (select r, count(distinct item_id) as n_items,
                 string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as names from found group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join words using (r) left join items using (r)
"""


@query("op7_decontamination", _OP7_SQL)
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_bpe.digest(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op10_context_tree")
def op10_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return context_tree.score(table(spark, folder, "documents"))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.report(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


# All phrases of up to three words inside the pieces, counted; then the cuts, and what longer ones share.
_OP12_SQL = r"""
with w as (
  select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w
  from (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents)),
f as (
  select lang, p, len(p) as size, count(*) as n
  from (select lang, w[i:i + k - 1] as p from (select lang, w, unnest(range(1, len(w) + 1)) as i from w), (values (1), (2), (3)) ks(k)
        where i + k - 1 <= len(w))
  group by 1, 2),
totals as (select lang, sum(n)::bigint as n from f where size = 1 group by 1),
inside as (
  select lang, part, max(n) as most
  from (select lang, n, unnest([p[1:2], p[2:3]]) as part from f where size = 3 and n >= 10) group by 1, 2),
cuts as (
  select c.lang, c.p, c.n as a, k, x.n as l, y.n as r,
         (1000000::hugeint * c.n * c.n) // (x.n::hugeint * y.n) as score
  from (select f.*, unnest(range(1, size)) as k from f left join inside i on i.lang = f.lang and i.part = f.p
        where f.size > 1 and f.n >= 10 and (most is null or 100 * most < 50 * f.n)) c
  join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:c.size]),
lowest as (select lang, array_to_string(p, ' ') as phrase, a, min(struct_pack(score := score, k := k, l := l, r := r)) as s from cuts group by lang, p, a),
placed as (select lang, row_number() over (partition by lang order by s.score desc, a desc, phrase) as rank, phrase, a, s.l as l, s.r as r, s.score::bigint as score from lowest)
select lang, rank, phrase, a, l, r, n, score from placed join totals using (lang) where rank <= 2000
"""


@query("op12_phrases", _OP12_SQL)
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_language_id")
def op13_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_kernel.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"))
