"""URL filter: a blocked Bloom filter lets possible hits through to an exact hash join.

Listed entries are keys of two kinds: canonical URLs of a block list, and rules of a
host suffix with a path prefix. Every URL has a few candidate keys (its canonical form,
and each host suffix with each path prefix of a length that occurs among the rules).
The filter holds one 256-bit block per row; candidates meet their block in an equi-join
on the block number and test eight bits inside it. What passes is joined on the whole
key with the entries, so false positives vanish there and results are exact at any
fill of the filter.

Defined results: null or scheme-less URLs have empty host and path, are never listed and
fit no rule; repeated URLs and entries count once; without entries all is allowed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import only

# Query parameters that do not change the page.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=|$)"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?"
# A block has four 64-bit words; each key sets two bits in each.
WORDS = 4
KEYS_PER_BLOCK = 16
MAX_BLOCKS = 1 << 18  # 18 MB of blocks at most: the bound of what is broadcast


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www./m. and default port, path without .html and closing slash,
    remaining parameters in order; null where there is no host."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/+)$", "")
    query = F.substring(F.coalesce(F.regexp_extract(url, _URL, 3), F.lit("")), 2, 1 << 30)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(host, path, tail))


def entries(listed: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """(key, rule, action) of a block list and of rules(host, path, action)."""
    urls = only(listed, url=url).select(canonical(F.col("url")).alias("_c")).where("_c is not null").distinct()
    text = F.concat("host", "path")
    return urls.select(
        F.concat(F.lit("U|"), "_c").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("action")
    ).unionByName(
        rules.select(F.concat(F.lit("R|"), text).alias("key"), text.alias("rule"), "action").distinct()
    )


def _spots(key: Column, n_blocks: int) -> list[Column]:
    """Block number, and the bits a key sets in each word of its block."""
    mixed = F.xxhash64(key, F.lit("bits"))
    out = [F.pmod(F.xxhash64(key), F.lit(n_blocks)).cast("int").alias("_block")]
    for i in range(WORDS):
        bits = [F.shiftrightunsigned(mixed, 12 * i + 6 * j).bitwiseAND(F.lit(63)).cast("int") for j in (0, 1)]
        one = F.lit(1).cast("bigint")
        words = [F.call_function("shiftleft", one, b) for b in bits]
        out.append(words[0].bitwiseOR(words[1]).alias(f"_m{i}"))
    return out


def blocks_for(n_keys: int) -> int:
    """A power of two with about KEYS_PER_BLOCK keys in a block, MAX_BLOCKS at most."""
    return min(MAX_BLOCKS, 1 << max(4, math.ceil(math.log2(max(1, n_keys) / KEYS_PER_BLOCK + 1))))


def build_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """The filter as rows (_block, _w0.._w3); ``n_blocks`` bounds their number."""
    spots = keys.select(*_spots(F.col("key"), n_blocks))
    return spots.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])


def possible_hits(candidates: DataFrame, bloom: DataFrame, n_blocks: int) -> DataFrame:
    """Candidates (with a column ``key``) whose bits are all set in their block."""
    test = " and ".join(f"(_w{i} & _m{i}) = _m{i}" for i in range(WORDS))
    probed = candidates.select("*", *_spots(F.col("key"), n_blocks))
    return probed.join(F.broadcast(bloom), "_block").where(test).select(*candidates.columns)


def candidate_keys(host: Column, path: Column, canon: Column, lengths: list[int]) -> Column:
    """All keys under which an entry could name this URL."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    prefixes = F.filter(
        F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths] or [F.lit(None).cast("string")]),
        lambda p: p.isNotNull(),
    )
    by_rule = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(F.lit("R|"), s, p))))
    by_rule = F.when(host != "", by_rule).otherwise(F.array().cast("array<string>"))
    by_url = F.when(canon.isNotNull(), F.array(F.concat(F.lit("U|"), canon))).otherwise(F.array().cast("array<string>"))
    return F.concat(by_rule, by_url)


def judge(pages: DataFrame, listed: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
          listed_url: str = "url") -> DataFrame:
    """One row per row of ``pages``: (key, host, path, rule, listed, verdict).

    The longest fitting rule decides; without one, listed URLs are blocked.
    """
    known = entries(listed, rules, listed_url)
    # The distinct path lengths of rules are few: no path is longer than a URL may be.
    facts = rules.select(F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    n_blocks = blocks_for(known.count())
    base = only(pages, key=key, url=url)
    urls = base.select("url").where("url is not null").distinct()
    asked = urls.select("url", F.explode(F.array_distinct(candidate_keys(
        host_of(F.col("url")), path_of(F.col("url")), canonical(F.col("url")), facts["lengths"]))).alias("key"))
    hits = possible_hits(asked, build_filter(known, n_blocks), n_blocks).join(known, "key")
    best = hits.groupBy("url").agg(
        F.min(F.when(F.col("rule").isNotNull(), F.struct((-F.length("rule")).alias("l"), "rule", "action"))).alias("best"),
        F.max(F.col("rule").isNull()).alias("listed"),
    )
    listed_here = F.coalesce(F.col("listed"), F.lit(False))
    return base.join(best, "url", "left").select(
        F.col("key").alias(key),
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"), listed_here.alias("listed"),
        F.coalesce(F.col("best.action"), F.when(listed_here, "block").otherwise("allow")).alias("verdict"),
    )
