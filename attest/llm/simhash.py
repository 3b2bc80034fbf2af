"""SimHash near-duplicates with a byte-position inverted index and count filtering.

A fingerprint is eight bytes. Two fingerprints that differ in at most ``bits`` bits agree
in at least 8 - bits byte positions: that is the guaranteed minimum of matches. Postings
are keyed by a few byte positions together with their values; the position sets are
chosen so that every set of the guaranteed size contains one of them, so a linking pair
shares a posting. Inside a posting the equal positional bytes of a pair are tallied,
pairs below the minimum go, the rest is verified on all bits. A posting gives back a
spanning forest of its links, never all pairs; postings beyond POSTING_ROWS are compared
in pairs of blocks, each a unit of work of its own. Only distinct fingerprints take part.

Key width follows the number n of distinct fingerprints: the fewest positions m >= 2 with
n / 256^m <= 256, so a posting holds 256 rows on average at most, at any size.

Defined results: null, empty and wordless texts have fingerprint zero and link like any
other; equal fingerprints link; ids that are null take part but never name a component
unless all its ids are null; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import only, spare, tidy, tokens_of, utf8
from attest.operators.components import connected_components
from attest.session import settle

SHINGLE, SEED, BITS = 4, 42, 4
POSTING_ROWS = 4096
_CHUNK = 1 << 16


def votes_of(digests: bytes) -> np.ndarray:
    """How many of some big-endian 64-bit hashes have each bit."""
    return np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)


def majority(votes: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles: a bit is set where over half of their hashes have it."""
    words = tokens_of(text)
    if not words:
        return 0
    flat = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_digest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        last = min(n, at + _CHUNK)
        ends = starts[at + width:last + width] if len(words) >= width else [len(flat) + 1]
        votes += votes_of(b"".join([digest(flat[a:b - 1], SEED) for a, b in zip(starts[at:last], ends)]))
    return majority(votes, n)


def set_fingerprint(hashes: np.ndarray) -> int:
    """Signed SimHash of a set of 64-bit hashes."""
    votes = sum(votes_of(hashes[at:at + _CHUNK].astype(">u8").tobytes()) for at in range(0, len(hashes), _CHUNK))
    found = majority(votes, len(hashes))
    return found - (1 << 64) if found >> 63 else found


def fingerprints(docs: DataFrame, text: str = "text", out: str = "_fp") -> DataFrame:
    """``docs`` with its fingerprints as signed 64-bit numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())],
                                             names=[*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(run), f"{fields}, `{out}` bigint")


def position_sets(shared: int, width: int) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` positions contain one.

    For width 2 and 3 the positions are dealt into groups (by the pigeonhole principle two,
    or three in a cyclic pattern, must fall together); else all sets of that width.
    """
    if width >= shared:
        return list(combinations(range(8), shared))
    groups = [range(g * 8 // (shared - 1), (g + 1) * 8 // (shared - 1)) for g in range(shared - 1)]
    if width == 2:
        return [c for g in groups for c in combinations(g, 2)]
    if width == 3 and shared == 4:
        inside = [c for g in groups for c in combinations(g, 3)]
        cyclic = [(*pair, x) for g in range(3) for pair in combinations(groups[g], 2) for x in groups[(g + 1) % 3]]
        return [tuple(sorted(c)) for c in inside + cyclic]
    return list(combinations(range(8), width))


def key_width(n: int, shared: int) -> int:
    width = 2
    while width < shared and n > 256 ** (width + 1):
        width += 1
    return min(width, shared)


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << (8 * p) for p in positions)
    return value - (1 << 64) if value >> 63 else value


def postings(distinct: DataFrame, shared: int, width: int, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """(part, key, lo, hi, block, fp): rows of one (part, key, lo, hi) are compared together."""
    sets = position_sets(shared, width)
    keyed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_mask(s))).alias("key"))
        for i, s in enumerate(sets)])).alias("p")).select("p.part", "p.key", "fp")
    hot = (keyed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > posting_rows)
           .select("part", "key", F.ceil(F.col("n") / (posting_rows // 2)).cast("int").alias("blocks")))
    dealt = keyed.join(hot, ["part", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    return dealt.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "part", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the trees of a[i] and b[i]; every node points at its root before and after."""
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above


def forest(group: np.ndarray, fp: np.ndarray, shared: int, bits: int, as_found: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links inside each group; ``group`` holds equal values in runs.

    With ``as_found`` the links that joined two trees, in place of each row and the root of its tree."""
    n = len(group)
    edge = np.append(True, group[1:] != group[:-1])
    sizes = np.diff(np.append(np.flatnonzero(edge), n))
    remaining = np.repeat(np.cumsum(sizes), sizes) - np.arange(n)  # rows from here to the end of the group
    root = np.arange(n)
    at = np.flatnonzero(remaining > 1)
    step, found = 1, []
    while len(at):
        apart = at[root[at] != root[at + step]]
        differ = fp[apart] ^ fp[apart + step]
        equal = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # positional bytes that agree
        able = equal >= shared
        link = apart[able][np.bitwise_count(differ[able]) <= bits]
        if len(link):
            root = unite(root, link, link + step)
            found.append((fp[link], fp[link + step]))
        step += 1
        at = at[remaining[at] > step]
    if as_found:
        return tuple(np.concatenate([fp[:0], *side]) for side in zip(*found)) if found else (fp[:0], fp[:0])
    child = np.flatnonzero(root != np.arange(n))
    return fp[child], fp[root[child]]


def links(posted: DataFrame, shared: int, bits: int, as_found: bool = False) -> DataFrame:
    """(u, v) spanning links of all postings."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            change = np.append(False, (rows[1:, :4] != rows[:-1, :4]).any(1))
            a, b = forest(np.cumsum(change), np.ascontiguousarray(rows[:, 4]).view(np.uint64), shared, bits, as_found)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["u", "v"])

        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([held, new]) if len(held) else new
            # The last group may go on in the next batch; a group has a bounded number of rows.
            differs = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1)) if len(rows) else []
            cut = int(differs[-1]) + 1 if len(differs) else 0
            held = rows[cut:]
            if cut:
                yield out(rows[:cut])
        if len(held):
            yield out(held)

    keys = ["part", "key", "lo", "hi"]
    dealt = posted.select(*keys, "fp").repartition(*keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(tidy(run), "u bigint, v bigint")


def all_links(distinct: DataFrame, bits: int = BITS, posting_rows: int = POSTING_ROWS, as_found: bool = False) -> DataFrame:
    """(u, v) links that span the components of distinct(fp)."""
    shared = 8 - bits
    if shared < 2:
        raise ValueError("at most 6 differing bits: fewer than two bytes would have to agree")
    posted = postings(distinct, shared, key_width(distinct.count(), shared), posting_rows)
    return links(posted, shared, bits, as_found)


def candidates(prints: DataFrame, bits: int = BITS, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """(u, v), u < v: pairs of the distinct prints(id, fp) that differ in at most ``bits`` bits, enough of them to span
    each component; ids of one fingerprint are paired with the smallest."""
    first = settle(prints.groupBy("fp").agg(F.min("id").alias("first")))
    found = all_links(first.select("fp"), bits, posting_rows, as_found=True).distinct()
    side = lambda name: first.select(F.col("fp").alias(name), F.col("first").alias(f"{name}_id"))
    across = found.join(side("u"), "u").join(side("v"), "v").select("u_id", "v_id")
    inside = prints.join(first, "fp").where(F.col("id") != F.col("first")).select(F.col("first").alias("u_id"), F.col("id").alias("v_id"))
    return across.union(inside).select(F.least("u_id", "v_id").alias("u"), F.greatest("u_id", "v_id").alias("v")).distinct()


def components(prints: DataFrame, bits: int = BITS, posting_rows: int = POSTING_ROWS) -> DataFrame:
    """(fp, component_id) of prints(id, fp): the smallest id reachable over links."""
    distinct = settle(prints.groupBy("fp").agg(F.min("id").alias("first")))
    roots = connected_components(all_links(distinct.select("fp"), bits, posting_rows)).select(F.col("node").alias("fp"), "root")
    tied = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return tied.join(tied.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """One row per document: (key, fingerprint, component_id)."""
    prints = settle(fingerprints(only(docs, id=key, text=text), "text", "fp").select(F.col("id").cast("bigint").alias("id"), "fp"))
    found = components(prints, bits)
    return prints.join(found, "fp").select(
        F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (of
    several with that id, the one with the smallest content hash; equal rows once)."""
    sign = F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    prints = settle(fingerprints(docs.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").alias("text"),
                                             sign.alias("sign")), "text", "fp").select("id", "sign", "fp"))
    found = prints.join(components(prints.select("id", "fp"), bits), "fp")
    # One row for a component; a null id names it only where there is no other.
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("sign").alias("sign")))
    by_name = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_alone"))
    # Keys without nulls: the join and the removal of repeated rows then share one shuffle.
    names = spare(docs.columns, "none", "id", "sign")
    parts = (F.col("b.none"), F.coalesce("b.id", F.lit(0)), F.col("b.sign"))
    stay = settle(by_name.agg(best.alias("b")).select(*[c.alias(n) for n, c in zip(names, parts)]))
    own = F.col(f"`{key}`").cast("bigint")
    marked = docs.withColumns(dict(zip(names, (own.isNull(), F.coalesce(own, F.lit(0)), sign))))
    kept = marked.join(stay, names, "left_semi").dropDuplicates(names)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
