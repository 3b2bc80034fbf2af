"""Near-duplicates by the Jaccard similarity of word shingles: SimHash first, then an exact prefix-filtered join.

A text is its set of five-word shingles (64-bit hashes; all words of a shorter text are one
shingle). Two texts are linked when their sets have a similarity of ALIKE or more.

Candidates come from SimHash first: fingerprints of the sets that differ in few bits, through the
byte-position index and count filter of ``simhash``, verified on the whole sets. Fingerprints of
texts at 0.8 differ in about ten bits, which such an index does not reach, so what it leaves
apart is completed, and every pair that is alike is found, by prefixes: ordered by (number of texts, hash), two such sets share a shingle
among their first n - ceil(ALIKE n) + 1, and one more is taken since shingles meet by
the bits of their bucket and 32 more only. Shingles of one text, most of all, come first and link nothing.
Pairs that meet are verified on their whole sets; nothing is sampled and no list is capped.

Numbers of texts are counted up to COMMON, beyond which shingles are equal in the order:
any common order is right, the rarest first is only the cheapest. They travel packed, 12
bytes each, by the first bits of their hashes: as many as give a bucket BUCKET_ENTRIES
shingles on average, by the counted number of all shingles.

Pairs of a posting are not made. Where SimHash has not linked all of its rows, they meet a few pivots,
those with the smallest share of shingles of their own, and what verifies is joined to components: most
of a large group of near copies is linked then. Postings that still have rows of different components are settled
exactly: those of up to SMALL rows by their pairs, larger ones by blocks of rows. There, rows not
linked to the posting's first pivot meet all rows that share this pivot, a block of sets with a
block of sets, as one product of presence matrices; a task gives back a spanning forest of
the links it finds, never pairs.

Defined results: null, empty and wordless texts have one empty shingle, and link to each
other; equal sets are one node, named by a 64-bit hash of the set; which row of a component
stays is said at ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.functions.scale import pack_blocks
from attest.llm.common import small_batches, spare, tidy, tokens_of, utf8
from attest.llm.simhash import candidates, set_fingerprint, unite
from attest.operators.components import connected_components
from attest.session import settle

SHINGLE, SEED = 5, 42
ALIKE = (4, 5)  # 0.8 as a fraction, so that sizes are compared in whole numbers
BUCKET_ENTRIES, LEAST_BITS = 1 << 20, 12
COMMON = 4096
_ENTRY = np.dtype([("h", "<u4"), ("node", "<i8")])
_FLUSH, _COMPACT = 500_000, 1 << 21
_TEXTS = 256  # texts whose sets are in memory together
_PIVOTS = 4
SMALL = 16  # rows of a posting whose pairs are made
BLOCK = 256  # sets of a block
_CELLS = 1 << 23  # of a presence matrix


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the word shingles, ascending."""
    words = tokens_of(text)
    flat = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    n = max(1, len(words) - width + 1)
    ends = starts[width:] if len(words) >= width else [len(flat) + 1]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(flat[a:b - 1], SEED) for a, b in zip(starts[:n], ends)])
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """The signed 64-bit name of a set."""
    name = xxhash.xxh64_intdigest(shingles.tobytes(), SEED)
    return name - (1 << 64) if name >> 63 else name


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(a) + len(b) - both)


def nodes_of(rows: DataFrame) -> DataFrame:
    """(id, sign, node, n, fp) of rows(id, sign, text); n is the size of the set, fp its SimHash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, fp = [], [], []
            for t in utf8(batch.column("text")):
                found = shingle_set(t)
                node.append(node_of(found))
                n.append(len(found))
                fp.append(set_fingerprint(found))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("sign"), *[pa.array(c, pa.int64()) for c in (node, n, fp)]],
                                             names=["id", "sign", "node", "n", "fp"])

    return rows.select("id", "sign", "text").mapInArrow(tidy(run), "id bigint, sign bigint, node bigint, n bigint, fp bigint")


def sets_of(rows: DataFrame) -> DataFrame:
    """(node, shingles) of rows(text), each set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _TEXTS):
                found = [shingle_set(t) for t in utf8(batch.column(0).slice(at, _TEXTS))]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()),
                                                  pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "shingles"])

    return rows.select("text").mapInArrow(tidy(run), "node bigint, shingles binary").dropDuplicates(["node"])


def bucket_bits(shingles: int) -> int:
    return min(31, max(LEAST_BITS, (shingles // BUCKET_ENTRIES).bit_length()))


def packed(rows: DataFrame, bits: int = LEAST_BITS) -> DataFrame:
    """(bucket, entries) of rows(text): the shingles of the texts by the first bits of their hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h = np.concatenate([s for s, _ in held])
            order = np.argsort(h)
            h = h[order]
            entries = np.empty(len(h), _ENTRY)
            entries["h"] = (h >> np.uint64(32 - bits)).astype(np.uint32)
            entries["node"] = np.repeat([n for _, n in held], [len(s) for s, _ in held])[order]
            bucket = (h >> np.uint64(64 - bits)).astype(np.int32)
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(first[1:], len(h))
            return pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([entries[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())],
                                              names=["bucket", "entries"])

        for batch in batches:
            for t in utf8(batch.column(0)):
                found = shingle_set(t)
                held.append((found, node_of(found)))
                size += len(found)
                if size >= _FLUSH:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return rows.select("text").mapInArrow(tidy(run), "bucket int, entries binary")


def shared(entries: DataFrame, common: int | None = None, compact: int | None = None) -> DataFrame:
    """(node, h, texts): shingles that several nodes have, with their number up to ``common``."""
    common, compact = common or COMMON, compact or _COMPACT

    def counted(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct entries by h, and how many each one's shingle has."""
        rows = np.unique(np.concatenate(held))
        first = np.flatnonzero(np.append(True, rows["h"][1:] != rows["h"][:-1]))
        times = np.diff(np.append(first, len(rows)))
        return rows, np.repeat(times, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(bucket: int, rows: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(rows["node"]), pa.array(rows["h"].astype(np.int64) | bucket << 32), pa.array(np.minimum(times, common).astype(np.int32))],
                names=["node", "h", "texts"])

        now, held, size, known = None, [], 0, np.zeros(0, np.uint32)

        def end() -> Iterator[pa.RecordBatch]:
            if held:
                rows, times = counted(held)
                several = times > 1
                if several.any():
                    yield out(now, rows[several], times[several])

        for batch in batches:
            for bucket, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if bucket != now:
                    yield from end()
                    now, held, size, known = bucket, [], 0, np.zeros(0, np.uint32)
                rows = np.frombuffer(value.as_buffer(), _ENTRY)
                if len(known):  # shingles known as common don't stay in memory
                    hot = np.isin(rows["h"], known)
                    if hot.any():
                        yield out(now, rows[hot], np.full(int(hot.sum()), common))
                        rows = rows[~hot]
                held.append(rows.copy())
                size += len(rows)
                if size > compact:
                    rows, times = counted(held)
                    hot = times >= common
                    if hot.any():
                        yield out(now, rows[hot], times[hot])
                        known = np.union1d(known, rows["h"][hot])
                    held = [rows[~hot]]
                    size = len(held[0]) // 2  # so that what stays is not sorted again for every row
        yield from end()

    dealt = entries.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(run), "node bigint, h bigint, texts int")


def prefixes(sizes: DataFrame, found: DataFrame) -> DataFrame:
    """(h, node, n, alone): the shared shingles among the first of each node, its size and how many of its shingles
    no other has; sizes(node, n), found(node, h, texts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 4), np.int64)

        def out(rows: np.ndarray) -> pa.RecordBatch:
            same = np.append(False, (rows[1:, :3] == rows[:-1, :3]).all(1))
            rows = rows[~same]
            head = np.flatnonzero(rows[:, 1] == 0)  # its size leads the rows of a node
            times = np.diff(np.append(head, len(rows)))
            n, there = rows[head, 3], times - 1
            least = -(-n * ALIKE[0] // ALIKE[1])
            take = n - least + 2 - (n - there)  # the others of its shingles come first
            spot = np.arange(len(rows)) - np.repeat(head, times)
            keep = (spot > 0) & (spot <= np.repeat(take, times))
            each = [pa.array(np.repeat(x, times)[keep]) for x in (n, n - there)]
            return pa.RecordBatch.from_arrays([pa.array(rows[keep, 2]), pa.array(rows[keep, 0]), *each], names=["h", "node", "n", "alone"])

        for batch in batches:
            new = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([held, new]) if len(held) else new
            differs = np.flatnonzero(rows[:, 0] != rows[-1, 0]) if len(rows) else []
            cut = int(differs[-1]) + 1 if len(differs) else 0
            held = rows[cut:]
            if cut:
                yield out(rows[:cut])
        if len(held):
            yield out(held)

    none = F.lit(0).cast("bigint")
    heads = sizes.select("node", F.lit(0).alias("texts"), none.alias("h"), "n")
    both = heads.union(found.select("node", "texts", "h", none.alias("n")))
    return both.repartition("node").sortWithinPartitions("node", "texts", "h").mapInArrow(tidy(run), "h bigint, node bigint, n bigint, alone bigint")


def sets_for(asked: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of asked(node), written; rows(id, sign, text) and nodes(id, sign, node) have their texts."""
    one = nodes.join(asked.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct(F.col("id").isNull().alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("sign").alias("_sign"))).alias("x"))
    wanted = settle(one.select("x._none", "x._id", "x._sign").distinct())
    marked = rows.select("text", F.col("id").isNull().alias("_none"), F.coalesce("id", F.lit(0)).alias("_id"), F.col("sign").alias("_sign"))
    return settle(sets_of(marked.join(wanted, ["_none", "_id", "_sign"], "left_semi")))


def verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs(u, v) that are alike."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64))
                    for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    sets = sets_for(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), rows, nodes)
    met = (pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u")
           .join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v"))
    return met.select("u", "v", "a", "b").mapInArrow(tidy(run), "u bigint, v bigint")


def _presence(sets: list[np.ndarray], known: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sets), len(known)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(known, s)
        at = at[known[np.minimum(at, len(known) - 1)] == s] if len(known) else at[:0]
        out[i, at] = 1
    return out


def alike_rows(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of two blocks are alike, as a matrix; long sets pass a few at a time."""
    out = np.zeros((len(left), len(right)), bool)
    size = np.array([len(s) for s in right])
    start = 0
    while start < len(left):
        end, cells = start, 0
        while end < len(left) and (end == start or cells + len(left[end]) * len(right) <= _CELLS):
            cells += len(left[end]) * len(right)
            end += 1
        some = left[start:end]
        known = np.unique(np.concatenate(some))
        both = _presence(some, known) @ _presence(right, known).T
        own = np.array([len(s) for s in some])[:, None]
        out[start:end] = ALIKE[1] * both >= ALIKE[0] * (own + size[None, :] - both)
        start = end
    return out


def block_links(keyed: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links between rows of keyed(lead, node, label, apart) with one lead and different labels, one of them ``apart``."""
    full = keyed.join(sets, "node").select("lead", "node", "label", "apart", "shingles")
    stored = pack_blocks(full, ["lead"], "node", ["label", "shingles"], BLOCK)
    counts = stored.groupBy("lead").agg(F.max("n_blocks").alias("all"))
    asked = (pack_blocks(full.where("apart"), ["lead"], "node", ["label", "shingles"], BLOCK).select("lead", F.col("rows").alias("probe"))
             .join(counts, "lead").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("all") - 1))))
    # Copies of blocks are invisible to the size estimate: never broadcast them.
    met = asked.hint("merge").join(stored.select("lead", "block", F.col("rows").alias("base")), ["lead", "block"]).select("probe", "base")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].values for c in ("probe", "base")]
                sets = [[np.frombuffer(v.as_buffer(), np.uint64) for v in x.field("shingles")] for x in sides]
                name, label = ([x.field(c).to_numpy(zero_copy_only=False) for x in sides] for c in ("node", "label"))
                hit = alike_rows(*sets) & (label[0][:, None] != label[1][None, :])
                a, b = np.nonzero(hit)
                if len(a):
                    every, at = np.unique(np.concatenate(name), return_inverse=True)
                    root = unite(np.arange(len(every)), at[a], at[len(name[0]) + b])
                    child = np.flatnonzero(root != np.arange(len(every)))
                    yield pa.RecordBatch.from_arrays([pa.array(every[child]), pa.array(every[root[child]])], names=["u", "v"])

    return met.mapInArrow(tidy(run), "u bigint, v bigint")


def links(posted: DataFrame, rows: DataFrame, nodes: DataFrame, pivots: int = _PIVOTS) -> DataFrame | None:
    """(node, root) of the nodes that are linked, over posted(h, node, n, alone); None where none are."""
    close = settle(candidates(nodes.select(F.col("node").alias("id"), "fp").distinct()))
    edges = settle(verified(close, rows, nodes))
    none = edges.isEmpty()
    roots = None if none else connected_components(edges)
    label = F.col("node") if none else F.coalesce("root", "node")
    linked = (posted if none else posted.join(roots, "node", "left")).select("h", "node", "n", "alone", label.alias("near"))
    # Postings whose rows SimHash has all linked are done.
    several = linked.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("near").alias("a"), F.max("near").alias("b")).where("a < b").select("h", "c")
    members = settle(linked.join(several, "h"))
    if members.isEmpty():
        return roots
    # Of a group of near copies, rows next to what all have in common: to these the most are alike.
    slot = F.pmod(F.xxhash64("node"), F.lit(pivots))
    leads = settle(members.groupBy("h", slot.alias("slot")).agg(F.min(F.struct((F.col("alone") / F.col("n")).alias("share"), "node", "n", "near")).alias("p"))
                   .select("h", F.col("p.share").alias("share"), F.col("p.node").alias("lead"), F.col("p.n").alias("lead_n"), F.col("p.near").alias("lead_near")))
    # Sets whose sizes differ too much are not alike whatever they share.
    able = lambda a, b: F.least(a, b) * ALIKE[1] >= F.greatest(a, b) * ALIKE[0]
    pair = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))
    pairs = settle(members.join(leads, "h").where((F.col("near") != F.col("lead_near")) & able("n", "lead_n")).select(*pair("node", "lead")).distinct()
                   .join(close, ["u", "v"], "left_anti"))
    edges = edges.union(settle(verified(pairs, rows, nodes)))
    none = edges.isEmpty()
    roots = None if none else connected_components(edges)
    label = F.col("node") if none else F.coalesce("root", "node")
    labelled = (members if none else members.join(roots, "node", "left")).select("h", "c", "node", "n", label.alias("label"))
    mixed = labelled.groupBy("h").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b").select("h")
    left = settle(labelled.join(mixed, "h", "left_semi"))
    if left.isEmpty():
        return roots
    small = left.where(F.col("c") <= SMALL)
    other = small.select("h", F.col("node").alias("o"), F.col("n").alias("on"), F.col("label").alias("ol"))
    met = small.join(other, "h").where((F.col("node") < F.col("o")) & (F.col("label") != F.col("ol")) & able("n", "on"))
    fresh = settle(met.select(*pair("node", "o")).distinct().join(pairs.union(close), ["u", "v"], "left_anti"))
    more = [] if fresh.isEmpty() else [settle(verified(fresh, rows, nodes))]
    large = left.where(F.col("c") > SMALL)
    if not large.isEmpty():
        first = leads.groupBy("h").agg(F.min(F.struct("share", "lead")).alias("p")).select("h", F.col("p.lead").alias("lead"))
        named = first.select("lead").distinct()
        own = (named.withColumn("own", F.col("lead")) if none else
               named.join(roots.withColumnRenamed("node", "lead"), "lead", "left").select("lead", F.coalesce("root", "lead").alias("own")))
        keyed = large.join(first, "h").select("lead", "node", "label").distinct().join(own, "lead")
        keyed = settle(keyed.select("lead", "node", "label", (F.col("label") != F.col("own")).alias("apart")))
        more.append(settle(block_links(keyed, sets_for(keyed.select("node"), rows, nodes))))
    for new in more:
        edges = edges.union(new)
    return None if edges.isEmpty() else connected_components(edges)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the smallest id (of
    several with that id, the one with the smallest content hash; equal rows once). A null id
    names a component only where there is no other."""
    with small_batches(docs.sparkSession):
        return _keep_one(docs, key, text)


def _keep_one(docs: DataFrame, key: str, text: str) -> DataFrame:
    own, sign = F.col(f"`{key}`").cast("bigint"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = docs.select(own.alias("id"), sign.alias("sign"), F.col(f"`{text}`").alias("text"))
    nodes = settle(nodes_of(rows))
    sizes = nodes.select("node", "n").distinct()
    bits = bucket_bits(nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    posted = settle(prefixes(sizes, shared(packed(rows, bits))))
    roots = links(posted, rows, nodes)
    root = F.col("node")
    found = nodes
    if roots is not None:
        found, root = nodes.join(roots, "node", "left"), F.coalesce("root", "node")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("sign").alias("sign")))
    # Keys without nulls: the join and the removal of repeated rows then share one shuffle.
    names = spare(docs.columns, "none", "id", "sign")
    parts = (F.col("b.none"), F.coalesce("b.id", F.lit(0)), F.col("b.sign"))
    stay = settle(found.groupBy(root.alias("root")).agg(best.alias("b")).select(*[c.alias(n) for n, c in zip(names, parts)]))
    marked = docs.withColumns(dict(zip(names, (own.isNull(), F.coalesce(own, F.lit(0)), sign))))
    kept = marked.join(stay, names, "left_semi").dropDuplicates(names)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
