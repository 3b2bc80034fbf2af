"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions, one for each node of the binary tree over byte values
(255 nodes). Each node has a context tree over the six whole bytes before, nearest first:
seven depths, from no context to all six, each tree node with up to 256 children. A tree
node holds counts of zeros and ones with their Krichevsky-Trofimov estimate; its weighted
probability is half its own estimate and half the product of its children's. The
prediction for a bit mixes the estimates of all depths on the context's path with the
weights that follow. The sum over a text's bits is its code length.

Counting runs over all training documents, and every context that occurs has its place:
the model is a table that grows with the text and stays a table. Texts lie in chunks of some
megabytes. The distinct codes of context and byte of a chunk are dealt into buckets by their four
nearest bytes, and travel as packed arrays, one row for a chunk and bucket. All contexts with the same
four nearest bytes (at most 2^24 codes) are a group, which lies whole in one bucket and is weighted in a
task; from there counts are summed to the root with one aggregation for each depth, and mixtures come
down with one join for each depth (at most 256 rows meet one parent) and meet their buckets again for the
last two depths. Each row of a chunk and bucket gives back a row with the prices of its codes in their
order, which meets the packed texts of the chunk, so that a task holds at most the codes of one chunk.
A text is scored as its lower-cased bytes and one end byte, after six bytes of start.

The unigram base goes the same way: the distinct words of a chunk, dealt into buckets by their hash, travel
packed, and each such row gives back one with the corpus counts of its words. Only sums reach the driver.

Defined results: null counts as empty, which is scored as the end alone; a null id has
remainder 0 and is held out; without training documents every bit has probability 1/2
and the base is that of an unseen word; repeated rows are counted and scored again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attest.llm.common import LOWER_BYTES, forget, only, small_batches, tidy, utf8, written

END = 0xFF  # in no UTF-8 text
FREQUENT = 1 << 18  # words of a bucket that are counted at once (the name is that of an earlier form)
CHUNK = 16 << 20  # bytes of text whose contexts a task holds at once, and at most one text more
_PIECE = 4 << 20
BEFORE = 6  # with the byte itself 56 bits of a code
CUT = 4  # contexts alike in so many nearest bytes are weighted within one task
_GROUP_SHIFT = 8 * (BEFORE - CUT) + 8  # from a code to these bytes
LEAST_BITS, MOST_BITS = 7, 13  # of a bucket
_AT_ONCE = 400_000  # codes


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes ``context << 8 | byte`` of all texts and their ends, and where each text begins.

    The nearest byte of the context has its highest bits, so that a shift gives the context one byte shorter.
    """
    flat = np.frombuffer(b"".join(bytes([END]) * BEFORE + t + bytes([END]) for t in texts), np.uint8)
    parts = np.zeros((len(flat) - BEFORE, 8), np.uint8)  # little-endian
    for back in range(BEFORE + 1):
        parts[:, BEFORE + 1 - back if back else 0] = flat[BEFORE - back:len(flat) - back]
    code = parts.view("<i8").ravel()
    lengths = np.array([len(t) + 1 for t in texts])
    first = np.cumsum(lengths) - lengths
    keep = np.ones(len(code), bool)
    for gap in range(BEFORE):  # the start of each text but the first
        keep[(first + BEFORE * np.arange(len(texts)))[1:] - 1 - gap] = False
    return code[keep], first


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunk, size = None, CHUNK
    for batch in batches:
        rows, texts, chunks = batch.column(2).to_pylist(), [], []
        for row, t in zip(rows, utf8(batch.column(1)), strict=True):
            if size >= CHUNK:
                chunk, size = row, 0
            size += len(t)
            chunks.append(chunk)
            texts.append(t.translate(LOWER_BYTES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(2), pa.array(chunks, pa.int64()), batch.column(0), pa.array(texts, pa.binary())],
            names=["row", "chunk", "id", "text"])


def _numbered(base: DataFrame) -> DataFrame:
    return base.select(F.col("id").cast("bigint").alias("id"), "text", F.monotonically_increasing_id().alias("row"))


def in_chunks(base: DataFrame) -> DataFrame:
    """(row, chunk, id, text) of base(id, text): lower-cased bytes; a chunk is named by its first row."""
    return _numbered(base).mapInArrow(tidy(_chunked), "row bigint, chunk bigint, id bigint, text binary")


def bucket_bits(size: int) -> int:
    """Buckets for so many bytes of text: a bucket has some hundred thousand codes, and a chunk not too few for each."""
    return min(MOST_BITS, max(LEAST_BITS, (size >> 24).bit_length()))


# The bucket of a group: the same arithmetic on arrays and in Spark.
_BUCKET = "cast((({g} * 1000003 + shiftright({g}, 16) * 7919) % 65521) & {mask} as int)"


def bucket_of(group: np.ndarray, bits: int) -> np.ndarray:
    return ((group * 1000003 + (group >> 16) * 7919) % 65521 & (1 << bits) - 1).astype(np.uint16)


def by_bucket(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of ascending codes in the order of their buckets, and the bucket of each place."""
    bucket = bucket_of(codes >> _GROUP_SHIFT, bits)
    order = np.argsort(bucket, kind="stable")
    return order, bucket[order]


def pack(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, first bytes of all values first."""
    return pa.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), "zstd", asbytes=True)


def unpack(blob: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(blob, n * size, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).view(kind).ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    """Ascending codes by their differences."""
    return pack(np.diff(codes, prepend=0))


def unpack_codes(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unpack(blob, n, np.int64))


def pack_words(words: list[bytes]) -> bytes:
    """Words without spaces, compressed behind the size they had."""
    flat = b" ".join(words)
    return len(flat).to_bytes(8, "little") + pa.compress(flat, "zstd", asbytes=True)


def unpack_words(blob: bytes) -> list[bytes]:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True).split(b" ")


def words_in(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, and how many each has; empty ones may stand at the ends of a text, and in an empty one."""
    # Bytes are taken as strings, unchecked: only ASCII white space matters.
    split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
    return split.flatten().view(pa.binary()).dictionary_encode(), pc.list_value_length(split).to_numpy()


def chunk_words(pieces: list[pa.Array], bits: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a chunk's pieces, the place of each piece's words among them, and the places of those not empty
    in the order of their buckets with these buckets."""
    coded = pa.concat_arrays(pieces).dictionary_encode()
    bucket = np.array([zlib.crc32(w) & (1 << bits) - 1 for w in coded.dictionary.to_pylist()], np.uint16)
    order = np.argsort(bucket, kind="stable")
    order = order[pc.binary_length(coded.dictionary).to_numpy()[order] > 0]
    return coded.dictionary, coded.indices.to_numpy(), order, bucket[order]


def spans(bucket: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal values."""
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


_PACKED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("size", pa.int32()), ("codes", pa.binary()), ("words", pa.binary()),
                     ("counts", pa.binary()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("texts", pa.binary()),
                     ("n", pa.int64())])
_PACKED_SQL = ("chunk bigint, bucket int, size int, codes binary, words binary, counts binary, ids array<bigint>, lengths array<int>, "
               "texts binary, n bigint")


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of several (ascending codes, numbers), ascending, and their numbers in all."""
    if len(parts) == 1:
        return parts[0]
    codes, spot = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(spot, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def packing(bits: int):
    """The task of ``counted`` over batches of chunked texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, codes, words, ids, low, size = None, [], [], [], [], 0

        def out(length: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(length, f.type) for f in _PACKED],
                                              schema=_PACKED)

        def flush_piece() -> Iterator[pa.RecordBatch]:
            """Codes stay, with a last bit for held-out texts while they are sorted; texts go."""
            nonlocal size
            if not low:
                return
            held = [is_held_out(i) for i in ids]
            code, first = laid_out(low)
            code <<= 1
            code |= np.repeat(np.array(held, np.int64), np.diff(np.append(first, len(code))))
            code.sort()
            first = np.flatnonzero(np.append(True, code[1:] >> 1 != code[:-1] >> 1))
            codes.append((code[first] >> 1, np.add.reduceat(1 - (code & 1), first)))
            found, times = words_in(low)
            learnt = np.repeat(~np.array(held), times)
            words.append((found.dictionary, np.bincount(found.indices.to_numpy(), learnt, len(found.dictionary)).astype(np.int64)))
            yield out(1, chunk=[now], ids=[ids], lengths=[[len(t) for t in low]], texts=[pa.compress(b"".join(low), "zstd", asbytes=True)],
                      n=[len(held) - sum(held)])
            ids.clear()
            low.clear()
            size = 0

        def flush_chunk() -> Iterator[pa.RecordBatch]:
            yield from flush_piece()
            if not codes:
                return
            found, numbers = summed(codes)
            codes.clear()
            order, bucket = by_bucket(found, bits)
            found, numbers = found[order], numbers[order]
            runs = spans(bucket)
            yield out(len(runs), chunk=[now] * len(runs), bucket=[int(bucket[a]) for a, _ in runs], size=[b - a for a, b in runs],
                      codes=[pack_codes(found[a:b]) for a, b in runs], counts=[pack(numbers[a:b].astype(np.int32)) for a, b in runs])
            names, spot, order, bucket = chunk_words([w for w, _ in words], bits)
            numbers = np.bincount(spot, np.concatenate([n for _, n in words]), len(names)).astype(np.int32)[order]
            words.clear()
            runs, names = spans(bucket), names.take(pa.array(order))
            yield out(len(runs), chunk=[now] * len(runs), bucket=[int(bucket[a]) for a, _ in runs], size=[b - a for a, b in runs],
                      words=[pack_words(names.slice(a, b - a).to_pylist()) for a, b in runs], counts=[pack(numbers[a:b]) for a, b in runs])

        for batch in batches:
            for chunk, i, t in zip(*[batch.column(c).to_pylist() for c in (1, 2, 3)], strict=True):
                if chunk != now:
                    yield from flush_chunk()
                    now = chunk
                ids.append(i)
                low.append(t)
                size += len(t) + BEFORE
                if size >= _PIECE:
                    yield from flush_piece()
        yield from flush_chunk()

    return run


def counted(base: DataFrame, bits: int) -> DataFrame:
    """Packed rows over base(id, text), of three kinds: the distinct codes of a chunk that lie in one bucket with their
    numbers in training texts (0 for those only in held-out texts of the chunk); the distinct words of a chunk in the same
    way; pieces of the chunk's texts, where n is the number of training texts."""
    run = packing(bits)
    return _numbered(base).mapInArrow(tidy(lambda batches: run(_chunked(batches))), _PACKED_SQL)


def count(texts: DataFrame) -> DataFrame:
    """(chunk, code, word, n) over chunked texts: the rows of ``counted`` with one for each code of a chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, of_codes = r["size"], r["codes"] is not None
                code = pa.array(unpack_codes(r["codes"], size)) if of_codes else pa.nulls(size, pa.int64())
                word = pa.nulls(size, pa.binary()) if of_codes else pa.array(unpack_words(r["words"]), pa.binary())
                n = pa.array(unpack(r["counts"], size, np.int32).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]] * size, pa.int64()), code, word, n], names=["chunk", "code", "word", "n"])

    rows = texts.mapInArrow(tidy(packing(LEAST_BITS)), _PACKED_SQL).where("texts is null").select("chunk", "size", "codes", "words", "counts")
    return rows.mapInArrow(tidy(run), "chunk bigint, code bigint, word binary, n bigint")


# Krichevsky-Trofimov and the weighting.

def log_gamma(x: Column) -> Column:
    """Stirling's series for x > 0, eight steps up."""
    y = x + F.lit(8.0)
    steps = x
    for k in range(1, 8):
        steps = steps * (x + F.lit(float(k)))
    z = F.lit(1.0) / (y * y)
    series = (F.lit(1 / 12) - z * (F.lit(1 / 360) - z * (F.lit(1 / 1260) - z / F.lit(1680.0)))) / y
    return (y - F.lit(0.5)) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series - F.log(steps)


def log_kt(zeros: Column, ones: Column) -> Column:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    half = F.lit(0.5)
    return log_gamma(zeros + half) + log_gamma(ones + half) - log_gamma(zeros + ones + F.lit(1.0)) - F.lit(math.log(math.pi))


_EXACT = 1 << 16


def _small_log_gamma(start: float) -> np.ndarray:
    return math.lgamma(start) + np.concatenate([[0.0], np.cumsum(np.log(np.arange(_EXACT - 1) + start))])


def log_kt_array(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """``log_kt`` of whole counts as arrays."""
    def gamma(count: np.ndarray, start: float) -> np.ndarray:
        out = _small_log_gamma_of[start][np.minimum(count, _EXACT - 1)]
        large = count >= _EXACT
        y = count[large] + start
        out[large] = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y)
        return out

    return gamma(zeros, 0.5) + gamma(ones, 0.5) - gamma(zeros + ones, 1.0) - math.log(math.pi)


_small_log_gamma_of = {0.5: _small_log_gamma(0.5), 1.0: _small_log_gamma(1.0)}


class Tree:
    """The depths from BEFORE up to ``CUT`` of all groups of some distinct codes with their numbers.

    Each of ``levels`` is (key, zeros, ones, weighted, share, up), deepest first; a key is ``context << 8 | node``,
    ``up`` the place of its parent in the next level. The keys of all levels but the deepest ascend.
    """

    def __init__(self, code: np.ndarray, n: np.ndarray) -> None:
        """Codes ascend, so the rows of a node at the deepest level are a run for each of the eight bits."""
        byte, parts, start = code & 255, [], 0
        self.spot, self.bit = np.empty((8, len(code)), np.int64), np.empty((8, len(code)), np.int64)
        for k in range(8):
            key = (code - byte) | 1 << k | byte >> (8 - k)
            new = np.append(True, key[1:] != key[:-1])
            first = np.flatnonzero(new)
            self.bit[k] = byte >> (7 - k) & 1
            self.spot[k] = np.cumsum(new) - 1 + start
            start += len(first)
            parts.append((key[first], np.add.reduceat(n, first), np.add.reduceat(self.bit[k] * n, first)))
        key, zeros, ones = (np.concatenate(c) for c in zip(*parts))
        zeros -= ones
        weighted, share = log_kt_array(zeros, ones), np.ones(len(key))
        self.levels = []
        for _ in range(BEFORE - CUT):
            above, up = np.unique(key >> 16 << 8 | key & 255, return_inverse=True)
            self.levels.append((key, zeros, ones, weighted, share, up))
            below = np.bincount(up, weighted, len(above))
            zeros, ones = (np.bincount(up, c, len(above)).astype(np.int64) for c in (zeros, ones))
            own = log_kt_array(zeros, ones)
            key, weighted = above, np.logaddexp(own, below) - math.log(2)
            share = np.exp(own - math.log(2) - weighted)
        self.levels.append((key, zeros, ones, weighted, share, None))

    def bits(self, total: np.ndarray, left: np.ndarray) -> np.ndarray:
        """log2 probability of each code, from the mixtures at the last level and the weight they leave to deeper ones."""
        for _, zeros, ones, _, share, up in self.levels[-2::-1]:
            total = total[up] + left[up] * share * (ones + 0.5) / (zeros + ones + 1.0)
            left = left[up] * (1 - share)
        p = np.clip(total, 1e-12, 1 - 1e-12)[self.spot]
        return np.log2(np.where(self.bit == 1, p, 1 - p)).sum(0)


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket; the first column is the bucket, in runs."""
    held, now = [], None
    for batch in batches:
        bucket = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if bucket[a] != now:
                if held:
                    yield pa.Table.from_batches(held)
                held, now = [], bucket[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def merged(sizes: list[int], codes: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes of a bucket with their numbers, and the place of each chunk's codes among them."""
    every = np.concatenate([unpack_codes(c, n) for c, n in zip(codes, sizes, strict=True)])
    numbers = np.concatenate([unpack(c, n, np.int32) for c, n in zip(counts, sizes, strict=True)])
    found, spot = np.unique(every, return_inverse=True)
    return found, np.bincount(spot, numbers, len(found)).astype(np.int64), spot


def group_slices(codes: np.ndarray) -> Iterator[slice]:
    """Slices of whole groups of ascending codes, of about ``_AT_ONCE`` codes."""
    group = codes >> _GROUP_SHIFT
    start = 0
    while start < len(codes):
        end = int(np.searchsorted(group, group[min(start + _AT_ONCE, len(codes)) - 1], "right"))
        yield slice(start, end)
        start = end


_ABOVE = "shiftleft(shiftright(key, 16), 8) | (key & 255)"  # the same node in the context one byte shorter


def levels(pairs: DataFrame, bits: int) -> list[tuple[DataFrame, str]]:
    """(key, zeros, ones, weighted, share) and its path for depth 0 to ``CUT`` over packed pairs(bucket, chunk, size, codes, counts).

    ``weighted`` is the log of the weighted probability, ``share`` the part of it that is the node's own estimate.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets(batches):
            code, n, _ = merged(*[rows.column(c).to_pylist() for c in range(1, 4)])
            for part in group_slices(code):
                last = Tree(code[part], n[part]).levels[-1]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in last[:5]], names=["key", "zeros", "ones", "weighted", "share"])

    half = F.lit(math.log(2))
    grouped = pairs.select("bucket", "size", "codes", "counts").repartition(1 << bits - 1, "bucket").sortWithinPartitions("bucket")
    out = [written(grouped.mapInArrow(tidy(run), "key bigint, zeros bigint, ones bigint, weighted double, share double"))]
    for _ in range(CUT):
        summed = out[-1][0].groupBy(F.expr(_ABOVE).alias("key")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
        own = summed.withColumn("own", log_kt(F.col("zeros"), F.col("ones")))
        more = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - half
        mixed = own.withColumn("weighted", more)
        out.append(written(mixed.select("key", "zeros", "ones", "weighted", F.exp(F.col("own") - half - F.col("weighted")).alias("share"))))
    return out[::-1]


def mixtures(found: list[DataFrame]) -> DataFrame:
    """(key, sum, left) at every key of the last of the levels: what the estimates down to it give to a one, and the
    weight left for deeper ones."""
    one = (F.col("ones") + F.lit(0.5)) / (F.col("zeros") + F.col("ones") + F.lit(1.0))
    path = None
    for level in found:
        here = level.select("key", (F.col("share") * one).alias("own"), (F.lit(1.0) - F.col("share")).alias("rest"))
        if path is None:
            path = here.select("key", F.col("own").alias("sum"), F.col("rest").alias("left"))
            continue
        above = path.select(F.col("key").alias("up"), "sum", "left")
        path = here.join(above, F.expr(_ABOVE) == F.col("up")).select(
            "key", (F.col("sum") + F.col("left") * F.col("own")).alias("sum"), (F.col("left") * F.col("rest")).alias("left"))
    return path


def train(pairs: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, size, bits): packed log2 probabilities of each byte after its context, for the codes of the same
    rows of pairs(bucket, chunk, size, codes, counts)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets(batches):
            is_pair = pc.is_valid(rows.column(1))
            own, above = rows.filter(is_pair), rows.filter(pc.invert(is_pair))
            sizes = own.column(2).to_pylist()
            code, n, spot = merged(sizes, own.column(3).to_pylist(), own.column(4).to_pylist())
            key, total, left = (above.column(c).to_numpy() for c in (5, 6, 7))  # by key
            price = np.empty(len(code), np.float32)
            for part in group_slices(code):
                tree = Tree(code[part], n[part])
                a = int(np.searchsorted(key, tree.levels[-1][0][0]))
                b = a + len(tree.levels[-1][0])
                price[part] = tree.bits(total[a:b], left[a:b])
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays(
                [own.column(1).combine_chunks(), own.column(0).combine_chunks(), own.column(2).combine_chunks(),
                 pa.array([pack(price[spot[e - s:e]]) for e, s in zip(ends, sizes)], pa.binary())], names=["chunk", "bucket", "size", "bits"])

    found = levels(pairs, bits)
    bucket = F.expr(_BUCKET.format(g="shiftright(key, 8)", mask=(1 << bits) - 1))
    none = lambda kind: F.lit(None).cast(kind)
    own = pairs.select("bucket", "chunk", "size", "codes", "counts", none("bigint").alias("key"), none("double").alias("sum"), none("double").alias("left"))
    above = mixtures([f for f, _ in found]).select(
        bucket.alias("bucket"), none("bigint").alias("chunk"), none("int").alias("size"), none("binary").alias("codes"),
        none("binary").alias("counts"), "key", "sum", "left")
    together = own.unionByName(above).repartition(1 << bits - 1, "bucket").sortWithinPartitions("bucket", "key")
    out = written(together.mapInArrow(tidy(run), "chunk bigint, bucket int, size int, bits binary"))[0]
    for _, path in found:
        forget(pairs.sparkSession, path)
    return out


def word_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(chunk, bucket, size, times, total, distinct) over packed rows(bucket, chunk, size, words, counts): packed corpus
    counts of the words of each row, and rows without a chunk with the sum of a bucket's counts and how many are not zero."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in buckets(batches):
            sizes, blobs, counts = (rows.column(c).to_pylist() for c in (2, 3, 4))
            dicts, places, start = [], [], 0
            while start < len(sizes):
                end, size = start, 0
                while end < len(sizes) and (end == start or size + sizes[end] <= FREQUENT):
                    size += sizes[end]
                    end += 1
                some = pa.array([w for b in blobs[start:end] for w in unpack_words(b)], pa.binary()).dictionary_encode()
                dicts.append(some.dictionary)
                places.append(some.indices.to_numpy())
                start = end
            every = pa.concat_arrays(dicts).dictionary_encode()
            base = np.cumsum([0, *map(len, dicts)])
            spot = np.concatenate([every.indices.to_numpy()[p + a] for p, a in zip(places, base)])
            numbers = np.concatenate([unpack(c, n, np.int32) for c, n in zip(counts, sizes, strict=True)])
            times = np.bincount(spot, numbers, len(every.dictionary)).astype(np.int64)
            back = [pack(times[spot[e - n:e]]) for e, n in zip(np.cumsum(sizes), sizes)]
            none = [None] * len(back)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in ((rows.column(1).to_pylist() + [None], pa.int64()), (rows.column(0).to_pylist() + [None], pa.int32()),
                                             (sizes + [None], pa.int32()), (back + [None], pa.binary()), (none + [int(times.sum())], pa.int64()),
                                             (none + [int((times > 0).sum())], pa.int64()))],
                names=["chunk", "bucket", "size", "times", "total", "distinct"])

    dealt = rows.repartition(1 << bits - 1, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(tidy(run), "chunk bigint, bucket int, size int, times binary, total bigint, distinct bigint")


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: (key, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte)."""
    spark = docs.sparkSession
    base = only(docs, id=key, text=text)
    size = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    width = bucket_bits(size)
    with small_batches(spark):
        packed = written(counted(base, width))[0]
    words = written(word_counts(packed.where("words is not null").select("bucket", "chunk", "size", "words", "counts"), width))[0]
    prices = train(packed.where("codes is not null").select("bucket", "chunk", "size", "codes", "counts"), width)
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first()
    end_seen = packed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + end_seen, distinct + (end_seen > 0)
    scale = math.log10(total + 0.1 * (distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a chunk lie together: prices by bucket, counts of words by bucket, texts."""
        now, bits, times, pieces = None, [], [], []

        def end() -> Iterator[pa.RecordBatch]:
            if not pieces:
                return
            coded, found = [], []
            for ids, lengths, blob in pieces:
                ends = list(accumulate(lengths, initial=0))
                flat = pa.decompress(blob, ends[-1], "zstd", asbytes=True)
                low = [flat[a:b] for a, b in zip(ends, ends[1:])]
                coded.append(pa.array(laid_out(low)[0]).dictionary_encode())
                found.append(words_in(low))
            every, spot = np.unique(np.concatenate([c.dictionary.to_numpy() for c in coded]), return_inverse=True)
            gains = np.empty(len(every))
            gains[by_bucket(every, width)[0]] = np.concatenate(bits)
            gains = gains[spot]
            names, spot, order, _ = chunk_words([w.dictionary for w, _ in found], width)
            seen, is_word = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            seen[order] = np.concatenate([np.zeros(0, np.int64), *times])
            is_word[order] = 1
            gain = np.log10(seen + 0.1) * is_word
            at_code = at_word = 0
            for (ids, lengths, _), c, (w, many) in zip(pieces, coded, found):
                own = gains[at_code:at_code + len(c.dictionary)]
                at_code += len(own)
                first = np.cumsum([0, *[n + 1 for n in lengths[:-1]]])
                model = np.add.reduceat(own[c.indices.to_numpy()], first) * math.log10(2)
                place = spot[at_word:at_word + len(w.dictionary)][w.indices.to_numpy()]
                at_word += len(w.dictionary)
                first = np.cumsum(many) - many  # every text has a word, if an empty one
                tokens, known, got = (np.add.reduceat(x[place], first) for x in (is_word, is_word * (seen > 0), gain))
                tokens += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(tokens), pa.array(known + (end_seen > 0)),
                     pa.array(got + math.log10(end_seen + 0.1) - tokens * scale), pa.array(model), pa.array(lengths, pa.int64())],
                    names=["id", "n_tokens", "n_known", "base", "score", "n_bytes"])

        for batch in batches:
            for chunk, n, price, count_of, *piece in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3, 4, 5, 6, 7)], strict=True):
                if chunk != now:
                    yield from end()
                    now, bits, times, pieces = chunk, [], [], []
                if price is not None:
                    bits.append(unpack(price, n, np.float32))
                elif count_of is not None:
                    times.append(unpack(count_of, n, np.int64))
                else:
                    pieces.append(piece)
        yield from end()

    # Word rows lie behind those of codes, texts behind both.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    no_text = [none("array<bigint>", "ids"), none("array<int>", "lengths"), none("binary", "texts")]
    priced = prices.select("chunk", "bucket", "size", "bits", none("binary", "times"), *no_text)
    told = words.where("chunk is not null").select(
        "chunk", (F.col("bucket") + (1 << MOST_BITS)).alias("bucket"), "size", none("binary", "bits"), "times", *no_text)
    asked = packed.where("texts is not null").select(
        "chunk", F.lit(2 << MOST_BITS).alias("bucket"), none("int", "size"), none("binary", "bits"), none("binary", "times"), "ids", "lengths", "texts")
    together = priced.unionByName(told).unionByName(asked).repartition(max(8, 2 * size // CHUNK), "chunk").sortWithinPartitions("chunk", "bucket")
    scored = together.mapInArrow(tidy(run), "id bigint, n_tokens bigint, n_known bigint, base double, score double, n_bytes bigint")
    held = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return scored.select(
        F.col("id").alias(key), held.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"),
        F.col("base").alias("base_score"), "score", "n_bytes",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"))
