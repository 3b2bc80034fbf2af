"""Merkle roots, proofs and proof checks over leaf tables, JVM-side."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.functions.canonical import canonical_float, canonical_string
from attest.session import settle

# Levels folded per shuffle: a block of 2^8 neighbouring nodes becomes one node.
LEVELS = 8
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaf_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def single_tree(name: str, hash: Column) -> Column:
    """Tree id of a table that is one tree.

    Derived from a column, since the optimizer folds a constant join key away and
    would leave a join without keys.
    """
    return F.concat(F.lit(name), F.substring(hash, 1, 0))


def _parent(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(left), F.unhex(right)), 256)


def _next_level(nodes: Column) -> Column:
    """Pairwise parents; an odd last node is paired with itself."""
    count = F.size(nodes)
    return F.transform(
        F.sequence(F.lit(0), F.floor((count + 1) / 2).cast("int") - 1),
        lambda i: _parent(F.get(nodes, i * 2), F.coalesce(F.get(nodes, i * 2 + 1), F.get(nodes, i * 2))),
    )


def _depth(n: Column) -> Column:
    """Levels from ``n`` nodes to one: the bit length of n - 1."""
    return F.when(n <= 1, F.lit(0)).otherwise(F.length(F.bin(n - 1)))


def _blocks(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """Blocks of neighbouring nodes: ``(tree, chunk, hashes, n)``, at most 2^LEVELS each.

    The size of the tree is joined to blocks, not to single nodes.
    """
    packed = nodes.groupBy("tree", F.floor(F.col("idx") / (1 << LEVELS)).alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda s: s["hash"]).alias("hashes")
    )
    return packed.join(sizes, "tree")


def _shrink(sizes: DataFrame) -> DataFrame:
    return sizes.select("tree", F.ceil(F.col("n") / (1 << LEVELS)).alias("n"))


def _sizes(leaves: DataFrame) -> tuple[DataFrame, int]:
    """Leaves per tree, and the number of shuffles the largest tree needs."""
    sizes = settle(leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n")))
    size = sizes.agg(F.max("n")).first()[0] or 0
    steps = 0
    while size > 1:
        size = -(-size // (1 << LEVELS))
        steps += 1
    return sizes, steps


def merkle_root(leaves: DataFrame) -> DataFrame:
    """``leaves(tree, idx, hash)`` with dense idx from 0 -> ``(tree, root, leaves)``.

    Eight levels per shuffle: a billion leaves need four.
    """
    totals, steps = _sizes(leaves)
    current, sizes = leaves.select("tree", "idx", "hash"), totals
    for _ in range(steps):
        depth = F.least(F.lit(LEVELS), _depth(F.col("n")))
        rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        folded = F.aggregate(rounds, F.col("hashes"), lambda acc, _: _next_level(acc))
        current = _blocks(current, sizes).select("tree", F.col("chunk").alias("idx"), F.get(folded, 0).alias("hash"))
        sizes = _shrink(sizes)
    return current.select("tree", F.col("hash").alias("root")).join(
        totals.withColumnRenamed("n", "leaves"), "tree"
    )


def merkle_roots_of(trees: DataFrame, leaves: DataFrame) -> DataFrame:
    """Roots for every tree id, trees without leaves included."""
    return trees.select("tree").distinct().join(merkle_root(leaves), "tree", "left").select(
        "tree", F.coalesce("root", F.lit(EMPTY_ROOT)).alias("root"),
        F.coalesce("leaves", F.lit(0).cast("bigint")).alias("leaves"),
    )


def merkle_proof(leaves: DataFrame) -> DataFrame:
    """``(tree, idx, leaf, proof)`` for every leaf; proof = array of (hash, position).

    A block yields the lower part of the proof of each of its nodes and one node
    for the next step; parts are joined on the block number.
    """
    sizes, steps = _sizes(leaves)
    step_type = "array<struct<hash:string,position:string>>"
    current = leaves.select("tree", "idx", "hash")
    proofs = current.select("tree", "idx", F.col("idx").alias("at"), F.col("hash").alias("leaf"),
                            F.array().cast(step_type).alias("proof"))
    for _ in range(steps):
        depth = F.least(F.lit(LEVELS), _depth(F.col("n")))
        rounds = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
        levels = F.aggregate(
            rounds, F.array(F.col("hashes")),
            lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1)))),
        )
        blocks = settle(_blocks(current, sizes).withColumn("levels", levels))
        sizes = _shrink(sizes)

        def sibling(level: Column, k: Column, place: Column) -> Column:
            at = F.floor(place / F.pow(F.lit(2), k)).cast("int")
            right = F.pmod(at, F.lit(2)) == 0
            other = F.when(right, at + 1).otherwise(at - 1)
            return F.struct(
                F.coalesce(F.get(level, other), F.get(level, at)).alias("hash"),
                F.when(right, "right").otherwise("left").alias("position"),
            )

        spread = blocks.select("tree", "chunk", "levels", F.posexplode("hashes").alias("place", "_h"))
        lower = F.slice("levels", 1, F.size("levels") - 1)
        parts = spread.select(
            "tree", (F.col("chunk") * (1 << LEVELS) + F.col("place")).alias("at"), F.col("chunk").alias("next"),
            F.transform(lower, lambda level, k: sibling(level, k, F.col("place"))).alias("part"),
        )
        proofs = settle(proofs.join(parts, ["tree", "at"]).select(
            "tree", "idx", F.col("next").alias("at"), "leaf",
            F.concat("proof", F.col("part").cast(step_type)).alias("proof"),
        ))
        current = blocks.select(
            "tree", F.col("chunk").alias("idx"), F.get(F.element_at("levels", -1), 0).alias("hash")
        )
    return proofs.select("tree", "idx", "leaf", "proof")


def verify_proof(leaf: Column, proof: Column, root: Column) -> Column:
    """Fold a leaf hash through its proof; anything malformed is false."""
    good = lambda h: F.coalesce(h.rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    sound = good(leaf) & good(root) & F.forall(
        proof, lambda s: good(s["hash"]) & F.coalesce(s["position"].isin("left", "right"), F.lit(False))
    )
    value = F.aggregate(
        proof, F.lower(leaf),
        lambda acc, s: F.when(s["position"] == "left", _parent(s["hash"], acc)).otherwise(_parent(acc, s["hash"])),
    )
    return F.coalesce(F.when(sound, value == F.lower(root)), F.lit(False))


def activation_leaves(activations: DataFrame, key: str, layer: str, values: str) -> DataFrame:
    """One canonical leaf per scalar; ``(tree, idx, hash)`` with layers in name order.

    Dense positions come from the sizes of earlier layers; a tree has few layers.
    """
    sizes = activations.select(F.col(key).alias("tree"), F.col(layer).alias("layer"), F.col(values).alias("v"))
    before = Window.partitionBy("tree").orderBy("layer").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("offset", F.coalesce(F.sum(F.size("v")).over(before), F.lit(0)))
    flat = placed.select("tree", "layer", "offset", F.size("v").alias("n"), F.posexplode("v").alias("i", "value"))
    text = F.concat(
        F.lit('{"index":'), F.col("i").cast("string"), F.lit(',"layer":'), canonical_string(F.col("layer")),
        F.lit(',"shape":['), F.col("n").cast("string"), F.lit('],"value":'),
        canonical_float(F.col("value").cast("double")), F.lit("}"),
    )
    return flat.select("tree", (F.col("offset") + F.col("i")).cast("bigint").alias("idx"), leaf_hash(text).alias("hash"))
