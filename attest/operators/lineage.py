"""Lineage graph: nodes, edges, closure, blast radius and downstream propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.operators.condensed import Graph, condense, sweep
from attest.operators.evidence import SCOPES
from attest.session import discard, settle

# Which node types a blast radius counts, and under which name.
RADIUS = {"model": "models", "dataset": "datasets",
          "inference": "inference_records", "inference_record": "inference_records"}
# Sources in one row on the way to the leaves.
LOT = 1024


def build_nodes(declared: DataFrame, edges: DataFrame, parent_types: DataFrame | None = None) -> DataFrame:
    """Declared nodes plus an orphan row for every parent nobody declared.

    ``declared(id, node_type, hash)``, ``edges(parent, child, parent_type)``. A node first
    known as a plain ``asset`` takes the more specific type when one is declared.
    """
    specific = F.when(F.col("node_type") != "asset", F.col("node_type"))
    merged = declared.groupBy("id").agg(
        F.coalesce(F.min(specific), F.lit("asset")).alias("node_type"), F.max("hash").alias("hash")
    )
    orphans = orphan_parents(merged, edges)
    return merged.withColumn("orphan", F.lit(False)).unionByName(
        orphans.select("id", "node_type", F.lit(None).cast("string").alias("hash"), F.lit(True).alias("orphan"))
    )


def type_conflicts(declared: DataFrame) -> DataFrame:
    """Ids declared under two different types (``asset`` may be refined and is no conflict)."""
    typed = declared.where("node_type <> 'asset'")
    return typed.groupBy("id").agg(
        F.min("node_type").alias("first_type"), F.max("node_type").alias("second_type")
    ).where("first_type <> second_type")


def orphan_parents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Parents that were referenced but never declared."""
    wanted = edges.groupBy(F.col("parent").alias("id")).agg(F.min("parent_type").alias("node_type"))
    return wanted.join(nodes.select("id"), "id", "left_anti")


def model_parents(models: DataFrame, declared_parents: DataFrame) -> DataFrame:
    """Training edges; a model without declared data gets a synthetic unknown parent."""
    joined = models.select("id").join(declared_parents, models["id"] == declared_parents["model_id"], "left")
    parent = F.coalesce("dataset_id", F.concat(F.lit("unknown-training-dataset:"), F.col("id")))
    return joined.select(parent.alias("parent"), F.col("id").alias("child"), F.lit("dataset").alias("parent_type")).distinct()


def finding_nodes(findings: DataFrame) -> DataFrame:
    """Content-addressed finding nodes: adding a finding twice gives one node."""
    body = F.concat_ws("\x1f", "asset_id", "finding_type", F.col("severity").cast("string"),
                       F.col("confidence").cast("string"), "modality", "provenance.detector_id",
                       F.array_join("evidence", "\x1e"))
    return findings.select(
        F.concat(F.lit("finding:"), F.sha2(body, 256)).alias("id"), F.col("asset_id").alias("parent"), "confidence"
    ).distinct()


def finding_edges(findings: DataFrame) -> DataFrame:
    """``(parent, child, parent_type)`` from each asset to its findings; an asset of any type takes findings."""
    return finding_nodes(findings).select("parent", F.col("id").alias("child"), F.lit("asset").alias("parent_type"))


def inference_edges(records: DataFrame, models: DataFrame) -> DataFrame:
    """``(parent, child, parent_type)`` from models to the records they made, by the models' digests.

    ``records(record_hash, model_digest)``, ``models(id, hash)``; a digest of no known model leads from a
    parent of its own, so that it shows as an orphan.
    """
    known = models.where("hash is not null").groupBy(F.col("hash").alias("model_digest")).agg(F.min("id").alias("id"))
    return records.join(known, "model_digest", "left").select(
        F.coalesce("id", F.concat(F.lit("unknown-model:"), F.col("model_digest"))).alias("parent"),
        F.col("record_hash").alias("child"), F.lit("model").alias("parent_type")).distinct()


def reach(graph: Graph, sources: DataFrame, names: bool = False, itself: bool = True) -> DataFrame:
    """``(source, node)``: the source's number, or its id with ``names``, and the id of a node strictly downstream of it; sources(id).

    Carried from level to level over the condensed graph and from there to the leaves; members of
    a cycle are below each other and, unless ``itself`` is false, themselves.
    """
    asked = settle(graph.components(sources.select("id").distinct(), "id").select("comp", F.col("node").alias("value")))
    # Each source that reaches a component, and whether from strictly above its members.
    got = sweep(graph, asked, DataFrame.distinct).union(asked.join(graph.cyclic, "comp", "left_semi")).withColumn("above", F.lit(True))
    every = got.union(asked.withColumn("above", F.lit(False))).groupBy("comp", "value").agg(F.max("above").alias("above"))
    if names:
        every = every.join(graph.members.select(F.col("node").alias("value"), F.col("id").alias("name")), "value")
    every = settle(every)
    source = F.col("name" if names else "value").alias("source")
    inner = every.where("above").join(graph.members, "comp")
    inner = (inner if itself else inner.where("value <> node")).select(source, F.col("id").alias("node"))
    # Sources travel to the leaves in lots, a row for each parent and lot. Of equal rows, which meet by id, one stays.
    place = F.row_number().over(Window.partitionBy("comp").orderBy("value")) - 1
    lots = settle(every.withColumn("lot", F.floor(place / F.lit(LOT)).cast("int")).groupBy("comp", "lot").agg(F.collect_list(source).alias("sources")))
    leaves = graph.leaves.join(lots, "comp").select("sources", F.col("id").alias("node"))
    spread = lambda rows: rows.repartition("node").select(F.explode("sources").alias("source"), "node").distinct()
    if names:
        return inner.union(spread(leaves))
    # Joins by id find these pairs in place.
    return spread(leaves.union(inner.select(F.array("source").alias("sources"), "node")))


def named(graph: Graph, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the ids of inner nodes in place of the numbers in ``column``."""
    names = graph.members.select(F.col("node").alias(column), F.col("id").alias("_name"))
    return rows.join(names, column).select(*[F.col("_name").alias(c) if c == column else c for c in rows.columns])


def closure(edges: DataFrame, sources: DataFrame, graph: Graph | None = None) -> DataFrame:
    """All ``(source, node)`` pairs with node strictly downstream of source."""
    graph = graph or condense(edges)
    return reach(graph, sources, names=True)


def downstream_of(edges: DataFrame, sources: DataFrame, graph: Graph | None = None) -> DataFrame:
    return closure(edges, sources, graph)


def ancestors_of(edges: DataFrame, targets: DataFrame | None = None, graph: Graph | None = None) -> DataFrame:
    """``(node, ancestor)`` pairs of the targets(id), or of all nodes."""
    graph = graph or condense(edges)
    pairs = reach(graph, graph.members, names=True)
    if targets is not None:
        pairs = pairs.join(targets.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    return pairs.select("node", F.col("source").alias("ancestor"))


def cycle_edges(edges: DataFrame, graph: Graph | None = None) -> DataFrame:
    """Edges that lie on a cycle: both ends are in one component, or the edge is a loop."""
    graph = graph or condense(edges)
    on_cycle = graph.members.join(graph.cyclic, "comp", "left_semi")
    side = lambda name: on_cycle.select(F.col("id").alias(name), F.col("comp").alias(f"_{name}"))
    both = graph.inner.join(side("parent"), "parent").join(side("child"), "child")
    return both.where("_parent = _child").select("parent", "child")


def blast_radius(pairs: DataFrame, nodes: DataFrame, graph: Graph | None = None, apart: bool = False) -> DataFrame:
    """Downstream models, datasets and inference records per source, with the total.

    ``pairs`` come from ``closure``, or from ``reach`` on ``graph``; findings and the source itself never count.
    ``apart`` tells that no source stands beside itself in ``pairs``.
    """
    kinds = F.create_map(*[F.lit(x) for item in RADIUS.items() for x in item])
    typed = nodes.select(F.col("id").alias("node"), F.try_element_at(kinds, F.col("node_type")).alias("kind")) \
        .where(F.col("kind").isNotNull())
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).cast("bigint").alias(k)
    if apart:
        others = pairs
    elif graph is None:
        others = pairs.where("source <> node")
    else:  # numbers of sources beside ids of nodes: only members of a cycle are below themselves
        own = graph.members.join(graph.cyclic, "comp", "left_semi").select(F.col("node").alias("source"), F.col("id").alias("node"))
        others = pairs.join(own, ["source", "node"], "left_anti")
    return others.join(typed, "node").groupBy("source").agg(
        count("models"), count("datasets"), count("inference_records"), F.count(F.lit(1)).alias("total")
    )


def consumers_hit(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Affected inference records per source and consumer; ``records(id, consumer_id)``."""
    return pairs.join(records.withColumnRenamed("id", "node"), "node").where(
        F.col("consumer_id").isNotNull()
    ).groupBy("source", "consumer_id").agg(F.count(F.lit(1)).alias("records"))


def propagate_min(edges: DataFrame, seeds: DataFrame, graph: Graph | None = None) -> DataFrame:
    """``(id, value)``: the smallest of seeds(id, value) on any strict ancestor of a node.

    Minima go from level to level, so the work is one use of every edge and no ancestor
    pairs are built. Members of a cycle are above each other and themselves.
    """
    graph = graph or condense(edges)
    own = settle(graph.components(seeds.select("id", "value"), "id").groupBy("comp").agg(F.min("value").alias("value")))
    above = settle(_lowest(graph, own))
    inner = above.join(graph.members, "comp").select("id", "value")
    here = above.union(own).groupBy("comp").agg(F.min("value").alias("value"))
    return inner.union(graph.leaves.join(here, "comp").groupBy("id").agg(F.min("value").alias("value")))


def _lowest(graph: Graph, own: DataFrame) -> DataFrame:
    """``(comp, value)``: the smallest own value strictly above each component's members."""
    least = lambda df: df.groupBy("comp").agg(F.min("value").alias("value"))
    return least(sweep(graph, own, least).union(own.join(graph.cyclic, "comp", "left_semi").select("comp", "value")))


def propagate_confidence(edges: DataFrame, findings: DataFrame, own: DataFrame, graph: Graph | None = None) -> DataFrame:
    """``own(id, confidence)`` capped by findings attached to strict ancestors, not siblings."""
    attached = findings.select(F.col("asset_id").alias("id"), F.col("confidence").alias("value"))
    capped = propagate_min(edges, attached, graph)
    return own.join(capped, "id", "left").select(
        "id", F.least(F.col("confidence"), F.coalesce("value", F.col("confidence"))).alias("confidence")
    )


def scope_tops(nodes: DataFrame, edges: DataFrame, graph: Graph | None = None) -> DataFrame:
    """``(id, top_id, top_type)``: the smallest highest scoped ancestor-or-self of each node.

    A scoped node is highest when no scoped node lies above it, whatever asset asks,
    so the highest ids themselves can travel downstream, as numbers in the ids' order.
    """
    graph = graph or condense(edges)
    is_scoped = F.col("node_type").isin(sorted(SCOPES))
    scoped = settle(graph.components(nodes.select("id", "node_type").where(is_scoped), "id"))
    below = _lowest(graph, settle(scoped.select("comp", F.lit(1).alias("value")).distinct()))
    top = settle(scoped.join(below, "comp", "left_anti").select("comp", F.col("node").alias("value"), "id", "node_type"))
    # A highest node is on no cycle with a scoped node, itself included: it is its own component's only one.
    reached = sweep(graph, top.select("comp", "value"), lambda df: df.groupBy("comp").agg(F.min("value").alias("value")))
    best = reached.union(top.select("comp", "value")).groupBy("comp").agg(F.min("value").alias("value"))
    names = top.select("value", F.col("id").alias("top_id"), F.col("node_type").alias("top_type"))
    best = settle(best.join(names, "value").select("comp", "value", "top_id", "top_type"))
    # A leaf, or a node without edges, is highest itself where nothing scoped is above. Names follow the numbers last.
    none = lambda kind: F.lit(None).cast(kind)
    from_above = settle(graph.leaves.join(best.select("comp", "value"), "comp").select("id", "value", none("string").alias("type")))
    outer = nodes.select("id", "node_type").where(is_scoped).join(graph.members, "id", "left_anti").select(
        "id", none("bigint").alias("value"), F.col("node_type").alias("type"))
    first = settle(from_above.union(outer).groupBy("id").agg(F.min("value").alias("value"), F.max("type").alias("type")))
    discard(from_above)
    outside = first.join(names, "value", "left").select("id", F.coalesce("top_id", "id").alias("top_id"), F.coalesce("top_type", "type").alias("top_type"))
    return best.join(graph.members, "comp").select("id", "top_id", "top_type").union(outside)
