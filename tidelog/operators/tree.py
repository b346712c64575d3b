"""Movable trees: ordered replay with a guard against loops, then ranking of siblings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.ids import DELETED_PARENT, container_kind, peer_number
from tidelog.plans.grouped import per_group
from tidelog.plans.storage import cut

PLACED = "doc_id string, container string, node_id string, parent_id string, fractional_index string, lamport bigint, peer string"


def _replay(rows: Iterator[dict]) -> Iterator[tuple]:
    parent: dict[str, str | None] = {}
    placed: dict[str, dict] = {}
    children: dict[str | None, int] = {}
    for r in rows:
        node, to = r["tree_target"], r["tree_parent"]
        if r["vkind"] == "delete":
            to = DELETED_PARENT
        at = to
        if children.get(node) or node == to:  # a node without children cannot come to lie below itself
            while at is not None and at != node:
                at = parent.get(at)
            if at == node:
                continue
        if node in parent:
            children[parent[node]] -= 1
        children[to] = children.get(to, 0) + 1
        parent[node] = to
        placed[node] = r
    for node, r in placed.items():
        yield r["doc_id"], r["container"], node, parent[node], r["fractional_index"], r["lamport"], r["peer"]


def tree_placements(ops: DataFrame) -> DataFrame:
    """(doc_id, container, node_id, parent_id, fractional_index, lamport, peer): where each node of each Tree stands.

    Moves are replayed in (lamport, peer, counter) order; one that would put a node below itself is skipped. A deleted
    node stands under the parent of deleted nodes. Rows without a target are no moves.
    """
    kept = ops.filter((container_kind(F.col("container")) == "Tree") & F.col("tree_target").isNotNull())
    once = kept.select("doc_id", "container", "peer", "counter", "lamport", "vkind", "tree_target", "tree_parent", "fractional_index").dropDuplicates(["doc_id", "container", "peer", "counter"])
    return per_group(once.withColumn("_p", peer_number(F.col("peer"))), ["doc_id", "container"], ["lamport", "_p", "counter"], _replay, PLACED, stream=True)


def leaf_placements(ops: DataFrame) -> DataFrame:
    """The same as ``tree_placements``. Where no node that moves again ever has children, no loop can arise, and the last
    move of each node is its place, which needs no replay and no tree in one task; other trees are replayed."""
    kept = ops.filter((container_kind(F.col("container")) == "Tree") & F.col("tree_target").isNotNull())
    to = F.when(F.col("vkind") == "delete", F.lit(DELETED_PARENT)).otherwise(F.col("tree_parent"))
    tree = ["doc_id", "container"]
    per = kept.groupBy(*tree, F.col("tree_target").alias("node_id")).agg(F.max(F.struct("lamport", peer_number(F.col("peer")).alias("p"), "counter", to.alias("parent_id"), "fractional_index", "peer")).alias("m"), F.count_distinct("peer", "counter").alias("_moves"))
    last = cut(per, "lastmoves")
    parents = kept.select(*tree, to.alias("node_id")).filter("node_id is not null").distinct()
    loops = kept.filter(to == F.col("tree_target")).select(*tree)
    risky = cut(last.filter("_moves > 1").join(parents, [*tree, "node_id"], "left_semi").select(*tree).union(loops).distinct(), "risky")
    settled = last.join(risky, tree, "left_anti").select(*tree, "node_id", "m.parent_id", "m.fractional_index", "m.lamport", "m.peer")
    return settled if risky.isEmpty() else settled.unionByName(tree_placements(ops.join(risky, tree, "left_semi")))


def ranked(placements: DataFrame) -> DataFrame:
    """``placements`` with ``index``, the place among siblings: by fractional index, then lamport and peer of the move."""
    w = Window.partitionBy("doc_id", "container", "parent_id").orderBy(F.unhex("fractional_index"), "lamport", peer_number(F.col("peer")), "node_id")
    return placements.withColumn("index", (F.row_number().over(w) - 1).cast("bigint"))
