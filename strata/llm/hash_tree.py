"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks and shards, each with a weight (a region's and a
rack's is the sum of what lies below). A row descends level by level: each
child draws ``-ln(u) / weight``, where u is a hash of the row's doc_id and the
child's name in (0, 1), and the least draw wins. A child's draw depends on its own name
and weight alone, so a changed weight moves rows only into (or out of) the
subtree that changed. A shard is added as a region of its own: every other
weight stays, and one more shard takes rows only into itself.

The law is ``key``: doc_id and the tree decide. Rows with a null doc_id share
one key. Slots number the rows of a shard from 0 without gaps: rows are
ranked within (shard, group), where a group is a hash range of doc_id and text, and a
small table of group sizes gives each group its first slot. The number of
groups grows with the rows, so no shard is numbered in one task.

Null texts count as empty: 8 bytes, crc32 0. Repeated rows go to the same shard
and get slots of their own. Columns named like an added one are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.llm.common import broadcast_within, free

# The layout of the first 24 shards.
REGIONS, RACKS, SHARDS = 2, 3, 4
# Rows that one task numbers, about.
GROUP_ROWS = 100_000
# Group sizes (24 bytes a row) that may be broadcast.
MAX_OFFSETS = 500_000


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``shard`` is set on leaves."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``shards`` shards: whole regions first, each further shard a region of its own."""
    weights = weights or {}

    def leaf(n: int) -> Node:
        return Node(f"shard{n}", shard=n, own_weight=weights.get(n, 1.0))

    base = min(shards, REGIONS * RACKS * SHARDS)
    regions = []
    for r in range(REGIONS):
        racks = []
        for k in range(RACKS):
            at = (r * RACKS + k) * SHARDS
            own = tuple(leaf(n) for n in range(at, min(at + SHARDS, base)))
            if own:
                racks.append(Node(f"region{r}/rack{k}", own))
        if racks:
            regions.append(Node(f"region{r}", tuple(racks)))
    regions += [Node(f"region-of-{n}", (Node(f"rack-of-{n}", (leaf(n),)),)) for n in range(base, shards)]
    return Node("root", tuple(regions))


def descend(key: Column, root: Node) -> Column:
    """The shard that ``key`` reaches from ``root``, level by level."""
    nodes = [root]
    for node in nodes:
        nodes += node.children
    number = {node.name: n for n, node in enumerate(nodes)}

    def row(c: Node) -> Column:
        return F.struct(
            F.lit(c.name).alias("name"), F.lit(float(c.weight)).alias("weight"), F.lit(number[c.name]).alias("node")
        )

    # A leaf is its own only child.
    children = F.array(*[F.array(*[row(c) for c in node.children or (node,)]) for node in nodes])

    def draw(c: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, c["name"]), 11)
        cost = -F.ln((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / c["weight"]
        return F.struct(cost.alias("cost"), c["node"].alias("node"))

    at = F.lit(0)
    for _ in range(_depth(root)):
        at = F.array_min(F.transform(F.get(children, at), draw))["node"]
    return F.get(F.array(*[F.lit(n.shard) for n in nodes]), at)


def _depth(node: Node) -> int:
    return 1 + max(map(_depth, node.children)) if node.children else 0


def place(documents: DataFrame, shards: int = 24, grown: bool = False) -> DataFrame:
    """``documents`` with size, text_crc32, law, shard and slot (and grown_shard) more."""
    key = F.col("doc_id").cast("string")
    text = F.coalesce(F.col("text"), F.lit(""))
    added = {
        "size": (F.octet_length(text) + 8).cast("bigint"),
        "text_crc32": F.crc32(text),
        "law": F.lit("key"),
        "shard": descend(key, tree(shards)).cast("int"),
    }
    if grown:
        added["grown_shard"] = descend(key, tree(shards + 1)).cast("int")
    groups = 1 + documents.count() // (shards * GROUP_ROWS)
    names = free([*documents.columns, *added, "slot"], "_group", "_n", "_s", "_g", "_first", "_rank")
    group, n, s, g, first, rank = names
    # Rows of one doc_id are dealt by their text, too.
    added[group] = F.pmod(F.xxhash64(F.lit("slot"), key, F.crc32(text), F.octet_length(text)), F.lit(groups)).cast("int")
    rows = documents.withColumns(added)
    sizes = rows.groupBy("shard", group).agg(F.count(F.lit(1)).alias(n))
    before = F.sum(n).over(Window.partitionBy("shard").orderBy(group)) - F.col(n)
    offsets = sizes.select(F.col("shard").alias(s), F.col(group).alias(g), before.alias(first))
    offsets = broadcast_within(offsets, shards * groups, MAX_OFFSETS)
    # All columns of doc_id and text order rows that share a doc_id; equal rows are alike in any order.
    order = Window.partitionBy("shard", group).orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn(rank, F.row_number().over(order) - 1)
    out = ranked.join(offsets, (F.col("shard") == F.col(s)) & (F.col(group) == F.col(g)))
    return out.withColumn("slot", (F.col(first) + F.col(rank)).cast("bigint")).drop(s, g, first, rank, group)
