"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends from region to rack to shard. At each level every child draws -ln(u) / weight, u being a hash of the
row's id and the child's name, and the smallest draw wins; a child wins in proportion to its weight. A draw depends on
nothing but the id, the name and the weight, so a changed weight moves rows only into or out of the subtree that has it.
Later shards open a region of their own: no existing weight changes, and the new shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import each_copy, free_name, gapless

BASE = 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has its number and no children."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def mass(self) -> float:
        return sum(c.mass for c in self.children) if self.children else self.weight


def hash_tree(shards: int, base: int = BASE, racks: int = 2, per_rack: int = 2) -> Node:
    """Shards below ``base`` fill regions of ``racks`` x ``per_rack``; each later one, up to ``shards``, has a region of its own.

    ``base`` is the number of shards when the corpus was first placed; trees of one base and n, n + 1, ... shards
    differ by the new regions alone. With fewer shards than ``base``, the base is that number.
    """
    if shards < 1 or base < 1 or racks < 1 or per_rack < 1:
        raise ValueError("a tree has at least one shard, rack and region")
    leaf = lambda k: Node(f"shard {k}", shard=k)
    first = min(shards, base)
    in_racks = [Node(f"rack {at // per_rack}", children=tuple(leaf(k) for k in range(at, min(at + per_rack, first)))) for at in range(0, first, per_rack)]
    regions = [Node(f"region {at // racks}", children=tuple(in_racks[at : at + racks])) for at in range(0, len(in_racks), racks)]
    grown = [Node(f"region of {k}", children=(Node(f"rack of {k}", children=(leaf(k),)),)) for k in range(first, shards)]
    return Node("root", children=(*regions, *grown))


def _draw(key: Column, node: Node) -> Column:
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(node.name), key), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(uniform) / F.lit(float(node.mass))


def shard_column(key: Column, tree: Node) -> Column:
    """The shard of ``key``: one draw a child on each level of the way down."""
    children = [c for c in tree.children if c.mass > 0]
    if not tree.children:
        return F.lit(tree.shard).cast("int")
    if not children:
        raise ValueError(f"{tree.name} has no child of positive weight")
    if len(children) == 1:
        return shard_column(key, children[0])
    won = F.array_min(F.array(*[F.struct(_draw(key, c).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(children)]))["i"]
    if all(not c.children for c in children):
        return F.element_at(F.array(*[F.lit(c.shard) for c in children]), won + 1).cast("int")
    below = F.when(won == 0, shard_column(key, children[0]))
    for i, c in enumerate(children[1:], 1):
        below = below.when(won == i, shard_column(key, c))
    return below


def assign_shards(docs: DataFrame, tree: Node, id_col: str = "doc_id", shard_col: str = "shard") -> DataFrame:
    """All columns and, last, the shard of each row; a projection, without a shuffle. Where ``docs`` has a column ``shard_col``, that one
    stays as it is and the new one gets underscores behind its name until it differs from all."""
    return docs.withColumn(free_name(docs, shard_col), shard_column(F.col(id_col), tree))


def number_shards(docs: DataFrame, tree: Node, grown: Node, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the id, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32`` (unsigned; 0 for none), ``law`` ("key"),
    ``shard``, ``slot`` (0, 1, 2, ... within the shard) and ``grown_shard``, the shard in the tree ``grown``.

    The id and the tree alone decide the shard, so rows of one id share it; null ids share one too. A null text counts
    as empty. Slots follow a hash of id and text and do not depend on how the input is cut. Rows equal in id,
    size and checksum are summed up before they move, and take as many slots in a row. Other columns are ignored.
    An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id_of_row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.groupBy("id_of_row", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("shard", shard_column(F.col("id_of_row"), tree)).withColumn("grown_shard", shard_column(F.col("id_of_row"), grown))
    buckets = max(1024, docs.count() >> 18)
    placed = each_copy(gapless(rows, ["shard"], ["id_of_row", "size", "text_crc32"], buckets, "copies"), "copies", "nth")
    return placed.select(F.col("id_of_row").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("pos") + F.col("nth")).alias("slot"), "grown_shard")
