"""Operator 2, sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards with weights. A document descends it: at each node every child draws
-ln(u) / weight, where u is a hash of the document's id and the child's own name, and the least draw wins. A child's
weight is the sum of the weights below it, so shards fill by weight. A draw depends on the child alone: changing a
weight moves documents into or out of that child's subtree only, and adding a subtree at the top moves documents into
it only.

Law `key`: the id and the cluster decide. `grown` adds one shard, in a rack and region of its own, so one more shard
takes rows into itself alone.

The draws use md5, so SQL can repeat them. A null id counts as a text of its own ('null'); null text has size 1.
Repeated rows share their shard and follow one another in it. Slots count a shard's rows in order of id (nulls last),
text size and hash; rows equal in all three are interchangeable. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapsegrid.llm.common import saved


@dataclass(frozen=True)
class Node:
    """A region, a rack or, without children, a shard with its number."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int | None = None


def cluster(shards: int, shards_a_rack: int = 4, racks_a_region: int = 2) -> Node:
    """Equal shards in full racks and regions, as far as they go."""
    leaves = [Node(f"s{i}", 1.0, shard=i) for i in range(shards)]

    def level(nodes: list[Node], size: int, letter: str) -> list[Node]:
        groups = [nodes[i : i + size] for i in range(0, len(nodes), size)]
        return [Node(f"{letter}{i}", sum(n.weight for n in g), tuple(g)) for i, g in enumerate(groups)]

    regions = level(level(leaves, shards_a_rack, "k"), racks_a_region, "r")
    return Node("all", float(shards), tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree and one more shard, in a rack and a region of its own."""
    leaf = Node(f"s{shard}", weight, shard=shard)
    region = Node(f"r+{shard}", weight, (Node(f"k+{shard}", weight, (leaf,)),))
    return Node(tree.name, tree.weight + weight, (*tree.children, region))


def _draw(key: Column, node: Node) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + node.name))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(2**48))
    return -F.ln(u) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard that a key (a string column) reaches."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    least = F.least(*[_draw(key, c) for c in node.children])
    found = descend(key, node.children[-1])
    for child in node.children[-2::-1]:
        found = F.when(_draw(key, child) == least, descend(key, child)).otherwise(found)
    return found


def numbered(rows: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """rows with a gapless number from 0 within each group. Ranges of the order are counted apart, so a group of any size is split.

    Only the rows' few columns move; the counts that cross ranges are one per range and group.
    """
    from pyspark.sql import Window

    ranged = rows.repartitionByRange(F.col(group), *order).withColumn("__range", F.spark_partition_id())
    ranged = saved(ranged, "ranges")
    counts = ranged.groupBy(group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)) - 1
    return ranged.withColumn("__within", within).join(before, [group, "__range"]).withColumn(name, F.col("__before") + F.col("__within")).drop("__range", "__n", "__before", "__within")


def shard_documents(docs: DataFrame, tree: Node, larger: Node, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and the shard in the larger tree for every row."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("__text"))
    rows = rows.select("doc_id", (F.octet_length("__text") + 1).cast("long").alias("size"), F.crc32("__text").alias("text_crc32"))
    rows = rows.withColumn("shard", descend(key, tree).cast("int")).withColumn("grown_shard", descend(key, larger).cast("int"))
    return numbered(rows, "shard", [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32")], "slot")


def descend_sql(key: str, node: Node) -> str:
    """The same descent as an SQL expression."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return descend_sql(key, node.children[0])

    def draw(n: Node) -> str:
        return f"(-ln((('0x' || substr(md5({key} || '/{n.name}'), 1, 12))::BIGINT + 0.5) / {2**48}.0) / {n.weight})"

    least = f"least({', '.join(draw(c) for c in node.children)})"
    cases = " ".join(f"WHEN {draw(c)} = {least} THEN {descend_sql(key, c)}" for c in node.children[:-1])
    return f"CASE {cases} ELSE {descend_sql(key, node.children[-1])} END"
