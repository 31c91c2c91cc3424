"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with u from a hash
of the row's key and the child's name, and the least draw wins, so a child is taken in proportion to its
weight. A draw depends on its own child alone: when a weight changes, rows move only into or out of that
child's subtree. Capacity grows by whole regions, so that one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logaudit.llm.common import shuffle_width, written

LAW = "key"
SHARDS = 8


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a leaf has a shard number, an inner node has children."""

    name: str
    weight: float
    children: tuple[Node, ...] = ()
    shard: int = -1


def tree(shards: int = SHARDS, racks: int = 2, per_rack: int = 2, base: int = SHARDS) -> Node:
    """The topology of so many shards of weight 1.

    The first ``base`` shards fill regions of ``racks`` racks of ``per_rack`` shards. Each further shard is
    a region of its own: an old region's weight never changes, so its rows stay or leave for the new one.
    Below ``base`` shards every shard is a region of its own, for the same reason.
    """
    leaf = lambda s, path: Node(f"{path}/shard{s}", 1.0, (), s)
    regions: list[Node] = []
    first = base if shards >= base else 0
    size = racks * per_rack
    for r in range(0, first, size):
        inner = []
        for k in range(r, min(r + size, first), per_rack):
            leaves = tuple(leaf(s, f"region{r}/rack{k}") for s in range(k, min(k + per_rack, r + size, first)))
            inner.append(Node(f"region{r}/rack{k}", sum(x.weight for x in leaves), leaves))
        regions.append(Node(f"region{r}", sum(x.weight for x in inner), tuple(inner)))
    for s in range(first, shards):
        rack = Node(f"single{s}/rack", 1.0, (leaf(s, f"single{s}/rack"),))
        regions.append(Node(f"single{s}", 1.0, (rack,)))
    return Node("", sum(x.weight for x in regions), tuple(regions))


def draw(key: Column, node: Node) -> Column:
    """The node's draw for a key: 52 bits of an MD5 as a number in (0, 1), to the weight's scale."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{node.name}:"), key).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / F.lit(node.weight)


def descend(key: Column, node: Node) -> Column:
    """The shard that a key reaches from a node: of equal draws the first child wins."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = F.array(*[draw(key, c) for c in node.children])
    chosen = F.array_position(draws, F.array_min(draws))
    out = None
    for i, child in enumerate(node.children, 1):
        below = descend(key, child)
        out = F.when(chosen == i, below) if out is None else out.when(chosen == i, below)
    return out


def numbered(df: DataFrame, group: str, order: list[str], slot: str = "slot") -> DataFrame:
    """Adds ``slot``: the place of a row in its group by ``order``, from 0 without gaps.

    Rows are dealt by ranges of ``order``; counts of each group in each range give every range its first
    number, and only rows of one group in one range are numbered together. A group may hold any share of
    all rows.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_width(spark), *order).withColumn("_part", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    counts = ranged.groupBy("_part", group).count()
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", group, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    local = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    return (
        ranged.withColumn("_local", local)
        .join(firsts, ["_part", group])
        .withColumn(slot, (F.col("_first") + F.col("_local")).cast("long"))
        .drop("_part", "_first", "_local")
    )


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row.

    The key and the number of shards decide the shard; ``grown_shard`` is the shard with one more of them.
    Slots number a shard's rows by key, then checksum, then size. Size is the text's UTF-8 bytes plus 1;
    a null text has none and the checksum of an empty one. Rows of a null key share the key ''; repeated
    rows share a shard and have slots of their own. Extra columns are ignored, an empty table gives none.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    placed = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        descend(key, tree(shards)).alias("shard"),
        descend(key, tree(shards + 1)).alias("grown_shard"),
    )
    return numbered(placed, "shard", ["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def query(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _sql_draw(node: Node) -> str:
    return (
        f"(-ln((('0x' || substr(md5('{node.name}:' || k), 1, 13))::BIGINT::DOUBLE + 0.5) / {float(1 << 52)!r}::DOUBLE)"
        f" / {node.weight!r}::DOUBLE)"
    )


def _sql_descend(node: Node) -> str:
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_descend(node.children[0])
    draws = "[" + ", ".join(map(_sql_draw, node.children)) + "]"
    cases = " ".join(f"WHEN {i} THEN {_sql_descend(c)}" for i, c in enumerate(node.children, 1))
    return f"(CASE list_position({draws}, list_min({draws})) {cases} END)"


SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(0, 8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i)
              ORDER BY i) AS t
  FROM range(0, 256) r(i)
), d AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS k, encode(coalesce(text, '')) AS b FROM documents
), h AS (
  SELECT doc_id, k, hex(b) AS x, octet_length(b) AS n FROM d
), c AS (
  SELECT doc_id, k, n + 1 AS size,
         xor(list_reduce(list_transform(range(0, n), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
                         lambda crc, byte: xor(crc >> 8, t[(xor(crc, byte) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc
  FROM h, crc_table
), s AS (
  SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, {_sql_descend(tree(SHARDS))}::INTEGER AS shard,
         {_sql_descend(tree(SHARDS + 1))}::INTEGER AS grown_shard
  FROM c
)
SELECT doc_id, size, text_crc32, '{LAW}' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1)::BIGINT AS slot, grown_shard
FROM s
"""
