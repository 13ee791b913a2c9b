"""Hierarchical weighted hash tree: region, rack and shard are drawn level by level.

At each node every child draws ln(u) / weight, u a hash of the row's key and the child's name; the largest draw wins,
so a child gets rows in proportion to its weight. A draw depends on nothing but the key and that child: where weights
change, rows move only into or out of the subtrees that changed. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, unit

#: Parts of a shard that are numbered on their own; bounds the rows of one task at any input size that 8 x SLICES tasks can hold.
SLICES = 512
SLICE_ROWS = 100_000


@dataclass(frozen=True)
class Node:
    """A shard (number set, no children), a rack or a region."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int = -1
    weight: float = 1.0

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


def tree(shards: int, racks: int = 2, per_rack: int = 2, base: int = 8) -> Node:
    """Regions of racks * per_rack shards for the first base shards; each later shard is a region of its own.

    So one more shard changes no weight but the new region's, and takes rows only into itself.
    """
    regions, held = [], min(shards, base)
    for r in range(0, held, racks * per_rack):
        own = range(r, min(r + racks * per_rack, held))
        rows = [[s for s in own if (s - r) // per_rack == k] for k in range(racks)]
        regions.append(Node(f"g{r}", tuple(Node(f"g{r}.k{k}", tuple(Node(f"s{s}", shard=s) for s in row)) for k, row in enumerate(rows) if row)))
    for s in range(base, shards):
        regions.append(Node(f"g{s}", (Node(f"g{s}.k0", (Node(f"s{s}", shard=s),)),)))
    return Node("root", tuple(regions))


def placed(key: Column, node: Node) -> Column:
    """The shard of a key, as an expression."""
    if not node.children:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return placed(key, node.children[0])
    live = [c for c in node.children if c.total > 0]
    draws = F.array(*[F.struct((F.ln(unit(key, c.name)) / F.lit(c.total)).alias("draw"), F.lit(i).alias("i")) for i, c in enumerate(live)])
    won = F.array_max(draws)["i"]
    out = F.when(won == 0, placed(key, live[0]))
    for i, c in enumerate(live[1:], 1):
        out = out.when(won == i, placed(key, c))
    return out


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str, slices: int | None = None) -> DataFrame:
    """rows with a gapless number from 0 within each group of by.

    A group is cut into slices by a hash of order; a slice is numbered alone and starts after those before it, so
    no task holds a whole group. The number of slices follows the number of rows. rows must be cheap to read twice and must have no column named slice.
    """
    from pyspark.sql import Window as W

    slices = slices or max(SLICES, rows.count() // SLICE_ROWS)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = materialize(rows.groupBy(*by, "slice").agg(F.count("*").alias("n")), "slices")
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy(*by).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select(*by, "slice", F.coalesce("before", F.lit(0)).alias("before"))
    within = F.row_number().over(W.partitionBy(*by, "slice").orderBy(*order))
    return rows.withColumn("within", within).join(before, [*by, "slice"]).withColumn(name, F.col("before") + F.col("within") - 1).drop("slice", "within", "before")


def sharded(docs: DataFrame, now: Node, grown: Node) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 length (null: 0) plus 1; a null doc_id is a key like any other. Rows that repeat a doc_id go
    to one shard, in slots of their own. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", (F.length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), placed(key, now).cast("int").alias("shard"), placed(key, grown).cast("int").alias("grown_shard"))
    out = numbered(materialize(rows, "placed"), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
