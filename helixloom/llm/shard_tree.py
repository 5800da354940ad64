"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A tree has regions, racks and shards; a node weighs what its shards weigh. From the root down each level draws: every
child gets -ln(u) / weight with u in (0, 1) hashed from the key and the child's name, and the least draw wins, so a child
wins in proportion to its weight, and a change of one weight moves keys only to or from that child. Movement thus stays
in the subtrees whose weights change. Shards added later each open a region of their own, so that the draw at the root is
the only one that changes and rows move only into the new shard.

Slots number the rows of a shard from 0 without gaps. Equal rows are counted first; the groups are cut into buckets by a
hash, of about ``ROWS`` groups each at any size, each bucket numbers its own groups, and running totals of the buckets'
sizes are added. No task sees a whole shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import documents

#: Groups of equal rows to a bucket, about.
ROWS = 20_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(shards: int, racks: int = 2, per_rack: int = 2) -> list[Leaf]:
    """A tree of equal weights for 0 .. shards - 1: regions of some racks, racks of some shards."""
    return [Leaf(f"g{s // (racks * per_rack)}", f"k{s // per_rack}", s) for s in range(shards)]


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    new = max((x.shard for x in leaves), default=-1) + 1
    return [*leaves, Leaf(f"own{new}", f"own{new}", new, weight)]


def _draw(key: Column, name: str, weight: float) -> Column:
    u = (F.pmod(F.xxhash64(key, F.lit(name)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / F.lit(float(weight))


def _pick(key: Column, options: list[tuple[str, float, Column]]) -> Column:
    """The value of the option with the least draw; the first of equals."""
    if len(options) == 1:
        return options[0][2]
    draws = [F.struct(_draw(key, name, weight).alias("d"), F.lit(k).alias("k")) for k, (name, weight, _) in enumerate(options)]
    best = F.least(*draws).getField("k")
    out = F.when(best == 0, options[0][2])
    for k, (_, _, value) in enumerate(options[1:], 1):
        out = out.when(best == k, value)
    return out


def place(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a key. Leaves of weight 0 get nothing; null keys are a key of their own."""
    live = [x for x in leaves if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    regions: dict[str, dict[str, list[Leaf]]] = {}
    for x in live:
        regions.setdefault(x.region, {}).setdefault(x.rack, []).append(x)
    heavy = lambda xs: sum(x.weight for x in xs)
    at_root = []
    for region, racks in regions.items():
        at_region = []
        for rack, xs in racks.items():
            shards = [(f"shard/{x.shard}", x.weight, F.lit(x.shard)) for x in xs]
            at_region.append((f"rack/{region}/{rack}", heavy(xs), _pick(key, shards)))
        at_root.append((f"region/{region}", heavy([x for xs in racks.values() for x in xs]), _pick(key, at_region)))
    return _pick(key, at_root).cast("int")


def shard_documents(docs: DataFrame, leaves: list[Leaf], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the tree alone decide the shard; grown_shard is the shard with one more. size is the
    UTF-8 bytes of the text, none for a null, plus 1; text_crc32 is that of the same bytes. Null ids are one key, so they
    share a shard; equal rows get slots of their own. An empty table gives no rows. Other columns do not matter.
    """
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(F.encode(raw, "UTF-8")).alias("text_crc32"))
    groups = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    total = rows.agg(F.expr(f"cast(ceil(count(*) / {ROWS}.0) as int)").alias("buckets"))
    groups = groups.withColumn("shard", place(F.col("doc_id"), leaves)).withColumn("grown_shard", place(F.col("doc_id"), grow(leaves)))
    buckets = max(1, total.first()["buckets"])
    groups = groups.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit("bucket")), F.lit(buckets)).cast("int"))
    sizes = groups.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = groups.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, ["shard", "bucket"])
    slots = F.explode(F.sequence(F.col("first") + F.col("offset"), F.col("first") + F.col("offset") + F.col("n") - 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slots.alias("slot"), "grown_shard")


def op6_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 8 shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return shard_documents(documents(spark, sf_dir), tree(8))
