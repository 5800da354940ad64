"""SimHash near-dedup with BK-trees.

Fingerprints of 64 bits are linked at up to ``radius`` differing bits. Their 64 bits are cut into radius + 2 blocks; two
fingerprints within the radius agree on at least two whole blocks, so each pair of blocks with its bits is a shard in
which they meet. In each shard a BK-tree holds the fingerprints: children hang below their parent by the Hamming distance
to it, and a search follows only edges whose distance is within the radius of the query's own.

The tree of a shard goes to the tasks that need it, not to all executors: shards of all documents together grow with the
input, so a broadcast would have no bound. A shard beyond the block size is cut into chunks, and a task builds one tree of
both chunks of a pair, for each pair. Of each shard only the links of a spanning forest leave it, so
a group of n near copies gives fewer than n rows a shard.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import connected_components, deal_groups, documents, fresh, map_columns, map_groups, persist_table, with_row_id

SEED = 42
SHINGLE = 4
RADIUS = 4


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned number; zero without words or for a null."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n < size:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))
    view, digest = memoryview(flat), xxhash.xxh64_intdigest
    total, ones = n - size + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        to = min(total, at + (1 << 16))
        h = np.fromiter((digest(view[i:j], SEED) for i, j in zip(starts[at:to].tolist(), ends[at + size - 1 : to + size - 1].tolist(), strict=True)), np.uint64, to - at)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, carry: list[str], text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """The carried columns and fp, the fingerprint as a signed long."""
    work = lambda: lambda texts: [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)]
    return map_columns(docs, [text_col], carry, StructType().add("fp", "long"), work)


class BKTree:
    """BK-tree over fingerprints that also joins what it finds into components.

    A node knows whether its whole subtree is one component; a search skips such a subtree if that is the query's own
    component, so dense clusters cost little more than their number of members.
    """

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.fp: list[int] = []
        self.down: list[dict[int, int]] = []
        self.even: list[bool] = []
        self.up: list[int] = []

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def add(self, fp: int) -> list[int]:
        """Adds a fingerprint not yet in the tree; returns one member for each component that it joins."""
        me, r, found = len(self.fp), self.radius, []
        self.up.append(me)
        todo = [0] if me else []
        while todo:
            x = todo.pop()
            d = (self.fp[x] ^ fp).bit_count()
            if d <= r and self.find(x) != self.find(me):
                self.up[self.find(x)] = self.find(me)
                found.append(self.fp[x])
            if self.even[x] and self.find(x) == self.find(me):
                continue
            todo += [y for edge, y in self.down[x].items() if d - r <= edge <= d + r]
        self.fp.append(fp)
        self.down.append({})
        self.even.append(True)
        x = 0
        while x != me:
            if self.even[x] and self.find(x) != self.find(me):
                self.even[x] = False
            x = self.down[x].setdefault((self.fp[x] ^ fp).bit_count(), me)
        return found


def shard_keys(radius: int = RADIUS) -> list[str]:
    """SQL for the shards of column fp: for each pair of blocks its number and the bits of both."""
    blocks = radius + 2
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    part = [f"((shiftrightunsigned(fp, {a})) & {(1 << (b - a)) - 1}L)" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    width = [b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [f"({k}L << 40) | ({part[i]} << {width[j]}) | {part[j]}" for k, (i, j) in enumerate(combinations(range(blocks), 2))]


def near_links(fps: DataFrame, radius: int = RADIUS, block: int = 20_000) -> DataFrame:
    """Links (a, b) between distinct longs fp within the radius, enough to span each component."""
    keyed = fps.select("fp", F.explode(F.array(*[F.expr(k) for k in shard_keys(radius)])).alias("shard"))

    def link(group: pd.DataFrame) -> pd.DataFrame | None:
        values = group["fp"].tolist()
        if len(values) == 2:
            a, b = values
            return pd.DataFrame({"a": [a], "b": [b]}) if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius else None
        tree, out = BKTree(radius), []
        for fp in values:
            out += [(fp, x) for x in tree.add(fp & (1 << 64) - 1)]
        if not out:
            return None
        a = np.array([x for x, _ in out], np.int64)
        return pd.DataFrame({"a": a, "b": np.array([y for _, y in out], np.uint64).view(np.int64)})

    return map_groups(deal_groups(keyed, "shard", block), ["shard", "_a", "_b"], link, "a long, b long")


def near_groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """rows with fp, and root: the fp that names the component. Rows of one fp are one node."""
    fps = persist_table(rows.select("fp").distinct())
    comp = connected_components(near_links(fps, radius))
    comp = persist_table(comp.select(F.col("node").alias("fp"), "root"))
    return rows.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits) and component_id, the smallest id reachable by links.

    Documents without words, null texts among them, have fingerprint zero and link like any other. Repeated ids and equal
    rows give a row each. Null ids get the smallest id of their component, null if it has none. No documents, no rows.
    """
    rows = persist_table(fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["id"]))
    low = rows.groupBy("fp").agg(F.min("id").alias("id"))
    root = persist_table(near_groups(low, radius))
    small = root.groupBy("root").agg(F.min("id").alias("component_id"))
    comp = persist_table(root.join(small, "root").select("fp", "component_id"))
    return rows.join(comp, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The documents, one of each component: that with the smallest id, null ids last, then the first row in the table."""
    row = fresh(docs, "_row")
    rows = with_row_id(docs, row)
    fp = persist_table(fingerprints(rows.select(F.col(row).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")), ["row", "id"]))
    best = fp.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
    root = persist_table(near_groups(best, radius))
    keep = root.groupBy("root").agg(F.min("best").alias("best")).select("root", F.col("best.row").alias("keep"))
    # the rows that go are fewer than those that stay, and narrow: where they are few enough they are broadcast, and texts do not move
    gone = fp.select("fp", "row").join(root.select("fp", "root").join(keep, "root"), "fp").filter("row <> keep").select(F.col("row").alias(row))
    return rows.join(persist_table(gone), row, "left_anti").drop(row)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, fingerprint, component_id."""
    return simhash_components(documents(spark, sf_dir))
