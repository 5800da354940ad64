"""Helpers that the training-data operators share: shared tables, row ids, groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import drop_table, prepare, write_table

#: Most members of a group that one task holds at once; larger groups are dealt out in blocks.
BLOCK = 20_000


def persist_table(df: DataFrame) -> DataFrame:
    """write_table, noted in the scope that is open."""
    out = write_table(df)
    if SCOPES:
        SCOPES[-1].append(out)
    return out


#: Lists of the tables written since each scope was opened; see table_scope.
SCOPES: list[list[DataFrame]] = []


@contextmanager
def table_scope() -> Iterator[list[DataFrame]]:
    """Collects the tables that persist_table writes inside, for a caller that knows when their results have been written."""
    SCOPES.append([])
    try:
        yield SCOPES[-1]
    finally:
        SCOPES.pop()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def column(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_columns(df: DataFrame, reads: list[str], keeps: list[str], made: StructType, work: Callable[[], Callable[..., list]]) -> DataFrame:
    """The columns keeps as they are, and the columns made, which work()(lists of the columns reads) gives for a batch.

    What is kept stays in Arrow: no value of it, an id beside a null among them, goes through another type.
    """
    prepare(df.sparkSession)
    at = df.select(*[column(c).alias(f"k{i}") for i, c in enumerate(keeps)], *[column(c).alias(f"r{i}") for i, c in enumerate(reads)])
    names, types, n = [f.name for f in made], [to_arrow_type(f.dataType) for f in made], len(keeps)
    out = StructType([at.schema[f"k{i}"] for i in range(n)] + [type(f)(f"m{i}", f.dataType, True) for i, f in enumerate(made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = work()
        for batch in batches:
            got = todo(*[batch.column(n + i).to_pylist() for i in range(len(reads))])
            arrays = [batch.column(i) for i in range(n)] + [pa.array(v, type=t) for v, t in zip(got, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[f"k{i}" for i in range(n)] + [f"m{i}" for i in range(len(types))])

    done = at.mapInArrow(run, out)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keeps)], *[F.col(f"m{i}").alias(c) for i, c in enumerate(names)])


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Adds a unique long per row and fixes it by writing the table, so that repeated ids and rows stay apart."""
    return persist_table(df.withColumn(name, F.monotonically_increasing_id()))


def deal_groups(df: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Deals the members of each group of two or more to tasks, in columns key, _a and _b.

    A group of up to ``block`` members is one task (_a = _b = 0). A larger one is cut into _c chunks by a hash of the
    whole row, _h is a row's chunk, and each pair of chunks _a < _b is a task, so that any two members meet in a task and
    no task holds more than two chunks.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1")
    wide = df.join(sizes, key)
    rest = [F.col(c) for c in df.columns if c != key]
    wide = wide.withColumn("_c", F.expr(f"cast(ceil(_n / {block}.0) as int)"))
    wide = wide.withColumn("_h", F.when(F.col("_c") > 1, F.pmod(F.xxhash64(*rest), F.col("_c")).cast("int")).otherwise(0))
    one = wide.filter("_c = 1").withColumn("_a", F.lit(0)).withColumn("_b", F.lit(0))
    many = (
        wide.filter("_c > 1")
        .withColumn("_o", F.explode(F.expr("filter(sequence(0, _c - 1), x -> x <> _h)")))
        .withColumn("_a", F.least("_h", "_o"))
        .withColumn("_b", F.greatest("_h", "_o"))
    )
    cols = [key, "_a", "_b", "_c", "_h", *[c for c in df.columns if c != key]]
    return one.select(*cols).unionByName(many.select(*cols))


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """Runs fn on each group of rows with equal integer keys, streaming over sorted partitions.

    Unlike a grouped map, groups of a few rows cost no call of Spark's each, and only one group is held beyond a batch.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def groups() -> Iterator[pd.DataFrame]:
            last = None
            for batch in batches:
                if not len(batch):
                    continue
                k = batch[keys].to_numpy()
                cut = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(batch)]
                for i, j in zip(cut[:-1], cut[1:], strict=True):
                    if held and last != tuple(k[i]):
                        yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                        held.clear()
                    held.append(batch.iloc[i:j])
                    last = tuple(k[i])
            if held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]

        out, rows = [], 0
        for group in groups():
            made = fn(group)
            if made is not None and len(made):
                out.append(made)
                rows += len(made)
                if rows > 50_000:
                    yield pd.concat(out, ignore_index=True)
                    out, rows = [], 0
        if out:
            yield pd.concat(out, ignore_index=True)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


class Forest:
    """Union-find over any hashable members; the smallest member is the root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def union(self, x, y) -> bool:
        a, b = self.find(x), self.find(y)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
            forest.union(a, b)
    out = [(x, forest.find(x)) for x in list(forest.up)]
    out = [(x, r) for x, r in out if x != r]
    for k in range(0, len(out), 100_000):
        yield pd.DataFrame(out[k : k + 100_000], columns=["a", "b"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph given by long columns a and b: rows (node, root), root the smallest node.

    Each partition first replaces its edges by stars of its own small union-find; then large-star and small-star rounds
    run until no edge changes. Only links and labels move, nothing comes to the driver but a checksum. Nodes without
    edges do not appear. No edges give an empty table.
    """
    prepare(edges.sparkSession)
    now = persist_table(edges.select("a", "b").filter("a <> b").mapInPandas(_stars, "a long, b long").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    was = mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a")
        small = small.select(F.expr("explode(array(named_struct('a', a, 'b', m), named_struct('a', b, 'b', m)))").alias("e")).select("e.*")
        nxt = persist_table(small.filter("a <> b").distinct())
        drop_table(now)
        now, at = nxt, mark(nxt)
        if at == was:
            break
        was = at
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
