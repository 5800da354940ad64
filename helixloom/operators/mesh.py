"""Shortest ways through folded scaffolds, for all pairs of bases of all designs at once.

A folded scaffold is a graph: bases are joined along the scaffold, and across crossovers. Only bases at crossovers, and the
ends of the ways that are asked for, matter; the stretches between two of them are edges as long as they are. From each start
the search goes on in rounds over arrays, for many pairs of many designs in one: a round follows the edges of the places
reached last, and a place goes on only if it was reached over fewer bases than before. No way is longer than the one along
the scaffold, so nothing beyond that is followed. A row is a design with its crossings and its pairs, so Spark deals out designs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import prepare
from .matching import ID

PAIR = [ID, "start", "goal"]
#: Fixed value: pairs that are searched together; what they have reached is all that a task holds beyond its batch.
BLOCK = 100_000


def _edges(design: np.ndarray, at: np.ndarray, n: np.ndarray, circular: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First edge of each place and one more, far ends and lengths; places (design, at) are sorted, u and v are numbers of places."""
    k = np.arange(len(at))
    first = np.searchsorted(design, design)
    last = np.searchsorted(design, design, side="right") - 1
    nxt = np.where(k < last, k + 1, first)
    w = np.where(k < last, at[nxt] - at, np.where(circular[design], n[design] - at + at[first], 0))
    x, y = np.concatenate([k, nxt, u, v]), np.concatenate([nxt, k, v, u])
    w = np.concatenate([w, w, np.ones(2 * len(u), w.dtype)])
    ok = (x != y) & (w > 0)
    x, y, w = x[ok], y[ok], w[ok]
    order = np.argsort(x, kind="stable")
    return np.searchsorted(x[order], np.arange(len(at) + 1)), y[order], w[order]


def _search(start: np.ndarray, goal: np.ndarray, most: np.ndarray, edges: tuple[np.ndarray, np.ndarray, np.ndarray], places: int) -> np.ndarray:
    """Bases on the shortest ways from start to goal, at most most."""
    first, to, w = edges
    out = most.copy()
    pair, x, d = np.arange(len(start)), start, np.zeros(len(start), np.int64)
    seen, dist = pair * places + x, d
    while len(pair):
        many = first[x + 1] - first[x]
        e = np.repeat(first[x] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        pair, d, x = np.repeat(pair, many), np.repeat(d, many) + w[e], to[e]
        # a place is worth going on from if it leaves room for one more step below what the pair has
        there = x == goal[pair]
        np.minimum.at(out, pair[there], d[there])
        ok = ~there & (d + 1 < out[pair])
        key, d = pair[ok] * places + x[ok], d[ok]
        order = np.lexsort((d, key))
        key, d = key[order], d[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key, d = key[new], d[new]
        j = np.searchsorted(seen, key)
        old = j < len(seen)
        old[old] = seen[j[old]] == key[old]
        better = ~old
        better[old] = d[old] < dist[j[old]]
        dist[j[old & better]] = d[old & better]
        seen, dist = np.insert(seen, j[~old], key[~old]), np.insert(dist, j[~old], d[~old])
        key, d = key[better], d[better]
        pair, x = key // places, key % places
    return out


def _hops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, circular = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(2).to_numpy(zero_copy_only=False)
        ends, rows = [], []
        for c in (3, 4):
            lists = batch.column(c)
            rows.append(np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)))
            ends.append([lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)])
        (a, b), (u, v) = ends
        wide = int(n.max(initial=0)) + 1
        keys = [r * wide + x for r, x in ((rows[0], a), (rows[0], b), (rows[1], u), (rows[1], v))]
        places = np.unique(np.concatenate(keys))
        a, b, u, v = (np.searchsorted(places, k) for k in keys)
        design, at = places // wide, places % wide
        edges = _edges(design, at, n, circular, u, v)
        for k in range(0, len(a), BLOCK):
            p, s, g = rows[0][k : k + BLOCK], a[k : k + BLOCK], b[k : k + BLOCK]
            gap = np.abs(at[s] - at[g])
            most = np.where(circular[p], np.minimum(gap, n[p] - gap), gap)
            hops = _search(s, g, most, edges, len(places))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(p)), *[pa.array(x.astype(np.int32)) for x in (at[s], at[g], hops)]], names=[*PAIR, "hops"])


def shortest_hops(pairs: DataFrame, crossings: DataFrame, design: DataFrame) -> DataFrame:
    """design_id, start, goal, hops for the distinct pairs: steps of the shortest way, none from a base to itself.

    crossings are design_id, u, v. Pairs and crossings with a base outside the scaffold are left out. A design's pairs and
    crossings are collected to its row; the rounds are as many as the shortest ways have stretches and crossings.
    """
    prepare(design.sparkSession)
    ends = lambda df, a, b, name: df.filter(f"{a} >= 0 and {b} >= 0").groupBy(ID).agg(F.collect_set(F.struct(F.col(a).cast("int").alias("a"), F.col(b).cast("int").alias("b"))).alias(name))
    at = design.select(ID, "n", "circular").join(ends(pairs, "start", "goal", "_p"), ID).join(ends(crossings, "u", "v", "_c"), ID, "left")
    none = F.array().cast("array<struct<a:int,b:int>>")
    inside = lambda c: F.filter(F.coalesce(c, none), lambda x: (x.a < F.col("n")) & (x.b < F.col("n"))).alias(c)
    at = at.select(ID, F.col("n").cast("int").alias("n"), "circular", inside("_p"), inside("_c"))
    return at.mapInArrow(_hops, f"{ID} {at.schema[ID].dataType.simpleString()}, start int, goal int, hops int")


def route_distances(sections: DataFrame, crossings: DataFrame, design: DataFrame, keys: list[str]) -> DataFrame:
    """keys and distance of routes (keys with design_id; section_id, i53, runlen): their bases, and what their crossovers bridge.

    A crossover counts the bases on the shortest way between its ends, both of them included.
    """
    w = Window.partitionBy(*keys).orderBy("section_id")
    at = sections.join(design.select(ID, "n", "circular"), ID).withColumn("goal", F.lead("i53").over(w))
    u = F.col("i53") - F.col("runlen") + 1
    at = at.withColumn("start", F.when(F.col("circular"), F.pmod(u, F.col("n"))).otherwise(u).cast("int"))
    hops = shortest_hops(at.filter("goal is not null"), crossings, design)
    bridged = F.when(F.col("goal").isNotNull(), F.coalesce(F.col("hops") + 1, F.lit(0))).otherwise(0)
    return at.join(hops, PAIR, "left").groupBy(*keys).agg((F.sum("runlen") + F.sum(bridged)).cast("long").alias("distance"))
