"""Whitening of embeddings from an exact integer scatter.

Entries become integers x = floor(scale * c). The distinct vectors of integers are the fit list. Each task subtracts one
fixed vector of integers, the shift, and sums what is left and its cross-products without rounding: numbers are cut into
limbs of 20 bits, whose products in float64 stay below 2**53 for a block of rows, and the blocks' sums are added as Python
integers of any size. Tasks' sums are added in a tree. n * X'X - S S' is formed exactly from them, does not depend on the
shift, and only then becomes floating point: divided by n * n it is the covariance, which eigh decomposes.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .shared import column, drop_table, persist_table

#: Bits of a limb, and rows whose products of limbs are summed in float64: 2 * (20 - 1) + 13 bits stay below 53.
LIMB, ROWS = 20, 1 << 13
SCALE, COMPONENTS = 256, 4
Sums = tuple[int, list, list]


def matrix(array: pa.Array) -> np.ndarray:
    """Lists of one length without nulls as a matrix of int64."""
    return array.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(array), -1)


def limbs(x: np.ndarray) -> list[np.ndarray]:
    """Integers (int64, or objects beyond) as float64 matrices l with x = sum of l[k] * 2**(LIMB * k), |l| <= 2**(LIMB - 1)."""
    out, half = [], 1 << (LIMB - 1)
    while x.any():
        low = ((x + half) & ((1 << LIMB) - 1)) - half
        out.append(low.astype(np.float64))
        x = (x - low) >> LIMB
        if x.dtype == object and all(abs(v) < 1 << 62 for v in x.ravel()):
            x = x.astype(np.int64)
    return out


def less(x: np.ndarray, shift: list[int]) -> np.ndarray:
    """x - shift, as objects where int64 could overflow."""
    big = 1 << 61
    if x.size and (max(-int(x.min()), int(x.max())) >= big or any(abs(s) >= big for s in shift)):
        return x.astype(object) - np.array(shift, dtype=object)
    return x - np.array(shift, dtype=np.int64)


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and X'X of up to ROWS rows, as Python integers, exact."""
    wide = x.shape[1]
    total, cross = np.zeros(wide, dtype=object), np.zeros((wide, wide), dtype=object)
    whole = lambda m: m.astype(np.int64).astype(object)
    parts = limbs(x)
    for a, left in enumerate(parts):
        total += whole(left.sum(axis=0)) << (LIMB * a)
        for b, right in enumerate(parts):
            cross += whole(left.T @ right) << (LIMB * (a + b))
    return total, cross


def add_sums(a: Sums | None, b: Sums | None) -> Sums | None:
    """Sums of two sets of rows; None has no rows."""
    if a is None or b is None:
        return a or b
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def reduce_parts(vectors: DataFrame, of_part: Callable[[Iterator[np.ndarray]], object], add: Callable):
    """of_part of each partition's matrices, added in a tree; None without partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = of_part(matrix(b.column(0)) for b in batches if b.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], type=pa.binary())], names=["made"])

    parts = vectors.mapInArrow(run, "made binary").rdd.map(lambda r: pickle.loads(r[0]))
    return None if parts.isEmpty() else parts.treeReduce(add, 3)


def exact_sums(vectors: DataFrame, shift: list[int]) -> Sums | None:
    """n, sum and X'X of the vectors (one array column of longs, all of one length) less the shift."""

    def of_part(blocks: Iterator[np.ndarray]) -> Sums | None:
        out = None
        for x in blocks:
            for k in range(0, len(x), ROWS):
                out = add_sums(out, (len(x[k : k + ROWS]), *block_sums(less(x[k : k + ROWS], shift))))
        return out

    return reduce_parts(vectors, of_part, add_sums)


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors; sums per dimension; unit eigenvectors in rows, eigenvalues, and their shares of the trace."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    shares: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Of each row the exact sum over dimensions of (n * x - S)**2, and its whitened components."""
        most = max([abs(s) for s in self.sums], default=0) + self.n * (max(-int(x.min()), int(x.max())) if x.size else 0)
        if most * most * max(1, x.shape[1]) < 1 << 63:
            d = self.n * x - np.array(self.sums, dtype=np.int64)
            deviation = (d * d).sum(axis=1).tolist()
        else:
            d = x.astype(object) * self.n - np.array(self.sums, dtype=object)
            deviation = (d * d).sum(axis=1).tolist()
        centred = d.astype(np.float64) / self.n
        return deviation, centred @ (self.axes / np.sqrt(self.values)[:, None]).T


def decompose(n: int, total: list, cross: list, shift: list[int], components: int) -> Whitening:
    """The leading components. Those whose eigenvalue is zero, as far as float64 can tell, cannot be scaled and are left out."""
    scatter = n * cross - np.outer(total, total)
    v = np.array([[int(c) / (n * n) for c in row] for row in scatter], dtype=np.float64).reshape(len(total), len(total))
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes.T[::-1]
    lives = values > (values[0] if len(values) else 0) * len(values) * np.finfo(np.float64).eps
    keep = min(components, int(lives.sum()))
    trace = sum(int(scatter[k][k]) for k in range(len(total))) / (n * n)
    sums = [int(t) + n * s for t, s in zip(total, shift, strict=True)]
    return Whitening(n, sums, axes[:keep], values[:keep], values[:keep] / trace if trace else values[:keep])


def identity_error(vectors: DataFrame, fit: Whitening) -> float:
    """Largest entry of the whitened vectors' covariance less the identity; centred before multiplying, parts merged by their means."""

    def add(a: tuple | None, b: tuple | None) -> tuple | None:
        if a is None or b is None:
            return a or b
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def of_part(blocks: Iterator[np.ndarray]) -> tuple | None:
        out = None
        for x in blocks:
            w = fit.apply(x)[1]
            mean = w.mean(axis=0)
            out = add(out, (len(w), mean, (w - mean).T @ (w - mean)))
        return out

    n, _, scatter = reduce_parts(vectors, of_part, add)
    return float(np.abs(scatter / n - np.eye(len(scatter))).max(initial=0.0))


def integers(vecs: DataFrame, vector_col: str, scale: int = SCALE) -> DataFrame:
    """The table with ``_x``, the vectors as integers, without rows whose vector is null or has a null or non-finite entry.

    All vectors are to have one length. Should there be others, the commonest length counts (of equals the longer) and
    rows of other lengths go, as they have no place in that space.
    """
    v = column(vector_col).cast("array<double>")
    whole = F.transform(v, lambda c: F.floor(c * scale).cast("long") + F.lit(0).cast("long"))
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = vecs.filter(v.isNotNull() & ~odd).withColumn("_x", whole)
    lengths = out.groupBy(F.size("_x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return out.filter(F.size("_x") == lengths[0]["d"]) if len(lengths) > 1 else out


def whiten(vecs: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """For each row and component: id, component, n, deviation, whitened, explained, identity_error, deviation_digits.

    The fit list has each distinct vector of integers once, so repeated rows weigh nothing and get equal values. deviation
    is null where it does not fit a long; deviation_digits has it always. Vectors beyond the range of long are cut to it.
    See integers for rows that go. Components without variance are left out, so a table of equal vectors gives no rows,
    like one without any. Equal eigenvalues leave their axes open. Null and repeated ids stay; other columns do not matter.
    """
    spark = prepare(vecs.sparkSession)
    schema = f"`{id_col}` {vecs.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, whitened double, "
    schema += "explained double, identity_error double, deviation_digits string"
    rows = integers(vecs.select(column(id_col).alias("_id"), column(vector_col).alias("_v")), "_v", scale).select("_id", "_x")
    fit_list = persist_table(rows.select("_x").distinct())
    first = fit_list.first()
    if first is None or not len(first["_x"]):
        drop_table(fit_list)
        return spark.createDataFrame([], schema)
    shift = list(first["_x"])
    fit = decompose(*exact_sums(fit_list, shift), shift, components)
    count = len(fit.values)
    if not count:
        drop_table(fit_list)
        return spark.createDataFrame([], schema)
    error = identity_error(fit_list, fit)
    drop_table(fit_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            deviation, white = fit.apply(matrix(batch.column(1)))
            each = np.repeat(np.arange(batch.num_rows), count)
            exact = [deviation[k] for k in each]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(len(each), fit.n, dtype=np.int64)),
                    pa.array([d if d < 1 << 63 else None for d in exact], type=pa.int64()),
                    pa.array(white.ravel()),
                    pa.array(np.tile(fit.shares, batch.num_rows)),
                    pa.array(np.full(len(each), error)),
                    pa.array([str(d) for d in exact], type=pa.string()),
                ],
                names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    made = rows.mapInArrow(run, schema.replace(f"`{id_col}`", "_id", 1))
    return made.withColumnRenamed("_id", id_col)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector and component up to 4: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
