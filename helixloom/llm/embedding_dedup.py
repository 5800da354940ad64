"""Embedding near-dedup by iterative quantisation.

Unit vectors are centred, projected on their principal directions and rotated so that the signs of the coordinates, the
code, are as balanced and as close to the coordinates as alternating steps make them. Several rotations give several
codes; each is cut into substrings, and each substring with the label is a table: multi-index Hamming tables. Vectors
that share an entry of a table meet there and are compared with their original components in double precision. A pair is
counted in the first table in which it meets, so counts need no list of pairs.

The rotations are fitted on at most SAMPLE vectors, those of the smallest hash; every vector is indexed. At cosine 0.98 a
sign differs with probability 0.064 or so, a substring of 16 bits agrees with 0.35, and one of 16 tables with 0.999.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .shared import connected_components, deal_groups, map_groups, persist_table

#: Most vectors to fit the rotations on, for each number of dimensions.
SAMPLE = 20_000
TABLES, SUB_BITS, MAX_BITS = 16, 16, 64
THRESHOLD = 0.98
BLOCK = 4_000
CAN_LINK = "coalesce(label is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) <> double('infinity')) and exists(embedding, x -> x <> 0), false)"


def rotations(bits: int) -> int:
    """Rotations that give TABLES tables of codes of so many bits."""
    return -(-TABLES // -(-bits // SUB_BITS))


def fit_itq(x: np.ndarray, bits: int, steps: int = 30, seed: int = 7) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each rotation an origin and the matrix from unit vectors less that to coordinates whose signs are the code.

    Every other rotation keeps the origin at zero: where one large cluster pulls the mean into its middle, signs around the
    mean would tell its own members apart.
    """
    out = []
    for k in range(rotations(bits)):
        mean = x.mean(axis=0) * (k % 2 == 0)
        v = x - mean
        _, axes = np.linalg.eigh(v.T @ v)
        axes = axes[:, ::-1][:, :bits]
        v = v @ axes
        r = np.linalg.qr(np.random.default_rng(seed + k).normal(size=(bits, bits)))[0]
        for _ in range(steps):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ b)
            r = left @ right
        out.append((mean, axes @ r))
    return out


def codes(x: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The codes of unit vectors, one column of signed longs a rotation."""
    out = []
    for mean, m in models:
        bits = ((x - mean) @ m >= 0).astype(np.uint8)
        whole = np.zeros((len(x), 64), np.uint8)
        whole[:, : bits.shape[1]] = bits
        out.append(np.packbits(whole, axis=1, bitorder="little").view("<i8")[:, 0])
    return np.stack(out, axis=1) if out else np.zeros((len(x), 0), np.int64)


def _unit(batch: pd.Series) -> np.ndarray:
    x = np.array(batch.tolist(), dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _tables(bits: int) -> list[tuple[int, int, int]]:
    """rotation, shift and mask of each table."""
    return [(r, at, (1 << min(SUB_BITS, bits - at)) - 1) for r in range(rotations(bits)) for at in range(0, bits, SUB_BITS)]


def _meet(threshold: float):
    """What one task of a table does: counts of links and links that span, for pairs that first meet in this table."""

    def run(group: pd.DataFrame) -> pd.DataFrame | None:
        n = len(group)
        if n < 2:
            return None
        x, c, label = _unit(group["embedding"]), np.array(group["codes"].tolist(), np.int64).view(np.uint64), group["label"].to_numpy()
        cid, many, t = group["cid"].to_numpy(), group["n"].to_numpy(), int(group["t"].iloc[0])
        chunk, chunks, a, b = group["_h"].to_numpy(), int(group["_c"].iloc[0]), int(group["_a"].iloc[0]), int(group["_b"].iloc[0])
        earlier = _tables(int(group["bits"].iloc[0]))[:t]
        # pairs inside a chunk belong to the task with the next chunk
        own = np.ones(n, bool) if chunks == 1 else (chunk + 1) % chunks == np.where(chunk == a, b, a)
        links, comp, edges = np.zeros(n, np.int64), np.arange(n), []
        step = max(1, min(512, 4_000_000 // n))
        for i in range(0, n, step):
            s = x[i : i + step] @ x[i:].T
            ii, jj = np.nonzero(s >= threshold)
            ok = jj > ii
            ii, jj = ii[ok] + i, jj[ok] + i
            ok = (label[ii] == label[jj]) & ((chunk[ii] != chunk[jj]) | own[ii])
            ii, jj = ii[ok], jj[ok]
            for r, shift, mask in earlier:
                if not len(ii):
                    break
                ok = (((c[ii, r] ^ c[jj, r]) >> np.uint64(shift)) & np.uint64(mask)) != 0
                ii, jj = ii[ok], jj[ok]
            if not len(ii):
                continue
            links += np.bincount(ii, many[jj], n).astype(np.int64) + np.bincount(jj, many[ii], n).astype(np.int64)
            at = np.flatnonzero(np.diff(ii, prepend=-1))
            for k, row in zip(at.tolist(), ii[at].tolist(), strict=True):
                js = jj[k : np.searchsorted(ii, row, "right")]
                new = js[comp[js] != comp[row]]
                while len(new):
                    j = new[0]
                    edges.append((cid[row], cid[j]))
                    comp[comp == comp[j]] = comp[row]
                    new = js[comp[js] != comp[row]]
        has = np.flatnonzero(links)
        if not len(has):
            return None
        return pd.concat([pd.DataFrame({"cid": cid[has], "links": links[has], "other": pd.NA}), pd.DataFrame(edges, columns=["cid", "other"]).assign(links=0)], ignore_index=True).astype({"cid": "Int64", "links": "Int64", "other": "Int64"})

    return run


def vector_classes(vectors: DataFrame) -> DataFrame:
    """Rows of vec_id, label and embedding that can link, with dim and the hashes h1 and h2 of the components."""
    return vectors.filter(CAN_LINK).select(
        "vec_id", "label", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")
    )


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors of one label and one length link at a cosine of the threshold or more. Null vectors or labels, empty or zero
    vectors and those with null or non-finite components link with nothing. Equal vectors are compared once, as a class,
    and count as links of each other. Repeated ids are rows of their own, and component_id is the smallest id of the
    component, null where all are null; kept is whether it is the row's own. No rows give no rows; other columns do not
    matter.
    """
    prepare(vectors.sparkSession)
    vectors = vectors.select("vec_id", "label", "embedding")
    good = vector_classes(vectors)
    key = ["label", "h1", "h2"]
    classes = good.groupBy(*key).agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.any_value("embedding").alias("embedding"), F.any_value("dim").alias("dim"))
    classes = persist_table(classes.withColumn("cid", F.monotonically_increasing_id()))
    coded = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        of = classes.filter(F.col("dim") == dim)
        sample = of.orderBy(F.xxhash64("embedding"), "cid").select("embedding").limit(SAMPLE).toPandas()
        bits = min(dim, MAX_BITS)
        models = fit_itq(_unit(sample["embedding"]), bits)

        def code(batches, models=models):
            for batch in batches:
                if len(batch):
                    yield pd.DataFrame({"cid": batch["cid"], "codes": list(codes(_unit(batch["embedding"]), models))})

        made = of.select("cid", "embedding").mapInPandas(code, "cid long, codes array<long>").withColumn("bits", F.lit(bits))
        coded = made if coded is None else coded.unionByName(made)
    if coded is None:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    coded = persist_table(coded)
    payload = persist_table(classes.select("cid", "label", "n", "embedding").join(coded, "cid"))
    entries = None
    for bits in sorted(r["bits"] for r in coded.select("bits").distinct().collect()):
        entry = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.expr(f"shiftrightunsigned(codes[{r}], {at}) & {mask}L").alias("sub")) for t, (r, at, mask) in enumerate(_tables(bits))]))
        part = payload.filter(F.col("bits") == bits).select("cid", "label", "bits", F.size("embedding").alias("dim"), entry.alias("e"))
        part = part.select("cid", F.col("e.t").alias("t"), F.xxhash64("label", "dim", "e.t", "e.sub").alias("entry"))
        entries = part if entries is None else entries.unionByName(part)
    dealt = deal_groups(entries, "entry", BLOCK).join(payload, "cid")
    found = persist_table(map_groups(dealt, ["entry", "_a", "_b"], _meet(threshold), "cid long, links long, other long"))
    counts = found.filter("other is null").groupBy("cid").agg(F.sum("links").alias("links"))
    comp = connected_components(found.filter("other is not null").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    per = classes.select("cid", *key, "low", "n").join(counts, "cid", "left").join(comp.withColumnRenamed("node", "cid"), "cid", "left")
    per = persist_table(per.withColumn("root", F.coalesce("root", "cid")))
    low = per.groupBy("root").agg(F.min("low").alias("component_id"))
    per = per.join(low, "root").select(*key, (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.select("vec_id", *key).join(per, key).select("vec_id", "n_links", "component_id")
    alone = vectors.filter(f"not {CAN_LINK}").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector: vec_id, n_links, component_id, kept."""
    return embedding_links(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
