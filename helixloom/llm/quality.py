"""Quality classifier by co-training.

A document has two views: its text, as hashed words, the shapes of odd ones and figures of its layout, and its page
metadata: language, source, stated size and pairs of these. The stated size is a column of the table; where it is right it
is the text's length, so the views share that figure. Two logistic models, one a view, learn from a sample of labelled documents; over some rounds each marks
the documents of which it is surest among all unlabelled ones, and the other learns from those too. Each view's scores are then
calibrated on labelled documents held back from training, and the calibrated log-odds are added with weights that are
fitted there as well. Two targets share the views: low quality and toxic; a document is kept if neither is likely.

At most LABELLED labelled documents, those of the smallest hash of their id, come to the driver. Unlabelled documents stay
in a table of their features. In a round a first pass scores all of them and brings back counts of scores in steps, which
give the cuts; a second pass finds the documents beyond the cuts, of this round and those before, and deals them out by
FIT_ROWS. Each part fits the models on the labelled sample and its own documents, and the models' mean, by documents, is
the round's model. So every marked document teaches, and no task holds more than a part.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import prepare
from .shared import documents, drop_table, map_columns, persist_table

LABELLED = 5_000
#: Marked documents of a part, about.
FIT_ROWS = 10_000
#: Scores are counted in steps of this width, and equal ones are spread over TIES steps by a hash of the row.
STEP, TIES = 0.0005, 20
BITS = 16
ROUNDS, STEPS = 3, 150
#: Log-likelihood ratio from which a feature counts; 15 comes by chance for one feature in ten thousand.
LEAST_G = 15.0
TARGETS, VIEWS = ("low", "toxic"), ("text", "meta")
_ODD = re.compile(r"[^\w\s]+$|^[^\w\s]+")
_META = 2048
_SIZES = {"text": 1 << BITS, "meta": _META}


class Features:
    """Feature ids of texts and metadata; a worker remembers those of words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}

    def word(self, w: str) -> tuple[int, ...]:
        size = (1 << BITS) - 1
        core = w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
        out = [zlib.crc32(core.encode("utf-8", "surrogatepass")) & size] if core else []
        for end in _ODD.findall(w):
            out.append(zlib.crc32(("\x01" + end[:4]).encode("utf-8", "surrogatepass")) & size)
        if len(core) > 1 and w.isupper():
            out.append(zlib.crc32(b"\x02caps") & size)
        return tuple(out)

    def text(self, text: str, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature ids and their values: for words a damped log of their number, for layout 1."""
        known = self.known
        if len(known) > 500_000:
            known.clear()
        ids: list[int] = []
        for w in words:
            f = known.get(w)
            if f is None:
                f = known[w] = self.word(w)
            ids += f
        at, many = np.unique(np.array(ids, np.int32), return_counts=True) if ids else (np.zeros(0, np.int32), np.zeros(0))
        value = 0.3 + np.log1p(many * (300.0 / (300.0 + len(words)))) / 3
        shape = np.unique(np.array(self.layout(text, words), np.int32))
        shape = shape[~np.isin(shape, at)]
        order = np.argsort(both := np.concatenate([at, shape]), kind="stable")
        return both[order], np.concatenate([value, np.ones(len(shape))])[order].astype(np.float32)

    @staticmethod
    def layout(text: str, words: list[str]) -> list[int]:
        """Figures of a text's size and layout, cut into steps, as ids."""
        n, nw = len(text), len(words)
        upper = sum(map(str.isupper, words))
        plain = sum(map(str.isalnum, words))
        figures = {
            "chars": int(math.log2(n + 1)),
            "words": int(math.log2(nw + 1)),
            "lines": int(math.log2(text.count("\n") + 1)),
            "perline": int(math.log2(n / (text.count("\n") + 1) + 1)),
            "wordlen": min(20, n // max(1, nw)),
            "upper": int(10 * upper / max(1, nw)),
            "plain": int(20 * plain / max(1, nw)),
            "pipes": min(9, int(20 * text.count("|") / max(1, nw))),
            "marks": min(9, int(10 * sum(text.count(c) for c in "#*&%$!") / max(1, nw))),
            "kinds": int(20 * len(set(words)) / max(1, nw)),
            "urls": min(5, text.count("://")),
        }
        return [zlib.crc32(f"\x03{k}={v}".encode()) & (1 << BITS) - 1 for k, v in figures.items()]

    @staticmethod
    def meta(lang: str | None, source: str | None, size: int | None) -> list[int]:
        """Metadata as ids: language, source, stated size in steps, and pairs of them."""
        size = None if size is None else int(2 * math.log2(max(0, size) + 1))
        known = {"lang": lang, "source": source, "size": size, "lang,source": (lang, source), "lang,size": (lang, size), "source,size": (source, size)}
        return [zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % _META for k, v in known.items()]


#: Columns that are read: the text and, where the table has them, the metadata.
READS = ("text", "lang", "source", "n_chars")


def read_columns(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep and READS, null for metadata that the table lacks."""
    kinds = ("string", "string", "string", "long")
    return docs.select(*keep, *[(F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in zip(READS, kinds, strict=True)])


def rows_of(texts: list, langs: list, sources: list, sizes: list, features: Features) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    for text, a, b, n in zip(texts, langs, sources, sizes, strict=True):
        words = (text or "").split()
        yield *features.text(text or "", words), Features.meta(a, b, n)


class Sparse:
    """Rows of (ids, values) as arrays for products with weights."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]) -> None:
        self.n = len(ids)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in ids])
        self.id = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
        self.value = np.concatenate(values).astype(np.float32) if values else np.zeros(0, np.float32)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.id], self.n)

    def only(self, keep: np.ndarray) -> Sparse:
        """The same rows with only the ids that keep marks."""
        out, m = Sparse([], []), keep[self.id]
        out.n, out.row, out.id, out.value = self.n, self.row[m], self.id[m], self.value[m]
        return out

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.id, self.value * g[self.row], size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, least: float = LEAST_G) -> np.ndarray:
    """Marks ids whose presence goes with the class: those with a log-likelihood ratio over least among weighted rows."""
    use = weight > 0
    n1, n0 = float((use & (y == 1)).sum()), float((use & (y == 0)).sum())
    a = np.bincount(x.id[(use & (y == 1))[x.row]], minlength=size).astype(float)
    b = np.bincount(x.id[(use & (y == 0))[x.row]], minlength=size).astype(float)

    def part(k: np.ndarray, n: float) -> np.ndarray:
        p, q = (a + b) / (n1 + n0), k / max(n, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(k * np.log(q / p)) + np.nan_to_num((n - k) * np.log((1 - q) / (1 - p)))

    return 2 * (part(a, n1) + part(b, n0)) > least


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, size: int, l2: float, steps: int = STEPS) -> np.ndarray:
    """Weights, the bias last, of a logistic model on telling ids, by Adagrad over all rows a step. weight 0 leaves a row out."""
    x = x.only(telling(x, y, weight, size))
    w, seen, total = np.zeros(size + 1), np.full(size + 1, 1e-8), max(weight.sum(), 1.0)
    for _ in range(steps):
        g = weight * (sigmoid(x.dot(w[:-1]) + w[-1]) - y)
        grad = np.append(x.back(g, size), g.sum()) / total
        grad[:-1] += l2 * w[:-1]
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def calibrate(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slope of each column of log-odds and a bias, so that their sum predicts y. Slopes are not negative."""
    n = z.shape[1]
    if not len(y) or y.min() == y.max():
        return np.append(np.full(n, 1 / max(1, n)), 0.0)
    a, scale = np.append(np.full(n, 0.5), 0.0), np.abs(z).mean(axis=0) + 1e-6
    u = np.column_stack([z / scale, np.ones(len(z))])
    v = a * np.append(scale, 1)
    for _ in range(400):
        v -= 0.5 * (u.T @ (sigmoid(u @ v) - y) / len(y) + 1e-3 * np.append(v[:-1], 0))
        v[:-1] = np.maximum(v[:-1], 0)
    return v / np.append(scale, 1)


def together(a: Sparse, b: Sparse) -> Sparse:
    """The rows of a and then those of b."""
    out = Sparse([], [])
    out.n, out.row = a.n + b.n, np.concatenate([a.row, b.row + np.int32(a.n)])
    out.id, out.value = np.concatenate([a.id, b.id]), np.concatenate([a.value, b.value])
    return out


def packed(ids: pd.Series, values: pd.Series | None) -> Sparse:
    """Rows whose ids, as 16-bit integers, and values, as 32-bit floats or all 1, are bytes."""
    out = Sparse([], [])
    out.n = len(ids)
    out.row = np.repeat(np.arange(out.n, dtype=np.int32), [len(x) // 2 for x in ids])
    out.id = np.frombuffer(b"".join(ids), np.uint16).astype(np.int32)
    out.value = np.ones(len(out.id), np.float32) if values is None else np.frombuffer(b"".join(values), np.float32)
    return out


def views_of(batch: pd.DataFrame) -> dict[str, Sparse]:
    return {"text": packed(batch["ids"], batch["values"]), "meta": packed(batch["meta"], None)}


class Labelled:
    """The labelled sample: both views, and for a target the classes, which rows train, their weights, the share of class 1."""

    def __init__(self, views: dict[str, Sparse], truth: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.views, self.y, self.train, self.weight, self.share = views, {}, {}, {}, {}
        for t, (y, train) in truth.items():
            share = float(y[train].mean()) if train.any() else 0.0
            self.y[t], self.train[t], self.share[t] = y, train, share
            if 0 < share < 1:
                # rare classes weigh more, up to a point
                base = np.where(y == 1, min(4.0, (1 - share) / share), min(4.0, share / (1 - share))).clip(1.0)
                self.weight[t] = np.where(train, base, 0.0)

    def fit(self, views: dict[str, Sparse] | None = None, given: dict[tuple, np.ndarray] | None = None) -> dict[tuple, np.ndarray]:
        """A model for each target and view, on the sample and, if any, the rows of views that given marks 0 or 1."""
        out = {}
        for t in self.weight:
            for v in VIEWS:
                x, y, weight = self.views[v], self.y[t], self.weight[t]
                if given is not None:
                    g = given[t, v]
                    x, y = together(x, views[v]), np.concatenate([y, np.nan_to_num(g)])
                    weight = np.concatenate([weight, np.where(np.isnan(g), 0.0, 0.5)])
                out[t, v] = fit(x, y, weight, _SIZES[v], 1e-6 if v == "text" else 1e-4)
        return out


def _steps(x: Sparse, model: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Log-odds of rows in steps, equal ones spread by tie."""
    z = np.clip(x.dot(model[:-1]) + model[-1], -35, 35)
    return np.floor(z / STEP).astype(np.int64) + tie % TIES


def marked(views: dict[str, Sparse], tie: np.ndarray, rounds: list[tuple[dict, dict]]) -> dict[tuple, np.ndarray]:
    """For each target and view the class that the other view gave a row in one of the rounds, nan for none."""
    given = {k: np.full(len(tie), np.nan) for k in rounds[0][0]} if rounds else {}
    for models, cuts in rounds:
        for (t, v), model in models.items():
            at, g, (lo, hi) = _steps(views[v], model, tie), given[t, VIEWS[v == "text"]], cuts[t, v]
            free = np.isnan(g)
            g[free & (at >= hi)] = 1.0
            g[free & (at <= lo)] = 0.0
    return given


def cuts_of(counts: pd.DataFrame, labelled: Labelled) -> dict[tuple, tuple[int, int]]:
    """The highest step of class 0 and the lowest of class 1 for each target and view.

    Of the rows that the other view can still be given, a twentieth at most is marked, in the classes' proportion, and only
    those with a probability over 0.9 of their class. counts: target, view, step, n; step is null for rows of neither side.
    """
    out = {}
    for t in labelled.weight:
        for v in VIEWS:
            c = counts[(counts["target"] == t) & (counts["view"] == v)]
            most, share = max(1, int(c["n"].sum()) // 20), labelled.share[t]
            c = c.dropna().sort_values("step")
            at, n = c["step"].to_numpy(np.int64), c["n"].to_numpy(np.int64)

            def cut(at: np.ndarray, n: np.ndarray, k: int, none: int) -> int:
                """The last step up to which there are at most k rows, or the first that has any."""
                return int(at[max(0, np.searchsorted(np.cumsum(n), k, "right") - 1)]) if len(at) else none

            hi, lo = at > 0, at < 0
            out[t, v] = cut(at[lo], n[lo], max(1, int(most * (1 - share))), -(1 << 40)), cut(at[hi][::-1], n[hi][::-1], max(1, int(most * share)), 1 << 40)
    return out


def _count(rest: DataFrame, models: dict, rounds: list) -> pd.DataFrame:
    """How many free unlabelled rows have each step of log-odds: target, view, step, n."""
    shared, sure = rest.sparkSession.sparkContext.broadcast((models, rounds)), math.log(9)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, rounds = shared.value
        for batch in batches:
            views, tie = views_of(batch), batch["tie"].to_numpy()
            given = marked(views, tie, rounds)
            for (t, v), model in models.items():
                at = _steps(views[v], model, tie)
                if given:
                    at = at[np.isnan(given[t, VIEWS[v == "text"]])]
                step, n = np.unique(np.where((at > sure / STEP) | (at < -sure / STEP), at, 0), return_counts=True)
                yield pd.DataFrame({"target": t, "view": v, "step": pd.array(np.where(step == 0, None, step), "Int64"), "n": n})

    return rest.mapInPandas(run, "target string, view string, step long, n long").groupBy("target", "view", "step").agg(F.sum("n").alias("n")).toPandas()


def _fit_marked(rest: DataFrame, labelled: Labelled, rounds: list) -> dict[tuple, np.ndarray] | None:
    """Models on the labelled sample and all marked unlabelled rows, a mean over parts; None if no row is marked."""
    context = rest.sparkSession.sparkContext
    shared, sample = context.broadcast(rounds), context.broadcast(labelled)

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            given = marked(views_of(batch), batch["tie"].to_numpy(), shared.value)
            keep = np.any([~np.isnan(g) for g in given.values()], axis=0)
            if keep.any():
                yield batch[keep]

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        held.clear()
        views = views_of(rows)
        for (t, v), w in sample.value.fit(views, marked(views, rows["tie"].to_numpy(), shared.value)).items():
            at = np.append(np.flatnonzero(w), len(w))
            yield pd.DataFrame({"target": t, "view": v, "at": at, "w": np.append(w[at[:-1]], 1.0) * len(rows)})

    chosen = persist_table(rest.mapInPandas(select, rest.schema))
    n = chosen.count()
    if not n:
        return None
    parts = chosen.repartition(-(-n // FIT_ROWS)).mapInPandas(learn, "target string, view string, at int, w double")
    got = parts.groupBy("target", "view", "at").agg(F.sum("w").alias("w")).toPandas()  # at most the weights of the models
    drop_table(chosen)
    out = {}
    for (t, v), c in got.groupby(["target", "view"]):
        w = np.zeros(_SIZES[v] + 2)
        w[c["at"]] = c["w"] / n
        out[t, v] = w[:-1]
    return out


def co_train(labelled: Labelled, rest: DataFrame, rounds: int = ROUNDS) -> dict[tuple, np.ndarray]:
    """Models of both views for each target that has both classes.

    A round gives each view the unlabelled rows on which the other is surest, among all of rest.
    """
    models, done = labelled.fit(), []
    for _ in range(rounds if models else 0):
        done.append((models, cuts_of(_count(rest, models, done), labelled)))
        again = _fit_marked(rest, labelled, done)
        if again is None:
            break
        models = again
    return models


def train_models(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> dict[str, dict]:
    """A model a target from documents (doc_id, text, lang, source) and labels (doc_id, quality, toxic).

    Several labels of a document are averaged. Without labels, or with one class only, the model is a constant.
    """
    prepare(docs.sparkSession)
    truth = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    first = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)  # bounded by the sample size
    docs = read_columns(docs, ["doc_id"]).withColumn("tie", F.xxhash64("doc_id", "text"))
    sample = docs.filter("doc_id is not null").join(F.broadcast(first), "doc_id").withColumn("_h", F.xxhash64(*READS))
    # one row of each id, so that what comes to the driver is bounded by the sample however often an id is repeated
    sample = sample.groupBy("doc_id", "q", "t").agg(*[F.min_by(c, "_h").alias(c) for c in READS])
    rest = docs.join(truth.select("doc_id").hint("merge"), "doc_id", "left_anti")
    packed_columns = StructType().add("ids", "binary").add("values", "binary").add("meta", "binary")

    def work():
        features = Features()

        def run(*columns: list) -> list:
            made = list(rows_of(*columns, features))
            return [[m[0].astype(np.uint16).tobytes() for m in made], [m[1].tobytes() for m in made], [np.array(m[2], np.uint16).tobytes() for m in made]]

        return run

    got = map_columns(sample, list(READS), ["doc_id", "q", "t"], packed_columns, work).toPandas().sort_values("doc_id")
    views, learns = views_of(got), np.array([zlib.crc32(str(d).encode()) % 4 != 0 for d in got["doc_id"]], bool)
    truths, known = {}, {}
    for target, column, bad in (("low", "q", lambda v: v < 0.5), ("toxic", "t", lambda v: v >= 0.5)):
        v = got[column].to_numpy(dtype=float)
        known[target] = ~np.isnan(v)
        truths[target] = np.where(known[target], bad(np.where(known[target], v, 0)), False).astype(float), known[target] & learns
    del got
    both = Labelled(views, truths)
    models = {}
    if both.weight:
        table = persist_table(map_columns(rest, list(READS), ["tie"], packed_columns, work))
        models = co_train(both, table)
        drop_table(table)
    out = {}
    for target in TARGETS:
        if target not in both.weight:
            out[target] = {"constant": both.share[target]}
            continue
        text, meta = (models[target, v] for v in VIEWS)
        z, held = np.column_stack([views[v].dot(m[:-1]) + m[-1] for v, m in (("text", text), ("meta", meta))]), known[target] & ~both.train[target]
        out[target] = {"text": text, "meta": meta, "mix": calibrate(z[held], both.y[target][held])}
    return out


def _score(model: dict, ids: np.ndarray, values: np.ndarray, meta: list[int]) -> tuple[float, float, float]:
    if "constant" in model:
        return (model["constant"],) * 3
    a = float(values @ model["text"][ids] + model["text"][-1]) if len(ids) else float(model["text"][-1])
    b = float(model["meta"][meta].sum() + model["meta"][-1])
    m = model["mix"]
    s = lambda z: 1 / (1 + math.exp(-max(-35.0, min(35.0, z))))
    return s(a), s(b), s(m[0] * a + m[1] * b + m[2])


SCORES = ("p_text", "p_meta", "p_low", "p_toxic")


def score_documents(docs: DataFrame, models: dict[str, dict], low: float = 0.65, toxic: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Adds p_text and p_meta (low quality by each view), p_low and p_toxic (both views, calibrated) and kept.

    kept is false if p_low is over low or p_toxic over toxic. Null and empty texts are scored by their metadata and the bias,
    long ones whole. Columns of these names in the input are replaced; others pass through, or only those named by keep;
    language, source and n_chars may be missing or null. No rows give no rows.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in (*SCORES, "kept")]
    made = StructType([StructField(c, DoubleType()) for c in SCORES]).add("kept", "boolean")
    shared = docs.sparkSession.sparkContext.broadcast(models)
    have = [c for c in READS if c in docs.columns]

    def work():
        features, m = Features(), shared.value

        def run(*columns: list) -> list:
            n = len(columns[0])
            given = dict(zip(have, columns, strict=True))
            out = np.zeros((n, 4))
            for k, (ids, values, meta) in enumerate(rows_of(*[given.get(c, [None] * n) for c in READS], features)):
                a, b, both = _score(m["low"], ids, values, meta)
                out[k] = a, b, both, _score(m["toxic"], ids, values, meta)[2]
            return [*out.T, (out[:, 2] <= low) & (out[:, 3] <= toxic)]

        return run

    return map_columns(docs, have, keep, made, work)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, p_text, p_meta, p_low, p_toxic, kept."""
    docs = documents(spark, sf_dir)
    models = train_models(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, models, keep=["doc_id"])
