"""LM scoring with a hashed maximum-entropy model.

A token's probability is that of its class given the two tokens before, times that of the token in its class. Frequent
words are classes of their own; the others go to classes by a hash of their last letters, which also places words that
training never saw. The class model is a softmax over features of the history: the previous class, the class before it (a
skip feature), both in order (a trigram feature), the previous word (an n-gram feature, by a 64-bit hash of the word) and a
bias. Each has weights of its own. Within a class, smoothed counts give the token's share, with one share for unseen
words, so probabilities add to one.

Training takes every training token, in two parts. The class features first: tokens with equal history are the same for
them, so counts of (history, class) are gathered once over the whole corpus and each gradient step runs over them in
parallel. The weights of a trigram feature stay in the table with the counts of its history and move there; the sums for
the others come back as one matrix of fixed size. Then the words: counts of (word, next class) go out by the word's hash,
and each task moves the weights of its own words, with the classes' shares after the word's class as the model to start
from. Words seen LEAST_WORD times or more have weights, so what is learnt grows with the corpus, and it is never gathered;
a pair seen less than PAIR times in training, or a weight that rounds to nothing, has no entry.

A first pass turns documents into blocks: one row with the token numbers of some megabytes of text and the words they stand
for. A block sends its distinct words by their hashes to buckets, packed, and a bucket answers each block with the totals
and weights of the words that it asked for, so no task and no driver holds the vocabulary, and no later pass cuts texts
into words again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from .shared import documents, drop_table, persist_table

#: Classes: one for the end, TOP for the most frequent words, the rest for hashed endings.
CLASSES, TOP = 256, 120
#: Rows of the matrix of shared weights: bias, previous class and class before it, each of the two also "before the text".
FEATURES = 1 + 2 * (CLASSES + 1)
STEPS, RATE, L2 = 16, 0.4, 3.0
#: Gradient steps for a word's weights, how often a word and a pair of word and class must be seen to have any, and steps of a stored weight to one.
WORD_STEPS, LEAST_WORD, PAIR, FINE = 10, 16, 2, 2
SMOOTH = 0.1
#: Partitions of the table of histories, and so of matrices that a step brings to the driver.
PARTS = 6
#: Bytes of text from which a block ends; a longer text is one block with those before it.
BLOCK_BYTES = 14_000_000
#: Words that blocks send to a bucket, about.
BUCKET_WORDS = 1_000_000
END = b""
START = CLASSES  # stands for "before the text" in a history
HISTORIES = (CLASSES + 1) ** 2
SEED = 17


def zipped(x: np.ndarray | bytes) -> bytes:
    """Bytes for a row that moves or is stored; most counts are small, and most tokens frequent."""
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes())


def unzipped(x: bytes, kind: type | None = None) -> np.ndarray | bytes:
    out = zstandard.ZstdDecompressor().decompress(x)
    return out if kind is None else np.frombuffer(out, kind)


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w, SEED)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hash, words), np.uint64, len(words)).view(np.int64)


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def held_out(doc_id) -> bool:
    """Whether a document is kept from learning. A null id is hashed as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def ending(w: bytes) -> int:
    """The class of a word that is none of its own: by its last letters, without marks around them."""
    if not w:
        return 0
    core = w.strip(b".,;:!?\"'()[]") or w
    return 1 + TOP + zlib.crc32(core[-3:] if len(core) > 3 else b"." + core) % (CLASSES - 1 - TOP)


class Numbers(dict):
    """A number for each word in the order in which they are met."""

    def __missing__(self, w: bytes) -> int:
        k = self[w] = len(self)
        return k


BLOCK = "block long, docs array<long>, ends binary, ids binary, words binary, counts binary, n_words long"


def blocks(docs: DataFrame) -> DataFrame:
    """Columns BLOCK, written to the shared folder: documents in the order of the scan, cut at BLOCK_BYTES.

    ends are the places after each document's last token, ids the numbers of the tokens, words what they stand for, one a
    line, and counts how often training documents have each; all of these are zipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        number, docs, ids, size = Numbers({END: 0}), [], [], 0

        def out() -> pa.RecordBatch:
            flat, lengths = np.concatenate(ids), np.array([len(x) for x in ids])
            learns = np.repeat(np.array([not held_out(d) for d in docs]), lengths)
            counts = np.bincount(flat[learns], minlength=len(number)).astype(np.int32)
            row = [part << 32 | made, docs, zipped(np.cumsum(lengths).astype(np.int64)), zipped(flat), zipped(b"\n".join(number)), zipped(counts), len(number)]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=["block", "docs", "ends", "ids", "words", "counts", "n_words"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens = tokens_of(text)
                docs.append(doc)
                ids.append(np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens)))
                size += len(text or "")
                if size >= BLOCK_BYTES:
                    yield out()
                    made += 1
                    number, docs, ids, size = Numbers({END: 0}), [], [], 0
        if docs:
            yield out()

    return persist_table(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOCK))


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types.values(), strict=True)], names=list(types))


def dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of words by bucket, and where each bucket starts and the last ends in it."""
    bucket = h.view(np.uint64) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))


def _buckets_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> dict[int, list[tuple]]:
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for bucket, *rest in zip(*[batch.column(x).to_pylist() for x in ("bucket", *columns)], strict=True):
            held.setdefault(bucket, []).append(tuple(rest))
    return held


def word_figures(table: DataFrame, buckets: int) -> DataFrame:
    """v, n, e and h: of each class e of endings the distinct training words and their tokens, h null; and frequent words, v null.

    Each bucket names its TOP + 1 most frequent words, so the TOP of all but the end are among them.
    """
    ask = {"bucket": pa.int32(), "h": pa.binary(), "n": pa.binary(), "e": pa.binary()}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                words, n = unzipped(words).split(b"\n"), unzipped(n, np.int32)
                words, n = [w for w, k in zip(words, n.tolist(), strict=True) if k], n[n > 0]
                h, e = hashes_of(words), np.fromiter(map(ending, words), np.int16, len(words))
                order, cuts = dealt(h, buckets)
                h, n, e = h[order], n[order], e[order]
                some = [(b, h[i:j].tobytes(), zipped(n[i:j]), zipped(e[i:j])) for b, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
                yield _batch(some, ask)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _buckets_of(batches, ["h", "n", "e"]).values():
            h, first, at = np.unique(np.concatenate([np.frombuffer(x[0], np.int64) for x in some]), return_index=True, return_inverse=True)
            n = np.bincount(at, np.concatenate([unzipped(x[1], np.int32) for x in some])).astype(np.int64)
            e = np.concatenate([unzipped(x[2], np.int16) for x in some])[first].astype(np.int64)
            v, tokens, best = np.bincount(e, minlength=CLASSES), np.bincount(e, n, CLASSES), np.lexsort((h, -n))[: TOP + 1]
            rows = [(int(v[k]), int(tokens[k]), int(k), None) for k in np.flatnonzero(v)] + [(None, int(n[k]), int(e[k]), int(h[k])) for k in best]
            yield _batch(rows, {"v": pa.int64(), "n": pa.int64(), "e": pa.int32(), "h": pa.int64()})

    sent = table.select("words", "counts").mapInArrow(send, "bucket int, h binary, n binary, e binary")
    return persist_table(sent.repartition(buckets, "bucket").mapInArrow(count, "v long, n long, e int, h long"))


def words_with(table: DataFrame, wanted: list[int]) -> dict[int, bytes]:
    """The words with the hashes wanted, which are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = set(wanted)
        for batch in batches:
            for words in batch.column("words").to_pylist():
                words = unzipped(words).split(b"\n")
                hit = [(h, w) for h, w in zip(hashes_of(words).tolist(), words, strict=True) if h in want]
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in hit], pa.int64()), pa.array([w for _, w in hit], pa.binary())], names=["h", "w"])

    return {r["h"]: bytes(r["w"]) for r in table.select("words").mapInArrow(run, "h long, w binary").distinct().collect()}


def classes_of(words: list[bytes], top: dict[bytes, int]) -> np.ndarray:
    get = top.get
    return np.fromiter((get(w) or ending(w) for w in words), np.int32, len(words))


def _before(x: np.ndarray, starts: np.ndarray, none: int) -> np.ndarray:
    """The value before each place, none at the start of a document."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[starts] = none
    return out


def _told(batch: pa.RecordBatch, top: dict[bytes, int]) -> Iterator[tuple]:
    """Of each block its id, words, their counts and classes, token numbers, document starts, and which tokens train."""
    for block, docs, ends, ids, words, n in zip(*[batch.column(c).to_pylist() for c in ("block", "docs", "ends", "ids", "words", "counts")], strict=True):
        words, ends = unzipped(words).split(b"\n"), unzipped(ends, np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        learns = np.repeat(np.array([not held_out(d) for d in docs]), ends - starts)
        yield block, words, unzipped(n, np.int32), classes_of(words, top), unzipped(ids, np.int32), starts, learns


TOLD = ["block", "docs", "ends", "ids", "words", "counts"]


def history_pairs(table: DataFrame, top: dict[bytes, int]) -> DataFrame:
    """part, keys, n of each block: keys history * CLASSES + class over its training tokens and how often, zipped; part is history % PARTS."""
    types = {"part": pa.int32(), "keys": pa.binary(), "n": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, own, ids, starts, learns in _told(batch, top):
                cls = own[ids]
                c1 = _before(cls, starts, START)
                c2 = _before(c1, starts, START)
                key, many = np.unique((c1 * (CLASSES + 1) + c2)[learns] * CLASSES + cls[learns], return_counts=True)
                part = key // CLASSES % PARTS
                yield _batch([(p, zipped(key[part == p].astype(np.int32)), zipped(many[part == p].astype(np.int32))) for p in range(PARTS)], types)

    return table.select(*TOLD).mapInArrow(run, "part int, keys binary, n binary")


def word_pairs(table: DataFrame, top: dict[bytes, int], buckets: int) -> DataFrame:
    """block, bucket, h, n, own, size, cls, many: what blocks send to a bucket of words by hash, zipped.

    h are the hashes of the block's words, n their training tokens, own their classes, size how many entries each has in cls
    and many, the classes that follow it in training and how often. What is before a document's first token is no word.
    """
    types = {"block": pa.int64(), "bucket": pa.int32()} | dict.fromkeys(("h", "n", "own", "size", "cls", "many"), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, n, own, ids, starts, learns in _told(batch, top):
                h = hashes_of(words)
                order, cuts = dealt(h, buckets)
                place = np.empty(len(words), np.int32)
                place[order] = np.arange(len(words), dtype=np.int32)
                w1 = _before(ids, starts, -1)
                learns &= w1 >= 0
                key, many = np.unique(place[w1[learns]].astype(np.int64) * CLASSES + own[ids[learns]], return_counts=True)  # words in the order in which they are sent
                size, cls, many = np.bincount(key // CLASSES, minlength=len(words)).astype(np.int16), (key % CLASSES).astype(np.uint8), many.astype(np.int32)
                entry = np.searchsorted(key, cuts * CLASSES).tolist()
                h, n, own, cuts = h[order], n[order], own[order].astype(np.int16), cuts.tolist()
                out = [
                    (block, b, h[i:j].tobytes(), *map(zipped, (n[i:j], own[i:j], size[i:j], cls[x:y], many[x:y])))
                    for b, (i, j, x, y) in enumerate(zip(cuts[:-1], cuts[1:], entry[:-1], entry[1:], strict=True))
                    if j > i
                ]
                yield _batch(out, types)

    return table.select(*TOLD).mapInArrow(run, "block long, bucket int, h binary, n binary, own binary, size binary, cls binary, many binary")


def history_counts(pairs: DataFrame) -> DataFrame:
    """history, counts over all training tokens: how often each class follows, as bytes of CLASSES 64-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # of fixed size: the histories of a part
        for batch in batches:
            for part, a, c in zip(*[batch.column(x).to_pylist() for x in ("part", "keys", "n")], strict=True):
                key, n = unzipped(a, np.int32).astype(np.int64), unzipped(c, np.int32)
                if part not in total:
                    total[part] = np.zeros((HISTORIES // PARTS + 1) * CLASSES, np.int64)
                total[part][key // CLASSES // PARTS * CLASSES + key % CLASSES] += n
        for part, counts in total.items():
            counts = counts.reshape(-1, CLASSES)
            has = np.flatnonzero(counts.any(axis=1))
            for k in range(0, len(has), 1000):
                at = has[k : k + 1000]
                yield pa.RecordBatch.from_arrays([pa.array(at * PARTS + part), pa.array([x.tobytes() for x in counts[at]], pa.binary())], names=["history", "counts"])

    return pairs.repartition(PARTS, "part").mapInArrow(run, "history long, counts binary")


def word_weights(pairs: DataFrame, shares: np.ndarray, buckets: int) -> DataFrame:
    """What buckets answer: block, bucket, total, size, cls, weights, zipped, for the words that a block has sent, in its order.

    total are training tokens of all blocks; size tells how many entries each word has in cls and weights, which are in steps
    of 1 / FINE. shares has the classes' probabilities after each class, which are where a word's weights start from.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(np.log(shares))
    types = {"block": pa.int64(), "bucket": pa.int32()} | dict.fromkeys(("total", "size", "cls", "weights"), pa.binary())

    def learn(own: np.ndarray, row: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Weights of entries (row, cls, n) of words whose classes are own."""
        start, many = shared.value[own], np.bincount(row, n, len(own))
        p = np.exp(start[row, cls])
        w, use = np.zeros(len(n)), n >= PAIR
        for _ in range(WORD_STEPS):
            # all but the entries keep their share, so the entries alone give the sum of a row
            total = 1 + np.bincount(row, p * np.expm1(w), len(own))
            expected = many[row] * p * np.exp(w) / total[row]
            w = np.where(use, w + np.clip((n - expected - L2 * w) / (expected + L2), -1.0, 1.0), 0.0)
        return w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, some in _buckets_of(batches, ["block", "h", "n", "own", "size", "cls", "many"]).items():
            flat = lambda k, kind: np.concatenate([unzipped(x[k], kind) for x in some])  # noqa: E731, B023
            h, lengths = np.concatenate([np.frombuffer(x[1], np.int64) for x in some]), [len(x[1]) // 8 for x in some]
            words, first, at = np.unique(h, return_index=True, return_inverse=True)
            total, own = np.bincount(at, flat(2, np.int32)).astype(np.int64), flat(3, np.int16)[first].astype(np.int64)
            key, inverse = np.unique(np.repeat(at, flat(4, np.int16).astype(np.int64)) * CLASSES + flat(5, np.uint8), return_inverse=True)
            n = np.bincount(inverse, flat(6, np.int32), len(key))
            some = [x[0] for x in some]
            word, cls = key // CLASSES, key % CLASSES
            keep = (total >= LEAST_WORD)[word]
            word, cls, n = word[keep], cls[keep], n[keep]
            w = np.clip(np.rint(FINE * learn(own, word, cls, n)), -127, 127).astype(np.int8) if len(n) else np.zeros(0, np.int8)
            has = w != 0
            word, cls, w = word[has], cls[has].astype(np.uint8), w[has]
            many = np.bincount(word, minlength=len(words))
            begin = np.cumsum(many) - many
            out, a = [], 0
            for block, k in zip(some, lengths, strict=True):
                mine = at[a : a + k]
                a += k
                size = many[mine]
                e = np.repeat(begin[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                out.append((block, bucket, *map(zipped, (total[mine], size.astype(np.int16), cls[e], w[e]))))
                if len(out) == 256:
                    yield _batch(out, types)
                    out = []
            yield _batch(out, types)

    return pairs.repartition(buckets, "bucket").mapInArrow(run, "block long, bucket int, total binary, size binary, cls binary, weights binary")


def feature_rows(history: np.ndarray) -> np.ndarray:
    """Rows of the shared weights for histories: bias, previous class, class before it."""
    return np.column_stack([np.zeros_like(history), 1 + history // (CLASSES + 1), 2 + CLASSES + history % (CLASSES + 1)])


def log_softmax(weights: np.ndarray, rows: np.ndarray, own: np.ndarray | None = None) -> np.ndarray:
    """Log-probabilities of the classes; own are the weights of the trigram feature of each row, 0 if not given."""
    z = weights[rows[:, 0]] + weights[rows[:, 1]]
    z += weights[rows[:, 2]]
    if own is not None:
        z += own
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


_BASE: list[tuple] = []


def base_model(model: tuple) -> np.ndarray:
    """Log-probabilities of the classes after each history, without the words' weights; a worker works them out once a model."""
    if not _BASE or _BASE[0][0] is not model:
        out = np.empty((HISTORIES, CLASSES), np.float32)
        for k in range(0, HISTORIES, 2048):
            h = np.arange(k, min(k + 2048, HISTORIES))
            out[h] = log_softmax(model[0], feature_rows(h), model[1][h].astype(np.float32))
        _BASE[:] = [(model, out)]
    return _BASE[0][1]


def _moved(weights: np.ndarray, start: np.ndarray | float, observed: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Weights after a step along observed minus expected counts, each by its own expected count."""
    gradient = observed - expected - L2 * (weights - start)
    return weights + np.clip(RATE * gradient / (expected + L2 + 2.0), -1.0, 1.0).astype(np.float32)


def train(counts: DataFrame, steps: int = STEPS) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """The shared weights, a table of history and own, the weights of its trigram feature as bytes, and observed counts of feature rows.

    By distributed gradient steps.

    A step sends the shared weights out; each task sums the expected counts of its histories by feature row and class, and
    the shared weights move on the driver. With the weights from before the step each history's own ones move in place,
    as the table is written anew with the next step.
    """
    spark = counts.sparkSession
    table = persist_table(counts.repartition(PARTS, "history").withColumn("own", F.lit(None).cast("binary")))
    weights, start = np.zeros((FEATURES, CLASSES), np.float32), None

    def own_of(batch: pd.DataFrame) -> np.ndarray:
        own = np.zeros((len(batch), CLASSES), np.float32)
        for k, x in enumerate(batch["own"]):
            if x is not None:
                own[k] = np.frombuffer(x, np.float32)
        return own

    def tables(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        return feature_rows(batch["history"].to_numpy()), np.frombuffer(b"".join(batch["counts"]), np.int64).reshape(-1, CLASSES).astype(np.float32)

    def sums(weights: np.ndarray | None) -> np.ndarray:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((FEATURES, CLASSES))
            for batch in batches:
                if len(batch):
                    rows, m = tables(batch)
                    if shared.value is not None:
                        m = np.exp(log_softmax(shared.value, rows, own_of(batch))) * m.sum(axis=1, keepdims=True)
                    for k in range(rows.shape[1]):
                        order = np.argsort(rows[:, k], kind="stable")
                        r, first = np.unique(rows[order, k], return_index=True)
                        out[r] += np.add.reduceat(m[order], first, axis=0)
            has = np.flatnonzero(out.any(axis=1))
            yield pd.DataFrame({"row": has, "v": [x.tobytes() for x in out[has]]})

        total = np.zeros((FEATURES, CLASSES))
        for row, v in table.mapInPandas(run, "row int, v binary").toPandas().itertuples(index=False):
            total[row] += np.frombuffer(v, np.float64)
        shared.destroy()
        return total

    def moved(weights: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    rows, m = tables(batch)
                    own = own_of(batch)
                    own = _moved(own, 0.0, m, np.exp(log_softmax(shared.value, rows, own)) * m.sum(axis=1, keepdims=True))
                    batch["own"] = [x.tobytes() for x in own]
                    yield batch

        return persist_table(table.mapInPandas(run, table.schema))

    observed = sums(None)
    share = observed[0] + 1
    weights[0] = np.log(share / share.sum())
    start = weights.copy()
    for _ in range(steps):
        expected, new = sums(weights), moved(weights)
        drop_table(table)
        weights, table = _moved(weights, start, observed, expected).astype(np.float32), new
    return weights, table, observed


def collect_own(table: DataFrame) -> np.ndarray:
    """The trigram weights of all histories, at most HISTORIES rows, as 16-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = [np.frombuffer(x, np.float32).astype(np.float16).tobytes() for x in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("history"), pa.array(short, pa.binary())], names=["history", "own"])

    own = np.zeros((HISTORIES, CLASSES), np.float16)
    for part in range(PARTS):  # a part at a time, to keep the driver small
        some = table.filter(f"own is not null and history % {PARTS} = {part}").select("history", "own")
        got = some.mapInArrow(run, "history long, own binary").toArrow()
        for h, x in zip(got.column("history").to_pylist(), got.column("own"), strict=True):
            own[h] = np.frombuffer(x.as_buffer(), np.float16)
    return own


def shares_after(observed: np.ndarray) -> np.ndarray:
    """The probability of each class after each class (the last: at the start) from the counts of feature rows, smoothed by all."""
    all_, after = observed[0] + 1.0, observed[1 : CLASSES + 2]
    return (after + 20.0 * all_ / all_.sum()) / (after.sum(axis=1, keepdims=True) + 20.0)


def score_documents(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).

    The model learns from the documents whose crc32 of the id is not a multiple of 10. A null text counts as an empty
    one, which has the end as its only token; repeated ids and equal rows are documents of their own; of words seen equally
    often those of the smaller hash become classes; long texts are scored whole. No documents give no rows.
    """
    spark = prepare(docs.sparkSession)
    table = blocks(docs.select("doc_id", "text"))
    sent = table.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sent // BUCKET_WORDS))
    figures = word_figures(table, buckets)
    cv, n_all, v_all = np.zeros(CLASSES), 0, 0
    for r in figures.filter("h is null").groupBy("e").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
        cv[r["e"]], n_all, v_all = r["v"], n_all + r["n"], v_all + r["v"]
    end = int(np.uint64(word_hash(END)).view(np.int64))
    best = figures.filter(F.col("h").isNotNull() & (F.col("h") != end)).orderBy(F.desc("n"), "h").limit(TOP).collect()
    of = words_with(table, [r["h"] for r in best]) if best else {}
    top = {of[r["h"]]: k for k, r in enumerate(best, 1)}
    for k, r in enumerate(best, 1):
        cv[r["e"]] -= 1
        cv[k] += 1
    weights, histories, observed = train(history_counts(history_pairs(table, top)), steps)
    own = collect_own(histories)
    drop_table(histories)
    answers = word_weights(word_pairs(table, top, buckets), shares_after(observed), buckets)
    shared = spark.sparkContext.broadcast((weights, own, observed[0], cv, top))

    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        model = shared.value
        _, _, cn, cv, top = model
        first_of = base_model(model)
        row = {c: block.column(c)[0].as_py() for c in ("ends", "ids", "words")}
        docs = block.column("docs")[0].as_py()
        words, ids, ends = unzipped(row["words"]).split(b"\n"), unzipped(row["ids"], np.int32), unzipped(row["ends"], np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        # answers stand in the order of buckets, and in each in that of the words sent
        by = np.argsort(known.column("bucket").to_numpy())
        flat = lambda c, kind: np.frombuffer(b"".join([unzipped(known.column(c)[k].as_py()) for k in by.tolist()]), kind)
        order, _ = dealt(hashes_of(words), buckets)
        count, size = np.empty(len(words)), np.empty(len(words), np.int64)
        count[order], sizes = flat("total", np.int64), flat("size", np.int16).astype(np.int64)
        size[order] = sizes
        first = np.empty(len(words), np.int64)
        first[order] = np.cumsum(sizes) - sizes
        entry_c, entry_w = flat("cls", np.uint8).astype(np.int64), flat("weights", np.int8) / FINE
        sort = np.argsort(entry_key := np.repeat(order, sizes) * CLASSES + entry_c)
        entry_key = entry_key[sort]
        own_class = classes_of(words, top)
        cls = own_class[ids]
        c1 = _before(cls, starts, START)
        history = c1 * (CLASSES + 1) + _before(c1, starts, START)
        logp = first_of[history, cls].astype(np.float64)
        w1 = _before(ids, starts, 0)  # the end, number 0, is before no token and has no weights
        t = np.flatnonzero(size[w1] > 0)
        if len(t):
            w1 = w1[t].astype(np.int64)
            at = np.searchsorted(entry_key, asked := w1 * CLASSES + cls[t]).clip(max=len(entry_key) - 1)
            logp[t] += np.where(entry_key[at] == asked, entry_w[sort][at], 0.0)
            key, at = np.unique(w1 * HISTORIES + history[t], return_inverse=True)
            norm = np.empty(len(key))
            for k in range(0, len(key), 16_000):
                w, h = key[k : k + 16_000] // HISTORIES, key[k : k + 16_000] % HISTORIES
                many = size[w]
                e = np.repeat(first[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                r = np.repeat(np.arange(len(w)), many)
                norm[k : k + 16_000] = np.log1p(np.bincount(r, np.exp(first_of[h[r], entry_c[e]]) * np.expm1(entry_w[e]), len(w)))
            logp[t] -= norm[at]
        share = np.log10(count + SMOOTH)
        base = np.log10(n_all + SMOOTH * (v_all + 1))
        in_class = np.log10(cn + SMOOTH * (cv + 1))
        share = share[ids]
        per = lambda x: np.add.reduceat(x, starts)
        made = {
            "doc_id": pa.array(docs, pa.int64()),
            "held_out": pa.array([held_out(d) for d in docs]),
            "n_tokens": pa.array(ends - starts),
            "n_known": pa.array(per((count > 0).astype(np.int64)[ids])),
            "train_tokens": pa.array(np.full(len(docs), n_all, np.int64)),
            "base_score": pa.array(per(share - base)),
            "score": pa.array(per(logp / np.log(10) + share - in_class[cls])),
        }
        return pa.table(made)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.select("block", "docs", "ends", "ids", "words").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_documents(documents(spark, sf_dir))
