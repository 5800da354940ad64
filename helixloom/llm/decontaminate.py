"""Benchmark decontamination by template canonicalisation.

Words become template tokens: numbers, names (capitalised inside a sentence) and units after a number turn into typed
placeholders, all else is lower-cased. A capitalised word that opens a sentence or line, or a word in all capitals, may be
a name or not: windows that hold one are hashed in both readings, as words and as names, if a plain word is left in them.
Windows of template tokens of documents and benchmark items are joined on their hashes. Hits of a document and an item that lie on one diagonal are a passage; its slots are consistent if each value in
the item stands for one value in the document and back, as in a question with other numbers and names. A hit by a second
reading counts where the first has none, and only if its values stand one for one on the diagonal too. A document is
contaminated by an item if consistent passages cover the coverage share of the item's windows.

Document windows pass a bit table of fixed size before they leave the scan, set from the benchmark's windows, so what is
broadcast does not grow with either side; the join that follows is an ordinary one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import prepare
from .shared import documents, fresh, persist_table, with_row_id

WINDOW, COVERAGE = 5, 0.8
#: Slots of the bit table, as a power of two.
BITS = 24
#: Words and symbols that are units after a number.
UNITS = frozenset(
    "mm cm dm m km inch inches ft foot feet yard yards mile miles mg g kg ton tons tonne tonnes oz lb lbs pound pounds ml cl l liter liters litre litres gallon gallons "
    "second seconds sec minute minutes min hour hours hr day days week weeks month months year years percent % dollar dollars $ euro euros € cent cents £ ¥ "
    "mph kmh km/h hz khz mhz ghz w kw mw v a j kj cal kcal k c f degrees degree kb mb gb tb".split()
)
NUMBER, NAME, UNIT = "\x01num", "\x01name", "\x01unit"
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)*|[%$€£¥]|[.!?\n]")
_ENDS = frozenset(".!?\n")
_P = np.uint64(0x9E3779B97F4A7C15)


def template(text: str) -> tuple[list[str], list[str], list[int]]:
    """The template tokens of a text, the surface tokens they stand for, and the indices of words that may be names.

    Sentence ends separate and are no tokens. Words that may be names are lower-cased words among the template tokens.
    """
    tokens, surface, either, start, after_number = [], [], [], True, False
    for t in _TOKEN.findall(text):
        c = t[0]
        if c in _ENDS:
            start, after_number = True, False
            continue
        if c.isdigit():
            kind, after_number = NUMBER, True
        else:
            low = t.lower()
            if after_number and low in UNITS:
                kind = UNIT
            elif not c.isupper():
                kind = low
            elif not start and not (len(t) > 1 and t.isupper()):
                kind = NAME
            else:
                kind = low
                either.append(len(tokens))
            after_number = False
        tokens.append(kind)
        surface.append(t if kind is NUMBER else t.lower())
        start = False
    return tokens, surface, either


class Hashes:
    """64-bit hashes of tokens, remembered by a worker, and of windows of them."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def tokens(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), 11)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))

    def readings(self, tokens: list[str], surface: list[str], either: list[int], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each window of width tokens, its hash with the tokens at either read as names, and the windows that have that second reading.

        A window of placeholders alone would meet any other of its kind, so it is hashed by what they stand for.
        """
        n = len(tokens)
        if n < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.tokens(tokens)
        first, slots = _roll(h, width), self.tokens([NUMBER, NAME, UNIT])
        plain = (h != slots[0]) & (h != slots[1]) & (h != slots[2])
        words = np.concatenate(([0], np.cumsum(plain)))
        for k in np.flatnonzero(words[width:] == words[:-width]).tolist():
            first[k] = xxhash.xxh64_intdigest("\x02".join(surface[k : k + width]).encode("utf-8", "surrogatepass"), 13)
        if not either:
            return first, first, np.zeros(0, np.int64)
        plain[either] = False
        may = np.zeros(n, bool)
        may[either] = True
        h[either] = slots[1]
        may, plain = (np.concatenate(([0], np.cumsum(x))) for x in (may, plain))
        return first, _roll(h, width), np.flatnonzero((may[width:] > may[:-width]) & (plain[width:] > plain[:-width]))


def _roll(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of so many token hashes."""
    n = len(h)
    out = np.full(n - width + 1, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = (out ^ h[k : n - width + 1 + k]) * _P
            out ^= out >> np.uint64(29)
    return out


def _named(tokens: list[str], either: list[int]) -> list[str]:
    """The template tokens with those at either read as names."""
    out = list(tokens)
    for k in either:
        out[k] = NAME
    return out


def _slots(tokens: list[str], surface: list[str], at: int, size: int) -> str:
    return "\x02".join(surface[k] for k in range(at, min(at + size, len(tokens))) if tokens[k][0] == "\x01")


def benchmark_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """h, item, ipos, total, islots, second, width, exact: the windows of columns item and text, in their readings.

    second marks a second reading. An item of fewer than size tokens is one window of its own width, and exact: so short a
    template says little, so its values must be the document's too. Items without tokens have no window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                tokens, surface, either = template(text or "")
                width = min(size, len(tokens))
                if not width:
                    continue
                h, named, at = hashes.readings(tokens, surface, either, width)
                for x, k, words, second in ((h, np.arange(len(h)), tokens, False), (named[at], at, _named(tokens, either), True)):
                    n = len(k)
                    if n:
                        slots = [_slots(words, surface, j, width) for j in k.tolist()]
                        made = [x.view(np.int64), pa.array([item] * n, pa.int64()), k.astype(np.int32), np.full(n, len(h), np.int32), slots, np.full(n, second), np.full(n, width, np.int32), np.full(n, width < size)]
                        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=columns)

    prepare(items.sparkSession)
    columns = ["h", "item", "ipos", "total", "islots", "second", "width", "exact"]
    return items.mapInArrow(run, "h long, item long, ipos int, total int, islots string, second boolean, width int, exact boolean")


def candidates(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """h, doc, id, dpos, dslots, second: windows of columns doc, id and text that may be in bench, and a row with dpos -1 and the id for each document."""
    table = np.zeros(1 << BITS >> 3, np.uint8)
    slots = bench.select(F.col("h").bitwiseAND((1 << BITS) - 1).cast("int").alias("s")).distinct().toPandas()["s"].to_numpy()  # at most 2**BITS
    np.bitwise_or.at(table, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    widths = sorted(r["width"] for r in bench.select("width").distinct().collect())  # at most WINDOW
    shared = docs.sparkSession.sparkContext.broadcast(table.tobytes())
    names = ["h", "doc", "id", "dpos", "dslots", "second"]
    id_type = to_arrow_type(docs.schema["id"].dataType)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        h, doc, at, slots, second = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(doc, pa.int64()), pa.nulls(len(out), id_type), pa.array(at, pa.int32()), pa.array(slots, pa.string()), pa.array(second, pa.bool_())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = Hashes(), np.frombuffer(shared.value, np.uint8)

        def found(texts: list[tuple[int, int]], tokens: list[str], surface: list[str], either: list[int]) -> Iterator[tuple]:
            """Rows of texts that lie end to end, given as (doc, first token); a window over two texts is none."""
            starts, names = np.array([x[1] for x in texts], np.int64), None
            for width in widths:
                h, named, at = hashes.readings(tokens, surface, either, width)
                within = np.ones(len(h), bool)
                cross = np.subtract.outer(starts[1:], np.arange(1, width)).ravel()
                within[cross[(cross >= 0) & (cross < len(h))]] = False
                for x, k, second in ((h, None, False), (named[at], at, True)):
                    low = (x & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    hit = np.flatnonzero(bits[low >> 3] >> (low & 7).astype(np.uint8) & 1)
                    k = hit if k is None else k[hit]
                    x, k = x[hit][within[k]], k[within[k]]
                    if not len(k):
                        continue
                    if second and names is None:
                        names = _named(tokens, either)
                    words = names if second else tokens
                    text = np.searchsorted(starts, k, "right") - 1
                    for v, j, t in zip(x.view(np.int64).tolist(), k.tolist(), text.tolist(), strict=True):
                        yield v, texts[t][0], j - texts[t][1], _slots(words, surface, j, width), second

        for batch in batches:
            n = batch.num_rows
            doc, text = batch.column("doc"), batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), doc, batch.column("id"), pa.array(np.full(n, -1, np.int32)), pa.array([""] * n, pa.string()), pa.array(np.zeros(n, bool))], names=names)
            out, texts, held = [], [], ([], [], [])
            for d, t in zip(doc.to_pylist(), text, strict=True):
                if not t:
                    continue
                made = template(t)
                if not made[0]:
                    continue
                texts.append((d, len(held[0])))
                held[2].extend([len(held[0]) + k for k in made[2]])
                held[0].extend(made[0])
                held[1].extend(made[1])
                if len(held[0]) > 20_000:
                    out += found(texts, *held)
                    texts, held = [], ([], [], [])
                if len(out) > 50_000:
                    yield rows(out)
                    out = []
            if texts:
                out += found(texts, *held)
            if out:
                yield rows(out)

    return docs.select("doc", "id", "text").mapInArrow(run, f"h long, doc long, id {docs.schema['id'].dataType.simpleString()}, dpos int, dslots string, second boolean")


def matches(found: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc, item, coverage, changed for the candidates found and the benchmark's windows.

    changed tells whether each window has a slot with another value in the document than in the item. Of the hits of two
    windows in several readings the one of both first readings counts. If values of first readings clash, the diagonal
    goes; where values of second readings clash, with any on the diagonal, the hits of second readings that hold one go.
    """
    hits = found.filter("dpos >= 0").join(bench.withColumnRenamed("second", "_second"), "h").filter("not exact or islots = dslots")
    window = ["doc", "item", "ipos", "total", "diagonal"]
    hits = hits.select("doc", "item", "ipos", "total", (F.col("dpos") - F.col("ipos")).alias("diagonal"), F.struct((F.col("second") | F.col("_second")).alias("second"), "islots", "dslots").alias("r"))
    hits = persist_table(hits.groupBy(*window).agg(F.min("r").alias("r")).select(*window, "r.*"))
    line = ["doc", "item", "diagonal"]
    each = hits.filter("islots <> '' or dslots <> ''").select(*line, "ipos", "second", F.explode(F.arrays_zip(F.split("islots", "\x02").alias("i"), F.split("dslots", "\x02").alias("d"))).alias("p")).select(*line, "ipos", "second", "p.i", "p.d")
    pairs = each.groupBy(*line, "i", "d").agg(F.bool_and("second").alias("second"))

    def clashes(pairs: DataFrame, side: str) -> DataFrame:
        return pairs.groupBy(*line, side).agg(F.count("*").alias("n")).filter("n > 1").select(*line, side)

    first = pairs.filter("not second")
    clash = clashes(first, "i").select(*line).unionByName(clashes(first, "d").select(*line)).distinct()
    again = each.filter("second")
    loose = again.join(clashes(pairs, "i"), [*line, "i"], "left_semi").select(*line, "ipos").unionByName(again.join(clashes(pairs, "d"), [*line, "d"], "left_semi").select(*line, "ipos")).distinct()
    good = hits.join(clash, line, "left_anti").join(loose.withColumn("second", F.lit(True)), [*line, "ipos", "second"], "left_anti")
    good = good.select("doc", "item", "ipos", "total", (F.col("islots") != F.col("dslots")).alias("other")).groupBy("doc", "item", "ipos", "total").agg(F.bool_and("other").alias("other"))
    per = good.groupBy("doc", "item", "total").agg(F.count("*").alias("n"), F.bool_or("other").alias("changed"))
    return per.filter(F.col("n") >= F.ceil(F.lit(coverage) * F.col("total"))).select("doc", "item", (F.col("n") / F.col("total")).alias("coverage"), "changed")


def _items(benchmark: DataFrame) -> DataFrame:
    """The benchmark with a number of its own for each row in ``item``: ids may be null, repeated, or of any type."""
    return with_row_id(benchmark.select("item_id", "text"), "item")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no benchmark item contaminates, columns unchanged. Null and empty texts stay, as do all if the benchmark is empty.

    Texts are read whole, whatever their length. Rows of the benchmark are items of their own, whatever their ids are.
    """
    row = fresh(docs, "_row")
    rows, bench = with_row_id(docs, row), persist_table(benchmark_windows(_items(benchmark), size))
    bad = matches(candidates(rows.select(F.col(row).alias("doc"), F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text")), bench), bench, coverage)
    return rows.join(bad.select(F.col("doc").alias(row)).distinct(), row, "left_anti").drop(row)


def flag_documents(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, contaminated, kept, n_items, item_ids (sorted, joined by commas), coverage of the best.

    Repeated and null ids are rows of their own, on both sides: n_items counts rows of the benchmark, and item_ids has their
    distinct ids, in the order of their type, without null ones. Ids keep their type.
    """
    items = _items(benchmark)
    bench = persist_table(benchmark_windows(items, size))
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    ids = persist_table(candidates(rows.select(F.col("_row").alias("doc"), F.col("doc_id").alias("id"), "text"), bench))
    found = matches(ids, bench, coverage)
    found = found.join(items.select("item", "item_id"), "item")
    per = found.groupBy(F.col("doc").alias("_row")).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_set("item_id")).cast("array<string>")).alias("item_ids"), F.max("coverage").alias("coverage"))
    out = ids.filter("dpos = -1").select(F.col("doc").alias("_row"), F.col("id").alias("doc_id")).join(per, "_row", "left")
    bad = F.col("n_items").isNotNull()
    return out.select("doc_id", bad.alias("contaminated"), (~bad).alias("kept"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, contaminated, kept, n_items, item_ids, coverage."""
    return flag_documents(documents(spark, sf_dir), prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
