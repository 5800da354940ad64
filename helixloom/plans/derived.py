"""Origami tables from the document table: designs whose staples, and so whose contact map, are known by construction.

A document's letters A-Z, upper-cased and folded onto ACGT, are a scaffold; even ids are LINEAR, odd ones CIRCULAR. Tiles of
16 bases start at base 0, or 8 on a circular scaffold. Of each whole group of four tiles, staple 2m pairs with tiles 4m and
4m+2, staple 2m+1 with tiles 4m+1 and 4m+3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import reverse_complement
from ..session import engine, file_bytes, spread

TILE = 16
ALPHABET, BASES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC"


def encoded(text: Column) -> Column:
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), ALPHABET, BASES)


def designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """design_id, scaffold_type, scaffold53, n, circular for each document with a letter."""
    path = f"{sf_dir}/documents.parquet"
    docs = engine(spark, together=True).read.parquet(path)
    # a filter on the code would work it out twice
    docs = docs.filter(F.col("text").rlike("[A-Za-z]"))
    out = docs.select(F.col("doc_id").alias("design_id"), encoded(F.col("text")).alias("scaffold53"))
    # the letters are worked out before the exchange, not again for each row that a scaffold is exploded to
    out = spread(out, file_bytes(spark, path)).withColumn("circular", F.col("design_id") % 2 != 0).withColumn("n", F.length("scaffold53"))
    return out.select("design_id", F.when(F.col("circular"), "CIRCULAR").otherwise("LINEAR").alias("scaffold_type"), "scaffold53", "n", "circular")


def staples(design: DataFrame) -> DataFrame:
    """design_id, staple_id, seq53 and sections, an array of (i53, runlen); one row per staple."""
    return placed_staples(design).drop("n", "circular")


def _numbers(n: Column, circular: Column) -> Column:
    """The numbers of a design's staples."""
    groups = F.floor((n - F.when(circular, 8).otherwise(0)) / (4 * TILE)).cast("int")
    return F.when(groups > 0, F.sequence(F.lit(0), 2 * groups - 1)).otherwise(F.array().cast("array<int>"))


def staple_ids(design: DataFrame) -> DataFrame:
    """design_id, staple_id of the staples, without their letters."""
    return design.select("design_id", F.explode(_numbers(F.col("n"), F.col("circular"))).alias("staple_id"))


def placed_staples(design: DataFrame) -> DataFrame:
    """staples with n and circular of their design, so that what needs these joins nothing."""
    n, at = F.col("n"), lambda c: F.when(F.col("circular"), 8).otherwise(0) + c
    # a scaffold is turned once, a piece of a binary costs its own length, and no row of a staple carries its scaffold
    turned = design.select("design_id", "n", "circular", reverse_complement("scaffold53").cast("binary").alias("_t"))
    part = lambda a: F.substring("_t", n - a - TILE + 1, F.lit(TILE)).cast("string")
    section = lambda a: F.struct((a + TILE - 1).alias("i53"), F.lit(TILE).alias("runlen"))

    def staple(m: Column) -> Column:
        a = at(4 * TILE * F.floor(m / 2).cast("int") + TILE * (m % 2))
        b = a + 2 * TILE
        return F.struct(m.alias("staple_id"), F.concat(part(a), part(b)).alias("seq53"), F.array(section(a), section(b)).alias("sections"))

    # no filter on the size, which would go below the exchange and make another one of it, with the letters worked out again
    return turned.select("design_id", F.inline(F.transform(_numbers(n, F.col("circular")), staple)), "n", "circular")


def shortened(placed: DataFrame, by: Column, runlen: Column | None = None) -> DataFrame:
    """Placed staples whose first section lacks so many bases at its 5' end; runlen is what is left of it, if that is not the rest."""
    def first(s: Column, k: Column) -> Column:
        run = s.getField("runlen") - by if runlen is None else runlen
        return F.struct((s.getField("i53") - F.when(k == 0, by).otherwise(0)).alias("i53"), F.when(k == 0, run).otherwise(s.getField("runlen")).alias("runlen"))

    return placed.withColumn("sections", F.transform("sections", first))


def sections(staple: DataFrame) -> DataFrame:
    """design_id, staple_id, section_id, i53, runlen."""
    return staple.select("design_id", "staple_id", F.posexplode("sections").alias("section_id", "s")).select("design_id", "staple_id", "section_id", "s.i53", "s.runlen")
