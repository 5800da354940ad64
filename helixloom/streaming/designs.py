"""A stream of input files, each solved when it arrives.

The reading side is a file stream of whole texts. Parsing a design needs only its own file, so each micro-batch is solved
as a table; results go to a partitioned sink keyed by batch, so a batch that is run again replaces its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.contact_map import ID
from ..operators.solver import Settings, solve
from ..sources.readers import numbered, rev_tables


def design_stream(spark: SparkSession, folder: str) -> DataFrame:
    """design_id, file_size, value of files as they appear in a folder."""
    name = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1), r"\.[^.]*$", "")
    return spark.readStream.format("text").option("wholetext", True).load(folder).select(name.alias(ID), F.col("_metadata.file_size").alias("file_size"), "value")


def solve_batch(files: DataFrame, method: str, settings: Settings) -> DataFrame:
    """name and the solver's columns for files of one batch."""
    t = rev_tables(numbered(files))
    ids = t["designs"].select(F.col(ID).alias("name")).distinct().withColumn("key", F.xxhash64("name"))
    named = lambda df: df.withColumnRenamed(ID, "name").join(ids, "name").withColumnRenamed("key", ID)
    out = solve(named(t["designs"]).select(ID, "scaffold53", "circular"), named(t["staples"]).select(ID, "staple_id", "seq53"), method, settings)
    good = out.join(ids.withColumnRenamed("key", ID), ID).drop(ID)
    bad = t["errors"].select(F.concat_ws(" ", "message", F.concat(F.lit("in line "), F.col("line").cast("string"))).alias("error"), F.col(ID).alias("name"))
    return good.unionByName(bad, allowMissingColumns=True)


def solve_stream(stream: DataFrame, out: str, checkpoint: str, method: str = "full", settings: Settings = Settings(), **trigger) -> StreamingQuery:
    """Writes solved sections below out/batch=<n>. trigger as in DataStreamWriter.trigger, availableNow by default."""

    def each(batch: DataFrame, n: int) -> None:
        solve_batch(batch, method, settings).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
