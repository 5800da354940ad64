"""What a query needs of a session: workers that find the library, joins planned by measured sizes, and shared tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BATCH, DEFAULT, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"
STATIC, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
#: Bytes of a compressed file to a partition, when each of its letters becomes a row.
SPREAD_BYTES = 1 << 20


def find_library(spark: SparkSession) -> None:
    """Lets the Python workers of this session import the library from where the driver has it."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in paths if p]])


def prepare(spark: SparkSession) -> SparkSession:
    """The session, whose workers find the library and whose Arrow batches are bounded.

    Rows here can be long texts, so a batch of Spark's default number of rows could take hundreds of megabytes on both
    sides of a worker's pipe. A number that was set on purpose stays.
    """
    if spark.conf.get(BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BATCH, ROWS)
    find_library(spark)
    return spark


def engine(spark: SparkSession, together: bool = False) -> SparkSession:
    """A session beside this one, with its settings, that broadcasts only tables whose size it has measured.

    Here a row of a small file becomes a million rows of bases. The optimiser's estimate knows nothing of that and takes
    the exploded table for as small as its file, so joins are planned without broadcast, and adaptive execution changes
    to one where the shuffled side has turned out to be small. The caller's session keeps its settings.

    together is for tables dealt out by their first key (spread): what is exploded from them stays where it is, and joins
    on that key and others find both sides in place, where Spark would else shuffle each row of bases for its second key.
    """
    out = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            out.conf.set(key, value)
    if out.conf.get(STATIC) != "-1":
        out.conf.set(MEASURED, out.conf.get(MEASURED, None) or out.conf.get(STATIC))
        out.conf.set(STATIC, "-1")
    if together:
        out.conf.set(ALL_KEYS, "false")
    return prepare(out)


def spread(df: DataFrame, file_bytes: int = 0) -> DataFrame:
    """Rows dealt out by a hash of their first column to spark.sql.shuffle.partitions, before each of them becomes thousands.

    A task reads whole row groups of a file, so a small file with large rows would be exploded by one task. The rows that
    move here are a small share of what they become. With the bytes that they have as a file, there are more partitions
    where these are many, so that what a task sorts stays in its memory however large the table is.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-file_bytes // SPREAD_BYTES))
    return df.repartition(parts, df.columns[0])


def file_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of the files below a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a temporary one, if the driver is also the only executor."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/helixloom-{uuid.uuid4().hex}"


def write_table(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends there, and any executor can read it.

    The files go with drop_table, or at the latest when the driver ends.
    """
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Removes the files of a table written by write_table that nothing needs any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        df._shared_path = None
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
