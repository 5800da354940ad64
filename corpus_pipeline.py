"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm import bpe, decontaminate, line_dedup, quality, simhash_dedup
from helixloom.llm.shared import drop_table, persist_table, table_scope
from helixloom.session import prepare

#: Tables that the last stage wrote for itself; its result has been written when the next stage begins, so they go then.
_left: list[DataFrame] = []


def _stage(work):
    """A stage that first removes what the one before it wrote for itself."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            table = _left.pop()
            if table.sparkSession.sparkContext is spark.sparkContext:
                drop_table(table)
        with table_scope() as tables:
            out = work(spark, docs, sf_dir)
        _left.extend(tables)
        return out

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    models = quality.train_models(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, models).filter("kept").select(*docs.columns)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; those of which nothing is left go, n_chars follows the text."""
    prepare(spark)
    out = line_dedup.dedup_lines(docs)
    out = out.filter((F.col("n_deleted") == 0) | (F.trim("text") != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@_stage
def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    prepare(spark)
    return simhash_dedup.keep_one(docs)


@_stage
def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    return decontaminate.decontaminate(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with n_tokens, ids_sha256 and decoded_sha256 of their encoding."""
    prepare(spark)
    return bpe.bpe_columns(docs, bpe.default_vocab(), digests=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding and decoding", token_stage),
]

#: No stage's rows can be had from SQL; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist_table(docs)
            drop_table(before)
            before = docs
    return docs
