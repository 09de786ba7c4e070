"""Training-data pipeline over the documents table: each stage is one operator of ``hindcast.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hindcast.llm.lines import dedup_lines
from hindcast.llm.ngram_join import ngram_components
from hindcast.llm.packing import pack_best_fit
from hindcast.llm.quality import score_quality
from hindcast.llm.queries import events_of, rejections, tokenizer
from hindcast.llm.stored import Workspace, bounded_arrow
from hindcast.llm.tiling import item_coverage
from hindcast.session import configure


def _without(docs: DataFrame, events: DataFrame) -> DataFrame:
    gone = events.select(F.col("event_id").alias("_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    configure(bounded_arrow(spark))
    labels = rejections(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, score_quality(events_of(docs), labels).filter("rejected"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of like lines stays; documents left without any go."""
    configure(bounded_arrow(spark))
    kept = dedup_lines(docs.select(F.col("doc_id").alias("event_id"), "text", "lang", "source", "n_chars"))
    return kept.select(F.col("event_id").alias("doc_id"), "text", "lang", "source",
                       F.coalesce(F.length("text").cast("long"), "n_chars").alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of documents whose five-word shingles are alike by 0.8 or more stays."""
    configure(bounded_arrow(spark))
    return _without(docs, ngram_components(events_of(docs), width=5, percent=80).filter("component_id <> event_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    configure(bounded_arrow(spark))
    return _without(docs, item_coverage(events_of(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their place in sequences."""
    configure(bounded_arrow(spark))
    return (pack_best_fit(events_of(docs), tokenizer("word_bpe_49k.json"))
            .withColumnRenamed("event_id", "doc_id"))


STAGES = [("quality", quality), ("lines", lines), ("near_copies", near_copies), ("decontaminated", decontaminated),
          ("packed", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = work.saved(stage(spark, docs, sf_dir), name)
    return docs
