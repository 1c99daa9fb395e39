"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as
the next one's documents. All but the last return the columns of ``documents``; the last returns the
packing (``textloom.llm.packing.pack``). Its rows depend on trained weights, hashes and a tokenizer,
so there is no SQL for them: ``ORACLE_SQL`` is None and tests hold the stages against brute force.

Defined results of all stages: an empty table gives an empty one; null texts count as empty; null ids are
ids of their own; repeated rows are judged each, but for near duplicates, which keep one; further columns
are kept, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontaminate, line_dedup, near_dedup, packing, quality
from textloom.llm.common import materialize, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it is fitted on the labelled ones among them. Without
    labels of both classes all that are not shorn of quality by their site stay (p = 0.5 is kept)."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("keep").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without runs of lines that occur earlier; ``n_chars`` follows the text, which is empty
    where it was null and may become empty."""
    out = line_dedup.dedup_lines(docs)
    return out.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the least id, a null one only if there is no
    other. Texts without words are one class."""
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; with no items all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; an empty text is one piece of one token."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
