"""The corpus pipeline: stages over documents, each written as Parquet and read as the next one's input.

In order: documents that the toxicity model rejects go; lines that stand on many sources go but for the first place;
one document of each group of near copies stays; sources are mixed to their target weights, a document's row standing
as often as the mix takes it; texts become token ids. All but the last return the columns of documents.

Defined cases, for every stage: documents may have further columns of any name, which pass through. A null or empty text
is never toxic, has no lines to remove, is a near copy of every other text without words, has size 0, which any mix
takes once, and has no token ids. A null doc_id or source is one of its own. Rows that repeat each other are near
copies, of which one stays. Very long texts are read whole. An empty table stays empty. The last stage adds token_ids,
with an underscore behind it if documents have that column already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import bpe, line_dedup, mixing, simhash, toxicity
from millrace.llm.common import delete, scratch, shared_path, table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labels of the documents that it is given, as op4 does, and keeps those below its threshold."""
    return toxicity.cleaned(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document goes only if none but white space is left of it."""
    return line_dedup.deduped(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8 or more, directly or in steps; the smallest doc_id stays."""
    return simhash.near_deduped(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.with_tokens(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The toxicity model, SimHash components and byte-pair merges can't be said in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from where they are written; that folder stays until the driver ends. What a stage
    stores on its way goes when the stage has been written, and its output when the next one has."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(written(spark, path))
        if before:
            delete(spark, before)
        before = path
    return docs
