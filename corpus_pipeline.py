"""A corpus pipeline over documents: toxicity, near duplicates, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellate.llm import decontaminate, ngram_join, packing, pii, toxicity
from stellate.llm.common import importable, table, written

#: Near duplicates share this percentage of their distinct word shingles of this size.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the model learns from the labels' training fold."""
    column = "toxicity"
    while column in {c.lower() for c in docs.columns}:
        column += "_"
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), column)
    return scored.where(F.col(column) < toxicity.THRESHOLD).drop(column)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document of the smallest doc_id stays."""
    importable(spark)
    return ngram_join.without_copies(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every confirmed personal-data span is replaced by its kind in brackets; no document goes."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    importable(spark)
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_copies), ("decontamination", drop_contaminated), ("pii", mask_personal_data), ("packing", pack)]
#: Packing takes a byte-pair tokenizer, which SQL doesn't have.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(chr(32), chr(45))}")
    return STAGES[-1][1](spark, docs, sf_dir)
