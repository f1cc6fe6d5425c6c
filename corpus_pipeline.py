"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's documents; all but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwatch.llm import mixing, packing, quality, simhash, suffix_dedup
from shelfwatch.llm.ship import ship
from shelfwatch.session import cut_lineage

END_ID = 2
# Texts may be long, and the Python workers of an executor hold a batch each.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the pairwise ranking puts above its threshold."""
    ready(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near copies."""
    ready(spark)
    return simhash.keep_one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts what earlier documents already say; a document of which nothing is left goes."""
    ready(spark)
    rows = suffix_dedup.remove_repeats(docs, "_kept", "_spans", whole_characters=True)
    rows = rows.filter((F.size("_spans") == 0) | (F.length("_kept") > 0))
    text = F.when(F.size("_spans") > 0, F.col("_kept").cast("string")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    return mixing.with_length(rows.select(*[F.col(f"`{c}`") for c in docs.columns]))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from every source its share of the words, repeating or leaving documents."""
    ready(spark)
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in sequences of at most 4096."""
    ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

# No SQL: the stages learn a model and follow links; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
