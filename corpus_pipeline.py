"""The corpus pipeline: five stages over the documents, each written as Parquet and read again by the next.

Language ID (rows without a language go), line dedup over the whole corpus, n-gram Jaccard join (one document of each
group stays), mixing of the sources to their target weights (rows repeat as the mix takes them), and encoding with
SentencePiece. All but the last stage return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from transit_spark.catalog.registry import Registry
from transit_spark.llm import language, lines, mixing, partenum, piece_table
from transit_spark.llm.common import documents, fresh, ship_code, tidy
from transit_spark.llm.queries import vocabulary
from transit_spark.session import checkpoint_root

REGISTRY = Registry()


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose text has a language; what is learned comes from the rows at hand."""
    ship_code(spark)
    return language.identified_rows(docs, language.labelled_sample(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; ``n_chars`` follows; a document left without a word goes."""
    ship_code(spark)
    found = lines.dedup_lines(docs)
    changed = F.col(found.columns[-1]) > 0
    kept = found.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return kept.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(found.columns[-1])


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their five-word shingles keeps the one with the smallest id."""
    ship_code(spark)
    found = partenum.near_duplicates(docs, shingle=5, percent=80)
    name = fresh(docs.columns, "__id")[0]
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of each source as often as the mix to target weights takes them."""
    ship_code(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, their hash, and the hash of what they decode to."""
    ship_code(spark)
    return piece_table.encode_pieces(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has no suffix automata, MinHash or SentencePiece; tests compare each stage with a brute-force version.
ORACLE_SQL = None


@REGISTRY.query("pipeline", oracle=ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what each returns is written to the shared folder and read again.

    Shuffle files of a stage go before the next one begins to write its own.
    """
    docs = documents(spark, sf_dir)
    folder = f"{checkpoint_root(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        tidy(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
