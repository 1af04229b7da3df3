"""The corpus pipeline: each stage calls one operator on all documents that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcheck.llm import bpe, line_dedup, minhash, mixing, toxicity
from postcheck.llm.common import stored
from postcheck.llm.queries import PATTERN, RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks toxic go.

    Null and empty texts are judged like others and stay unless marked; repeated rows are judged alike; rows without an
    id stay open to judgement; extra columns are kept, also those named like the classifier's results. Long texts are read whole.
    """
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from every document; n_chars follows the text.

    A null text becomes empty; a text that loses all lines stays as an empty one. Repeated rows of one id count as one document.
    """
    kept = line_dedup.drop_common_lines(docs, min_documents=10, min_chars=1, stats=False)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one of least id.

    Texts without words and rows without an id are no duplicates and stay. Rows that share the least id of a group all stay.
    """
    return minhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until the sources have their target words.

    A null source is a source of its own; texts without words stay once. Repeated rows and ids draw for themselves.
    """
    return mixing.take(docs, mixing.mix(docs, weights=(3, 1, 2), share=1.5, cap=2.0))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text again. A null or empty text has no ids and decodes to nothing; repeated rows keep their own result."""
    both = bpe.encode(docs, RANKS, PATTERN, out="ids", decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return both.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", tokenise),
]

#: The classifier, the min-hash forest and the mixing rates have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
    return docs
