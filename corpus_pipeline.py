"""Corpus pipeline over ``documents``: toxicity, near-duplicates, substring duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame; its result is written
as Parquet and read again as the next stage's documents. The last stage returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import read_table, stored
from tidemill.llm.decontaminate import decontaminate
from tidemill.llm.neardup import representatives
from tidemill.llm.pack import pack, with_crc
from tidemill.llm.queries import tokenizer_path
from tidemill.llm.substrings import drop_repeats
from tidemill.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    scored = toxicity(docs.select("doc_id", "text", "lang", "source", "n_chars"), read_table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select("doc_id", "text", "lang", "source", "n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the least doc id."""
    return representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; other texts stay as they are. Documents that lose all words go."""
    cut = drop_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.coalesce(F.length(text).cast("long"), F.col("n_chars")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in benchmark windows go."""
    judged = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return judged.filter("not contaminated").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences."""
    return with_crc(pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Learned weights and tokenizers have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
