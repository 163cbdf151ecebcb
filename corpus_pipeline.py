"""The corpus pipeline: quality, boilerplate lines, near-duplicates, benchmark passages, then token ids.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last give the columns of ``documents``, with n_chars as it is after the stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmotif.llm import bpe_lexicon, decontam, line_dedup, minhash_tensor, quality
from trackmotif.session import drop_tables, materialise, table, tables_written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SHINGLE_WORDS = 5


def _documents(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity isn't above their language's fence."""
    return quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).where("accepted").select(*COLUMNS)


def line_dedup_by_host(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source."""
    return _documents(line_dedup.drop_boilerplate(docs.select(*COLUMNS)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; documents without an identifier all stay."""
    docs = docs.select(*COLUMNS)
    kept = minhash_tensor.near_duplicates(docs, SHINGLE_WORDS).where("kept").select("doc_id").distinct()
    one = docs.join(kept, "doc_id", "left_semi").groupBy("doc_id").agg(*(F.first(c).alias(c) for c in COLUMNS[1:]))
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are little else go."""
    return _documents(decontam.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text and their number, and whether they decode to it."""
    return bpe_lexicon.encode_rows(docs, TOKENIZER)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_by_host),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]
#: The quality model, the automaton and the tokenizer can't be put in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. When a stage's rows are written, the tables that it and the one before left are dropped."""
    docs, before = table(spark, sf_dir, "documents"), tables_written(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
        drop_tables(spark, before, -1)  # all but the stage's own
    return docs
