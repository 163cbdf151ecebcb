"""The queries opN_<name> over the driver's tables, with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackmotif.llm import avi_mjpeg, bpe_lexicon, decontam, lexical, line_dedup, minhash_tensor, pii, quality, resample, simhash, sstable, toxicity, warc
from trackmotif.session import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), columns=["doc_id", "lang"])
    return found.select("doc_id", "lang", "n_units", F.exp("log_ppl").alias("perplexity"), F.exp("fence").alias("threshold"), "accepted")


def op2_avi_motion_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return avi_mjpeg.media_digests(table(spark, sf_dir, "documents"))


def op3_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_tensor.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op4_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op5_token_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.read_digests(sstable.write_shards(table(spark, sf_dir, "documents"), TOKENIZER))


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, counts=("n_lines", "n_dropped")).drop("source")


def op8_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_lexicon.codec_digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op11_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_suffix_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_kneser_ney_quality, op2_avi_motion_jpeg, op3_minhash_tensor, op4_warc_source, op5_token_sstable, op6_suffix_automaton, op7_information_pii,
        op8_ftrl_toxicity, op9_line_dedup, op10_bpe_lexicon, op11_impact_search, op12_suffix_resample, op13_simhash_bktree,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_warc_source": warc.ORACLE_SQL, "op9_line_dedup": line_dedup.ORACLE_SQL, "op11_impact_search": lexical.ORACLE_SQL, "op12_suffix_resample": resample.ORACLE_SQL}
