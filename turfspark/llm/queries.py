"""The registered queries of the training-data operators, each over its whole table."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, digest, fim, langid, licenses, oracles, quality, sentencepiece_fst, sharding, simhash, tokenbin, toxicity, trie, warc
from ._store import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placements(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokenbin.round_trip(spark, table(spark, sf_dir, "documents"), scratch_path(spark, "tokens"), path)


def op10_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_pairs(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"), trie.spliced)


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.round_trip(table(spark, sf_dir, "documents"))


def queries() -> dict:
    registered = (
        op1_decontam, op2_sharding, op3_sentencepiece, op4_langid, op5_warc, op6_licenses, op7_simhash, op8_toxicity, op9_token_files, op10_digest,
        op11_quality, op12_trie, op13_fim,
    )
    return {f.__name__: f for f in registered}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
