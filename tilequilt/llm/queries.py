"""The registered queries of the corpus operators and, where SQL expresses them, their oracle SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, linededup, media, mixing, pii, secretscan, simhash, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.store_media(_table(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 0, F.lit(False))
    return langid.predict_languages(docs, langid.train(docs)).withColumn("held_out", held_out)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.filter_captures(urlfilter.page_captures(pages), urlfilter.page_entries(pages))


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_surrogates(_table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_entities"), spans.alias("spans"), "text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.line_counts(_table(spark, sf_dir, "documents"))
    return found.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_report(_table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_media, op2_language, op3_url_filter, op4_nearest, op5_simhash, op6_surrogates, op7_line_dedup, op8_mixing, op9_secrets, op10_byte_bpe)}
ORACLES = {"op3_url_filter": urlfilter.ORACLE, "op8_mixing": mixing.ORACLE}
