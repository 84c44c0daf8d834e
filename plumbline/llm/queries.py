"""Queries opN_<name> over the test tables, by their contracts, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from . import ann, byte_bpe, embed_dup, filter_audit, lang_id, mixing, near_dup, passage_dup, pii, token_files, top_k, url_filter, whitening
from .oracles import ORACLES  # noqa: F401  with QUERIES, what __spark_entry__ registers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op1_top_k(spark, sf_dir):
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op2_near_dup(spark, sf_dir):
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_embed_dup(spark, sf_dir):
    return embed_dup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = lang_id.learn(docs.where(~held_out))
    return lang_id.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op6_token_files(spark, sf_dir):
    return token_files.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_byte_bpe(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_passage_dup(spark, sf_dir):
    return passage_dup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_top_k,
    op2_near_dup,
    op3_embed_dup,
    op4_url_filter,
    op5_language_id,
    op6_token_files,
    op7_byte_bpe,
    op8_passage_dup,
    op9_mixing,
    op10_pii,
    op11_ann,
    op12_whitening,
    op13_filter_audit,
)}
