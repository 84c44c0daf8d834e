"""The corpus pipeline: language ID, near-dedup, personal data, mixing, BPE, in this order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. run() writes each stage's rows as Parquet in the shared folder and reads them again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from plumbline.llm import byte_bpe, lang_id, mixing, near_dup, pii
from plumbline.llm.common import DOC_COLUMNS, join_checked, materialize, noting, remove, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts each document's language from its text, learning from the stage's own labels, and
    drops those without one: null or letterless texts and ambiguous ones of low score. lang becomes
    the prediction."""
    docs = docs.select(*DOC_COLUMNS)
    found = lang_id.identify(docs, lang_id.learn(docs))
    return found.where("lang_pred <> 'und' and not (ambiguous and score < 0.5)").withColumn("lang", F.col("lang_pred")).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 or more: the least doc_id. Of
    rows that repeat a doc_id the least text stays; rows with a null doc_id stay."""
    docs = docs.select(*DOC_COLUMNS)
    found = near_dup.near_duplicates(docs, percent=80, rows=5)
    odd = materialize(found.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1"), "dropped")
    marked = join_checked(docs, odd, "doc_id", "left", odd.count(), 32)
    once = marked.where("n is null").select(*DOC_COLUMNS)
    least = F.row_number().over(W.partitionBy("doc_id").orderBy("text", "source", "lang"))
    return once.unionByName(marked.where("n > 1 and kept").withColumn("at", least).where("at = 1").select(*DOC_COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in every text; n_chars follows the text. No document goes."""
    return pii.mask(docs.select(*DOC_COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights in whole documents: each document appears 0, 1 or 2
    times, rounded so that the errors cancel within a source (mixing.whole). Rows of one doc_id, source
    and size share their number of copies, and so do rows with a null doc_id of one source and size."""
    docs = docs.select(*DOC_COLUMNS)
    taken = materialize(mixing.whole(mixing.mix(docs)).toDF("_id", "_source", "_size", "copies"), "copies")
    same = docs["doc_id"].eqNullSafe(taken["_id"]) & docs["source"].eqNullSafe(taken["_source"]) & (mixing.word_count(docs["text"]) == taken["_size"])
    rows = join_checked(docs, taken, same, "inner", taken.count(), 48)
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*DOC_COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes the ids again: doc_id, lang, source, n_tokens, ids, and whether
    the decoded bytes are the text's."""
    file, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return byte_bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), file, pattern)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("personal_data", personal_data), ("mixing", mix), ("byte_bpe", tokens)]
#: SQL can express neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents. When a stage's rows are written, what it read and made goes."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with noting() as made:
            docs, path = written(stage(spark, docs, sf_dir), name)
        remove(spark, [p for p in [kept, *made] if p and p != path])
        kept = path
    return docs
