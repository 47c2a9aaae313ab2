"""The corpus pipeline: quality, exact dedup, near dedup, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``. Stages are written as Parquet and read again between each other.

All stages take rows with nulls in any column: a null text is an empty one, a null id is an id like
others, a null source or language is one more of them. Very long texts are read whole, equal rows
are rows of their own until a dedup stage meets them, an empty table gives an empty one, and
columns beside those of ``documents`` pass through, whatever their names, to the token stage, which
leaves them out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.llm import bpe, exact_dedup, mixing, near_dedup, quality
from casewell.llm.common import discard, drop_keys, scratch, stored, table
from casewell.llm.queries import vocabulary_path


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps and does not call toxic, by the labels beside ``documents``.
    Without labels of both kinds all stay; rows that repeat id and text are judged alike."""
    judged = quality.classify(docs, table(spark, sf_dir, "labels"))
    gone = stored(judged.filter("not kept or toxic").select("doc_id", "text_hash"), "rejected", narrow=True)
    return drop_keys(docs, gone, {"doc_id": F.col("doc_id"), "text_hash": text_hash()})


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, empty and null ones included, the one with the largest id; of rows that repeat
    it one, and a null id is smaller than any other."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest id, and rows that repeat it. Texts without words and
    rows without an id stay."""
    classes = near_dedup.near_duplicates(docs)
    gone = stored(classes.filter("not kept").select("doc_id", "text_hash"), "near", narrow=True)
    return drop_keys(docs, gone, {"doc_id": F.col("doc_id"), "text_hash": text_hash()})


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut as far as it is taken, and
    ``n_chars`` is then that of the part. Sources without words are not taken at all."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, token_ids, exact``: token ids of every document, and whether they
    decode to its text. Null and empty texts have none."""
    docs = docs.withColumn("text_sha256", sha("text"))
    out = bpe.encode(docs, vocabulary_path(), carry=("doc_id", "lang", "source", "text_sha256"), round_trip=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "token_ids", (sha("decoded") == F.col("text_sha256")).alias("exact"))


def sha(c: str) -> Column:
    return F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("source mixing", mixing_stage),
    ("tokens", token_stage),
]
#: Weighted sampling and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
