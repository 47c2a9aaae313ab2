"""The registered queries of the training-data operators. Each applies its operator, with the
production parameters, to its whole table and returns the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, line_dedup, mixing, near_dedup, prefix_trie, quality, resampling, secrets, simhash, url_filter, vectors, warc
from .common import table
from .oracles import ORACLES


def vocabulary_path() -> str:
    """Where the public byte-level vocabulary lies; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs).select("doc_id", "class_id", "class_size", "n_compared_links", "kept")


def captures(pages: DataFrame) -> DataFrame:
    """Pages as a capture log, by fixed rules of the id: every page is fetched four times, a full
    response first; later fetches are not modified, but the third one of every fourth page is
    a new response. Validators are weak in revisits, missing for some pages and wrong in
    the last revisit of every eleventh page."""
    visits = pages.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(3))))
    i, v = F.col("page_id"), F.col("v")
    changed = i % 4 == 0
    full = (v == 0) | ((v == 2) & changed)
    version = F.when((v >= 2) & changed, 1).otherwise(0) + F.when((v == 3) & (i % 11 == 5), 5).otherwise(0)
    etag = F.when(i % 7 != 0, F.concat(F.when(full, "").otherwise("W/"), F.lit('"v'), version.cast("string"), F.lit('"')))
    modified = F.when(i % 5 >= 2, F.concat(F.lit("day "), version.cast("string")))
    time = i + v.cast("long") * 1_000_000_000
    headers = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Date"), time.cast("string"), F.lit("ETag"), etag)
    return visits.select(
        (i * 4 + v).alias("record_id"),
        F.when(full, "response").otherwise("revisit").alias("kind"),
        "url",
        time.alias("ts"),
        etag.alias("etag"),
        modified.alias("last_modified"),
        headers.alias("headers"),
        F.when(full, F.col("body")).alias("digest"),
    )


def op2_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    out = warc.resolve_revisits(captures(table(spark, sf_dir, "pages").select("page_id", "url", body.alias("body"))))
    headers = F.array_join(F.transform(F.map_entries("resolved_headers"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";")
    return out.select(
        "record_id", "canonical", "kind", "state", "resolved_id", "resolved_digest", headers.alias("resolved_headers")
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode(docs, vocabulary_path(), round_trip=True)
    return out.select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(mixing.with_words(docs))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge_urls(pages, url_filter.HOST_RULES + url_filter.read_rules(), carry=("page_id",))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.nearest_neighbours(rows, F.col("vec_id") % 100 == 0)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = line_dedup.drop_boilerplate(docs)
    return out.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return exact_dedup.progressive_dedup(docs, carry={"text_sha256": sha}).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")).drop("text_hash")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["rank"] < len(secrets.BASE_RULES))
    def count(rank: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{r.kind}") for i, r in enumerate(secrets.BASE_RULES)],
        F.sha2(secrets.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each distinct sequence of first turns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    return prefix_trie.trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


__all__ = ["ORACLES", "QUERIES"]

_ALL = (
    op1_near_dedup,
    op2_warc_revisits,
    op3_bpe,
    op4_mix_sources,
    op5_url_filter,
    op6_nearest,
    op7_line_dedup,
    op8_exact_dedup,
    op9_quality,
    op10_secret_scan,
    op11_prefix_trie,
    op12_resample,
    op13_simhash,
)
QUERIES = {f.__name__: f for f in _ALL}
