"""One key with two thirds of the rows: adaptive execution splits the joins of op2, op5 and op7."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casewell.llm import line_dedup, url_filter, warc

LOW = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.files.maxPartitionBytes": "64k",
}


@pytest.fixture
def low(spark):
    before = {k: spark.conf.get(k, None) for k in LOW}
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def splits(df) -> int:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


def test_revisits_of_one_response(low):
    noise = F.sha2(F.col("id").cast("string"), 256)
    rows = low.range(0, 9000, 1, 8).select(
        F.col("id").alias("record_id"), F.when(F.col("id") % 3000 == 0, "response").otherwise("revisit").alias("kind"),
        F.when(F.col("id") < 6000, "http://hot.example/").otherwise(F.concat(F.lit("http://e.org/"), noise)).alias("url"), F.col("id").alias("ts"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.create_map(F.lit("x"), noise).alias("headers"), noise.alias("digest"),
    )
    assert splits(warc.resolve_revisits(rows)) >= 1


def test_rows_of_one_url(low):
    noise = F.sha2(F.col("id").cast("string"), 512)
    rows = low.range(0, 9000, 1, 8).select(F.concat(noise, noise, noise).alias("page_id"), F.when(F.col("id") < 6000, "http://hot.net/a").otherwise(F.concat(F.lit("http://e.net/"), noise)).alias("url"))
    judged = url_filter.judge_urls(rows.unionByName(low.range(100).select(F.col("id").cast("string").alias("page_id"), F.lit(None).cast("string").alias("url"))), url_filter.HOST_RULES, carry=("page_id",))
    assert splits(judged) >= 1
    assert judged.filter("url is null and verdict = 'allow' and host = '' and rule is null").count() == 100
    assert judged.count() == 9100


def test_texts_of_one_host(low):
    noise = F.sha2(F.col("id").cast("string"), 512)
    rows = low.range(0, 6000, 1, 8).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"), F.concat(noise, F.lit("\ncommon line\n"), noise).alias("text")
    )
    out = line_dedup.drop_boilerplate(rows, broadcast_lines=0)
    assert splits(out) >= 1
    assert out.filter("n_dropped <> 1 or n_lines <> 3 or contains(clean_text, 'common')").count() == 0
