"""Evidence analyzers over bytes that the carrier tables hold or that are made of their rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from casewell.operators import media
from casewell.storage import table

from .registry import query

TONES = 64  # recordings made at once


@query("b1_digest_of_files", "SELECT 'page-' || page_id::VARCHAR || '.html' AS path, 'unsupported' AS kind, strlen(html)::BIGINT AS length, sha256(html) AS sha256 FROM pages")
def b1(spark, sf):
    p = table(spark, sf, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"))
    return media.stamped(p.withColumn("length", F.octet_length("content").cast("long"))).drop("analyzed_at")


@query("b4_kind_by_extension", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'unsupported' END AS kind FROM part")
def b4(spark, sf):
    path = F.concat("p_name", F.element_at(F.array(F.lit(".JPG"), F.lit(".mp4"), F.lit(".wav"), F.lit(".doc")), (F.col("p_size") % 4 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", media.kind(path).alias("kind"))


@query("b6_b8_time_entities", "SELECT n_nationkey, array_to_string(list_transform(generate_series(0, greatest(n_nationkey - 1, 0)), lambda s: 'PT' || s::VARCHAR || 'S'), ',') AS t FROM nation WHERE n_nationkey > 0")
def b8(spark, sf):
    n = table(spark, sf, "nation").filter("n_nationkey > 0")
    return n.select("n_nationkey", F.array_join(media.time_entities(media.sample_seconds(F.col("n_nationkey"))), ",").alias("t"))


@query("b9_b10_b12_audio")
def b10(spark, sf):
    """A recording for each supplier: silence, its tone, silence, a tone of 880 Hz; analysed from its bytes."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("no"))
    r = media.analyze(_recordings(s), "audio", media.audio_analysis, "C1")
    return r.select("path", "sha256", "result.duration", "result.rate", F.size("result.segments").alias("n_segments"), F.size("result.mfcc_mean").alias("n_coefficients"))


def _recordings(numbers):
    """``path, length, content`` of a WAV file for each number."""

    def tones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, TONES):  # a recording is 160 kB, and batches have any number of rows
                some = batch.column(0).slice(first, TONES)
                files = [media.tone_fixture([(1, 0), (2, 200 + n % 60 * 10), (1, 0), (1, 880)]) for n in some.to_pylist()]
                yield pa.RecordBatch.from_arrays([some.cast(pa.int64()), pa.array(files, pa.binary())], ["no", "content"])

    dealt = numbers.select(F.col("no").cast("long").alias("no")).repartition(-(-numbers.count() // (8 * TONES)) or 1, "no")
    rows = dealt.mapInArrow(tones, "no long, content binary")
    rows = rows.select(F.concat(F.lit("tone-"), F.col("no").cast("string"), F.lit(".wav")).alias("path"), "content")
    return rows.select("path", F.octet_length("content").cast("long").alias("length"), "content")
