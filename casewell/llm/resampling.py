"""Importance resampling towards a target distribution of hashed features.

Scoring explodes nothing: higher-order functions turn a text into the array of its features'
buckets, which is stored, and a document's weight is an aggregate over that array with
``element_at`` of one literal array that holds the gain of every bucket. The literal has
``BUCKETS`` entries whatever the corpus. What is shuffled are counts: of buckets, one row for each
bucket and task, and of scores, one row for each score and task. Scores are whole numbers
between bounds that follow from the logarithm, so their table is small at any size. It gives the
score at which the draw ends; rows below are done, and only those at or above it are sorted, by
ranges, for their rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.operators.frames import running

from .common import ascii_lower, scratch, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++"
BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
RANGE_ROWS = 100_000  # rows of the draw that one task sorts


def words(text: Column) -> Column:
    """Words of a text in lower case (A-Z only); null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bucket_array(found: Column, longest: int = 1, buckets: int = BUCKETS) -> Column:
    """The bucket of every run of 1 to ``longest`` words, repeats included."""

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(found, bucket)
        starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.array_join(F.slice(found, i, F.lit(n)), " ")))

    def bucket(feature: Column) -> Column:
        return (F.crc32(feature.cast("binary")) % buckets).cast("int")

    return F.concat(*[runs(n) for n in range(1, longest + 1)]) if longest > 1 else runs(1)


def _with_buckets(rows: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``rows`` with ``__words`` and ``__buckets`` in place of the text."""
    rows = rows.withColumn("__found", words(F.col(text_col)))
    return rows.withColumns({"__words": F.size("__found").cast("long"), "__buckets": bucket_array(F.col("__found"), longest, buckets)}).drop("__found", text_col)


def gains(ours: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` for every bucket, of two tables with ``__buckets``:
    ``floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))``, S and T the features of all rows."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.explode("__buckets").alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias(name))

    both = counted(ours, "s").unionByName(counted(target, "t"), allowMissingColumns=True).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    every = ours.sparkSession.range(0, buckets, 1, 1).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    totals = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    x = both.crossJoin(F.broadcast(totals))  # one row
    d = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = ((d["t"] + 1) * (d["all_s"] + buckets)) / ((d["s"] + 1) * (d["all_t"] + buckets))
    return x.select("bucket", F.floor(1000 * F.ln(ratio)).alias("gain"))


def _literal(spark: SparkSession, table: DataFrame, buckets: int) -> Column:
    """The gains as one literal array, by bucket. The driver gets ``buckets`` rows."""
    found = table.toArrow().to_pydict()
    gain = dict(zip(found["bucket"], found["gain"], strict=True))
    return F.split(F.lit(",".join(str(gain[i]) for i in range(buckets))), ",").cast("array<bigint>")


def _floored_mean() -> Column:
    """``__total`` over ``n_features`` in whole numbers, rounded down; no features have a total of zero."""
    return F.expr("(__total - pmod(__total, greatest(n_features, 1L))) div greatest(n_features, 1L)")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the id alone, so that reruns draw the same documents."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_text: str = "text",
    target_text: str = "text",
    longest: int = 1,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` for every row of ``docs``, drawn towards ``target``.

    Of the N rows with ``least_words`` words or more, the ``percent`` in a hundred (rounded down)
    of highest score have a rank from 1, ties to the smaller id, a null id last, then to fewer features;
    all others have a null rank. Rows that repeat an id are drawn each by its own, as they share its noise.
    A null text has no words: weight 0. A null id has the noise of an empty one. Very long texts are
    scored whole. An empty ``docs`` gives no rows, an empty ``target`` leaves its counts at zero.
    Columns besides id and text take no part, whatever their names."""
    with scratch(docs.sparkSession) as keep:
        docs, target = docs.select("doc_id", F.col(doc_text).alias("__text")), target.select(F.col(target_text).alias("__text"))
        return keep(stored(_ranked(_scored(docs, target, longest, buckets, seed, least_words), percent, range_rows), "resampled", narrow=True))


def _scored(docs: DataFrame, target: DataFrame, longest: int, buckets: int, seed: int, least_words: int) -> DataFrame:
    """``doc_id, n_features, weight, score, __may``, stored; ``__may`` if it has words enough to be drawn."""
    spark = docs.sparkSession
    ours = stored(_with_buckets(docs, "__text", longest, buckets), "buckets")
    theirs = _with_buckets(target, "__text", longest, buckets)
    gain = _literal(spark, gains(ours, theirs, buckets), buckets)
    total = F.aggregate("__buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.element_at(gain, b + 1))
    scored = ours.select("doc_id", "__words", F.size("__buckets").cast("long").alias("n_features"), total.alias("__total"))
    scored = scored.withColumn("weight", _floored_mean()).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return stored(scored.select("doc_id", "n_features", "weight", "score", (F.col("__words") >= least_words).alias("__may")), "scores")


def _ranked(scored: DataFrame, percent: int, range_rows: int) -> DataFrame:
    """``scored`` with ``rank`` in place of ``__may``: the score at which the draw ends by the counts of scores, then
    a rank for the rows at or above it."""
    may = scored.filter("__may").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    upto = running(may, [F.desc("score")], {"upto": F.col("n")}, range_rows)
    upto = stored(upto, "score-counts", narrow=True)
    wanted = (upto.agg(F.sum("n")).first()[0] or 0) * percent // 100
    last = upto.filter(F.col("upto") >= wanted).agg(F.max("score")).first()[0]
    none = F.lit(None).cast("long")
    if not wanted or last is None:
        return scored.drop("__may").withColumn("rank", none)
    above = F.col("__may") & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")]
    drawn = running(scored.filter(above), order, {"rank": F.lit(1).cast("long")}, range_rows)
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return scored.filter(~above).withColumn("rank", none).unionByName(drawn).drop("__may")
