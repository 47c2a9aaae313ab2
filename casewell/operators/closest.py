"""The closest of a table of names for each of a table of values, by the ratio of a sequence matcher."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.functions.similarity import match_ratio
from casewell.storage import scratch, stored


def _tokens(text: Column) -> Column:
    """The characters of a text, each with its number among equal ones, so that what two texts have in
    common is the overlap of two sets."""
    letters = F.array_sort(F.filter(F.split(text, ""), lambda x: x != ""))
    return F.transform(letters, lambda x, i: F.concat(x, (i - F.array_position(letters, x) + 1).cast("string")))


def _with_prefix(texts: DataFrame, rarity: DataFrame, cutoff: float) -> DataFrame:
    """``text, n, tokens, token``: a row for each token of a text's prefix, its rarest tokens first. A text within
    the cutoff has ``cutoff / 2`` of both lengths in common with it, at least ``cutoff * n / (2 - cutoff)`` tokens,
    so all but that many, and one more, are enough to meet it."""
    ranked = texts.select("text", F.explode("tokens").alias("token")).join(rarity, "token", "left")
    ranked = ranked.groupBy("text").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "token"))).alias("ranked"))
    least = F.greatest(F.ceil(F.col("n") * (cutoff / (2 - cutoff)) - 1e-9), F.lit(1))
    prefix = F.slice("ranked", F.lit(1), (F.col("n") - least + 1).cast("int"))
    return texts.join(ranked, "text").select("text", "n", "tokens", F.explode(F.transform(prefix, lambda x: x["token"])).alias("token"))


def closest_names(values: DataFrame, choices: DataFrame, value: str = "value", choice: str = "choice", cutoff: float = 0.55) -> DataFrame:
    """``value, best, ratio`` for each distinct value that has a choice of at least the cutoff: the choice of
    the greatest ratio, of equal ones the last in order of characters. Both are compared in lower case,
    values also without outer blanks; of choices that differ in case alone the greatest is returned. Null is
    compared as empty, and an empty text is close to an empty one alone.

    The ratio is twice the characters matched over both lengths. The matcher never matches more than the
    characters that two texts have in common, so pairs whose lengths or common characters cannot reach the
    cutoff are never made: each text is filed under the rarest of its characters, as many as
    the cutoff makes necessary, and meets only those it shares one with. Of what is left the overlap
    is counted exactly, and the matcher runs for pairs that pass. Neither table is collected."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    with scratch(values.sparkSession) as keep:
        named = values.select(F.col(value).alias("value"), F.trim(low(value)).alias("text"))
        v = stored(named.select("text").distinct().withColumn("tokens", _tokens(F.col("text"))).withColumn("n", F.size("tokens")), "values")
        c = choices.groupBy(low(choice).alias("text")).agg(F.max(F.coalesce(choice, F.lit(""))).alias("choice"))
        c = stored(c.withColumn("tokens", _tokens(F.col("text"))).withColumn("n", F.size("tokens")), "choices")
        rarity = stored(c.select(F.explode("tokens").alias("token")).groupBy("token").count(), "rarity", narrow=True)
        left = _with_prefix(v, rarity, cutoff)
        right = _with_prefix(c.drop("choice"), rarity, cutoff).select(F.col("text").alias("other"), F.col("n").alias("m"), F.col("tokens").alias("theirs"), "token")
        total = F.col("n") + F.col("m")
        near = (2 * F.least("n", "m") >= cutoff * total - 1e-9) & (2 * F.size(F.array_intersect("tokens", "theirs")) >= cutoff * total - 1e-9)
        pairs = stored(left, "prefixes").join(stored(right, "prefixes"), "token").filter(near & (F.col("text") != F.col("other"))).select("text", "other").distinct()
        rated = stored(pairs, "pairs", narrow=True).withColumn("ratio", match_ratio("other", "text")).filter(F.col("ratio") >= cutoff)
        same = v.select("text").join(c.select("text"), "text").select("text", F.col("text").alias("other"), F.lit(1.0).alias("ratio"))
        best = rated.unionByName(same).groupBy("text").agg(F.max(F.struct("ratio", "other")).alias("best"))
        out = best.select("text", "best.*").join(c.select(F.col("text").alias("other"), "choice"), "other")
        out = named.distinct().join(out, "text").select("value", F.col("choice").alias("best"), "ratio")
        return keep(stored(out, "closest", narrow=True))
