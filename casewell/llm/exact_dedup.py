"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when their UTF-8 bytes are; null counts as empty. Nothing but keys and
digests is shuffled. Each round leaves a sieve, sized by the groups that still have two rows or
more, and the next, dearer digest is computed map-side only for rows that pass it. A sieve's
false hit costs one digest and ends as a group of one; where there are more surviving groups than
the largest sieve tells apart, more rows are digested, in the scan that reads them anyway, and
still no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sieve, discard, drop_keys, stored

PREFIX_BYTES = 64


def progressive_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX_BYTES, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, len, sha, row_tag``.

    Of equal texts the largest id stays; a null id is smaller than any other, and among
    repeated rows of one id exactly one is kept. An empty table gives no rows. Extra columns
    of ``docs`` are ignored; ``carry`` names expressions over ``docs`` to keep beside the
    result. ``sha`` (SHA-256, hex) is null for rows whose length and prefix are unique.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("__bytes"), F.octet_length(text).cast("long").alias("len"), *[c.alias(n) for n, c in carry.items()]
    )
    shared_by = lambda rows, *by: stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*by), "shared", narrow=True)
    lengths = shared_by(base.select("len"), "len")
    by_length = Sieve(lengths, ["len"])
    ph = F.xxhash64(F.substring("__bytes", 1, prefix))
    shared = by_length.mark(base.select("len", "__bytes"), [F.col("len")], "__again").filter("__again").select("len", ph.alias("ph"))
    prefixes = shared_by(shared, "len", "ph")
    by_prefix = Sieve(prefixes, ["len", "ph"])
    marked = by_prefix.mark(base.withColumn("__ph", ph), [F.col("len"), F.col("__ph")], "__again")
    rows = stored(
        marked.select(
            "doc_id",
            F.monotonically_increasing_id().alias("row_tag"),
            "len",
            F.when(F.col("__again"), F.sha2("__bytes", 256)).alias("sha"),
            *carry,
        ),
        "dedup",
    )
    discard(lengths, prefixes)
    some = rows.filter("sha is not null")
    groups = (
        some.groupBy("len", "sha")
        .agg(F.max(F.struct("doc_id", "row_tag")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    groups = stored(groups, "groups", narrow=True)  # so that both sides of the join are plain shuffles, which a hot group can be split in
    alone = F.col("top").isNull()
    out = some.join(groups, ["len", "sha"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("top.row_tag") == F.col("row_tag"))).alias("kept"),
        "len",
        "sha",
        "row_tag",
        *carry,
    )
    one = rows.filter("sha is null").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "len",
        "sha",
        "row_tag",
        *carry,
    )
    return out.unionByName(one)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) with one row of each group of equal texts, as ``progressive_dedup``
    chooses it. Rows that repeat id and text of the kept row go as well: those few keys are
    deduplicated exactly, and no other text is shuffled. Null and empty texts are equal, a null id
    is smaller than any other, very long texts are read whole, and an empty table gives no rows;
    no column of ``docs`` is changed, whatever its name."""
    judged = stored(
        progressive_dedup(docs, id_col, text_col).select("doc_id", "kept", "keep_id", "sha", "group_size").filter("group_size > 1"), "copies"
    )
    sha = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    key = {"doc_id": F.col(id_col), "sha": sha}
    same_id = judged.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    same_id = stored(same_id.filter("not kept or n > 1"), "gone", narrow=True)
    rest = drop_keys(docs, same_id.select("doc_id", "sha"), key)
    again = stored(same_id.filter("kept").select(F.col("doc_id").alias("__g_id"), F.col("sha").alias("__g_sha")), "again", narrow=True)
    discard(judged)
    if again.isEmpty():
        return rest
    marked = Sieve(again, ["__g_id", "__g_sha"]).mark(docs, [F.col(id_col), sha], "__maybe").filter("__maybe")
    one = (
        marked.withColumn("__sha", sha)
        .join(again, F.col(id_col).eqNullSafe(F.col("__g_id")) & (F.col("__sha") == F.col("__g_sha")), "left_semi")
        .dropDuplicates([id_col, "__sha"])
    )
    return rest.unionByName(one.select(docs.columns))
