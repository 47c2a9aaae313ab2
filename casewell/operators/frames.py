"""Time-range joins and windows cut into time buckets, so that no key is a single task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import micros
from casewell.storage import stored

SECOND = 1_000_000
PART_ROWS = 500_000  # rows of a range that one task sorts


def follow_join(first: DataFrame, second: DataFrame, on: tuple[str, str], ts: tuple[str, str], seconds: int, inclusive_start: bool = False) -> DataFrame:
    """Rows of ``first`` and ``second`` with equal keys and ``t1 < t2 <= t1 + seconds``.

    Times are cut into buckets as wide as the range: a row of ``first`` looks in its own and the
    next bucket only, so the equi-join's groups are a key's rows of two buckets.
    """
    width = seconds * SECOND
    a = first.withColumn("__t1", micros(F.col(ts[0])))
    b = second.withColumn("__t2", micros(F.col(ts[1]))).withColumn("__at", F.floor(F.col("__t2") / width))
    at = F.floor(F.col("__t1") / width)
    a = a.withColumn("__at1", F.explode(F.array(at, at + 1)))
    after = F.col("__t2") >= F.col("__t1") if inclusive_start else F.col("__t2") > F.col("__t1")
    near = after & (F.col("__t2") <= F.col("__t1") + width)
    return a.join(b, (a[on[0]] == b[on[1]]) & (a["__at1"] == b["__at"]) & near).drop("__t1", "__t2", "__at", "__at1")


def forward_frame(rows: DataFrame, keys: list[str], ts: str, seconds: int, aggregates: dict[str, Callable[[], Column]]) -> DataFrame:
    """Each row with ``aggregates`` over the key's rows from its time to ``seconds`` later, both ends
    included. Every row is also handed to the bucket before, so that a window's partition is a
    key's rows of two buckets, not all of them."""
    width = seconds * SECOND
    t = micros(F.col(ts))
    at = F.floor(F.col("__t") / width)
    both = rows.withColumn("__t", t).withColumn("__at", F.explode(F.array(at, at - 1)))
    frame = Window.partitionBy(*keys, "__at").orderBy("__t").rangeBetween(0, width)
    for name, make in aggregates.items():
        both = both.withColumn(name, make().over(frame))
    return both.filter(F.col("__at") == at).drop("__t", "__at")


def keep_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_least(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, none of a null key. Rows are thinned to ``n`` in each task before they are
    shuffled, so a hot key is many tasks and little in the last one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.dropna(subset=keys).withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def in_ranges(rows: DataFrame, order: list, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``__part``: ranges of about ``part_rows`` rows along ``order``, numbered along it.
    What follows can work in every range by itself and hand a row a range on."""
    rows = stored(rows, "rows")
    parts = -(-rows.count() // part_rows)
    if parts <= 1:
        return rows.withColumn("__part", F.lit(0))
    return stored(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: list, sums: dict[str, Column], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with the running sums ``sums`` (name to summand) along the whole table's ``order``, the
    row itself included: sums within each range, and the total of the ranges before it."""
    placed = in_ranges(rows, order, part_rows)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__part").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    offsets = totals.select(F.col("__part").alias("__at"), *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    out = out.join(F.broadcast(offsets), F.col("__part") == F.col("__at"))  # a row for each range
    return out.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums}).drop("__part", "__at", *[f"__{n}" for n in sums])


def edge_totals(placed: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """``keys, __part`` and ``totals`` of the first and the last key of each range of ``placed`` (as of ``in_ranges`` along
    the keys): two rows for each range at most. Other keys lie within one range, so whatever goes on
    from a range into the next is here, and no key is one task."""
    key = F.struct(*keys)
    ends = placed.groupBy("__part").agg(F.min(key).alias("__lo"), F.max(key).alias("__hi"))
    near = placed.join(F.broadcast(ends), "__part").filter(key.eqNullSafe(F.col("__lo")) | key.eqNullSafe(F.col("__hi")))  # a row for each range
    return near.groupBy(*keys, "__part").agg(*[c.alias(n) for n, c in totals.items()])


def hand_on(placed: DataFrame, keys: list[str], handed: DataFrame) -> DataFrame:
    """``placed`` with the columns of ``handed`` (``keys, __part`` and more; two rows for each range at most)
    for the rows of that key and range, null for others."""
    named = handed.select(F.struct(*keys).alias("__for"), F.col("__part").alias("__at"), *[c for c in handed.columns if c not in (*keys, "__part")])
    same = (F.col("__part") == F.col("__at")) & F.struct(*keys).eqNullSafe(F.col("__for"))
    return placed.join(F.broadcast(named), same, "left").drop("__for", "__at")


def forward_fill(rows: DataFrame, column: str, order: str, partition: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``column`` with its last value that is not null, in ``order``. Without a partition the rows are cut
    into ranges, and each range takes over the last value of those before it."""
    upto = lambda w: w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    if partition:
        return rows.withColumn(column, F.last(column, ignorenulls=True).over(upto(Window.partitionBy(partition))))
    placed = in_ranges(rows, [order], part_rows)
    last = placed.groupBy("__part").agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order))).alias("__last"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(F.col("__part").alias("__at"), F.last("__last", ignorenulls=True).over(before).alias("__last"))
    own = F.last(column, ignorenulls=True).over(upto(Window.partitionBy("__part")))
    out = placed.withColumn(column, own).join(F.broadcast(handed), F.col("__part") == F.col("__at"))  # a row for each range
    return out.withColumn(column, F.coalesce(column, "__last")).drop("__part", "__at", "__last")


def numbered(rows: DataFrame, name: str, pattern: str, order: list) -> DataFrame:
    """Sequential ids like ``ALT-00001`` along ``order``, for results of any length."""
    return running(rows, order, {name: F.lit(1)}).withColumn(name, F.format_string(pattern, F.col(name)))
