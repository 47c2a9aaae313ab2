"""Operators on single tables: filters, reshaping, lookups, counts, limits, set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.text import clean_na
from casewell.storage import stored

from .frames import PART_ROWS, edge_totals, hand_on, in_ranges


def case_slice(rows: DataFrame, key: str, case_id) -> DataFrame:
    """Rows of one case, compared as text."""
    return rows.filter(F.col(key).cast("string") == F.lit(str(case_id)))


def with_defaults(rows: DataFrame, defaults: dict) -> DataFrame:
    """Columns that are missing, with their default value."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def find_column(rows: DataFrame, *candidates: str) -> str | None:
    """The first candidate that names a column, whatever its case, blanks and underscores."""
    plain = lambda s: "".join(ch for ch in s.lower() if ch not in " _")
    known = {plain(c): c for c in reversed(rows.columns)}
    return next((known[plain(c)] for c in candidates if plain(c) in known), None)


def unpivot_roles(rows: DataFrame, key: str, roles: dict[str, str], value: str = "name") -> DataFrame:
    """Wide to long: ``key, role, value`` for a column per role, missing values left out."""
    pairs = ", ".join(f"'{r}', cast(`{c}` as string)" for r, c in roles.items())
    long = rows.select(key, F.expr(f"stack({len(roles)}, {pairs}) as (role, {value})"))
    return long.withColumn(value, clean_na(F.col(value))).filter(F.col(value).isNotNull())


def search(rows: DataFrame, text: str = "", columns: list[str] | None = None, day: str | None = None, start=None, end=None) -> DataFrame:
    """Rows of which any column contains the text in any case, and whose day lies within inclusive
    bounds; a day that cannot be read fails a bound."""
    if text:
        parts = [F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(text.lower())), F.lit(False)) for c in columns or rows.columns]
        rows = rows.filter(reduce(Column.__or__, parts))
    if day and (start or end):
        d = F.col(day).cast("string").substr(1, 10).try_cast("date")
        rows = rows.filter(d.isNotNull())
        rows = rows.filter(d >= F.lit(start).cast("date")) if start else rows
        rows = rows.filter(d <= F.lit(end).cast("date")) if end else rows
    return rows


def snippet(text: Column, needle: str, before: int = 200, after: int = 4000) -> Column:
    """Text around the first occurrence, null without one."""
    at = F.instr(text, needle)
    start = F.greatest(at - before, F.lit(1))
    return F.when(at > 0, F.substring(text, start, at + after - start))


def direction(rows: DataFrame, kind: str = "kind", own: str = "own", other: str = "other") -> DataFrame:
    """``sender, receiver`` of a statement line: a debit goes from the own side to the other."""
    debit = F.upper(kind) == "DR"
    return rows.withColumns({"sender": F.when(debit, F.col(own)).otherwise(F.col(other)), "receiver": F.when(debit, F.col(other)).otherwise(F.col(own))})


def counts(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def mode(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Most frequent value per group, the least one on ties; nulls do not count."""
    n = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col(value).alias("v")))
    return n.groupBy(by).agg(best.alias("b")).select(by, F.col("b.v").alias(value), (-F.col("b.n")).alias("n"))


def share_of(rows: DataFrame, condition: Column) -> DataFrame:
    """One row: percentage of rows for which the condition holds, to one digit; 0 for no rows."""
    return rows.agg(F.round(100.0 * F.count_if(condition) / F.greatest(F.count(F.lit(1)), F.lit(1)), 1).alias("percent"))


def share_of_largest(counted: DataFrame, value: str) -> DataFrame:
    """Each count as a percentage of the largest."""
    top = counted.agg(F.max(value)).scalar()
    return counted.withColumn("percent", F.round(F.col(value) / top * 100, 2))


def complement(part: Column, whole: Column) -> Column:
    return F.greatest(whole - part, F.lit(0))


def running_balance(rows: DataFrame, key: str, order: str, amount: str, start: float, floor: float, part_rows: int = PART_ROWS) -> DataFrame:
    """``key, order, balance``: after each signed amount, never below the floor, in decimals.

    With the running sum S of the amounts it is ``S + max(start, max of floor - S so far)``. A stretch of
    an account is the pair of its sum and its greatest lift ``floor - S``, and pairs compose: the lift of
    a stretch counts from its beginning, so after others it is less by their sum. The table is cut
    into ranges along key and order, each range is scanned by itself, and an account that
    goes on takes over the pair of the ranges before it. An account of any size is many tasks.
    A null key is an account of its own; a null amount moves nothing."""
    number = "decimal(28,8)"
    placed = in_ranges(rows.select(key, order, F.coalesce(F.col(amount).cast(number), F.lit(0).cast(number)).alias("__amount")), [key, order], part_rows)
    along = Window.partitionBy("__part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = placed.withColumn("__sum", F.sum("__amount").over(along))
    sums = sums.withColumn("__lift", F.max(F.lit(floor).cast(number) - F.col("__sum")).over(along))
    before = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pairs = edge_totals(sums, [key], {"__total": F.sum("__amount"), "__most": F.max("__lift")}).withColumn("__sum_before", F.sum("__total").over(before))
    pairs = pairs.withColumn("__lift_before", F.max(F.col("__most") - F.coalesce("__sum_before", F.lit(0).cast(number))).over(before))
    handed = stored(pairs.filter("__sum_before is not null").select(key, "__part", "__sum_before", "__lift_before"), "handed", narrow=True)
    out = hand_on(sums, [key], handed)
    gone = F.coalesce("__sum_before", F.lit(0).cast(number))
    lift = F.greatest(F.lit(start).cast(number), F.col("__lift_before"), F.col("__lift") - gone)
    return out.select(key, order, F.round(F.col("__sum") + gone + lift, 2).cast("double").alias("balance"))


def last_of_group(rows: DataFrame, key: str, order: str, flag: str = "flagged", part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``flag`` on one row of each key, the last along ``order``; a null key is a key. Ranges are
    looked at by themselves, and a key that goes on in the next range has no last row in this one."""
    placed = in_ranges(rows, [key, order], part_rows)
    back = F.row_number().over(Window.partitionBy("__part", key).orderBy(F.desc(order)))
    later = F.max("__part").over(Window.partitionBy(key)) > F.col("__part")
    going_on = edge_totals(placed, [key], {"__n": F.count(F.lit(1))}).withColumn("__goes_on", later).filter("__goes_on").drop("__n")
    out = hand_on(placed.withColumn("__back", back), [key], stored(going_on, "handed", narrow=True))
    return out.withColumn(flag, (F.col("__back") == 1) & F.col("__goes_on").isNull()).drop("__back", "__goes_on", "__part")


def joined_list(rows: DataFrame, by: str, value: str, separator: str = "; ", empty: str = "NONE") -> DataFrame:
    """Distinct values of a group as one sorted text."""
    text = F.array_join(F.array_sort(F.collect_set(value)), separator)
    return rows.groupBy(by).agg(F.when(text == "", empty).otherwise(text).alias(value))


def with_lookup(rows: DataFrame, table: DataFrame, key: str, value: str, default, small: bool = False) -> DataFrame:
    """Left join on a key, the default where nothing is found. ``small`` only for fixed tables."""
    t = table.select(key, value)
    return rows.join(F.broadcast(t) if small else t, key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def first_child(parents: DataFrame, children: DataFrame, key: str, order: list) -> DataFrame:
    """Each parent with its first child, if any."""
    w = Window.partitionBy(key).orderBy(*order)
    return parents.join(children.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n"), key, "left")


def top(rows: DataFrame, n: int, order: list) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def top_per_group(rows: DataFrame, n: int, by: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def cycled(index: Column, *values) -> Column:
    """The value whose turn it is."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))
