"""One timeline of cases, calls, tolls, payments and report lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import forward_fill

COLUMNS = ("case_id", "ts", "event_type", "person", "location", "description", "source", "risk_score")
CALL_LIMIT = 100  # calls that a timeline shows, in order of arrival


def events(rows: DataFrame, kind: str, source: str, **columns: Column) -> DataFrame:
    """Rows as events; columns that are not given are null, rows without a time leave."""
    values = {"event_type": F.lit(kind), "source": F.lit(source)} | columns
    out = [values.get(c, F.lit(None).cast("string")).alias(c) for c in COLUMNS]
    return rows.select(*out).filter("ts is not null")


def call_risk(duration: Column) -> Column:
    return F.when(duration < 10, 65).otherwise(30)


def toll_risk(mismatch: Column) -> Column:
    return F.when(mismatch, 95).otherwise(40)


def merge(*parts: DataFrame) -> DataFrame:
    """All events with ``date, time, weekday``, in order of time."""
    all_ = reduce(DataFrame.unionByName, parts)
    day = {"date": F.date_format("ts", "yyyy-MM-dd"), "time": F.date_format("ts", "HH:mm"), "weekday": F.date_format("ts", "EEEE")}
    return all_.withColumns(day).orderBy("ts", "event_type", "person", "description")


def first_calls(calls: DataFrame, order: str, n: int | None = CALL_LIMIT) -> DataFrame:
    return calls.orderBy(order).limit(n) if n else calls


def overview(timeline: DataFrame) -> DataFrame:
    """Per case: events, persons, most frequent place, greatest risk."""
    from .tables import mode

    sums = timeline.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_distinct("person").alias("n_persons"), F.max("risk_score").alias("max_risk"))
    return sums.join(mode(timeline, "case_id", "location").drop("n"), "case_id", "left")


def report_lines(lines: DataFrame, header: Column, finding: Column) -> DataFrame:
    """``line_no, text`` of a report to ``case_id, finding``: a header line names the case of the
    findings up to the next header."""
    marked = lines.withColumn("case_id", header).withColumn("finding", finding)
    return forward_fill(marked, "case_id", "line_no").filter("finding is not null").select("line_no", "case_id", "finding")
