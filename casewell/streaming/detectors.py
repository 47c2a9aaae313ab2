"""Detectors over streams: an extension, with the batch detectors' thresholds.

Sources are streaming DataFrames whose event time is a timestamp with zone; the watermark bounds
the state. Every function also takes a batch DataFrame, which is how they are tested.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How late an event may come.
LATE = "1 hour"


def timed(rows: DataFrame, ts: str = "ts", late: str = LATE) -> DataFrame:
    """Event time as a timestamp with zone, and the watermark on it."""
    out = rows.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, late) if out.isStreaming else out


def daily_contacts(calls: DataFrame) -> DataFrame:
    """``entity, day, n`` per tumbling day; complete once the watermark passes the day."""
    t = timed(calls)
    sides = t.select(F.explode(F.array("entity_a", "entity_b")).alias("entity"), "ts")
    counted = sides.groupBy("entity", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("entity", F.to_date(F.col("window.start")).alias("day"), "n")


def convoys(crossings: DataFrame, minutes: int = 20) -> DataFrame:
    """Two vehicles or more at a plaza in a sliding window."""
    t = timed(crossings)
    w = F.window("ts", f"{minutes} minutes", f"{minutes // 2} minutes")
    seen = t.groupBy("plaza", w).agg(F.array_sort(F.collect_set("vehicle")).alias("vehicles"))
    return seen.filter(F.size("vehicles") >= 2).select("plaza", F.col("window.start").alias("start_ts"), "vehicles")


def follow(first: DataFrame, second: DataFrame, keys: tuple[str, str], ts: tuple[str, str], minutes: int) -> DataFrame:
    """Rows of ``second`` within ``minutes`` after rows of ``first`` with an equal key: an interval
    join, whose state both watermarks bound."""
    a, b = timed(first, ts[0]), timed(second, ts[1])
    later = (F.col(ts[1]) > F.col(ts[0])) & (F.col(ts[1]) <= F.col(ts[0]) + F.expr(f"interval {minutes} minutes"))
    return a.join(b, (F.col(keys[0]) == F.col(keys[1])) & later)


def visits(crossings: DataFrame, hours: int = 48, least: int = 3) -> DataFrame:
    """Sessions of one vehicle at one plaza without a gap of ``hours``, with ``least`` visits."""
    t = timed(crossings)
    s = t.groupBy("vehicle", "plaza", F.session_window("ts", f"{hours} hours")).agg(F.count(F.lit(1)).alias("n_visits"))
    return s.filter(F.col("n_visits") >= least).select("vehicle", "plaza", F.col("session_window.start").alias("first_ts"), "n_visits")


def run_once(result: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, write Parquet, stop."""
    q = result.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    q.awaitTermination()
