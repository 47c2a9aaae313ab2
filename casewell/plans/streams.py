"""Streaming detectors, run over the event table as a batch and as a finished stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewell.storage import new_path
from casewell.streaming import detectors

from .carriers import CALLS, CROSSINGS, calls, crossings
from .registry import query


@query("stream_daily_contacts", f"WITH {CALLS} SELECT entity, ts::DATE AS day, count(*)::BIGINT AS n FROM (SELECT entity_a AS entity, ts FROM calls UNION ALL SELECT entity_b, ts FROM calls) GROUP BY 1, 2")
def daily(spark, sf):
    return detectors.daily_contacts(calls(spark, sf))


@query("stream_follow", "SELECT a.event_id AS id1, b.event_id AS id2 FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 30 MINUTE")
def follow(spark, sf):
    c = crossings(spark, sf)
    a = c.filter("plaza = 'click'").select(F.col("crossing_id").alias("id1"), F.col("vehicle").alias("v1"), F.col("ts").alias("ts1"))
    b = c.filter("plaza = 'purchase'").select(F.col("crossing_id").alias("id2"), F.col("vehicle").alias("v2"), F.col("ts").alias("ts2"))
    return detectors.follow(a, b, ("v1", "v2"), ("ts1", "ts2"), 30).select("id1", "id2")


@query("stream_visits", f"""WITH {CROSSINGS}, g AS (SELECT vehicle, plaza, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 48 HOUR, true) AS new FROM crossings WINDOW w AS (PARTITION BY vehicle, plaza ORDER BY ts)),
  s AS (SELECT vehicle, plaza, ts, sum(new::INT) OVER (PARTITION BY vehicle, plaza ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS no FROM g)
  SELECT vehicle, plaza, min(ts)::TIMESTAMP AS first_ts, count(*)::BIGINT AS n_visits FROM s GROUP BY vehicle, plaza, no HAVING count(*) >= 3""")
def visits(spark, sf):
    return detectors.visits(crossings(spark, sf)).withColumn("first_ts", F.col("first_ts").cast("timestamp_ntz"))


@query("stream_convoys_finished", f"""WITH {CROSSINGS}, w AS (SELECT plaza, vehicle, time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes((unnest([0, 10]))::INT) AS start_ts FROM crossings)
  SELECT plaza, start_ts, array_to_string(list_sort(list_distinct(list(vehicle))), ',') AS vehicles FROM w GROUP BY 1, 2 HAVING count(DISTINCT vehicle) >= 2""")
def convoys(spark, sf):
    """The events as a finished stream, written and read back. A last row, far later and of no vehicle, lets the
    watermark pass all windows, so that none is held back when the stream ends."""
    source, out, state = new_path(spark, "source"), new_path(spark, "stream"), new_path(spark, "state")
    rows = crossings(spark, sf).select("plaza", "vehicle", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg((F.max("ts") + F.expr("interval 1 day")).alias("ts")).select(F.lit(None).cast("string").alias("plaza"), F.lit(None).cast("long").alias("vehicle"), "ts")
    rows.unionByName(end.filter("ts is not null")).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    detectors.run_once(detectors.convoys(stream), out, state)
    found = spark.read.schema("plaza string, start_ts timestamp, vehicles array<long>").parquet(out)
    return found.select("plaza", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.array_join(F.transform("vehicles", lambda v: v.cast("string")), ",").alias("vehicles"))
