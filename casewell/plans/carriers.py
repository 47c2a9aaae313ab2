"""The case tables as the star-schema test tables carry them: same roles, other columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.storage import table


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Events as calls: ``call_id, entity_a, entity_b, ts, case_id, duration_s``."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("call_id"),
        F.col("user_id").alias("entity_a"),
        ((F.col("event_id") * 31 + 7) % 150).alias("entity_b"),
        "ts",
        F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("case_id"),
        F.floor(F.abs("value")).cast("long").alias("duration_s"),
    )


def payments(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as payments: ``payment_id, sender, amount, day``."""
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("sender"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").alias("ts"))


def crossings(spark: SparkSession, sf: str) -> DataFrame:
    """Events as toll crossings: ``crossing_id, vehicle, plaza, ts, tag, case_id, cross_match``."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("crossing_id"),
        F.col("user_id").alias("vehicle"),
        F.col("event_type").alias("plaza"),
        "ts",
        F.concat(F.lit("TAG"), F.col("user_id").cast("string")).alias("tag"),
        F.concat(F.lit("C"), (F.col("user_id") % 10).cast("string")).alias("case_id"),
        F.when(F.col("value") >= 150, "mismatch").otherwise("MATCH").alias("cross_match"),
    )


CALLS = """calls AS (SELECT event_id AS call_id, user_id AS entity_a, (event_id * 31 + 7) % 150 AS entity_b, ts,
  'C' || (user_id % 10)::VARCHAR AS case_id, floor(abs(value))::BIGINT AS duration_s FROM events)"""
CROSSINGS = """crossings AS (SELECT event_id AS crossing_id, user_id AS vehicle, event_type AS plaza, ts, 'TAG' || user_id::VARCHAR AS tag,
  'C' || (user_id % 10)::VARCHAR AS case_id, CASE WHEN value >= 150 THEN 'mismatch' ELSE 'MATCH' END AS cross_match FROM events)"""


def trades(spark: SparkSession, sf: str) -> DataFrame:
    """The graph of all orders as edges ``src < dst`` of customers and suppliers; keys are made distinct before they are named."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    joined = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = joined.select("o_custkey", "l_suppkey").distinct()
    return keys.select(F.concat(F.lit("CUST::"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("SUPP::"), F.col("l_suppkey").cast("string")).alias("dst"))


TRADES = """trades AS (SELECT DISTINCT 'CUST::' || o_custkey::VARCHAR AS src, 'SUPP::' || l_suppkey::VARCHAR AS dst
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def parts_as_people(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as person records: two-word names, types as districts, brand and size as a vehicle."""
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("record_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_partkey") % 3 == 0, F.format_string("%.2f", "p_retailprice")).alias("phone"),
        F.col("p_type").alias("address"),
        F.array(F.concat_ws("-", "p_brand", F.col("p_size").cast("string"))).alias("vehicles"),
        F.concat(F.lit("C"), (F.col("p_partkey") % 7).cast("string")).alias("case_id"),
    )
