"""Domain rules, detected from the tables. Findings carry ``rule`` and ``severity``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewell.functions.values import gap_minutes, micros, ratio

from .frames import follow_join


def _finding(rows: DataFrame, number: int, severity: str, id_col: str = "id") -> DataFrame:
    return rows.select(F.col(id_col).alias("id"), F.lit(f"RULE {number}").alias("rule"), F.lit(severity).alias("severity"), "person")


def cloned_plates(tolls: DataFrame, cameras: DataFrame) -> DataFrame:
    """Rule 1: the camera's plate differs from the tag's at the same ``crossing``."""
    return _finding(tolls.join(cameras, "crossing").filter("captured <> plate"), 1, "CRITICAL", "crossing")


def alibi_breaches(seen: DataFrame, towers: DataFrame, minutes: int = 30) -> DataFrame:
    """Rule 2: a person's phone is at another place within ``minutes`` after the person was seen."""
    met = follow_join(seen, towers, ("person", "caller"), ("ts", "call_ts"), minutes * 60).filter("tower <> place")
    return _finding(met.dropDuplicates(["id"]), 2, "HIGH")


def mobile_discrepancies(licences: DataFrame, registered: DataFrame) -> DataFrame:
    """Rule 4: licence and registration of a person name different phones."""
    both = licences.join(registered.withColumnRenamed("phone", "other"), "person").filter("phone <> other")
    return _finding(both.withColumn("id", F.col("person")), 4, "MEDIUM")


def structuring(payments: DataFrame, low: float = 41_000, high: float = 49_000, least: int = 3) -> DataFrame:
    """Rule 5: ``least`` payments of a person between two amounts on one day."""
    some = payments.filter(F.col("amount").between(low, high)).groupBy("person", F.to_date("ts").alias("day"))
    out = some.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("amount"), 2).alias("total")).filter(F.col("n") >= least)
    return out.withColumns({"rule": F.lit("RULE 5"), "severity": F.lit("HIGH")})


def rapid_layering(moves: DataFrame, low: int = 2, high: int = 12) -> DataFrame:
    """Rule 6: a credit followed by a debit of the same person after ``low`` to ``high`` minutes."""
    credit = moves.filter("kind = 'CR'").select(F.col("id").alias("credit_id"), "person", F.col("ts").alias("ts1"))
    debit = moves.filter("kind = 'DR'").select(F.col("id").alias("debit_id"), F.col("person").alias("person2"), F.col("ts").alias("ts2"))
    met = follow_join(credit, debit, ("person", "person2"), ("ts1", "ts2"), high * 60)
    met = met.filter(micros(F.col("ts2")) - micros(F.col("ts1")) >= low * 60_000_000)
    return met.select("credit_id", "debit_id", "person", gap_minutes(F.col("ts1"), F.col("ts2")).alias("gap_min"))


def proxy_payments(payments: DataFrame, proxies: DataFrame) -> DataFrame:
    """Rule 7: payments from a listed address."""
    return _finding(payments.join(proxies, "ip", "left_semi"), 7, "HIGH")


def crypto_payouts(deposits: DataFrame, payouts: DataFrame, minutes: int = 75) -> DataFrame:
    """Rule 8: a payout of the same person within ``minutes`` after a deposit."""
    out = payouts.select("payout_id", F.col("person").alias("person2"), F.col("ts").alias("ts2"))
    met = follow_join(deposits.withColumnRenamed("ts", "ts1"), out, ("person", "person2"), ("ts1", "ts2"), minutes * 60)
    return met.select("deposit_id", "payout_id", "person", gap_minutes(F.col("ts1"), F.col("ts2")).alias("gap_min"))


def income_mismatch(totals: DataFrame, most: float = 15.0) -> DataFrame:
    """Rule 9: large spending over income above ``most``; without income the ratio is zero."""
    r = ratio(F.col("large_spending"), F.nullif("income", F.lit(0.0)))
    out = totals.withColumn("__r", r).filter(F.col("__r") > most)
    return out.select("person", F.round("__r", 2).alias("ratio"), F.lit("RULE 9").alias("rule"), F.lit("HIGH").alias("severity"))


def nominee_directors(filings: DataFrame, most: int = 8, income: float = 200_000) -> DataFrame:
    """Rule 10: over ``most`` directorships on a small declared income."""
    out = filings.groupBy("person", "income").agg(F.count(F.lit(1)).alias("directorships")).filter((F.col("directorships") > most) & (F.col("income") < income))
    return out.select("person", "directorships", "income", F.lit("RULE 10").alias("rule"), F.lit("CRITICAL").alias("severity"))


def fake_bills(bills: DataFrame) -> DataFrame:
    """Rule 11: transport bills that the forensic flag calls fake."""
    return _finding(bills.filter(F.upper("forensic_flag").contains("FAKE")), 11, "HIGH")


def shared_addresses(filings: DataFrame) -> DataFrame:
    """Rule 12: one registered address of several entities."""
    out = filings.groupBy("address").agg(F.count_distinct("entity").alias("n_entities")).filter("n_entities > 1")
    return out.withColumn("rule", F.lit("RULE 12"))


def all_anomalies(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)
