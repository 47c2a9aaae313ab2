"""The answers of the service, put together from the operators: one DataFrame each, no server.

Rows of any table may be many; nothing is collected. Lists that a page shows whole are rows here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import both_ways, cross_case_count
from .tables import share_of_largest, with_lookup


def overview(cases: DataFrame, people: DataFrame, vehicles: DataFrame, alerts: DataFrame, owned: DataFrame) -> DataFrame:
    """One row of numbers: ``n_cases, n_people, n_vehicles`` (distinct ``case_id``, ``name``, ``vehicle``),
    ``n_alerts``, ``n_urgent`` (critical or high), ``n_cross_case`` links between persons of ``owned`` (``person, identifier,
    kind, case_ids``), which are counted without their pairs. Empty tables count 0."""
    count = lambda rows, c, name: rows.agg(F.count_distinct(c).alias(name)).scalar()
    urgent = F.count_if(F.col("severity").isin("CRITICAL", "HIGH"))
    return alerts.agg(F.count(F.lit(1)).alias("n_alerts"), urgent.alias("n_urgent")).select(
        count(cases, "case_id", "n").alias("n_cases"),
        count(people, "name", "n").alias("n_people"),
        count(vehicles, "vehicle", "n").alias("n_vehicles"),
        "n_alerts",
        "n_urgent",
        cross_case_count(owned).scalar().alias("n_cross_case"),
    )


def network(edges: DataFrame) -> DataFrame:
    """``element, id, type, label, other, weight``: a row per node and a row per edge of ``src, dst, weight``."""
    node = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").cast("double").alias("weight"))
    kind, label = F.split_part("id", F.lit("::"), F.lit(1)), F.regexp_replace("id", "^[A-Z]+::", "")
    nodes = node.select(F.lit("node").alias("element"), "id", kind.alias("type"), label.alias("label"), F.lit(None).cast("string").alias("other"), "weight")
    lines = edges.select(F.lit("edge").alias("element"), F.col("src").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("label"), F.col("dst").alias("other"), F.col("weight").cast("double").alias("weight"))
    return nodes.unionByName(lines)


def timeline_of(events: DataFrame, case_id) -> DataFrame:
    """Events of one case, in order of time."""
    return events.filter(F.col("case_id").cast("string") == str(case_id)).orderBy("ts", "event_type", "person")


def alerts_of(alerts: DataFrame, severity: str | None = None) -> DataFrame:
    """Alerts, of one severity if it is named (in any case)."""
    return alerts.filter(F.col("severity") == severity.upper()) if severity else alerts


def persons(people: DataFrame, degrees: DataFrame, role: str | None = None) -> DataFrame:
    """``people`` (``id, name, role, case_id``), of one role if it is named, with ``n_neighbours``, 0 for
    those outside the graph."""
    rows = people.filter(F.lower("role") == role.lower()) if role else people
    return with_lookup(rows, degrees, "id", "n_neighbours", 0)


def analytics(rows: DataFrame, category: Column) -> DataFrame:
    """``category, n, percent``: numbers of rows, and their percentage of the largest."""
    return share_of_largest(rows.groupBy(category.alias("category")).agg(F.count(F.lit(1)).alias("n")), "n")


def districts(cases: DataFrame) -> DataFrame:
    """Distinct filled districts."""
    return cases.filter(F.trim("district") != "").select(F.trim("district").alias("district")).distinct()


def police_stations(cases: DataFrame, district: str) -> DataFrame:
    """Distinct filled stations of a district, whose name is compared in any case."""
    here = cases.filter((F.lower(F.trim("district")) == district.strip().lower()) & (F.trim("police_station") != ""))
    return here.select(F.trim("police_station").alias("police_station")).distinct()
