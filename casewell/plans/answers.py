"""The service's answers over the carrier tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewell.operators import analytics as measures
from casewell.operators import answers, detectors, graph
from casewell.storage import stored, table

from .carriers import calls, crossings, trades
from .detection import FAR, SPIKES, Z
from .graphs import BOTH, full, owned
from .registry import query
from .relational import TIMELINE, merged_timeline


@query("api_overview", SPIKES + f""", hits AS (SELECT {Z} AS z FROM daily JOIN own USING (entity) WHERE {FAR}), scores AS (SELECT round(50 + 8 * least(z, 6), 2) AS score FROM hits),
  owned AS (SELECT o_custkey AS person, l_partkey AS identifier, list_sort(list_distinct(list(o_orderpriority))) AS cases FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
  links AS (SELECT count(*) FILTER (a.cases <> b.cases) AS n FROM owned a JOIN owned b ON a.identifier = b.identifier AND a.person < b.person)
  SELECT (SELECT count(DISTINCT case_id) FROM calls)::BIGINT AS n_cases, (SELECT count(DISTINCT c_name) FROM customer)::BIGINT AS n_people, (SELECT count(DISTINCT user_id) FROM events)::BIGINT AS n_vehicles,
    count(*)::BIGINT AS n_alerts, count(*) FILTER (score >= 70)::BIGINT AS n_urgent, (SELECT n FROM links)::BIGINT AS n_cross_case FROM scores WHERE score >= 55""")
def overview(spark, sf):
    c = calls(spark, sf)
    found = detectors.alerts(spikes=detectors.communication_spikes(c), s=detectors.Settings(alert_limit=None))
    return answers.overview(c, table(spark, sf, "customer").select(F.col("c_name").alias("name")), crossings(spark, sf), found, owned(spark, sf))


@query("api_network", f"""WITH {BOTH}, e AS (SELECT 'CUST::' || o_custkey::VARCHAR AS src, 'SUPP::' || l_suppkey::VARCHAR AS dst, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
  SELECT 'node' AS element, a AS id, split_part(a, '::', 1) AS type, split_part(a, '::', 2) AS label, NULL::VARCHAR AS other, count(DISTINCT b)::DOUBLE AS weight FROM ways GROUP BY a UNION ALL SELECT 'edge', src, NULL, NULL, dst, weight FROM e""")
def network(spark, sf):
    return answers.network(stored(full(spark, sf).select("src", "dst", "weight"), "edges"))


@query("api_timeline", TIMELINE + " SELECT ts, event_type, person, description, risk_score::INT AS risk_score FROM t WHERE case_id = 'C3'")
def timeline_of(spark, sf):
    return answers.timeline_of(merged_timeline(spark, sf), "C3").select("ts", "event_type", "person", "description", "risk_score")


@query("api_alerts", SPIKES + f", hits AS (SELECT entity, {Z} AS z FROM daily JOIN own USING (entity) WHERE {FAR}) SELECT entity::VARCHAR AS entities, round(50 + 8 * least(z, 6), 2)::DOUBLE AS score FROM hits WHERE 50 + 8 * least(z, 6) >= 70 AND 50 + 8 * least(z, 6) < 85")
def alerts_of(spark, sf):
    found = detectors.alerts(spikes=detectors.communication_spikes(calls(spark, sf)), s=detectors.Settings(alert_limit=None))
    return answers.alerts_of(found, "High").select(F.array_join("entities", ",").alias("entities"), "score")


@query("api_persons", f"WITH {BOTH}, d AS (SELECT a, count(DISTINCT b)::BIGINT AS n FROM ways GROUP BY 1) SELECT 'CUST::' || c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS role, coalesce(n, 0) AS n_neighbours FROM customer LEFT JOIN d ON a = 'CUST::' || c_custkey::VARCHAR WHERE c_mktsegment = 'BUILDING'")
def persons(spark, sf):
    people = table(spark, sf, "customer").select(graph.node_id("CUST", F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"))
    return answers.persons(people, measures.degree(trades(spark, sf)), "building").select("id", "name", "role", "n_neighbours")


@query("api_analytics", "SELECT c_mktsegment AS category, count(*)::BIGINT AS n, round(count(*) / max(count(*)) OVER () * 100, 2) AS percent FROM customer GROUP BY 1")
def analytics(spark, sf):
    return answers.analytics(table(spark, sf, "customer"), F.col("c_mktsegment"))


def _places(spark, sf):
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat(F.lit(" "), "n_name").alias("district"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("police_station"))


@query("api_districts", "SELECT DISTINCT n_name AS district FROM nation JOIN customer ON c_nationkey = n_nationkey")
def districts(spark, sf):
    return answers.districts(_places(spark, sf))


@query("api_police_stations", "SELECT DISTINCT c_mktsegment AS police_station FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 3) AND c_custkey % 5 <> 0")
def police_stations(spark, sf):
    name = table(spark, sf, "nation").filter("n_nationkey = 3").first()["n_name"]
    return answers.police_stations(_places(spark, sf), name.lower())
