"""Detectors, alerts and domain rules over the carrier tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewell.operators import detectors, rules
from casewell.storage import table

from .carriers import CALLS, CROSSINGS, calls, crossings, payments
from .registry import query

SPIKES = f"""WITH {CALLS}, daily AS (
  SELECT entity, ts::DATE AS day, count(*) AS n FROM (SELECT entity_a AS entity, ts FROM calls UNION ALL SELECT entity_b, ts FROM calls) GROUP BY 1, 2),
own AS (SELECT entity, avg(n) AS mean, stddev_pop(n) AS std, count(*) AS k, sum(n)::HUGEINT AS s, sum(n * n)::HUGEINT AS q FROM daily GROUP BY 1)"""
#: In whole numbers: what lies exactly at the limit counts, whatever the order of sums.
FAR = "k >= 3 AND k * q > s * s AND k * n > s AND (k * n - s) * (k * n - s) >= 4 * (k * q - s * s)"
Z = "round((k * n - s)::DOUBLE / sqrt((k * q - s * s)::DOUBLE), 2)"


@query("a1_daily_activity", f"WITH {CALLS} SELECT entity, ts::DATE AS day, count(*)::BIGINT AS n FROM (SELECT entity_a AS entity, ts FROM calls UNION ALL SELECT entity_b, ts FROM calls) GROUP BY 1, 2")
def a1(spark, sf):
    return detectors.daily_activity(calls(spark, sf))


@query("a2_a3_own_baseline", SPIKES + " SELECT entity, round(mean, 6) AS mean, round(std, 6) AS std, k::BIGINT AS days FROM own WHERE k >= 3 AND std > 0")
def a2(spark, sf):
    daily = detectors.daily_activity(calls(spark, sf))
    own = daily.groupBy("entity").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.count(F.lit(1)).alias("days"))
    return own.filter("days >= 3 and std > 0").select("entity", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "days")


@query("d1_communication_spike", SPIKES + f" SELECT entity, day, n::BIGINT AS n, {Z} AS z FROM daily JOIN own USING (entity) WHERE {FAR}")
def d1(spark, sf):
    return detectors.communication_spikes(calls(spark, sf)).select("entity", "day", "n", "z")


MONEY = """cents AS (SELECT o_orderkey, o_custkey, o_totalprice, round(o_totalprice * 100)::HUGEINT AS v FROM orders),
spent AS (SELECT o_custkey, count(*)::HUGEINT AS k, sum(v)::HUGEINT AS s, sum(v * v)::HUGEINT AS q FROM cents GROUP BY 1),
money AS (SELECT o_orderkey AS payment_id, o_custkey AS sender, o_totalprice AS amount, round((k * v - s)::DOUBLE / sqrt((k * q - s * s)::DOUBLE), 2) AS z
  FROM cents JOIN spent USING (o_custkey) WHERE k >= 3 AND k * q > s * s AND k * v > s AND 4 * (k * v - s) * (k * v - s) >= 25 * (k * q - s * s))"""


@query("d2_financial_anomaly", f"WITH {MONEY} SELECT * FROM money")
def d2(spark, sf):
    return detectors.amount_outliers(payments(spark, sf)).select("payment_id", "sender", "amount", "z")


CHAINS = f"""WITH {CALLS}, met AS (
  SELECT x.entity_a AS a, x.entity_b AS b, y.entity_b AS c, x.ts AS ts1, y.ts AS ts2, x.call_id AS call1, y.call_id AS call2
  FROM calls x JOIN calls y ON x.entity_b = y.entity_a AND y.ts > x.ts AND y.ts <= x.ts + INTERVAL 30 MINUTE AND y.entity_b <> x.entity_a),
one AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY ts1, ts2, call1, call2) AS k FROM met)
SELECT a, b, c, call1, call2, round((epoch_us(ts2) - epoch_us(ts1)) / 60000000.0, 1) AS gap_min FROM one WHERE k = 1"""


@query("d3_j1_contact_chain", CHAINS)
def d3(spark, sf):
    return detectors.contact_chains(calls(spark, sf)).select("a", "b", "c", "call1", "call2", "gap_min")


CONVOYS = f"""WITH {CROSSINGS}, seen AS (
  SELECT plaza, ts, crossing_id, list_sort(list_distinct(list(vehicle) OVER (PARTITION BY plaza ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 20 MINUTE FOLLOWING))) AS v FROM crossings),
many AS (SELECT plaza, ts, crossing_id, len(v) AS n_vehicles, array_to_string(v, ',') AS vehicle_list FROM seen WHERE len(v) >= 2),
one AS (SELECT *, row_number() OVER (PARTITION BY plaza, vehicle_list ORDER BY ts, crossing_id) AS k FROM many)
SELECT plaza, vehicle_list, n_vehicles::INT AS n_vehicles, ts AS start_ts FROM one WHERE k = 1"""


@query("d4_j2_w2_coordinated_movement", CONVOYS)
def d4(spark, sf):
    return detectors.coordinated_movement(crossings(spark, sf))


LOOPS = f"""WITH {CROSSINGS}, seen AS (
  SELECT vehicle, plaza, ts, crossing_id, count(*) OVER w AS visits, max(ts) OVER w AS last_ts FROM crossings
  WINDOW w AS (PARTITION BY vehicle, plaza ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 48 HOUR FOLLOWING)),
one AS (SELECT *, row_number() OVER (PARTITION BY vehicle, plaza ORDER BY ts, crossing_id) AS k FROM seen WHERE visits >= 3)
SELECT vehicle, plaza, ts AS first_ts, last_ts, visits::BIGINT AS visits FROM one WHERE k = 1"""


@query("d5_location_loop", LOOPS)
def d5(spark, sf):
    return detectors.location_loops(crossings(spark, sf))


@query("d6_p4_plate_mismatch", f"WITH {CROSSINGS} SELECT vehicle, plaza, ts, tag, case_id FROM crossings WHERE upper(cross_match) = 'MISMATCH'")
def d6(spark, sf):
    return detectors.plate_mismatches(crossings(spark, sf))


def _inner(sql: str) -> str:
    """The tables of a query of the above without the carrier it starts from, and what it selects."""
    return sql.split("FROM events)", 1)[1].lstrip(", \n")


_CHAINS, _CONVOYS, _LOOPS = (_inner(q).replace("one AS", f"one{i} AS").replace("FROM one ", f"FROM one{i} ") for i, q in enumerate((CHAINS, CONVOYS, LOOPS)))


def _last(sql: str, name: str) -> str:
    """``sql``'s tables, its result as the table ``name``."""
    at = sql.rindex("\nSELECT")
    return f"{sql[:at]},\n{name} AS ({sql[at + 1 :]})"


ALERTS = SPIKES + f""", hits AS (SELECT entity, day, n, {Z} AS z FROM daily JOIN own USING (entity) WHERE {FAR}), {MONEY}, {CROSSINGS},
{_last(_CHAINS, "chains")}, {_last(_CONVOYS.replace("seen", "met_at"), "convoys")}, {_last(_LOOPS, "loops")},
raw AS (SELECT 'COMMUNICATION_SPIKE' AS alert_type, 50 + 8 * least(z, 6) AS score, least(90, 50 + 6 * z) AS confidence, entity::VARCHAR AS entities,
    entity::VARCHAR || ': ' || n::VARCHAR || ' contacts on ' || day::VARCHAR AS summary FROM hits
  UNION ALL SELECT 'FINANCIAL_ANOMALY', 55 + 7 * least(z, 6), least(92, 55 + 6 * z), sender::VARCHAR, sender::VARCHAR || ': payment of ' || printf('%.2f', amount) FROM money
  UNION ALL SELECT 'CONTACT_CHAIN', 60 + greatest(0, 10 - gap_min), 65, array_to_string(list_sort(list_distinct([a::VARCHAR, b::VARCHAR, c::VARCHAR])), ','), a::VARCHAR || ' > ' || b::VARCHAR || ' > ' || c::VARCHAR FROM chains
  UNION ALL SELECT 'COORDINATED_MOVEMENT', 55 + 5 * least(n_vehicles, 8), 60, array_to_string(list_sort(list_distinct(string_split(vehicle_list, ','))), ','), n_vehicles::VARCHAR || ' vehicles at ' || plaza FROM convoys
  UNION ALL SELECT 'LOCATION_LOOP', 50 + 5 * least(visits, 10), 60, vehicle::VARCHAR, vehicle::VARCHAR || ': ' || visits::VARCHAR || ' visits to ' || plaza FROM loops
  UNION ALL SELECT 'VEHICLE_IDENTITY_MISMATCH', 88, 80, vehicle::VARCHAR, vehicle::VARCHAR || ': plate differs at ' || plaza FROM crossings WHERE upper(cross_match) = 'MISMATCH'),
scored AS (SELECT alert_type, round(greatest(0, least(100, score)), 2)::DOUBLE AS score, round(greatest(0, least(100, confidence)), 2)::DOUBLE AS confidence, entities, summary FROM raw),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, confidence DESC, alert_type, entities, summary) AS k FROM scored WHERE score >= 55)
SELECT format('ALT-{{:05d}}', k) AS alert_id, alert_type, CASE WHEN score >= 85 THEN 'CRITICAL' WHEN score >= 70 THEN 'HIGH' ELSE 'MEDIUM' END AS severity, score, confidence, entities, summary FROM ranked WHERE k <= 100"""


@query("d7_l3_alerts", ALERTS)
def d7(spark, sf):
    c, t = calls(spark, sf), crossings(spark, sf)
    out = detectors.alerts(
        detectors.communication_spikes(c), detectors.amount_outliers(payments(spark, sf)), detectors.contact_chains(c),
        detectors.coordinated_movement(t, most=detectors.Settings().alert_limit), detectors.location_loops(t), detectors.plate_mismatches(t),
    )
    return out.select("alert_id", "alert_type", "severity", "score", "confidence", F.array_join("entities", ",").alias("entities"), "summary")


@query("d7_spike_scores", SPIKES + f", hits AS (SELECT entity, day, {Z} AS z FROM daily JOIN own USING (entity) WHERE {FAR})" + """
SELECT entity, day, round(greatest(0, least(100, 50 + 8 * least(z, 6))), 2) AS score, round(least(90, 50 + 6 * z), 2) AS confidence,
  CASE WHEN 50 + 8 * least(z, 6) >= 85 THEN 'CRITICAL' WHEN 50 + 8 * least(z, 6) >= 70 THEN 'HIGH' WHEN 50 + 8 * least(z, 6) >= 55 THEN 'MEDIUM' ELSE 'LOW' END AS severity FROM hits""")
def d7_spikes(spark, sf):
    spikes = detectors.communication_spikes(calls(spark, sf))
    scored = detectors.alerts(spikes=spikes, s=detectors.Settings(alert_limit=None))
    found = F.from_json("evidence", "entity long, day date")
    return scored.select(found["entity"].alias("entity"), found["day"].alias("day"), "score", "confidence", "severity")


@query("d7_j5_emerging_clusters", """WITH sizes AS (SELECT o_custkey AS community_id, count(*)::BIGINT AS size FROM orders GROUP BY 1)
  SELECT community_id, size FROM sizes WHERE size >= greatest(12, (SELECT floor(quantile_cont(size, 0.75)) FROM sizes))""")
def d7_clusters(spark, sf):
    sizes = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("community_id")).agg(F.count(F.lit(1)).alias("size"))
    return detectors.emerging_clusters(sizes)


# --- domain rules -----------------------------------------------------------------------------


@query("r1_j17_cloned_plate", """SELECT a.event_id AS id, 'RULE 1' AS rule, 'CRITICAL' AS severity, a.user_id AS person FROM events a
  WHERE a.event_type = 'purchase' AND (CASE WHEN a.value >= 100 THEN a.user_id + 1 ELSE a.user_id END) <> a.user_id""")
def r1(spark, sf):
    e = table(spark, sf, "events").filter("event_type = 'purchase'")
    tolls = e.select(F.col("event_id").alias("crossing"), F.col("user_id").alias("person"), F.col("user_id").alias("plate"))
    cams = e.select(F.col("event_id").alias("crossing"), F.when(F.col("value") >= 100, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("captured"))
    return rules.cloned_plates(tolls, cams)


@query("r2_geo_alibi", f"""WITH {CALLS} SELECT DISTINCT e.event_id AS id, 'RULE 2' AS rule, 'HIGH' AS severity, e.user_id AS person
  FROM events e JOIN calls c ON c.entity_a = e.user_id AND c.ts > e.ts AND c.ts <= e.ts + INTERVAL 30 MINUTE AND c.case_id || 'x' <> e.event_type""")
def r2(spark, sf):
    seen = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), "ts", F.col("event_type").alias("place"))
    towers = calls(spark, sf).select(F.col("entity_a").alias("caller"), F.col("ts").alias("call_ts"), F.concat("case_id", F.lit("x")).alias("tower"))
    return rules.alibi_breaches(seen, towers)


@query("r4_j18_mobile_discrepancy", """SELECT c_custkey AS id, 'RULE 4' AS rule, 'MEDIUM' AS severity, c_custkey AS person FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey""")
def r4(spark, sf):
    licences = table(spark, sf, "customer").select(F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("phone"))
    registered = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("person"), F.col("s_nationkey").alias("phone"))
    return rules.mobile_discrepancies(licences, registered)


@query("r5_a18_structuring", """SELECT o_custkey AS person, o_orderdate::DATE AS day, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total, 'RULE 5' AS rule, 'HIGH' AS severity
  FROM orders WHERE o_totalprice BETWEEN 100000 AND 300000 GROUP BY 1, 2 HAVING count(*) >= 2""")
def r5(spark, sf):
    p = payments(spark, sf).withColumn("person", F.col("sender"))
    return rules.structuring(p, low=100_000, high=300_000, least=2)


@query("r6_rapid_layering", """SELECT a.event_id AS credit_id, b.event_id AS debit_id, a.user_id AS person, round((epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0, 1) AS gap_min
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts + INTERVAL 2 MINUTE AND b.ts <= a.ts + INTERVAL 30 MINUTE""")
def r6(spark, sf):
    e = table(spark, sf, "events")
    moves = e.filter("event_type in ('click', 'purchase')").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("person"), "ts", F.when(F.col("event_type") == "click", "CR").otherwise("DR").alias("kind")
    )
    return rules.rapid_layering(moves, 2, 30)


@query("r7_proxy_payment", "SELECT c_custkey AS id, 'RULE 7' AS rule, 'HIGH' AS severity, c_custkey AS person FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def r7(spark, sf):
    paid = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("person"), F.col("c_nationkey").alias("ip"))
    proxies = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("ip"))
    return rules.proxy_payments(paid, proxies)


@query("r8_crypto_payout", """SELECT a.event_id AS deposit_id, b.event_id AS payout_id, a.user_id AS person, round((epoch_us(b.ts) - epoch_us(a.ts)) / 60000000.0, 1) AS gap_min
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 75 MINUTE""")
def r8(spark, sf):
    e = table(spark, sf, "events")
    part = lambda kind, name: e.filter(F.col("event_type") == kind).select(F.col("event_id").alias(name), F.col("user_id").alias("person"), "ts")
    return rules.crypto_payouts(part("view", "deposit_id"), part("purchase", "payout_id"))


@query("r9_f48_income_ratio", """WITH x AS (SELECT c_custkey AS person, c_acctbal AS income, sum(o_totalprice) AS spent FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2)
  SELECT person, round(CASE WHEN income = 0 THEN 0 ELSE spent / income END, 2) AS ratio, 'RULE 9' AS rule, 'HIGH' AS severity FROM x WHERE CASE WHEN income = 0 THEN 0 ELSE spent / income END > 15""")
def r9(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    totals = c.groupBy(F.col("c_custkey").alias("person"), F.col("c_acctbal").alias("income")).agg(F.sum("o_totalprice").alias("large_spending"))
    return rules.income_mismatch(totals)


@query("r10_nominee_director", """SELECT o_custkey AS person, count(*)::BIGINT AS directorships, c_acctbal AS income, 'RULE 10' AS rule, 'CRITICAL' AS severity
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, c_acctbal HAVING count(*) > 8 AND c_acctbal < 200000""")
def r10(spark, sf):
    filings = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return rules.nominee_directors(filings.select(F.col("o_custkey").alias("person"), F.col("c_acctbal").alias("income")))


@query("r11_fake_eway_bill", "SELECT event_id AS id, 'RULE 11' AS rule, 'HIGH' AS severity, user_id AS person FROM events WHERE event_type = 'error'")
def r11(spark, sf):
    bills = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("person"), F.when(F.col("event_type") == "error", "FAKE").otherwise("CLEAN").alias("forensic_flag"))
    return rules.fake_bills(bills)


@query("r12_shared_address", "SELECT c_nationkey AS address, count(DISTINCT c_mktsegment)::BIGINT AS n_entities, 'RULE 12' AS rule FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def r12(spark, sf):
    return rules.shared_addresses(table(spark, sf, "customer").select(F.col("c_nationkey").alias("address"), F.col("c_mktsegment").alias("entity")))


@query("u3_anomaly_union", """SELECT rule, severity, count(*)::BIGINT AS n FROM (
  SELECT 'RULE 7' AS rule, 'HIGH' AS severity FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
  UNION ALL SELECT 'RULE 11', 'HIGH' FROM events WHERE event_type = 'error') GROUP BY 1, 2""")
def u3(spark, sf):
    return rules.all_anomalies(r7(spark, sf), r11(spark, sf)).groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
