"""Graph operators over the trade graph and over generated case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewell.operators import analytics, detectors, graph
from casewell.operators.components import connected_components
from casewell.storage import stored, table

from .carriers import TRADES, calls, crossings, payments, trades
from .registry import query

BOTH = TRADES + ", ways AS (SELECT src AS a, dst AS b FROM trades UNION SELECT dst, src FROM trades)"


def full(spark, sf):
    """The trade graph with the columns of merged edges."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    mentions = joined.select(
        *graph.mention(
            graph.node_id("CUST", F.col("o_custkey").cast("string")), graph.node_id("SUPP", F.col("l_suppkey").cast("string")), "BOUGHT_FROM",
            F.col("o_orderpriority"), F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_returnflag"),
        )
    )
    return graph.merge_edges(mentions)


@query("g1_g2_case_graph")
def g1(spark, sf):
    from casewell.sources import generate

    cases = generate.cases_of(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seq")))
    people = cases.select(
        F.col("FIR_No").alias("case_id"), F.col("seq"), F.col("Informant_Name").alias("informant_name"), F.col("Informant_Contact").alias("informant_contact"),
        F.col("Informant_Vehicles").alias("informant_vehicles"), F.col("Victim_Name").alias("victim_name"), F.col("Victim_Contact").alias("victim_contact"),
        F.col("Victim_Vehicles").alias("victim_vehicles"), F.col("Accused_Name_Alias").alias("accused_name"), F.col("Accused_Contact").alias("accused_contact"),
        F.col("Accused_Vehicles").alias("accused_vehicles"),
    )
    edges = graph.merge_edges(graph.case_mentions(people))
    return edges.select("src", "dst", "weight", F.array_join("relation_types", ",").alias("relation_types"), F.array_join("case_ids", ",").alias("case_ids"))


TITLE = "array_to_string(list_transform(regexp_extract_all({x}, '([\\p{{L}}]+|[^\\p{{L}}]+)'), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), '')"


@query("g1_g2_case_graph_of_customers", f"""WITH c AS (SELECT 'CASE::C' || c_custkey::VARCHAR AS c, 'PERSON::' || {TITLE.format(x="c_name")} AS i, 'PERSON::' || {TITLE.format(x="n_name")} AS v, 'PERSON::' || {TITLE.format(x="c_mktsegment")} AS a,
    'PHONE::9' || right(c_name, 9) AS p, 'VEHICLE::MH' || c_custkey::VARCHAR AS car FROM customer JOIN nation ON c_nationkey = n_nationkey),
  m AS (SELECT c, i AS x, c AS y, 'INVOLVED_AS_INFORMANT' AS r FROM c UNION ALL SELECT c, v, c, 'INVOLVED_AS_VICTIM' FROM c UNION ALL SELECT c, a, c, 'INVOLVED_AS_ACCUSED' FROM c UNION ALL SELECT c, i, p, 'OWNS_PHONE' FROM c
    UNION ALL SELECT c, i, car, 'OWNS_VEHICLE' FROM c UNION ALL SELECT c, a, v, 'ACCUSED_OF_CRIME_AGAINST' FROM c UNION ALL SELECT c, i, v, 'REPORTED_INCIDENT_FOR' FROM c)
  SELECT least(x, y) AS src, greatest(x, y) AS dst, count(*)::DOUBLE AS weight, array_to_string(list_sort(list_distinct(list(r))), ',') AS relation_types, count(DISTINCT c)::INT AS n_cases FROM m GROUP BY 1, 2""")
def g1_customers(spark, sf):
    """Customers as informants of a case each, their nations as victims, their market segments as accused."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    none = F.lit(None).cast("string")
    key = F.col("c_custkey").cast("string")
    cases = c.select(
        F.concat(F.lit("C"), key).alias("case_id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("informant_name"), F.concat(F.lit("+91 9"), F.right("c_name", F.lit(9))).alias("informant_contact"),
        F.concat(F.lit("mh"), key, F.lit(" (Car)")).alias("informant_vehicles"), F.col("n_name").alias("victim_name"), none.alias("victim_contact"), none.alias("victim_vehicles"),
        F.col("c_mktsegment").alias("accused_name"), none.alias("accused_contact"), none.alias("accused_vehicles"),
    )
    edges = graph.merge_edges(graph.case_mentions(cases))
    return edges.select("src", "dst", "weight", F.array_join("relation_types", ",").alias("relation_types"), F.size("case_ids").alias("n_cases"))


@query("g3_edge_merge", """SELECT 'CUST::' || o_custkey::VARCHAR AS src, 'SUPP::' || l_suppkey::VARCHAR AS dst, count(*)::DOUBLE AS weight, 'BOUGHT_FROM' AS relation_types,
  array_to_string(list_sort(list_distinct(list(o_orderpriority))), ',') AS case_ids, least(count(*), 25)::INT AS n_evidence
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def g3(spark, sf):
    e = full(spark, sf)
    return e.select("src", "dst", "weight", F.array_join("relation_types", ",").alias("relation_types"), F.array_join("case_ids", ",").alias("case_ids"), F.size("evidence").alias("n_evidence"))


@query("g4_j4_cross_case_links", """WITH own AS (SELECT o_custkey AS person, l_partkey AS identifier, list_sort(list_distinct(list(o_orderpriority))) AS cases FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)
  SELECT a.person AS person_a, b.person AS person_b, 'PART' AS kind, a.identifier, a.cases <> b.cases AS cross_case FROM own a JOIN own b ON a.identifier = b.identifier AND a.person < b.person""")
def g4(spark, sf):
    return graph.shared_identifier_links(owned(spark, sf))


def owned(spark, sf):
    """Customers as persons, the parts they ordered as identifiers, order priorities as cases."""
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    out = joined.groupBy(F.col("o_custkey").alias("person"), F.col("l_partkey").alias("identifier")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("case_ids"))
    return out.withColumn("kind", F.lit("PART"))


@query("g4_j4_case_set_links", """WITH own AS (SELECT o_custkey AS person, l_partkey AS identifier, list_sort(list_distinct(list(o_orderpriority))) AS cases FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
  pairs AS (SELECT a.identifier, least(a.cases, b.cases) AS cases, a.cases = b.cases AS same FROM own a JOIN own b ON a.identifier = b.identifier AND a.person < b.person),
  n AS (SELECT identifier, cases, count(*) FILTER (same) AS n_links, count(*) FILTER (NOT same) AS n_cross_links FROM pairs GROUP BY 1, 2)
  SELECT o.identifier, array_to_string(o.cases, ',') AS case_ids, count(*)::BIGINT AS n_persons, coalesce(any_value(n_links), 0)::BIGINT AS n_links, coalesce(any_value(n_cross_links), 0)::BIGINT AS n_cross_links
  FROM own o LEFT JOIN n ON n.identifier = o.identifier AND n.cases = o.cases GROUP BY o.identifier, o.cases""")
def g4_sets(spark, sf):
    return graph.case_set_links(owned(spark, sf)).select("identifier", F.array_join("case_ids", ",").alias("case_ids"), "n_persons", "n_links", "n_cross_links")


@query("g5_components", f"""WITH RECURSIVE {BOTH}, reach(a, b) USING KEY (a) AS (SELECT a, min(b) FROM (SELECT a, b FROM ways UNION ALL SELECT a, a FROM ways) GROUP BY 1
  UNION SELECT w.a, min(r.b) FROM ways w JOIN reach r ON w.b = r.a JOIN recurring.reach old ON old.a = w.a WHERE r.b < old.b GROUP BY 1)
  SELECT a AS node, b AS root FROM reach""")
def g5(spark, sf):
    return connected_components(trades(spark, sf), "src", "dst")


@query("g6_degree", f"WITH {BOTH} SELECT a AS id, count(DISTINCT b)::BIGINT AS n_neighbours, round(count(DISTINCT b) / ((SELECT count(DISTINCT a) FROM ways) - 1.0), 4) AS degree FROM ways GROUP BY 1")
def g6(spark, sf):
    return analytics.degree(trades(spark, sf))


@query("g7_betweenness")
def g7(spark, sf):
    return analytics.betweenness(stored(trades(spark, sf), "trades"))


@query("g8_eigenvector")
def g8(spark, sf):
    return analytics.eigenvector(stored(trades(spark, sf), "trades"))


@query("g9_bridges")
def g9(spark, sf):
    return analytics.bridges(stored(trades(spark, sf), "trades"))


@query("g10_communities")
def g10(spark, sf):
    return analytics.communities(stored(trades(spark, sf), "trades"))


@query("g10_label_communities")
def g10b(spark, sf):
    return analytics.label_communities(stored(trades(spark, sf), "trades"))


def _ranked(spark, sf, most=25):
    e, found = _placed_trades(spark, sf)
    return e, stored(analytics.ranking(analytics.degree(e), analytics.betweenness(e), analytics.eigenvector(e), found, most), "ranked")


def _placed_trades(spark, sf):
    e = stored(trades(spark, sf), "trades")
    return e, stored(analytics.communities(e), "communities")


@query("g11_ranking")
def g11(spark, sf):
    return _ranked(spark, sf)[1]


@query("g12_s14_ego_graph", f"WITH {BOTH}, near AS (SELECT 'SUPP::1' AS id UNION SELECT b FROM ways WHERE a = 'SUPP::1') SELECT src, dst FROM trades WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) AND 'SUPP::1' IN (SELECT a FROM ways)")
def g12(spark, sf):
    return graph.ego_graph(stored(trades(spark, sf), "trades"), "SUPP::1", 1).select("src", "dst")


@query("g12_within_hops", f"""WITH {BOTH}, one AS (SELECT DISTINCT b FROM ways WHERE a = 'SUPP::1'), two AS (SELECT DISTINCT w.b FROM ways w JOIN one ON w.a = one.b),
  x AS (SELECT a AS id, 0 AS distance FROM ways WHERE a = 'SUPP::1' UNION ALL SELECT b, 1 FROM one UNION ALL SELECT b, 2 FROM two)
  SELECT id, min(distance)::INT AS distance FROM x GROUP BY 1""")
def g12b(spark, sf):
    return graph.within_hops(stored(trades(spark, sf), "trades"), "SUPP::1", 2)


@query("g13_shortest_path", f"WITH {TRADES} SELECT 'SUPP::1 > ' || min(a.src) || ' > SUPP::2' AS path, 2::INT AS length FROM trades a JOIN trades b ON a.src = b.src WHERE a.dst = 'SUPP::1' AND b.dst = 'SUPP::2' HAVING count(*) > 0")
def g13(spark, sf):
    return graph.shortest_path(stored(trades(spark, sf), "trades"), "SUPP::1", "SUPP::2").select(F.array_join("path", " > ").alias("path"), "length")


@query("g14_neighbours", "SELECT DISTINCT 'CUST::' || o_custkey::VARCHAR AS id, 'BOUGHT_FROM' AS relation_types FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_suppkey = 1")
def g14(spark, sf):
    return graph.neighbours(full(spark, sf), "SUPP::1").withColumn("relation_types", F.array_join("relation_types", ","))


@query("g15_summary", f"WITH {BOTH}, n AS (SELECT count(DISTINCT a) AS nodes FROM ways), m AS (SELECT count(*) AS edges FROM trades) SELECT nodes::BIGINT AS nodes, edges::BIGINT AS edges, round(2.0 * edges / (nodes * (nodes - 1.0)), 5) AS density FROM n, m")
def g15(spark, sf):
    e = full(spark, sf)
    return graph.summary(graph.nodes_of(e), e)


@query("g15_node_types", f"WITH {BOTH} SELECT split_part(a, '::', 1) AS type, count(DISTINCT a)::BIGINT AS n FROM ways GROUP BY 1")
def g15b(spark, sf):
    return graph.nodes_of(full(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("g16_find_case", f"WITH {BOTH} SELECT DISTINCT a AS id FROM ways WHERE lower(a) = 'supp::1' OR split_part(a, '::', 2) = 'supp::1'")
def g16(spark, sf):
    return graph.find_case(graph.nodes_of(full(spark, sf)), "Supp::1").select("id")


@query("g18_case_map", """SELECT s_suppkey AS case_id, 'Case' AS layer, n_name AS place FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT s_suppkey, 'Bank Counterparty', c_name FROM supplier JOIN (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer) ON c_nationkey = s_nationkey AND k <= 5""")
def g18(spark, sf):
    from casewell.operators.frames import keep_least
    from casewell.operators.maps import case_map

    s, n, c = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "customer")
    cases = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(F.col("s_suppkey").alias("case_id"), F.col("n_name").alias("place"), F.col("s_suppkey").alias("seq"))
    # all cases of a nation have the same counterparties, so the first five are found once for each nation
    c = keep_least(c, ["c_nationkey"], [F.col("c_custkey"), F.col("c_name")], 5)
    parties = s.join(c, s["s_nationkey"] == c["c_nationkey"]).select(F.col("s_suppkey").alias("case_id"), F.col("c_name").alias("place"), F.col("c_custkey").alias("seq"))
    return case_map(cases, {"Bank Counterparty": (parties, 5)}).select("case_id", "layer", "place")


@query("e13_alias_merge", """WITH m AS (SELECT 'CUST::' || (o_custkey // 2)::VARCHAR AS src, 'SUPP::' || l_suppkey::VARCHAR AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
  SELECT src, dst, count(*)::DOUBLE AS weight, least(count(*), 25)::INT AS n_evidence FROM m GROUP BY 1, 2""")
def e13(spark, sf):
    e = full(spark, sf)
    ids = graph.nodes_of(e).filter("type = 'CUST'").select(F.col("id").alias("alias"), F.concat(F.lit("CUST::"), F.floor(F.col("label").cast("long") / 2).cast("string")).alias("canonical"))
    out = graph.apply_aliases(e, ids)
    return out.select("src", "dst", "weight", F.size("evidence").alias("n_evidence"))


@query("d8_structural_alerts")
def d8(spark, sf):
    e, ranked = _ranked(spark, sf)
    return detectors.structural_alerts(ranked, analytics.bridges(e))


@query("d7_alerts_of_all_sources")
def d7_all(spark, sf):
    """The eight sources of alerts in one ranking: six detectors, the first bridge entities of the ranking, and large communities."""
    e, found = _placed_trades(spark, sf)
    ranked = stored(analytics.ranking(analytics.degree(e), analytics.betweenness(e), analytics.eigenvector(e)), "ranked")
    c, t = calls(spark, sf), crossings(spark, sf)
    clusters = detectors.emerging_clusters(found.select("community_id", "size").distinct())
    out = detectors.alerts(
        detectors.communication_spikes(c), detectors.amount_outliers(payments(spark, sf)), detectors.contact_chains(c),
        detectors.coordinated_movement(t), detectors.location_loops(t), detectors.plate_mismatches(t), _suspects(ranked, analytics.bridges(e)), clusters,
        detectors.Settings(alert_limit=None),
    )
    return out.select("alert_id", "alert_type", "severity", "score", "confidence", F.array_join("entities", ",").alias("entities"), "summary")


@query("d7_j5_bridge_entities")
def d7(spark, sf):
    e, ranked = _ranked(spark, sf)
    return _bridge_alerts(ranked, analytics.bridges(e))


def _suspects(ranked, b):
    """The first 20 of the ranked that are an end of a bridge."""
    ends = b.select(F.col("src").alias("id")).union(b.select("dst")).distinct()
    return ranked.join(ends, "id", "left_semi").orderBy(F.desc("composite_score"), "id").limit(20)


def _bridge_alerts(ranked, b):
    return detectors.alerts(bridges=_suspects(ranked, b)).select("alert_id", "alert_type", "severity", "score", F.array_join("entities", ",").alias("entities"))


# ---- customers and the states of their orders: a graph with hubs and with bridges

STATUSES = """st AS (SELECT DISTINCT 'CUST::' || o_custkey::VARCHAR AS src, 'STATUS::' || o_orderstatus AS dst FROM orders),
ways AS (SELECT src AS a, dst AS b FROM st UNION ALL SELECT dst, src FROM st), nodes AS (SELECT a AS id, count(*) AS links FROM ways GROUP BY 1), size AS (SELECT count(*) AS n FROM nodes)"""
#: An edge of a customer with one state, or with no other customer who leads back to another of the states.
STATUS_BRIDGES = """other AS (SELECT x.src, x.dst, count(*) AS n FROM st x JOIN st y ON y.src = x.src AND y.dst <> x.dst JOIN st u ON u.dst = x.dst AND u.src <> x.src JOIN st v ON v.src = u.src AND v.dst = y.dst GROUP BY 1, 2),
bridge AS (SELECT st.src, st.dst FROM st LEFT JOIN other USING (src, dst) WHERE n IS NULL)"""


def _measures(levels: int = 6) -> str:
    """CTEs of the measures: shortest paths level by level, out and back; power iteration by rounds."""
    out = [STATUSES, "l0 AS (SELECT id AS s, id AS v, 1.0::DOUBLE AS n FROM nodes)"]
    for k in range(1, levels + 1):
        known = " UNION ALL ".join(f"SELECT s, v FROM l{i}" for i in range(max(k - 2, 0), k))
        out.append(f"l{k} AS (SELECT s, b AS v, sum(n) AS n FROM l{k - 1} JOIN ways ON a = v WHERE (s, b) NOT IN ({known}) GROUP BY 1, 2)")
    out.append(f"g{levels} AS (SELECT *, 0.0::DOUBLE AS g FROM l{levels})")
    for k in range(levels - 1, 0, -1):
        back = f"SELECT s, b AS v, sum((1 + g) / n) AS c FROM g{k + 1} JOIN ways ON a = v GROUP BY 1, 2"
        out.append(f"g{k} AS (SELECT s, v, n, n * coalesce(c, 0) AS g FROM l{k} LEFT JOIN ({back}) USING (s, v))")
    total = " UNION ALL ".join(f"SELECT v, g FROM g{k}" for k in range(1, levels + 1))
    out.append(f"b AS (SELECT v AS id, round(sum(g) / ((any_value(size.n) - 1) * (any_value(size.n) - 2)), 4) AS betweenness FROM ({total}), size GROUP BY 1)")
    out.append("loops AS (SELECT a, b, 1 AS w FROM ways UNION ALL SELECT id, id, 25 FROM nodes)")
    out.append("""e AS (SELECT id, 0 AS k, 1.0::DOUBLE AS x FROM nodes UNION ALL SELECT id, k, x / sqrt(sum(x * x) OVER ()) FROM
  (SELECT a AS id, any_value(k) + 1 AS k, sum(w * x) AS x FROM loops JOIN e ON e.id = b GROUP BY a) WHERE k <= 120)""")
    out.append("v AS (SELECT id, round(x, 4) AS eigenvector FROM e WHERE k = 120), d AS (SELECT id, round(links / (n - 1), 4) AS degree FROM nodes, size)")
    out.append("""scored AS (SELECT *, least(100.0, (0.5::DOUBLE * betweenness + 0.3::DOUBLE * degree + 0.2::DOUBLE * eigenvector) * 100) AS raw FROM b JOIN d USING (id) JOIN v USING (id)),
tiers AS (SELECT id, degree, betweenness, eigenvector, round(raw::VARCHAR::DECIMAL(20, 10), 2)::DOUBLE AS composite_score FROM scored),
r AS (SELECT *, CASE WHEN composite_score >= 70 THEN 'CRITICAL' WHEN composite_score >= 40 THEN 'HIGH' WHEN composite_score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier FROM tiers ORDER BY composite_score DESC, id LIMIT 25)""")
    return "WITH RECURSIVE " + ",\n".join(out)


MEASURES = _measures()


def statuses(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("CUST::"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("STATUS::"), "o_orderstatus").alias("dst")).distinct()


def _ranked_statuses(spark, sf):
    e = stored(statuses(spark, sf), "statuses")
    return e, stored(analytics.ranking(analytics.degree(e), analytics.betweenness(e), analytics.eigenvector(e, tolerance=1e-10)), "ranked")


@query("g7_betweenness_of_statuses", MEASURES + " SELECT id, betweenness FROM b")
def g7_statuses(spark, sf):
    return analytics.betweenness(stored(statuses(spark, sf), "statuses"))


@query("g8_eigenvector_of_statuses", MEASURES + " SELECT id, eigenvector FROM v")
def g8_statuses(spark, sf):
    return analytics.eigenvector(stored(statuses(spark, sf), "statuses"), tolerance=1e-10)


@query("g8_eigenvector_rounds", f"""WITH RECURSIVE {BOTH}, loops AS (SELECT a, b FROM ways UNION ALL SELECT DISTINCT a, a FROM ways), e AS (SELECT DISTINCT a AS id, 0 AS k, 1.0::DOUBLE AS x FROM ways UNION ALL
  SELECT id, k, x / sqrt(sum(x * x) OVER ()) FROM (SELECT a AS id, any_value(k) + 1 AS k, sum(x) AS x FROM loops JOIN e ON e.id = b GROUP BY a) WHERE k <= 8) SELECT id, round(x, 6) AS eigenvector FROM e WHERE k = 8""")
def g8_rounds(spark, sf):
    """Eight rounds over all trades, whatever they still change."""
    return analytics.eigenvector(stored(trades(spark, sf), "trades"), rounds=8, settle=False, digits=6)


@query("g9_bridges_of_statuses", f"WITH {STATUSES}, {STATUS_BRIDGES} SELECT src, dst FROM bridge")
def g9_statuses(spark, sf):
    return analytics.bridges(stored(statuses(spark, sf), "statuses"))


@query("g11_ranking_of_statuses", MEASURES + " SELECT id, degree, betweenness, eigenvector, composite_score, risk_tier FROM r")
def g11_statuses(spark, sf):
    return _ranked_statuses(spark, sf)[1].drop("community_id")


@query("d8_structural_alerts_of_statuses", f"""{MEASURES}, {STATUS_BRIDGES}, few AS (SELECT * FROM bridge ORDER BY src, dst LIMIT 6),
  top AS (SELECT * FROM r WHERE risk_tier IN ('CRITICAL', 'HIGH') ORDER BY composite_score DESC, id LIMIT 12),
  x AS (SELECT 0 AS part, id AS subject, risk_tier AS severity, CASE WHEN degree >= 0.3 THEN 'hub' WHEN betweenness > 0.1 THEN 'broker' ELSE 'connected' END AS pattern, composite_score AS w FROM top
    UNION ALL SELECT 1, src || ' - ' || dst, 'MEDIUM', 'bridge', 0 FROM few)
  SELECT printf('NET-%03d', row_number() OVER (ORDER BY part, w DESC, subject)) AS alert_id, subject, severity, pattern FROM x""")
def d8_statuses(spark, sf):
    e, ranked = _ranked_statuses(spark, sf)
    return detectors.structural_alerts(ranked, analytics.bridges(e))


@query("d7_j5_bridge_entities_of_statuses", f"""{MEASURES}, {STATUS_BRIDGES}, x AS (SELECT id FROM r WHERE id IN (SELECT src FROM bridge UNION SELECT dst FROM bridge) ORDER BY composite_score DESC, id LIMIT 20)
  SELECT printf('ALT-%05d', row_number() OVER (ORDER BY id)) AS alert_id, 'GRAPH_BRIDGE_ENTITY' AS alert_type, 'HIGH' AS severity, 72.0::DOUBLE AS score, id AS entities FROM x""")
def d7_statuses(spark, sf):
    e, ranked = _ranked_statuses(spark, sf)
    return _bridge_alerts(ranked, analytics.bridges(e))
