"""Filters, joins, aggregates, windows, limits and set operations over the carrier tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from casewell.functions.values import parse_time
from casewell.operators import frames, tables, timeline
from casewell.storage import table

from .carriers import CALLS, calls, crossings, payments
from .registry import query

def rows_n(name: str):
    return F.count(F.lit(1)).alias(name)


# --- projections, filters, predicates -----------------------------------------------------------


@query("p1_case_slice", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey::VARCHAR = '7'")
def p1(spark, sf):
    return tables.case_slice(table(spark, sf, "orders"), "o_custkey", 7).select("o_orderkey", "o_totalprice")


@query("p2_membership", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def p2(spark, sf):
    return table(spark, sf, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("p3_f40_parseable_times", """SELECT l_orderkey, l_linenumber, l_shipdate AS ts FROM lineitem WHERE l_linenumber % 2 = 0""")
def p3(spark, sf):
    li = table(spark, sf, "lineitem")
    text = F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss")).otherwise(F.lit("soon"))
    return li.select("l_orderkey", "l_linenumber", parse_time(text).cast("timestamp_ntz").alias("ts")).filter("ts is not null")


@query("p5_conditional_risk", f"WITH {CALLS} SELECT call_id, (CASE WHEN duration_s < 10 THEN 65 ELSE 30 END)::INT AS risk FROM calls")
def p5(spark, sf):
    return calls(spark, sf).select("call_id", timeline.call_risk(F.col("duration_s")).alias("risk"))


@query("p6_p7_rename_and_defaults", "SELECT s_suppkey AS id, s_name AS label, 'LOW' AS tier, 0 AS risk FROM supplier")
def p6(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"))
    return tables.with_defaults(rows, {"label": "none", "tier": "LOW", "risk": 0})


@query("p8_first_filled", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), c_mktsegment) AS label FROM customer")
def p8(spark, sf):
    name = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", tables.first_filled(name, F.col("c_mktsegment")).alias("label"))


@query("p9_sender_receiver", """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey ELSE l_suppkey END AS sender,
  CASE WHEN l_returnflag = 'R' THEN l_suppkey ELSE l_partkey END AS receiver FROM lineitem""")
def p9(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("kind", F.when(F.col("l_returnflag") == "R", "dr").otherwise("CR"))
    return tables.direction(rows, "kind", "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber", "sender", "receiver")


@query("p10_unpivot_roles", "SELECT p_partkey, role, name FROM (SELECT p_partkey, 'brand' AS role, p_brand AS name FROM part UNION ALL SELECT p_partkey, 'type', p_type FROM part UNION ALL SELECT p_partkey, 'name', p_name FROM part) WHERE name IS NOT NULL")
def p10(spark, sf):
    return tables.unpivot_roles(table(spark, sf, "part"), "p_partkey", {"brand": "p_brand", "type": "p_type", "name": "p_name"})


@query("p11_explode_list", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def p11(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("p12_call_adapter", f"WITH {CALLS} SELECT entity_a, entity_b, ts, case_id, duration_s FROM calls")
def p12(spark, sf):
    return calls(spark, sf).select("entity_a", "entity_b", "ts", "case_id", "duration_s")


@query("p13_payment_adapter", "SELECT o_orderkey AS payment_id, o_custkey AS sender, o_totalprice AS amount FROM orders")
def p13(spark, sf):
    return payments(spark, sf).select("payment_id", "sender", "amount")


@query("p14_exclude_unknown", "SELECT p_partkey FROM part WHERE lower(trim(CASE WHEN p_size < 10 THEN ' Unknown ' WHEN p_size < 20 THEN '' ELSE p_name END)) NOT IN ('', 'unknown')")
def p14(spark, sf):
    name = F.when(F.col("p_size") < 10, " Unknown ").when(F.col("p_size") < 20, "").otherwise(F.col("p_name"))
    return table(spark, sf, "part").filter(~F.lower(F.trim(name)).isin("", "unknown")).select("p_partkey")


@query("p15_exclude_plazas", "SELECT s_suppkey FROM supplier WHERE NOT regexp_matches(s_name, '(?i)supplier#0+[1-4]') AND NOT regexp_matches(s_name, '(?i)^tp-\\d')")
def p15(spark, sf):
    return table(spark, sf, "supplier").filter(~F.col("s_name").rlike(r"(?i)supplier#0+[1-4]") & ~F.col("s_name").rlike(r"(?i)^tp-\d")).select("s_suppkey")


@query("p16_keyword_and_dates", """SELECT o_orderkey FROM orders WHERE (contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderstatus), 'urgent'))
  AND o_orderdate::DATE >= DATE '1995-01-01' AND o_orderdate::DATE <= DATE '1996-12-31'""")
def p16(spark, sf):
    rows = table(spark, sf, "orders")
    return tables.search(rows, "URGENT", ["o_orderpriority", "o_orderstatus"], "o_orderdate", "1995-01-01", "1996-12-31").select("o_orderkey")


@query("p16_message_search", "SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'the') OR contains(lower(role), 'the')")
def p16b(spark, sf):
    return tables.search(table(spark, sf, "conversations"), "the", ["text", "role"]).select("conv_id", "turn")


@query("p17_role_filter", "SELECT conv_id, turn FROM conversations WHERE role = 'user'")
def p17(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'user'").select("conv_id", "turn")


@query("p18_score_threshold", "SELECT event_id, value FROM events WHERE value >= 55")
def p18(spark, sf):
    return table(spark, sf, "events").filter("value >= 55").select("event_id", "value")


@query("p19_snippet", "SELECT doc_id, substr(text, greatest(strpos(text, 'the') - 20, 1), strpos(text, 'the') + 100 - greatest(strpos(text, 'the') - 20, 1)) AS snippet FROM documents WHERE strpos(text, 'the') > 0")
def p19(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tables.snippet(F.col("text"), "the", 20, 100).alias("snippet")).filter("snippet is not null")


# --- joins ---------------------------------------------------------------------------------------


@query("j5_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j5(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_semi").select("c_custkey")


@query("j6_lookup_default", "SELECT c_custkey, coalesce(s_nationkey, 1) AS community FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def j6(spark, sf):
    found = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("community"))
    return tables.with_lookup(table(spark, sf, "customer").select("c_custkey"), found, "c_custkey", "community", 1)


@query("j7_j8_child_fan_out", "SELECT c_custkey, count(o_orderkey)::BIGINT AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def j7(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(rows_n("n"), F.sum("o_totalprice").alias("total"))
    out = table(spark, sf, "customer").select("c_custkey").join(sums, "c_custkey", "left")
    return out.select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query("j9_first_child", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) ON c_custkey = o_custkey AND k = 1")
def j9(spark, sf):
    children = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return tables.first_child(table(spark, sf, "customer").select("c_custkey"), children, "c_custkey", ["o_orderdate", "o_orderkey"]).select("c_custkey", "o_orderkey")


@query("j10_j15_hash_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j10(spark, sf):
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select("s_suppkey", "n_name", "r_name")


@query("j13_j16_normalized_join", "SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON right(regexp_replace(c_name, '\\D', '', 'g'), 4) = right(regexp_replace(s_name, '\\D', '', 'g'), 4)")
def j13(spark, sf):
    key = lambda c: F.right(F.regexp_replace(c, r"\D", ""), F.lit(4))
    c = table(spark, sf, "customer").select("c_custkey", key("c_name").alias("k"))
    return c.join(table(spark, sf, "supplier").select("s_suppkey", key("s_name").alias("k")), "k").select("c_custkey", "s_suppkey")


@query("j14_degree_join", "SELECT c_custkey, count(DISTINCT l_suppkey)::BIGINT AS degree FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def j14(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    degrees = o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_distinct("l_suppkey").alias("degree"))
    return tables.with_lookup(table(spark, sf, "customer").select("c_custkey"), degrees, "c_custkey", "degree", 0)


@query("j20_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j20(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "left_anti").select("c_custkey")


# --- aggregations --------------------------------------------------------------------------------


@query("a4_percentile", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.75), 4) AS p75 FROM customer GROUP BY 1")
def a4(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.round(F.percentile("c_acctbal", 0.75), 4).alias("p75"))


@query("a5_count_by_category", "SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY 1")
def a5(spark, sf):
    return tables.counts(table(spark, sf, "events"), "event_type")


@query("a6_count_distinct", "SELECT event_type, count(DISTINCT user_id)::BIGINT AS persons FROM events GROUP BY 1")
def a6(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("persons"))


@query("a7_mode", "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS k FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
def a7(spark, sf):
    return tables.mode(table(spark, sf, "events"), "user_id", "event_type")


@query("a8_max_risk", "SELECT user_id, max(value) AS top FROM events GROUP BY 1")
def a8(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max("value").alias("top"))


@query("a9_share", "SELECT round(100.0 * count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) / greatest(count(*), 1), 1) AS percent FROM orders")
def a9(spark, sf):
    return tables.share_of(table(spark, sf, "orders"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))


@query("a10_conditional_count", "SELECT c_mktsegment, count(*) FILTER (c_acctbal < 0)::BIGINT AS n FROM customer GROUP BY 1")
def a10(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") < 0).alias("n"))


@query("a11_set_aggregate", "SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY 1")
def a11(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a12_weighted_edges", "SELECT o_custkey, l_suppkey, round(sum(l_quantity), 2) AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def a12(spark, sf):
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"]).groupBy("o_custkey", "l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("weight"))


@query("a13_bounded_list", "SELECT user_id, array_to_string(list(event_id ORDER BY ts, event_id), ',') AS first_events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k <= 25 GROUP BY 1")
def a13(spark, sf):
    kept = tables.top_per_group(table(spark, sf, "events"), 25, ["user_id"], ["ts", "event_id"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_id"))), lambda x: x["event_id"].cast("string"))
    return kept.groupBy("user_id").agg(F.array_join(ordered, ",").alias("first_events"))


@query("a14_first_known", "SELECT o_custkey, arg_min(CASE WHEN o_totalprice > 100000 THEN o_orderpriority END, o_orderkey) FILTER (o_totalprice > 100000) AS priority FROM orders GROUP BY 1")
def a14(spark, sf):
    from casewell.operators.graph import first_known

    rows = table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderpriority")).alias("priority"))
    return first_known(rows, "o_custkey", ["priority"])


@query("a15_most_frequent_then_longest", "SELECT p_brand, p_type AS name FROM (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, length(p_type) DESC, p_type) AS k FROM part GROUP BY 1, 2) WHERE k = 1")
def a15(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(rows_n("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), (-F.length("p_type")).alias("l"), "p_type"))
    return n.groupBy("p_brand").agg(best.alias("b")).select("p_brand", F.col("b.p_type").alias("name"))


@query("a17_extraction_metrics", """WITH x AS (SELECT count(*) AS got, count(*) + (SELECT count(*) FROM nation) AS want FROM region)
  SELECT round(least(1.0, got / (want + 1e-5)), 4) AS prec, round(least(1.0, got / (want + 1e-5)), 4) AS rec, round(2 * least(1.0, got / (want + 1e-5)) ** 2 / (2 * least(1.0, got / (want + 1e-5)) + 1e-5), 4) AS f1 FROM x""")
def a17(spark, sf):
    from casewell.operators.extraction import metrics

    got = table(spark, sf, "region").agg(rows_n("got"))
    want = table(spark, sf, "nation").agg(rows_n("want")).scalar()
    out = got.select("got", (F.col("got") + want).alias("want"))
    return metrics(out, "want", "got").withColumnsRenamed({"precision": "prec", "recall": "rec", "f1_score": "f1"})


@query("a19_report_list", "SELECT s_nationkey, array_to_string(list_sort(list_distinct(list(s_name))), '; ') AS reports FROM supplier GROUP BY 1")
def a19(spark, sf):
    return tables.joined_list(table(spark, sf, "supplier").withColumnRenamed("s_name", "reports"), "s_nationkey", "reports")


@query("a20_floored_balance", """WITH RECURSIVE x AS (SELECT o_custkey, o_orderkey, (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END * o_totalprice::DECIMAL(18, 2))::DECIMAL(18, 2) * 0.001::DECIMAL(4, 3) AS amount,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
  f AS (SELECT o_custkey, o_orderkey, k, greatest(500, 1000 + amount)::DECIMAL(28, 8) AS b FROM x WHERE k = 1
  UNION ALL SELECT x.o_custkey, x.o_orderkey, x.k, greatest(500, f.b + x.amount)::DECIMAL(28, 8) FROM f JOIN x ON x.o_custkey = f.o_custkey AND x.k = f.k + 1)
  SELECT o_custkey, o_orderkey, round(b, 2)::DOUBLE AS balance FROM f""")
def a20(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,2)") * F.lit("0.001").cast("decimal(4,3)")
    signed = F.when(F.col("o_orderstatus") == "F", price).otherwise(-price)
    return tables.running_balance(table(spark, sf, "orders").withColumn("amount", signed), "o_custkey", "o_orderkey", "amount", 1000, 500)


@query("a21_share_of_largest", "SELECT event_type, n::BIGINT AS n, round(n / max(n) OVER () * 100, 2) AS percent FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def a21(spark, sf):
    return tables.share_of_largest(tables.counts(table(spark, sf, "events"), "event_type"), "n")


@query("a22_complement", "SELECT user_id, greatest(100 - count(*), 0)::BIGINT AS rest FROM events GROUP BY 1")
def a22(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(tables.complement(F.count(F.lit(1)), F.lit(100).cast("long")).alias("rest"))


# --- windows, order, limits ----------------------------------------------------------------------


@query("w1_z_score", "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 2) + 0.0 AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def w1(spark, sf):
    from casewell.operators.detectors import z_scores

    return z_scores(table(spark, sf, "events"), "event_type", "value", 2).select("event_id", "z")


@query("w3_forward_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN CURRENT ROW AND INTERVAL 48 HOUR FOLLOWING)::BIGINT AS n FROM events")
def w3(spark, sf):
    return frames.forward_frame(table(spark, sf, "events"), ["user_id"], "ts", 48 * 3600, {"n": lambda: F.count(F.lit(1))}).select("event_id", "n")


@query("w4_forward_fill", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS asked FROM conversations")
def w4(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("asked"))
    return frames.forward_fill(rows, "asked", "turn", "conv_id")


@query("w5_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def w5(spark, sf):
    return frames.keep_first(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("w6_sequential_ids", "SELECT n_name, format('NET-{:03d}', row_number() OVER (ORDER BY n_name)) AS id FROM nation")
def w6(spark, sf):
    return frames.numbered(table(spark, sf, "nation").select("n_name"), "id", "NET-%03d", ["n_name"])


@query("w7_l2_ranked", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def w7(spark, sf):
    best = tables.top(table(spark, sf, "customer"), 25, [F.desc("c_acctbal"), "c_custkey"])
    return best.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("place"))


@query("w8_cycling", "SELECT n_nationkey, i::INT AS i, ['Vashi', 'Khalapur', 'Urse', 'Khed'][(i % 4) + 1] AS plaza, (i * 45)::INT AS minutes FROM nation, generate_series(0, 5) t(i)")
def w8(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i"))
    return rows.select("n_nationkey", "i", tables.cycled(F.col("i"), "Vashi", "Khalapur", "Urse", "Khed").alias("plaza"), (F.col("i") * 45).alias("minutes"))


@query("w9_last_of_group", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1 AS flagged FROM orders")
def w9(spark, sf):
    return tables.last_of_group(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("l4_first_in_order", f"WITH {CALLS} SELECT call_id, entity_a FROM calls ORDER BY call_id LIMIT 100")
def l4(spark, sf):
    return timeline.first_calls(calls(spark, sf), "call_id").select("call_id", "entity_a")


@query("l5_capped_lists", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def l5(spark, sf):
    return tables.top_per_group(table(spark, sf, "orders"), 5, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("l6_l8_display_cap", "SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 300")
def l6(spark, sf):
    return tables.top(table(spark, sf, "part"), 300, ["p_name", "p_partkey"]).select("p_partkey", "p_name")


@query("l7_u7_distinct_sorted", "SELECT DISTINCT o_custkey FROM orders ORDER BY 1")
def l7(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct().orderBy("o_custkey")


@query("l10_descending_history", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def l10(spark, sf):
    return tables.top(table(spark, sf, "events"), 50, [F.desc("ts"), F.desc("event_id")]).select("event_id", "ts")


# --- set operations and the timeline -------------------------------------------------------------


@query("u2_both_sides", f"WITH {CALLS} SELECT entity, count(*)::BIGINT AS n FROM (SELECT entity_a AS entity FROM calls UNION ALL SELECT entity_b FROM calls) GROUP BY 1")
def u2(spark, sf):
    c = calls(spark, sf)
    return tables.counts(c.select(F.col("entity_a").alias("entity")).union(c.select("entity_b")), "entity")


@query("u4_set_union", "SELECT DISTINCT k FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier)")
def u4(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).union(table(spark, sf, "supplier").select("s_suppkey")).distinct()


@query("u5_u6_set_comparison", """WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM events WHERE event_id % 2 = 0 GROUP BY 1),
  b AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS k FROM events WHERE event_id % 2 = 1 GROUP BY 1)
  SELECT user_id, len(list_intersect(a.k, b.k))::INT AS shared, a.k <> b.k AS differ FROM a JOIN b USING (user_id)""")
def u5(spark, sf):
    e = table(spark, sf, "events")
    half = lambda r, n: e.filter(F.col("event_id") % 2 == r).groupBy("user_id").agg(F.collect_set("event_type").alias(n))
    differ = (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))) > 0
    return half(0, "a").join(half(1, "b"), "user_id").select("user_id", F.size(F.array_intersect("a", "b")).alias("shared"), differ.alias("differ"))


def merged_timeline(spark, sf):
    c, t, p = calls(spark, sf), crossings(spark, sf), payments(spark, sf)
    person = lambda x: F.col(x).cast("string")
    call = timeline.events(c, "CALL", "calls", case_id=F.col("case_id"), ts=F.col("ts"), person=person("entity_a"), location=F.lit("tower"), description=F.concat(F.lit("to "), person("entity_b")), risk_score=timeline.call_risk(F.col("duration_s")))
    wrong = F.upper("cross_match") == "MISMATCH"
    toll = timeline.events(t, "TOLL", "tolls", case_id=F.col("case_id"), ts=F.col("ts"), person=person("vehicle"), location=F.col("plaza"), description=F.col("cross_match"), risk_score=timeline.toll_risk(wrong))
    paid = timeline.events(p, "PAYMENT", "bank", case_id=F.concat(F.lit("C"), (F.col("sender") % 10).cast("string")), ts=F.col("ts"), person=person("sender"), location=F.lit("bank"), description=F.lit("paid"), risk_score=F.when(F.col("amount") > 300000, 70).otherwise(20))
    return timeline.merge(call, toll, paid)


TIMELINE = f"""WITH {CALLS}, t AS (
  SELECT case_id, ts, 'CALL' AS event_type, entity_a::VARCHAR AS person, 'tower' AS location, 'to ' || entity_b::VARCHAR AS description, 'calls' AS source, CASE WHEN duration_s < 10 THEN 65 ELSE 30 END AS risk_score FROM calls
  UNION ALL SELECT 'C' || (user_id % 10)::VARCHAR, ts, 'TOLL', user_id::VARCHAR, event_type, CASE WHEN value >= 150 THEN 'mismatch' ELSE 'MATCH' END, 'tolls', CASE WHEN value >= 150 THEN 95 ELSE 40 END FROM events
  UNION ALL SELECT 'C' || (o_custkey % 10)::VARCHAR, o_orderdate, 'PAYMENT', o_custkey::VARCHAR, 'bank', 'paid', 'bank', CASE WHEN o_totalprice > 300000 THEN 70 ELSE 20 END FROM orders)"""


@query("u1_l1_timeline", TIMELINE + " SELECT case_id, ts, event_type, person, location, description, source, risk_score::INT AS risk_score, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time, strftime(ts, '%A') AS weekday FROM t")
def u1(spark, sf):
    return merged_timeline(spark, sf)


@query("a6_a8_timeline_overview", TIMELINE + """, m AS (SELECT case_id, location, row_number() OVER (PARTITION BY case_id ORDER BY count(*) DESC, location) AS k FROM t GROUP BY 1, 2)
  SELECT t.case_id, count(*)::BIGINT AS n_events, count(DISTINCT person)::BIGINT AS n_persons, max(risk_score)::INT AS max_risk, any_value(m.location) AS location FROM t JOIN m ON t.case_id = m.case_id AND k = 1 GROUP BY 1""")
def a6_timeline(spark, sf):
    return timeline.overview(merged_timeline(spark, sf))


@query("s15_unified_report", """SELECT c_custkey AS case_id, c_name || ' | ' || c_mktsegment || ' | ' || coalesce((SELECT array_to_string(list(o_orderkey::VARCHAR ORDER BY o_orderkey), '; ') FROM orders WHERE o_custkey = c_custkey), 'NONE') AS report FROM customer""")
def s15(spark, sf):
    from casewell.operators.reports import unified_report

    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), "c_name", "c_mktsegment")
    paid = table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").cast("string").alias("line"), F.col("o_orderkey").alias("seq"))
    return unified_report(cases, "case_id", ["c_name", "c_mktsegment"], {"orders": paid})
