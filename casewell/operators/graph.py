"""The graph of entities: building, merging, links across cases, neighbourhoods, paths.

Nodes are ``id, type, label, case_ids, roles``; undirected edges ``src < dst, weight,
relation_types, case_ids, evidence``. Mentions of an edge (``src, dst, relation, case_id, seq,
evidence``) are aggregated by ``merge_edges``; ``seq`` is the order of arrival.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.text import account, display_name, person_and_role, phone_digits, plate, vehicles_of
from casewell.storage import scratch, stored

MOST_EVIDENCE = 25
ROLES = ("Informant", "Victim", "Accused")


def node_id(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"{kind}::"), key)


def mention(src: Column, dst: Column, relation: str, case: Column, seq: Column, evidence: Column) -> list[Column]:
    return [
        src.alias("src"),
        dst.alias("dst"),
        F.lit(relation).alias("relation"),
        case.cast("string").alias("case_id"),
        seq.alias("seq"),
        evidence.cast("string").alias("evidence"),
    ]


def people_of_cases(cases: DataFrame) -> DataFrame:
    """Wide to long: one row per case and role that names somebody. ``cases`` has ``case_id, seq`` and
    ``<role>_name, <role>_contact, <role>_vehicles`` in lower case."""
    stack = ", ".join(f"'{r}', {r.lower()}_name, {r.lower()}_contact, {r.lower()}_vehicles" for r in ROLES)
    long = cases.select("case_id", "seq", F.expr(f"stack({len(ROLES)}, {stack}) as (role, name, contact, vehicles)"))
    return long.withColumn("name", display_name(F.col("name"))).filter("name is not null")


def case_mentions(cases: DataFrame) -> DataFrame:
    people = people_of_cases(cases)
    person, case = node_id("PERSON", F.col("name")), node_id("CASE", F.col("case_id"))
    roles = [
        people.filter(F.col("role") == r).select(*mention(person, case, f"INVOLVED_AS_{r.upper()}", F.col("case_id"), F.col("seq"), F.lit(None)))
        for r in ROLES
    ]
    phones = people.select(*mention(person, node_id("PHONE", phone_digits(F.col("contact"))), "OWNS_PHONE", F.col("case_id"), F.col("seq"), F.col("contact")))
    plates = people.withColumn("v", F.explode(vehicles_of(F.col("vehicles"))))
    plates = plates.select(*mention(person, node_id("VEHICLE", plate(F.col("v.plate"))), "OWNS_VEHICLE", F.col("case_id"), F.col("seq"), F.col("v.description")))
    who = {r: display_name(F.col(f"{r.lower()}_name")) for r in ROLES}
    accused = cases.select(*mention(node_id("PERSON", who["Accused"]), node_id("PERSON", who["Victim"]), "ACCUSED_OF_CRIME_AGAINST", F.col("case_id"), F.col("seq"), F.lit(None)))
    reported = cases.select(*mention(node_id("PERSON", who["Informant"]), node_id("PERSON", who["Victim"]), "REPORTED_INCIDENT_FOR", F.col("case_id"), F.col("seq"), F.lit(None)))
    return reduce(DataFrame.unionByName, [*roles, phones, plates, accused, reported])


def call_mentions(calls: DataFrame) -> DataFrame:
    """``caller, callee, case_id, seq, detail``."""
    a, b = node_id("PHONE", phone_digits(F.col("caller"))), node_id("PHONE", phone_digits(F.col("callee")))
    return calls.select(*mention(a, b, "CALLED", F.col("case_id"), F.col("seq"), F.col("detail")))


def toll_mentions(tolls: DataFrame) -> DataFrame:
    """``vehicle, plaza, case_id, seq, detail``."""
    a, b = node_id("VEHICLE", plate(F.col("vehicle"))), node_id("LOCATION", display_name(F.col("plaza")))
    return tolls.select(*mention(a, b, "CROSSED_TOLL", F.col("case_id"), F.col("seq"), F.col("detail")))


def bank_mentions(bank: DataFrame) -> DataFrame:
    """``person, account, counterparty, kind (CR/DR), case_id, seq, detail``: ownership, and transfers
    from sender to receiver."""
    own = node_id("ACCOUNT", account(F.col("account")))
    other = node_id("ACCOUNT", account(F.col("counterparty")))
    person = node_id("PERSON", display_name(person_and_role(F.col("person"))["name"]))
    debit = F.upper("kind") == "DR"
    owns = bank.select(*mention(person, own, "OWNS_ACCOUNT", F.col("case_id"), F.col("seq"), F.lit(None)))
    moved = bank.select(*mention(F.when(debit, own).otherwise(other), F.when(debit, other).otherwise(own), "TRANSFERRED_TO", F.col("case_id"), F.col("seq"), F.col("detail")))
    return owns.unionByName(moved)


def subscriber_mentions(subscribers: DataFrame) -> DataFrame:
    """``phone, subscriber, case_id, seq``."""
    a, b = node_id("PERSON", display_name(F.col("subscriber"))), node_id("PHONE", phone_digits(F.col("phone")))
    return subscribers.select(*mention(a, b, "REGISTERED_SUBSCRIBER_OF", F.col("case_id"), F.col("seq"), F.lit(None)))


def sorted_set(c: str | Column) -> Column:
    return F.array_sort(F.collect_set(c))


def merge_edges(mentions: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """Undirected edges: weight is the number of mentions, sets are united, the first ``most``
    pieces of evidence stay. Null ends and loops are left out.

    Weight and sets aggregate map-side. Only mentions with evidence are ranked, and the rank
    limit is applied before their shuffle, so a hot edge sends at most ``most`` rows a task.
    """
    ends = mentions.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).filter("src is not null and dst is not null and src <> dst")
    sums = ends.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"), sorted_set("relation").alias("relation_types"), sorted_set("case_id").alias("case_ids"))
    first = Window.partitionBy("a", "b").orderBy("seq", "relation", "evidence")
    kept = ends.filter("evidence is not null").select("a", "b", "seq", "relation", "evidence").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    lists = kept.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("n", "relation", "evidence"))).alias("evidence"))
    out = sums.join(lists, ["a", "b"], "left")
    return out.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight", "relation_types", "case_ids", F.coalesce("evidence", F.array().cast("array<struct<n:int,relation:string,evidence:string>>")).alias("evidence"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """``id, type, label, case_ids`` of all ends of edges."""
    ends = edges.select(F.col("src").alias("id"), "case_ids").unionByName(edges.select(F.col("dst").alias("id"), "case_ids"))
    cases = ends.withColumn("case_id", F.explode_outer("case_ids")).groupBy("id").agg(sorted_set("case_id").alias("case_ids"))
    return cases.select("id", F.split_part("id", F.lit("::"), F.lit(1)).alias("type"), F.regexp_replace("id", "^[A-Z]+::", "").alias("label"), "case_ids")


def first_known(rows: DataFrame, key: str, values: list[str], seq: str = "seq") -> DataFrame:
    """First value that is not null, per key and column, in order of arrival."""
    return rows.groupBy(key).agg(*[F.min_by(v, F.when(F.col(v).isNotNull(), F.col(seq))).alias(v) for v in values])


def shared_identifier_links(owned: DataFrame) -> DataFrame:
    """``person, identifier, kind, case_ids`` to pairs of persons that share an identifier:
    ``person_a < person_b, kind, identifier, cross_case``; ``cross_case`` if their cases differ."""
    owned = stored(owned.select("person", "identifier", "kind", "case_ids"), "owned")  # a join of plain shuffles, in which a hot identifier is split
    a = owned.select(F.col("person").alias("person_a"), "identifier", "kind", F.col("case_ids").alias("cases_a"))
    b = owned.select(F.col("person").alias("person_b"), "identifier", "kind", F.col("case_ids").alias("cases_b"))
    differ = (F.size(F.array_except("cases_a", "cases_b")) + F.size(F.array_except("cases_b", "cases_a"))) > 0
    return a.join(b, ["identifier", "kind"]).filter("person_a < person_b").select("person_a", "person_b", "kind", "identifier", differ.alias("cross_case"))


def case_set_links(owned: DataFrame) -> DataFrame:
    """``kind, identifier, case_ids, n_persons, n_links, n_cross_links``: a row for each distinct set of cases of an
    identifier's persons. Two persons of one row have the same cases; any two of different rows of
    an identifier are a cross-case link. ``n_links`` counts the pairs within a row, ``n_cross_links`` those with
    persons of later rows (in order of the sets), so both add up to the numbers of pairs. Counting
    takes no pair; persons of a set are those of ``owned``."""
    sets = owned.select("kind", "identifier", F.array_sort("case_ids").alias("case_ids")).groupBy("kind", "identifier", "case_ids").agg(F.count(F.lit(1)).alias("n_persons"))
    later = Window.partitionBy("kind", "identifier").orderBy(F.desc("case_ids")).rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_persons")
    after = F.coalesce(F.sum(n).over(later), F.lit(0))
    return sets.select("kind", "identifier", "case_ids", "n_persons", F.expr("n_persons * (n_persons - 1) div 2").alias("n_links"), (n * after).alias("n_cross_links"))


def cross_case_count(owned: DataFrame) -> DataFrame:
    """One row ``n``: pairs of persons that share an identifier and differ in their cases. Of n persons of an
    identifier n (n - 1) / 2 pairs, less as many for each set of equal cases: two aggregates, no join."""
    sets = owned.select("kind", "identifier", F.array_sort("case_ids").alias("case_ids")).groupBy("kind", "identifier", "case_ids").agg(F.count(F.lit(1)).alias("m"))
    m = F.col("m").cast("decimal(20,0)")
    per = sets.groupBy("kind", "identifier").agg(F.sum(m).alias("n"), F.sum(m * m).alias("same"))
    return per.agg(F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2), F.lit(0)).cast("long").alias("n"))


def apply_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Edges with ends moved to their canonical node (``alias, canonical``) and merged again:
    weights add up, sets unite, evidence stays capped, edges within one entity go. The cap is
    applied before the evidence is gathered, so a hot edge is no large group."""
    moved = edges
    for end in ("src", "dst"):
        names = aliases.select(F.col("alias").alias(end), F.col("canonical").alias("__to"))
        moved = moved.join(names, end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    moved = moved.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst")).filter("src <> dst").select("a", "b", "weight", "relation_types", "case_ids", "evidence")
    moved = stored(moved, "moved")
    sets = {c: moved.select("a", "b", F.explode(c).alias(c)).groupBy("a", "b").agg(sorted_set(c).alias(c)) for c in ("relation_types", "case_ids")}
    first = Window.partitionBy("a", "b").orderBy("e")
    kept = moved.select("a", "b", F.explode("evidence").alias("e")).withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= MOST_EVIDENCE)
    out = moved.groupBy("a", "b").agg(F.sum("weight").alias("weight"))
    for c, rows in (*sets.items(), ("evidence", kept.groupBy("a", "b").agg(F.array_sort(F.collect_list("e")).alias("evidence")))):
        out = out.join(rows, ["a", "b"], "left").withColumn(c, F.coalesce(c, F.array().cast(moved.schema[c].dataType)))
    return out.withColumnsRenamed({"a": "src", "b": "dst"})


def both_ways(edges: DataFrame, *more: str) -> DataFrame:
    return edges.select("src", "dst", *more).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))


def neighbours(edges: DataFrame, node) -> DataFrame:
    """``id, relation_types`` of the direct neighbours."""
    return both_ways(edges, "relation_types").filter(F.col("src") == node).select(F.col("dst").alias("id"), F.array_sort("relation_types").alias("relation_types"))


def within_hops(edges: DataFrame, node, hops: int) -> DataFrame:
    """``id, distance`` of all nodes within ``hops``, the start included; empty if it is unknown."""
    ways = both_ways(edges)
    kind = edges.schema["src"].dataType
    start = ways.filter(F.col("src") == F.lit(node).cast(kind)).select(F.col("src").alias("id")).limit(1).withColumn("distance", F.lit(0))
    with scratch(edges.sparkSession) as keep:
        found = front = stored(start, "front")
        for d in range(1, hops + 1):
            front = front.join(ways, front["id"] == ways["src"]).select(F.col("dst").alias("id")).distinct().join(found, "id", "left_anti")
            front = stored(front.withColumn("distance", F.lit(d)), "front")
            found = found.unionByName(front)
        return keep(stored(found, "hops", narrow=True))


def ego_graph(edges: DataFrame, node, hops: int = 1) -> DataFrame:
    """Edges between nodes within ``hops`` of ``node``."""
    near = within_hops(edges, node, hops).select("id")
    return edges.join(near.withColumnRenamed("id", "src"), "src", "left_semi").join(near.withColumnRenamed("id", "dst"), "dst", "left_semi")


def shortest_path(edges: DataFrame, start, end, most: int = 6) -> DataFrame:
    """One row with ``path`` and ``length`` of the first shortest path in order of its nodes; no row if
    an end is unknown or more than ``most`` edges away. The search keeps one path per node."""
    ways = both_ways(edges)
    kind = edges.schema["src"].dataType
    s, e = F.lit(start).cast(kind), F.lit(end).cast(kind)
    front = stored(ways.filter(F.col("src") == s).select(F.col("src").alias("id")).limit(1).withColumn("path", F.array("id")), "front")
    seen = front.select("id")
    for _ in range(most + 1):
        hit = front.filter(F.col("id") == e)
        if not hit.isEmpty() or front.isEmpty():
            return hit.select("path", (F.size("path") - 1).alias("length"))
        step = front.join(ways, front["id"] == ways["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = stored(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "front")
        seen = seen.union(front.select("id"))
    return front.limit(0).select("path", (F.size("path") - 1).alias("length"))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of nodes and edges, density to five digits."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("nodes")), edges.agg(F.count(F.lit(1)).alias("edges"))
    both = n.select("nodes", m.scalar().alias("edges"))
    density = F.round(F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1.0)), F.lit(0.0)), 5)
    return both.withColumn("density", density)


def find_case(nodes: DataFrame, wanted: str) -> DataFrame:
    """Nodes whose id or label is the wanted case, in any case, with or without prefix."""
    w = wanted.lower()
    return nodes.filter(F.lower("id").isin(w, f"case::{w}") | (F.lower("label") == w))
