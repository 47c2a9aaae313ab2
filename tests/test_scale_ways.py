"""What large accounts, identifiers, blocks and graphs take instead of one group: held against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casewell.operators import analytics, frames, graph, resolution, tables
from casewell.operators.components import spanning_forest, sums_to_end

from .test_whole_graph import RANDOM, naive_betweenness

BARBELL = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


# ---- accounts


def accounts(seed=3):
    r = random.Random(seed)
    return [("hot" if r.random() < 0.5 else r.choice(["a", "b", None, "c"]), i, r.choice([None, *range(-900, 700, 37)])) for i in range(400)]


@pytest.mark.parametrize("part_rows", [60, 10_000])
def test_balance_of_a_hot_account_is_many_tasks(spark, part_rows):
    rows = accounts()
    frame = spark.createDataFrame(rows, "k string, n int, x int")
    got = {r.n: r.balance for r in tables.running_balance(frame, "k", "n", "x", 1000, 500, part_rows).collect()}
    now = {}
    for k, n, x in rows:
        now[k] = max(Decimal(500), now.get(k, Decimal(1000)) + (x or 0))
        assert got[n] == float(now[k]), (k, n)
    largest = frames.in_ranges(frame, ["k", "n"], part_rows).groupBy("__part").count().agg(F.max("count")).first()[0]
    assert largest <= 3 * part_rows


@pytest.mark.parametrize("part_rows", [60, 10_000])
def test_last_of_a_hot_group(spark, part_rows):
    rows = accounts(4)
    found = tables.last_of_group(spark.createDataFrame(rows, "k string, n int, x int"), "k", "n", part_rows=part_rows).collect()
    want = {k: max(n for j, n, _ in rows if j == k) for k, _, _ in rows}
    assert len(found) == len(rows) and {(r.k, r.n) for r in found if r.flagged} == set(want.items())
    assert tables.last_of_group(spark.createDataFrame([], "k string, n int"), "k", "n").count() == 0


# ---- identifiers


def test_links_are_counted_without_pairs(spark):
    r = random.Random(1)
    rows = [(f"p{i}", r.choice(["x", "y", "z"]), "PHONE", sorted(r.sample(["c1", "c2", "c3"], r.randrange(3)))) for i in range(60)]
    owned = spark.createDataFrame(rows, "person string, identifier string, kind string, case_ids array<string>")
    pairs = graph.shared_identifier_links(owned).collect()
    assert graph.cross_case_count(owned).first().n == sum(p.cross_case for p in pairs)
    sets = graph.case_set_links(owned)
    total = sets.agg(F.sum("n_links"), F.sum("n_cross_links")).first()
    assert tuple(total) == (sum(not p.cross_case for p in pairs), sum(p.cross_case for p in pairs))
    assert {(s.identifier, *s.case_ids): s.n_persons for s in sets.collect()} == Counter((i, *c) for _, i, _, c in rows)
    assert graph.cross_case_count(owned.limit(0)).first().n == 0
    plan = graph.cross_case_count(owned)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


# ---- records


def records(seed, n=90):
    r = random.Random(seed)
    names = ["Ravi Kumar", "Ravi Kumaar", "Ravi  Kumar", "Asha Patil", "Asha Patel", "", None, "१२३", "Unknown"]
    return [
        (i, r.choice(names), r.choice(["", None, "900", "901"]) if r.random() < 0.5 else None, r.choice(["1 Main Road", "1 Main Rd", "Hill View", "", None]), r.choice([[], None, ["MH1"], ["MH1", "MH2"]]) if r.random() < 0.3 else [], r.choice(["c1", "c2", "", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", [1, 3])
def test_likely_pairs_are_all_that_can_match(spark, seed):
    x = spark.createDataFrame(records(seed), "record_id int, name string, phone string, address string, vehicles array<string>, case_id string")
    every = resolution.score_pairs(x, resolution.candidate_pairs(x)).filter("decision <> 'NON_MATCH'").select("a", "b", "score").collect()
    assert sorted(every) == sorted(resolution.matching_pairs(x).select("a", "b", "score").collect())
    assert every


def test_profiles_are_compared_and_not_records(spark):
    """Ten times the records of the same values: as many profile pairs, and no pair of a sound that cannot match."""
    rows = [(n * 100 + i, name, None, place, ["V%d-%d" % (n, i)], "c1") for n in range(10) for i, (name, place) in enumerate([("Ravi Kumar", "Hill View"), ("Ravi Kumar", "Sea Side")])]
    x = spark.createDataFrame(rows, "record_id int, name string, phone string, address string, vehicles array<string>, case_id string")
    pairs = resolution.likely_pairs(x)
    assert pairs.count() == 2 * 45  # of equal addresses alone, as both have vehicles
    assert resolution.candidate_pairs(x).count() == 190


def paired(rows, wanted):
    """Scores of the pairs of a plain join of blocks, for those wanted."""
    keys = resolution.block_keys(rows)
    other = keys.withColumnRenamed("record_id", "b")
    pairs = keys.withColumnRenamed("record_id", "a").join(other, "block").filter("a < b").select("a", "b").distinct()
    return sorted(tuple(r) for r in resolution.score_pairs(rows, pairs).select(*wanted).collect())


@pytest.mark.parametrize(("seed", "chunk", "task"), [(5, 3, 50), (6, 256, 4_000_000)])
def test_pairs_of_faces_are_all_pairs(spark, monkeypatch, seed, chunk, task):
    monkeypatch.setattr(resolution, "CHUNK", chunk)
    monkeypatch.setattr(resolution, "TASK_PAIRS", task)
    x = spark.createDataFrame(records(seed), "record_id int, name string, phone string, address string, vehicles array<string>, case_id string")
    wanted = ["a", "b", "score", "decision", "name_similarity", "phone_agrees", "address_agrees", "vehicle_agrees", "case_agrees", "shared_vehicles"]
    plain = paired(x, wanted)
    assert sorted(map(repr, plain)) == sorted(repr(tuple(r)) for r in resolution.candidate_scores(x).select(*wanted).collect())
    assert sorted((r.a, r.b) for r in resolution.candidate_pairs(x).collect()) == [p[:2] for p in plain]
    faces, judged, placed = resolution.resolved(x)
    scored = resolution.score_pairs(x, resolution.candidate_pairs(x))
    assert sorted(resolution.clusters(x, scored).collect()) == sorted(placed.select("record_id", "entity_id").collect())
    inside = resolution.entity_evidence(scored, placed.select("record_id", "entity_id"))
    assert sorted(inside.collect()) == sorted(resolution.inner_pairs(faces, judged, placed).select(*inside.columns).collect())
    tops = inside.groupBy("entity_id").agg(F.max("score").alias("top"), F.count(F.lit(1)).alias("n_pairs"))
    assert sorted(tops.collect()) == sorted(resolution.inner_totals(faces, judged, placed).collect())


def test_no_pairs_of_equal_records_are_written(spark, monkeypatch):
    """300 equal records have 44,850 pairs: clusters take none of them, and pairs are written nowhere on the way."""
    largest, keep = [], resolution.stored

    def counted(df, label, **k):
        out = keep(df, label, **k)
        largest.append(out.count())
        return out

    monkeypatch.setattr(resolution, "stored", counted)
    rows = [(i, "Ravi Kumar", "900", "Hill View", ["MH1"], "c1") for i in range(300)]
    x = spark.createDataFrame(rows, "record_id int, name string, phone string, address string, vehicles array<string>, case_id string")
    assert {r.entity_id for r in resolution.resolved(x)[2].collect()} == {0}
    assert resolution.matching_pairs(x).count() == 300 * 299 // 2
    assert max(largest) == 300


# ---- graphs


def random_pairs(seed, n=60, m=70):
    r = random.Random(seed)
    return sorted({tuple(sorted((f"n{r.randrange(n)}", f"n{r.randrange(n)}"))) for _ in range(m)})


def naive_bridges(pairs):
    nodes = {v for e in pairs for v in e}
    whole = parts(pairs, nodes)
    return {tuple(sorted(e)) for e in pairs if e[0] != e[1] and parts([x for x in pairs if x != e], nodes) > whole}


def test_spanning_forest(spark):
    pairs = random_pairs(1, 40, 45) + [("hub", f"v{i}") for i in range(30)]
    forest = spanning_forest(edges(spark, [*pairs, ("z", "z"), (None, "z")]), "src", "dst").collect()
    found = {(r.ea, r.eb) for r in forest}
    assert found <= set(pairs) and len(found) == len(forest) == len({r.node for r in forest})
    nodes = {v for e in pairs if e[0] != e[1] for v in e}
    assert len(forest) == len(nodes) - parts(pairs, nodes) and parts(found, nodes) == parts(pairs, nodes)


def parts(pairs, nodes):
    """Number of components."""
    up = {v: v for v in nodes}

    def top(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in pairs:
        if a != b:
            up[top(a)] = top(b)
    return len({top(v) for v in nodes})


def test_sums_along_lists(spark):
    cells = spark.createDataFrame([(1, 2, 5), (2, 3, 6), (3, None, 9), (7, None, 1)], "id long, next long, x long")
    assert {r.id: r.x for r in sums_to_end(cells, "x").collect()} == {1: 6 ^ 9, 2: 9, 3: 0, 7: 0}


#: Two components, a hub over several ranges, trees and circles, a loop.
MIXED = [*random_pairs(4, 12, 14), *[("hub", f"v{i}") for i in range(14)], ("v1", "v2"), ("v3", "v4"), ("x", "x")]


@pytest.mark.parametrize(("pairs", "part_rows"), [(MIXED, 6)])
def test_bridges_without_a_group(spark, pairs, part_rows):
    frame = edges(spark, [*pairs, (None, "a"), ("a", None)])
    assert {(r.src, r.dst) for r in analytics.bridges(frame, part_rows).collect()} == naive_bridges(pairs)


def test_bridges_of_empty_graphs(spark):
    assert analytics.bridges(edges(spark, [("a", "a")])).count() == 0
    assert analytics.bridges(edges(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("sources", [11])
def test_betweenness_by_joins(spark, sources):
    far = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, RANDOM), most=0, sources=sources).collect()}
    near = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, RANDOM)).collect()}
    assert far == near and naive_betweenness(RANDOM).keys() == far.keys()


def modularity(pairs, placed):
    pairs = [p for p in set(pairs) if p[0] != p[1]]
    m, inside, share = len(pairs), Counter(), Counter()
    for a, b in pairs:
        share[placed[a]] += 1
        share[placed[b]] += 1
        inside[placed[a]] += placed[a] == placed[b]
    return sum(inside[c] / m - (share[c] / (2 * m)) ** 2 for c in share)


def rings(n, size):
    """Rings of cliques."""
    out = [(f"k{i}_{a}", f"k{i}_{b}") for i in range(n) for a in range(size) for b in range(a)]
    return out + [(f"k{i}_0", f"k{(i + 1) % n}_1") for i in range(n)]


@pytest.mark.parametrize(("pairs", "part_rows"), [(RANDOM, 10_000), (rings(8, 4), 5), (random_pairs(6, 50, 90), 10_000)])
def test_contracted_communities_come_near_the_greedy_ones(spark, pairs, part_rows):
    found = {r.id: r.community_id for r in analytics.contracted_communities(edges(spark, pairs), part_rows).collect()}
    greedy = {r.id: r.community_id for r in analytics.communities(edges(spark, pairs)).collect()}
    assert found.keys() == greedy.keys()
    assert modularity(pairs, found) >= 0.98 * modularity(pairs, greedy) - 1e-9


def test_communities_beyond_the_bound_are_contracted(spark):
    pairs = rings(3, 4)
    found = defaultdict(set)
    for r in analytics.communities(edges(spark, pairs), most=0).collect():
        found[r.community_id].add(r.id[:2])
    assert sorted(map(sorted, found.values())) == [["k0"], ["k1"], ["k2"]]


TWINS = [*[("hub", f"v{i}") for i in range(5)], ("hub", "x"), ("x", "y"), *[(h, f"w{i}") for h in ("hub", "y") for i in range(3)], ("p", "q"), ("q", "r"), ("r", "s"), ("s", "p")]


@pytest.mark.parametrize("most", [0, 1000])
def test_twins_are_searched_once(spark, monkeypatch, most):
    found, keep = [], analytics.stored
    monkeypatch.setattr(analytics, "stored", lambda df, label, **k: found.append((label, keep(df, label, **k))) or found[-1][1])
    got = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, TWINS), most=most, sources=4).collect()}
    plain = naive_betweenness(TWINS)
    assert got.keys() == plain.keys() and all(abs(got[k] - plain[k]) < 6e-5 for k in plain)
    assert [df.count() for label, df in found if label == "kinds"] == [6]  # of 15 nodes


def test_eigenvector_of_kinds(spark, monkeypatch):
    found, keep = [], analytics.stored
    monkeypatch.setattr(analytics, "stored", lambda df, label, **k: found.append((label, keep(df, label, **k))) or found[-1][1])
    pairs = [*TWINS, ("p", "p"), ("q", None)]
    got = {r.id: r.eigenvector for r in analytics.eigenvector(edges(spark, pairs), rounds=4, settle=False, digits=6).collect()}
    assert next(df.count() for label, df in found if label == "kinds") == 7  # of 15 nodes; p has itself as a neighbour
    near = defaultdict(set)
    for a, b in TWINS + [("p", "p")]:
        near[a].add(b)
        near[b].add(a)
    x = dict.fromkeys(near, 1.0)
    for _ in range(4):
        x = {v: x[v] + sum(x[w] for w in near[v]) for v in near}
    norm = sum(v * v for v in x.values()) ** 0.5
    assert got.keys() == x.keys() and all(abs(got[v] - x[v] / norm) < 2e-6 for v in x)


# ---- rows that come in large batches or from hot keys


def test_recordings_are_made_and_handed_over_few_at_a_time(spark):
    from casewell.plans import media as plans

    rows = plans._recordings(spark.range(1, 1201).coalesce(1).select(F.col("id").alias("no")))
    assert rows.rdd.getNumPartitions() == 3
    found = rows.select("path", "length", F.sha2("content", 256).alias("d")).collect()
    assert len({r.path for r in found}) == 1200 and {r.length for r in found} == {5 * 16_000 * 2 + 44} and len({r.d for r in found}) == 60


def test_least_rows_of_a_key(spark):
    rows = spark.createDataFrame([(k, i) for k in ("a", "b", None) for i in range(9)] + [("c", 5)], "k string, i int")
    found = frames.keep_least(rows, ["k"], [F.col("i")], 3).collect()
    assert sorted((r.k, r.i) for r in found) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1), ("b", 2), ("c", 5)]


def test_case_map_joins_five_parties_of_a_nation(spark, tmp_path):
    from casewell.plans import registry

    base = f"file://{tmp_path}"
    spark.range(50).select((F.col("id") + 1).alias("s_suppkey"), F.lit(1).alias("s_nationkey")).write.parquet(f"{base}/supplier.parquet")
    spark.range(400).select((F.col("id") + 1).alias("c_custkey"), F.format_string("Customer %d", F.col("id") + 1).alias("c_name"), F.lit(1).alias("c_nationkey")).write.parquet(f"{base}/customer.parquet")
    spark.createDataFrame([(1, "X")], "n_nationkey int, n_name string").write.parquet(f"{base}/nation.parquet")
    df = registry.QUERIES["g18_case_map"](spark, base)
    assert df.filter("layer <> 'Case'").groupBy("place").count().count() == 5 and df.count() == 50 * 6
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("row_number") > plan.index("Join")  # ranked below the join with the cases


def test_keys_longer_than_their_field_are_cut_as_by_the_sql(spark, tmp_path):
    from casewell.plans import registry

    base = f"file://{tmp_path}"
    spark.createDataFrame([(7,), (12,), (1_234_568,)], "p_partkey long").write.parquet(f"{base}/part.parquet")
    assert {r.case_id for r in registry.QUERIES["f19_case_header"](spark, base).collect()} == {None, "FIR/2026/000012", "FIR/2026/123456"}
    spark.createDataFrame([(1234,), (12_345,)], "s_suppkey long").write.parquet(f"{base}/supplier.parquet")
    assert tuple(registry.QUERIES["api_case_report"](spark, base).first()) == ("FIR/2026/1234", 50)
