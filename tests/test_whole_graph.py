"""The graph queries over all orders, and the measures against plain versions on a small graph."""

import random
from fractions import Fraction
from itertools import combinations

import pytest

from casewell.operators import analytics
from casewell.plans import registry

from .conftest import SF
from .oracle import connection

RANDOM = sorted({(f"c{r.randrange(14):02}", f"s{r.randrange(6)}") for r in [random.Random(5)] for _ in range(34)})


@pytest.fixture(scope="module")
def all_nodes():
    sql = "SELECT DISTINCT unnest(['CUST::' || o_custkey::VARCHAR, 'SUPP::' || l_suppkey::VARCHAR]) FROM orders JOIN lineitem ON o_orderkey = l_orderkey"
    return {x for (x,) in connection(SF).execute(sql).fetchall()}


@pytest.mark.parametrize("name", ["g7_betweenness", "g8_eigenvector", "g10_communities", "g10_label_communities", "g6_degree"])
def test_every_node_is_measured(spark, sf, all_nodes, name):
    assert {r.id for r in registry.QUERIES[name](spark, sf).select("id").collect()} == all_nodes


def test_graph_queries_take_all_orders():
    graph = [n for n in registry.ORACLES if n.startswith(("g", "e13"))]
    assert len(graph) >= 12 and not any("o_totalprice" in registry.ORACLES[n] for n in graph)
    assert not any(n.endswith("_whole") for n in registry.QUERIES)


def naive_betweenness(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def paths(s):
        far, ways, front = {s: 0}, {s: 1}, [s]
        while front:
            new = {}
            for v in front:
                for w in near[v]:
                    if w not in far:
                        new[w] = new.get(w, 0) + ways[v]
            far.update({w: far[front[0]] + 1 for w in new})
            ways.update(new)
            front = list(new)
        return far, ways

    n, found = len(near), {}
    all_paths = {v: paths(v) for v in near}
    for v in near:
        fv, wv = all_paths[v]
        total = Fraction(0)
        for s, t in combinations([x for x in near if x != v and x in fv], 2):
            fs, ws = all_paths[s]
            if fs[v] + fv[t] == fs[t]:
                total += Fraction(ws[v] * wv[t], ws[t])
        found[v] = float(total * 2 / ((n - 1) * (n - 2)))
    return found


def naive_communities(pairs):
    m, names = len(pairs), sorted({x for p in pairs for x in p})
    part = {v: [v] for v in names}
    degree = {v: sum(v in p for p in pairs) for v in names}
    while True:
        best = None
        for a, b in combinations(sorted(part), 2):
            links = sum((x in part[a] and y in part[b]) or (x in part[b] and y in part[a]) for x, y in pairs)
            gain = 2 * m * links - sum(degree[x] for x in part[a]) * sum(degree[x] for x in part[b])
            if links and gain > 0 and (best is None or gain > best[0]):
                best = gain, a, b
        if best is None:
            return sorted(map(sorted, part.values()))
        part[best[1]] += part.pop(best[2])


def test_measures_against_plain_versions(spark):
    edges = spark.createDataFrame(RANDOM, "src string, dst string")
    plain = naive_betweenness(RANDOM)
    found = {r.id: r.betweenness for r in analytics.betweenness(edges).collect()}
    assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 6e-5 for k in plain)
    groups = {}
    for r in analytics.communities(edges).collect():
        groups.setdefault(r.community_id, []).append(r.id)
    assert sorted(map(sorted, groups.values())) == naive_communities(RANDOM)
