"""Measures of graphs whose components are small, whatever the whole graph has."""

from __future__ import annotations

import numpy as np
import pytest

from casewell.operators import analytics, brandes

from .test_scale_ways import edges, random_pairs
from .test_whole_graph import naive_betweenness, naive_communities

#: Three components of 12 nodes each at most, one of two sides, a pair and a loop.
APART = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a, b in random_pairs(3, 12, 20) if a != b] + [(f"l{i}", f"r{j}") for i in range(4) for j in range(5) if (i + j) % 3] + [("p", "q")]


def never(*args, **kwargs):
    raise AssertionError("taken for one large component")


def test_betweenness_is_searched_by_component(spark, monkeypatch):
    monkeypatch.setattr(analytics, "_advanced", never)
    found = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, APART), most=25).collect()}
    plain = naive_betweenness(APART)
    assert len(APART) > 25 and found.keys() == plain.keys()
    assert all(abs(found[k] - plain[k]) < 6e-5 for k in plain)


def test_betweenness_of_small_and_large_components(spark):
    found = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, APART), most=5, sources=7).collect()}
    plain = naive_betweenness(APART)
    assert found.keys() == plain.keys() and all(abs(found[k] - plain[k]) < 6e-5 for k in plain)


@pytest.mark.parametrize("two_sides", [True, False])
def test_dense_searches_are_the_listed_ones(two_sides):
    r = np.random.default_rng(5)
    pairs = {(int(a), int(b)) for a, b in zip(r.integers(0, 8, 40), r.integers(8, 20, 40), strict=True)} | (set() if two_sides else {(0, 1), (0, 2), (1, 2)})
    a, b = np.array(sorted(pairs)).T
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, size = ends[: len(a)], ends[len(a) :], r.integers(1, 4, len(names)).astype(float)
    side = brandes._sides(a, b, len(names))
    assert (side is not None) == two_sides
    all_of = np.arange(len(names))
    listed = brandes._listed(all_of, np.concatenate([a, b]), np.concatenate([b, a]), size)
    assert np.allclose(brandes._dense(all_of, a, b, size, side), listed) and np.allclose(brandes._dense(all_of, a, b, size, None), listed)


@pytest.mark.parametrize("most", [25, 5])
def test_communities_are_greedy_by_component(spark, monkeypatch, most):
    if most == 25:  # no component is larger
        monkeypatch.setattr(analytics, "contracted_communities", never)
        monkeypatch.setattr(analytics, "_contracted", never, raising=False)
    groups = {}
    for r in analytics.communities(edges(spark, APART), most=most).collect():
        groups.setdefault(r.community_id, []).append(r.id)
    if most == 25:
        assert sorted(map(sorted, groups.values())) == naive_communities(APART)
    else:
        assert sorted(v for g in groups.values() for v in g) == sorted({v for e in APART for v in e}) and {"p", "q"} in map(set, groups.values())
