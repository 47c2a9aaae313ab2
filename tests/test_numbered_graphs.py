"""Label propagation on numbers of nodes, against plain versions on names."""

from __future__ import annotations

from collections import Counter

import pytest

from casewell.operators import analytics, components

from .test_scale_ways import edges, random_pairs

#: Ids whose order is not that of their numbers, a hub, a loop, both directions of an edge, a pair apart and null ends.
PAIRS = [(f"v{a}", f"v{b}") for a, b in random_pairs(11, 30, 60)] + [("hub", f"v{i}") for i in range(25)]
PAIRS += [("v1", "v1"), ("hub", "hub"), ("v3", "v2"), ("v2", "v3"), ("p", "q"), (None, "v4"), ("alone", None)]


def plain_labels(pairs, rounds):
    near = {v: set() for p in pairs for v in p if v is not None}
    for a, b in pairs:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    label = {v: v for v in near}
    for _ in range(rounds):
        votes = {v: Counter([label[v], *(label[w] for w in near[v])]) for v in near}
        label = {v: min(n, key=lambda x, n=n: (-n[x], x)) for v, n in votes.items()}
    size = Counter(label.values())
    place = {h: i for i, h in enumerate(sorted(size, key=lambda h: (-size[h], h)), 1)}
    return {v: (place[h], size[h]) for v, h in label.items()}


@pytest.mark.parametrize(("rounds", "hub"), [(0, 1_000), (1, 1_000), (2, 1_000), (5, 1_000), (5, 4)])
def test_labels_are_the_plain_ones(spark, rounds, hub):
    found = {r.id: (r.community_id, r.size) for r in analytics.label_communities(edges(spark, PAIRS), rounds, hub).collect()}
    assert found == plain_labels(PAIRS, rounds)


def test_labels_beyond_the_numbers_of_one_long(spark, monkeypatch):
    monkeypatch.setattr(components, "MOST_CODED", 3)
    found = {r.id: (r.community_id, r.size) for r in analytics.label_communities(edges(spark, PAIRS)).collect()}
    assert found == plain_labels(PAIRS, 5)


def test_rounds_of_labels_store_numbers_only(spark, monkeypatch):
    kinds, stored = [], analytics.stored

    def seen(df, label, narrow=False):
        kinds.extend(t for _, t in df.dtypes if label == "labels")
        return stored(df, label, narrow)

    monkeypatch.setattr(analytics, "stored", seen)
    analytics.label_communities(edges(spark, PAIRS)).count()
    assert len(kinds) == 10 and set(kinds) == {"bigint"}
