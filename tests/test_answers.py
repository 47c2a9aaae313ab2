"""Answers on small tables, and what large graphs and hot edges take another way for."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casewell.operators import analytics, answers, detectors, graph, resolution
from casewell.plans import registry
from casewell.sources import tables as files

from .test_whole_graph import RANDOM


def test_answers_of_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], "case_id string, name string, vehicle string, severity string, person string, identifier string, kind string, case_ids array<string>")
    assert tuple(answers.overview(none, none, none, none, none).first()) == (0, 0, 0, 0, 0, 0)
    cases = spark.createDataFrame([(" Pune ", "East"), ("Pune", None), ("pune", " "), ("Thane", "West"), (None, "X"), ("", "Y")], "district string, police_station string")
    assert {r.district for r in answers.districts(cases).collect()} == {"Pune", "pune", "Thane"}
    assert [r.police_station for r in answers.police_stations(cases, "PUNE").collect()] == ["East"]
    people = spark.createDataFrame([("a", "Accused"), ("b", "VICTIM"), ("c", None)], "id string, role string")
    degrees = spark.createDataFrame([("a", 3)], "id string, n_neighbours long")
    assert {r.id: r.n_neighbours for r in answers.persons(people, degrees).collect()} == {"a": 3, "b": 0, "c": 0}
    assert [r.id for r in answers.persons(people, degrees, "victim").collect()] == ["b"]


def test_eigenvector_settles(spark):
    edges = spark.createDataFrame([*RANDOM, ("c00", "c00")], "src string, dst string")
    found = {r.id: r.eigenvector for r in analytics.eigenvector(edges).collect()}
    near = {v: {b if a == v else a for a, b in [*RANDOM, ("c00", "c00")] if v in (a, b)} for v in found}
    x = dict.fromkeys(found, 1.0)
    for _ in range(400):
        y = {v: x[v] + sum(x[w] for w in near[v]) for v in x}
        norm = sum(z * z for z in y.values()) ** 0.5
        x = {v: z / norm for v, z in y.items()}
    assert all(abs(found[v] - x[v]) <= 2e-4 for v in x)
    assert {r.eigenvector for r in analytics.eigenvector(edges, rounds=1).collect()} == {0.0}
    assert {r.eigenvector for r in analytics.eigenvector(edges, rounds=1, settle=False).collect()} != {0.0}


def test_evidence_of_a_merged_edge_is_capped_before_it_is_gathered(spark):
    rows = [("P::x", f"Q::{i}", "R", "c", i * 10 + j, f"e{i}-{j}") for i in range(4) for j in range(30)]
    edges = graph.merge_edges(spark.createDataFrame(rows, "src string, dst string, relation string, case_id string, seq long, evidence string"))
    aliases = spark.createDataFrame([(f"Q::{i}", "Q::all") for i in range(4)], "alias string, canonical string")
    one = graph.apply_aliases(edges, aliases).collect()
    assert len(one) == 1 and one[0].weight == 120 and len(one[0].evidence) == graph.MOST_EVIDENCE and list(one[0].case_ids) == ["c"]


def test_names_without_a_sound_are_a_block_if_asked_for(spark):
    rows = [(1, None, "", "x", [], "c"), (2, "N/A", "", "y", [], "d"), (3, "Asha Rao", "", "z", [], "c")]
    records = spark.createDataFrame(rows, "record_id long, name string, phone string, address string, vehicles array<string>, case_id string")
    pairs = resolution.candidate_pairs(records)
    assert [tuple(r) for r in pairs.collect()] == [(1, 2)]
    assert resolution.score_pairs(records, pairs).first().decision == "NON_MATCH"
    assert resolution.candidate_pairs(records, silent=False).count() == 0


def test_all_eight_sources_give_alerts(spark, sf):
    found = registry.QUERIES["d7_alerts_of_all_sources"](spark, sf).groupBy("alert_type").count().collect()
    kinds = {r.alert_type for r in found}
    assert {"CONTACT_CHAIN", "COORDINATED_MOVEMENT", "VEHICLE_IDENTITY_MISMATCH"} <= kinds
    one = spark.createDataFrame([("x",)], "id string")
    clusters = spark.createDataFrame([(1, 20)], "community_id int, size long")
    both = detectors.alerts(bridges=one, clusters=clusters).collect()
    assert [r.alert_type for r in both] == ["GRAPH_BRIDGE_ENTITY", "EMERGING_ENTITY_CLUSTER"]


def test_limits_are_exact_whatever_the_partitions(spark):
    """Five days of n and one that lies exactly at two deviations: (1, 1, 1, 1, 6): mean 2, deviation 2."""
    rows = [("a", d, n) for d, n in enumerate((1, 1, 1, 1, 6))] + [("b", d, n) for d, n in enumerate((1, 1, 1, 1, 1))]
    df = spark.createDataFrame(rows, "entity string, day int, n long")
    for k in (1, 3, 7):
        found = detectors.exact_z_scores(df.repartition(k), "entity", "n", 3, 2.0).collect()
        assert [(r.entity, r.n, r.z, r["mean"], r["std"]) for r in found] == [("a", 6, 2.0, 2.0, 2.0)]
    assert detectors.exact_z_scores(df, "entity", "n", 3, 2.01).count() == 0


def test_texts_are_embedded_in_batches(spark):
    chunks = spark.createDataFrame([(i, "x" * (i % 7) if i else None) for i in range(250)], "no int, chunk string").coalesce(1)
    sized = lambda texts: [[float(len(t)), float(len(texts))] for t in texts]
    found = {r.no: list(r.embedding) for r in files.embedded(chunks, sized).collect()}
    assert all(found[i][0] == i % 7 for i in found) and max(v[1] for v in found.values()) == 100


@pytest.mark.parametrize("name", ["api_overview", "api_network"])
def test_counts_are_those_of_the_parts(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).filter(F.lit(True)).count() > 0
