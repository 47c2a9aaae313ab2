"""Closest names over tables, batches of a vector store, the export of a graph."""

from __future__ import annotations

import difflib
import os
import random

import pytest
from pyspark.sql import functions as F

from casewell.operators.closest import closest_names
from casewell.sources import tables
from casewell.storage import new_path


def plain_closest(values, choices, cutoff):
    low = {}
    for c in sorted({c or "" for c in choices}):
        low[c.lower()] = c
    out = {}
    for v in set(values):
        found = difflib.get_close_matches((v or "").strip(" ").lower(), list(low), 1, cutoff)
        if found:
            out[v] = low[found[0]]
    return out


@pytest.mark.parametrize("cutoff", [0.3, 0.8])
def test_closest_names_are_those_of_the_matcher(spark, cutoff):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé漢 ") for _ in range(r.randrange(9)))
    choices = [word() for _ in range(60)] + ["Abc", "abc", "ABC", None]
    values = [word() for _ in range(80)] + [None, "", "  ABC ", choices[3], "x" * 300, "x" * 299 + "y"]
    choices.append("x" * 300)
    got = closest_names(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame([(c,) for c in choices], "choice string"), cutoff=cutoff)
    assert {x.value: x.best for x in got.collect()} == plain_closest(values, choices, cutoff)


def test_closest_part_names_and_customers(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_name").alias("value")).distinct().limit(40)
    names = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_name").alias("choice"))
    want = plain_closest([x.value for x in parts.collect()], [x.choice for x in names.collect()], 0.3)
    found = closest_names(spark.createDataFrame(parts.collect(), "value string"), names, cutoff=0.3)
    assert {x.value: x.best for x in found.collect()} == want
    assert closest_names(parts.limit(0), names).count() == closest_names(parts, names.limit(0)).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x)]) for i, x in rows], "vec_id long, embedding array<float>")


def test_a_killed_and_repeated_write_changes_nothing(spark):
    path = new_path(spark, "store")
    schema = vectors(spark, []).schema
    assert tables.vectors_of(spark, path, schema).count() == 0
    assert tables.put_vectors(vectors(spark, [(1, 1), (2, 2)]), path, 1)

    broken = vectors(spark, [(i, i) for i in range(50)]).repartition(8, "vec_id")
    stop = F.udf(lambda i: 1 // (i - 37) and i, "long")
    with pytest.raises(Exception, match="ZeroDivision"):
        tables.put_vectors(broken.withColumn("vec_id", stop("vec_id")), path, 2)
    local = path.removeprefix("file://")
    os.makedirs(f"{local}/batch=0000000003")  # what a driver that died in the middle leaves
    open(f"{local}/batch=0000000003/part-00000.parquet", "wb").write(b"half a file")
    assert tables.committed_batches(spark, path) == [1]
    assert sorted((r.vec_id, *r.embedding) for r in tables.vectors_of(spark, path, schema).collect()) == [(1, 1.0), (2, 2.0)]

    for again in (True, False):
        assert tables.put_vectors(vectors(spark, [(2, 9), (3, 3), (3, 4)]), path, 2) == again
    assert tables.put_vectors(vectors(spark, [(5, 5)]), path, 3)
    found = sorted((r.vec_id, *r.embedding) for r in tables.vectors_of(spark, path, schema).collect())
    assert found == [(1, 1.0), (2, 9.0), (3, 4.0), (5, 5.0)]


def test_embedding_goes_on_where_it_stopped(spark):
    path = new_path(spark, "store")
    chunks = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(40)], "vec_id long, chunk string")
    sized = lambda texts: [[float(len(t))] for t in texts]

    def fails(texts):
        raise RuntimeError("no service")

    assert tables.embed_into(chunks, sized, path, 4) == 4
    assert tables.embed_into(chunks, fails, path, 4) == 0
    assert tables.embed_into(chunks, sized, path, 4, first=4) == 4
    found = {r.vec_id: r.embedding[0] for r in tables.vectors_of(spark, path, "vec_id long, embedding array<float>").collect()}
    assert found == {i: float(i % 5) for i in range(40)}


@pytest.mark.parametrize("part_rows", [7])
def test_node_link_export_is_read_back(spark, part_rows):
    r = random.Random(2)
    ids = [f"n{i}" for i in range(40)] + ['a "quoted" one', "é漢"]
    pairs = sorted({(r.choice(ids), r.choice(ids)) for _ in range(90)})
    nodes = spark.createDataFrame([(i, i.upper()) for i in ids], "id string, label string")
    edges = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(pairs)] + [("n1", "gone", 999)], "src string, dst string, weight long")
    path = new_path(spark, "export")
    tables.write_node_link(nodes, edges, path, part_rows)
    back, links = tables.read_node_link(spark, path, "id string, label string", "weight long")
    assert sorted((x.no, x.id, x.label) for x in back.collect()) == [(k, i, i.upper()) for k, i in enumerate(sorted(ids))]
    assert sorted(map(tuple, links.collect())) == sorted((a, b, k) for k, (a, b) in enumerate(pairs))
    lines = [x.value for x in spark.read.text(f"{path}/nodes").collect()]
    assert len(lines) == len(ids) and all('"no":' in x for x in lines)
