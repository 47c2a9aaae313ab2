"""Tables of text in files of few rows, and forms in tasks of few."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from casewell.operators import extraction
from casewell.sources import tables


def test_a_csv_table_is_files_of_few_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "FILE_ROWS", 10)
    path = f"{tmp_path}/t.csv"
    rows = spark.range(95).coalesce(1).select(F.col("id").cast("string").alias("a"), F.lit('x\n"y"').alias("b"))
    assert tables.write_csv(rows, path) and tables.write_csv(rows, path, append=True)
    assert len(list(Path(path).glob("*.csv"))) == 20
    assert sorted(map(tuple, tables.read_csv(spark, path, ["a", "b"]).collect())) == sorted([*map(tuple, rows.collect())] * 2)


def test_forms_are_dealt_to_tasks(spark, monkeypatch):
    form = "District\n(native):\nPune\nActs Sections\n1\nIPC 1860\n303\n(a)\nName\n(native) :\nA B\nAddress\n(native)::\nNo Type\n1\ncurrent\nFlat 4,\nLane 2\n2\nDetails of known accused\nPresent Address(native))\n1\nC D\n"
    forms = spark.range(40).coalesce(1).select("id", F.when(F.col("id") != 7, form).alias("form"))
    whole = sorted(map(tuple, extraction.form_fields(forms, "form").collect()), key=lambda r: r[0])
    monkeypatch.setattr(extraction, "TASK_FORMS", 10)
    found = extraction.form_fields(forms, "form")
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect()), key=lambda r: r[0]) == whole
    one = found.filter("id = 3").first()
    assert (one.district, one.acts_sections, one.case_type, one.informant_name) == ("Pune", "IPC 1860 Section 303", "Theft", "A B")
    assert (one.informant_address, one.accused_name_alias) == ("Flat 4, Lane 2", "C D")


def test_links_are_read_with_the_numbers_of_their_ends(spark, tmp_path):
    edges = spark.createDataFrame([("b", "c", 1), ("a", "c", 2)], "src string, dst string, w int")
    nodes = spark.createDataFrame([("c",), ("a",), ("b",)], "id string")
    tables.write_node_link(nodes, edges, f"{tmp_path}/g")
    read, found = tables.read_node_link(spark, f"{tmp_path}/g", "id string", "w int", numbers=True)
    assert {(r.id, r.no) for r in read.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src, r.dst, r.source, r.target, r.w) for r in found.collect()} == {("b", "c", 1, 2, 1), ("a", "c", 0, 2, 2)}
    assert tables.read_node_link(spark, f"{tmp_path}/g", "id string", "w int")[1].columns == ["src", "dst", "w"]
