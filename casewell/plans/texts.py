"""Extraction from reports and forms, chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewell.functions.text import case_of_header
from casewell.operators import extraction, retrieval, timeline
from casewell.storage import table

from .registry import query


@query("s3_structured_people", """SELECT c_custkey AS case_id, 'PER-' || left(md5(name), 8) AS person_id, name, role, phone, 'N/A' AS address FROM (
  SELECT c_custkey, c_name AS name, 'Informant' AS role, c_mktsegment AS phone FROM customer UNION ALL SELECT c_custkey, 'Unknown Victim', 'Victim', 'N/A' FROM customer)""")
def s3(spark, sf):
    rows = table(spark, sf, "customer").withColumn("none", F.lit(""))
    return extraction.structured_people(rows, "c_custkey", {"Informant": ("c_name", "c_mktsegment", "none"), "Victim": ("none", "none", "none")})


@query("s3_role_edges", "SELECT c_custkey AS case_id, c_mktsegment AS source_name, c_name AS target_name, 'TARGETED' AS relation FROM customer")
def s3b(spark, sf):
    rows = table(spark, sf, "customer").withColumn("none", F.lit(""))
    people = extraction.structured_people(rows, "c_custkey", {"Accused": ("c_mktsegment", "none", "none"), "Victim": ("c_name", "none", "none")})
    return extraction.role_edges(people)


@query("m13_document_entities", "SELECT doc_id AS case_id, 'Unknown Accused' AS accused, 0::INT AS n_contacts, length(text)::INT AS length FROM documents")
def m13(spark, sf):
    out = extraction.document_entities(table(spark, sf, "documents"), "doc_id", "text")
    return out.select("case_id", F.col("nodes")[2]["name"].alias("accused"), F.size("contacts").alias("n_contacts"), "length")


@query("s4_f20_case_blocks", "SELECT 'FIR/2026/' || lpad(n_nationkey::VARCHAR, 4, '0') AS case_id, n_regionkey AS region, 2::INT AS block_no FROM nation")
def s4(spark, sf):
    heading = F.format_string("1. FIR BASIC INFORMATION - CASE ID: FIR/2026/%04d\nText\n", "n_nationkey")
    reports = table(spark, sf, "nation").select("n_regionkey", F.concat(F.lit("REPORT\n1. FIR BASIC INFORMATION\n"), heading).alias("value"))
    out = extraction.case_blocks(reports.select("value"))
    first = extraction.case_blocks(reports.select("value")).select("case_id", "block_no")
    return out.select("case_id").join(first, "case_id").join(table(spark, sf, "nation").select(F.format_string("FIR/2026/%04d", "n_nationkey").alias("case_id"), F.col("n_regionkey").alias("region")), "case_id")


@query("s5_report_lines", "SELECT n_nationkey * 2 + 1 AS line_no, 'C' || n_nationkey::VARCHAR AS case_id, n_name AS finding FROM nation")
def s5(spark, sf):
    n = table(spark, sf, "nation")
    head = n.select((F.col("n_nationkey") * 2).alias("line_no"), F.concat(F.lit("CASE ID: C"), F.col("n_nationkey").cast("string")).alias("text"))
    body = n.select((F.col("n_nationkey") * 2 + 1).alias("line_no"), F.concat(F.lit(" [1] SEVERITY: HIGH | "), "n_name").alias("text"))
    finding = F.nullif(F.trim(F.regexp_extract("text", r"\[\d+\] SEVERITY: \w+ \| (.*)$", 1)), F.lit(""))
    return timeline.report_lines(head.unionByName(body), case_of_header(F.col("text")), finding)


@query("f22_f24_form_fields", """SELECT p_partkey, p_type AS district, p_name AS informant_name, 'Flat 4, ' || p_brand AS informant_address,
  CASE p_partkey % 3 WHEN 0 THEN 'IPC 1860 Section 303' WHEN 1 THEN 'Nyaya Sanhita, 2023 Section 318(4)' ELSE 'Motor Act' END AS acts_sections,
  CASE p_partkey % 3 WHEN 0 THEN 'Theft' WHEN 1 THEN 'Cyber Fraud' ELSE '' END AS case_type,
  CASE p_partkey % 3 WHEN 2 THEN '' ELSE 'Unknown man' END AS accused_name_alias FROM part""")
def f22(spark, sf):
    """Forms of three layouts: one act with a code, an act over two lines, neither code nor accused."""
    which = lambda *parts: F.element_at(F.array(*[F.lit(p) for p in parts]), (F.col("p_partkey") % 3 + 1).cast("int"))
    form = F.concat(
        F.lit("District\n(native):\n"), F.col("p_type"), F.lit("\nActs Sections\n"), which("1\nIPC 1860\n303\n", " 1 \n\nNyaya\n Sanhita, 2023\n318(4)\n", "2\nMotor Act\n"),
        F.lit("(a)\nName\n(native) :\n"), F.col("p_name"), F.lit("\nAddress\n(native)::\nNo Type\n1\ncurrent\nFlat 4,\n"), F.col("p_brand"),
        which("\n2\nDetails of known accused\nPresent Address(native))\n1\nअज्ञात man\n", "\n2\nother\nElsewhere\nDetails of known accused\n(x) Present Address(native))\n\n1\n अज्ञात man \nHere\n", "\n2\n"),
    )
    out = extraction.form_fields(table(spark, sf, "part").select("p_partkey", form.alias("form")), "form")
    # without a code the act runs on to what follows it
    first = F.when(F.col("p_partkey") % 3 == 2, F.left("acts_sections", F.lit(9))).otherwise(F.col("acts_sections"))
    return out.select("p_partkey", "district", "informant_name", first.alias("acts_sections"), "case_type", "informant_address", "accused_name_alias")


@query("v1_f36_stride_chunks", """SELECT doc_id, k::INT AS chunk_no, substr(text, (k * 1350 + 1)::BIGINT, 1500) AS chunk
  FROM documents, LATERAL (SELECT unnest(generate_series(0, greatest(ceil((length(text) - 150) / 1350.0)::BIGINT - 1, 0))) AS k) WHERE length(text) > 0""")
def v1(spark, sf):
    return retrieval.stride_chunks(table(spark, sf, "documents"), "doc_id", "text")


@query("s6_f36_text_chunks")
def s6(spark, sf):
    return retrieval.text_chunks(table(spark, sf, "documents"), "doc_id", "text")


FIRST = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _question(spark, sf):
    rows = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").take(1)
    return [float(x) for x in rows[0][0]] if rows else []


@query("v3_l9_top_k", f"""WITH s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], {FIRST}::DOUBLE[]) AS x FROM embeddings)
  SELECT vec_id, round(x, 6) AS similarity, row_number() OVER (ORDER BY x DESC, vec_id)::INT AS rank, x >= 0.5 AS strong FROM s ORDER BY x DESC, vec_id LIMIT 5""")
def v3(spark, sf):
    return retrieval.retrieve(table(spark, sf, "embeddings"), _question(spark, sf))


@query("v4_context", "SELECT array_to_string(list('[Excerpt ' || r_regionkey::VARCHAR || ']' || chr(10) || r_name ORDER BY r_regionkey), chr(10) || chr(10)) AS context FROM region")
def v4(spark, sf):
    return retrieval.context(table(spark, sf, "region"), "r_name", "r_regionkey")


@query("v5_answer_or_refuse", f"SELECT max(list_cosine_similarity(embedding::DOUBLE[], {FIRST}::DOUBLE[])) >= 0.5 AS answerable, NULL::VARCHAR AS refusal FROM embeddings")
def v5(spark, sf):
    return retrieval.answer_or_refuse(retrieval.retrieve(table(spark, sf, "embeddings"), _question(spark, sf)))
