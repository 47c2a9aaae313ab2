"""Text reports of cases, slices of the report catalogue, bounded exports for viewers."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Report, table and key column, by category.
CATALOGUE = {
    "Case": (("FIR dataset", "complete_fir_dataset", "FIR_No"),),
    "Telecom": (("Subscribers", "Subscriber_Detail_Records", "Case_ID"), ("Calls", "Call_Recording", "Case_ID"), ("IP sessions", "IP_Detail_Records", "Case_ID")),
    "Vehicle": (
        ("Summary", "Vehicle_Summary", "Case_ID"), ("VAHAN", "VAHAN_Database", "Case_ID"), ("SARATHI", "SARATHI_Database", "Case_ID"),
        ("FASTag", "FASTag_Toll_Logs", "Case_ID"), ("ANPR", "ANPR_Camera_Feeds", "Case_ID"),
    ),
    "Financial": (
        ("Summary", "Financial_Summary", "Case_ID"), ("Bank", "Bank_Statement_Records", "Case_ID"), ("UPI", "UPI_Payment_Gateway_Logs", "Case_ID"),
        ("Merchant", "Merchant_Gateway_Transaction_Logs", "Case_ID"), ("On-chain", "Crypto_OnChain_Transactions", "Case_ID"),
        ("Exchange KYC", "Crypto_Exchange_KYC_Records", "Case_ID"), ("On/off ramp", "Crypto_Exchange_OnOffRamp_Logs", "Case_ID"),
        ("ITR", "ITR_Forensic_Profile", "Case_ID"), ("GST", "GST_EWayBill_Records", "Case_ID"), ("CIBIL", "CIBIL_Commercial_Credit_Report", "Case_ID"),
        ("RoC", "RoC_Shell_Company_Filings", "Case_ID"),
    ),
    "Medical": (
        ("Summary", "Medical_Forensic_Summary", "Case_ID"), ("MLC", "MLC_Clinical_Assault_Reports", "Case_ID"), ("Autopsy", "PostMortem_Autopsy_Reports", "Case_ID"),
        ("Toxicology", "Forensic_Toxicology_Reports", "Case_ID"), ("DNA", "DNA_Profiling_Reports", "Case_ID"), ("SAFE", "SAFE_Reports", "Case_ID"),
        ("Odontology", "Forensic_Odontology_Reports", "Case_ID"), ("Skeletal", "Skeletal_Identification_Reports", "Case_ID"),
        ("Psychiatric", "Forensic_Psychiatric_Reports", "Case_ID"),
    ),
}
MOST_EXPORTED = 5_000


def unified_report(cases: DataFrame, key: str, facts: list[str], sections: dict[str, DataFrame]) -> DataFrame:
    """``key, report``: the case's facts and each section's lines (``key, seq, line``) in order of
    ``seq``, ``NONE`` for a section without lines. Sections are gathered per case, then joined."""
    out = cases
    for name, rows in sections.items():
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
        lines = rows.groupBy(key).agg(F.array_join(ordered, "; ").alias(f"__{name}"))
        out = out.join(lines, key, "left").withColumn(f"__{name}", F.coalesce(f"__{name}", F.lit("NONE")))
    return out.select(key, F.concat_ws(" | ", *facts, *[f"__{n}" for n in sections]).alias("report"))


def case_report(spark, base: str, table: str, case_id) -> DataFrame:
    """Rows of one catalogue table for one case."""
    from casewell.sources.tables import read_table

    keys = {t: k for group in CATALOGUE.values() for _, t, k in group}
    return read_table(spark, base, table).filter(F.col(keys[table]).cast("string") == str(case_id))


def catalogue(spark, base: str) -> DataFrame:
    """``category, report, table, key, exists``."""
    from casewell.sources.tables import exists

    rows = [(c, r, t, k, exists(spark, f"{base}/{t}.csv")) for c, group in CATALOGUE.items() for r, t, k in group]
    return spark.createDataFrame(rows, "category string, report string, table string, key string, `exists` boolean")


def graph_json(nodes: DataFrame, edges: DataFrame, most: int = MOST_EXPORTED) -> str:
    """Node-link JSON of a small graph; refuses a larger one."""
    n, e = nodes.limit(most + 1).toJSON().collect(), edges.limit(most + 1).toJSON().collect()
    if len(n) > most or len(e) > most:
        raise ValueError(f"more than {most} nodes or edges; take a neighbourhood first")
    return json.dumps({"nodes": [json.loads(x) for x in n], "links": [json.loads(x) for x in e]}, ensure_ascii=False)


def network_page(nodes: DataFrame, edges: DataFrame, title: str = "Network", most: int = MOST_EXPORTED) -> str:
    """A page that lists a small graph's nodes and edges, with its data as JSON."""
    data = graph_json(nodes, edges, most)
    graph = json.loads(data)
    items = "".join(f"<li>{escape(str(x.get('id')))}</li>" for x in graph["nodes"])
    lines = "".join(f"<li>{escape(str(x.get('src')))} - {escape(str(x.get('dst')))}</li>" for x in graph["links"])
    safe = data.replace("</", "<\\/")
    return f"<!DOCTYPE html><title>{escape(title)}</title><h1>{escape(title)}</h1><ul>{items}</ul><ul>{lines}</ul><script type='application/json'>{safe}</script>"
