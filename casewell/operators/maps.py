"""Points of cases and of what is linked to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import coordinates


def case_map(cases: DataFrame, linked: dict[str, tuple[DataFrame, int | None]]) -> DataFrame:
    """``case_id, layer, place, lat, lon``: each case's place, and per layer the first ``n`` linked
    places of each case (tables of ``case_id, place, seq``)."""
    first = Window.partitionBy("case_id").orderBy("seq", "place")
    out = cases.select("case_id", F.lit("Case").alias("layer"), "place")
    for layer, (rows, most) in linked.items():
        kept = rows.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= most) if most else rows
        out = out.unionByName(kept.select("case_id", F.lit(layer).alias("layer"), "place"))
    p = coordinates(F.col("place"), F.col("case_id").cast("string"))
    return out.withColumn("__p", p).select("case_id", "layer", "place", F.col("__p.lat").alias("lat"), F.col("__p.lon").alias("lon"))
