"""Detectors of statistical and temporal patterns, and the alerts that they score."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import clip, gap_minutes, severity

from .convoys import convoys
from .frames import follow_join, forward_frame, keep_first, numbered

CONVOY_COUNTS = 8  # vehicles beyond add nothing to an alert's score


@dataclass(frozen=True)
class Settings:
    """Thresholds; the defaults are fixed values."""

    spike_days: int = 3
    spike_z: float = 2.0
    money_rows: int = 3
    money_z: float = 2.5
    chain_minutes: int = 30
    convoy_minutes: int = 20
    loop_hours: int = 48
    loop_visits: int = 3
    alert_score: float = 55.0
    alert_limit: int | None = 100  # None for all


def daily_activity(calls: DataFrame) -> DataFrame:
    """``entity, day, n``: calls per day of either side."""
    sides = calls.select(F.col("entity_a").alias("entity"), "ts").union(calls.select("entity_b", "ts"))
    return sides.groupBy("entity", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def z_scores(rows: DataFrame, key: str, value: str, least_rows: int) -> DataFrame:
    """``mean, std, z`` against the key's own rows (population deviation); keys with fewer rows or
    without variance leave. The statistics are aggregated first and joined, so a hot key is not
    a window of one task."""
    own = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(F.lit(1)).alias("__n"))
    own = own.filter((F.col("__n") >= least_rows) & (F.col("std") > 0)).drop("__n")
    return rows.join(own, key).withColumn("z", F.round((F.col(value) - F.col("mean")) / F.col("std"), 2) + 0.0)


def exact_z_scores(rows: DataFrame, key: str, value: str, least_rows: int, least_z: float, unit: float = 1) -> DataFrame:
    """As ``z_scores``, the rows at ``least_z`` or above. Values are whole numbers of ``unit``, so whether a
    row lies at the limit is decided without rounding and does not depend on the order of sums: with
    n rows, sum S and sum of squares Q, ``(v - mean) / std >= z`` is ``n v > S`` and
    ``(n v - S) ** 2 >= z ** 2 (n Q - S ** 2)``."""
    whole = lambda c: c.cast("decimal(38,0)")
    z = Fraction(str(least_z))
    rows = rows.withColumn("__v", whole(F.round(F.col(value) / unit)))
    own = rows.groupBy(key).agg(whole(F.count("__v")).alias("__n"), whole(F.sum("__v")).alias("__s"), whole(F.sum(whole(F.col("__v") * F.col("__v")))).alias("__q"))
    own = own.withColumn("__spread", whole(F.col("__n") * F.col("__q")) - whole(F.col("__s") * F.col("__s"))).filter((F.col("__n") >= least_rows) & (F.col("__spread") > 0))
    out = rows.join(own, key).withColumn("__off", whole(F.col("__n") * F.col("__v")) - F.col("__s"))
    far = whole(F.col("__off") * F.col("__off")) * z.denominator**2 >= F.col("__spread") * z.numerator**2
    real = lambda c: F.col(c).cast("double")
    out = out.filter((F.col("__off") > 0) & far).withColumn("mean", real("__s") / real("__n") * unit).withColumn("std", F.sqrt(real("__spread")) / real("__n") * unit)
    return out.withColumn("z", F.round(real("__off") / F.sqrt(real("__spread")), 2)).drop("__v", "__n", "__s", "__q", "__spread", "__off")


def communication_spikes(calls: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Days on which an entity is ``spike_z`` deviations above its mean over active days."""
    return exact_z_scores(daily_activity(calls), "entity", "n", s.spike_days, s.spike_z)


def amount_outliers(payments: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Payments ``money_z`` deviations above the sender's mean; amounts are read in hundredths."""
    return exact_z_scores(payments, "sender", "amount", s.money_rows, s.money_z, 0.01)


def contact_chains(calls: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``a -> b -> c`` within ``chain_minutes``, the earliest of each pair of legs."""
    first = calls.select(F.col("entity_a").alias("a"), F.col("entity_b").alias("b"), F.col("ts").alias("ts1"), F.col("call_id").alias("call1"))
    second = calls.select(F.col("entity_a").alias("b2"), F.col("entity_b").alias("c"), F.col("ts").alias("ts2"), F.col("call_id").alias("call2"))
    met = follow_join(first, second, ("b", "b2"), ("ts1", "ts2"), s.chain_minutes * 60).filter("c <> a").drop("b2")
    met = met.withColumn("gap_min", gap_minutes(F.col("ts1"), F.col("ts2")))
    return keep_first(met, ["a", "b", "c"], ["ts1", "ts2", "call1", "call2"])


def coordinated_movement(crossings: DataFrame, s: Settings = Settings(), most: int | None = None) -> DataFrame:
    """Two vehicles or more at a plaza within ``convoy_minutes``; each set of vehicles once. With ``most`` only those that
    can be among as many first alerts."""
    return convoys(crossings, s.convoy_minutes * 60, most, CONVOY_COUNTS)


def location_loops(crossings: DataFrame, s: Settings = Settings()) -> DataFrame:
    """A vehicle ``loop_visits`` times at one plaza within ``loop_hours``, the first such window."""
    counts = {"visits": lambda: F.count(F.lit(1)), "last_ts": lambda: F.max("ts")}
    seen = forward_frame(crossings, ["vehicle", "plaza"], "ts", s.loop_hours * 3600, counts).filter(F.col("visits") >= s.loop_visits)
    return keep_first(seen, ["vehicle", "plaza"], ["ts", "crossing_id"]).select("vehicle", "plaza", F.col("ts").alias("first_ts"), "last_ts", "visits")


def plate_mismatches(crossings: DataFrame) -> DataFrame:
    """Crossings whose camera check says MISMATCH, in any case."""
    return crossings.filter(F.upper("cross_match") == "MISMATCH").select("vehicle", "plaza", "ts", "tag", "case_id")


def _alert(rows: DataFrame, kind: str, score: Column, confidence: Column, entities: Column, summary: Column) -> DataFrame:
    s = F.round(clip(score), 2)
    return rows.select(
        F.lit(kind).alias("alert_type"),
        severity(s).alias("severity"),
        s.cast("double").alias("score"),
        F.round(clip(confidence), 2).cast("double").alias("confidence"),
        summary.alias("summary"),
        F.array_sort(F.array_distinct(F.transform(entities, lambda e: e.cast("string")))).alias("entities"),
        F.to_json(F.struct(*rows.columns)).alias("evidence"),
    )


def alerts(
    spikes: DataFrame | None = None,
    outliers: DataFrame | None = None,
    chains: DataFrame | None = None,
    convoys: DataFrame | None = None,
    loops: DataFrame | None = None,
    mismatches: DataFrame | None = None,
    bridges: DataFrame | None = None,
    clusters: DataFrame | None = None,
    s: Settings = Settings(),
) -> DataFrame:
    """Scored alerts of all findings given, the ``alert_limit`` highest by score, confidence, type
    and entities, numbered from ``ALT-00001``."""
    z = F.least(F.col("z"), F.lit(6.0))
    parts = []
    if spikes is not None:
        say = F.format_string("%s: %d contacts on %s", F.col("entity").cast("string"), "n", F.col("day").cast("string"))
        parts.append(_alert(spikes, "COMMUNICATION_SPIKE", 50 + 8 * z, F.least(F.lit(90.0), 50 + 6 * F.col("z")), F.array("entity"), say))
    if outliers is not None:
        say = F.format_string("%s: payment of %.2f", F.col("sender").cast("string"), F.col("amount").cast("double"))
        parts.append(_alert(outliers, "FINANCIAL_ANOMALY", 55 + 7 * z, F.least(F.lit(92.0), 55 + 6 * F.col("z")), F.array("sender"), say))
    if chains is not None:
        say = F.concat_ws(" > ", F.col("a").cast("string"), F.col("b").cast("string"), F.col("c").cast("string"))
        parts.append(_alert(chains, "CONTACT_CHAIN", 60 + F.greatest(F.lit(0.0), 10 - F.col("gap_min")), F.lit(65.0), F.array("a", "b", "c"), say))
    if convoys is not None:
        say = F.format_string("%d vehicles at %s", "n_vehicles", F.col("plaza").cast("string"))
        parts.append(
            _alert(convoys, "COORDINATED_MOVEMENT", 55 + 5 * F.least(F.col("n_vehicles"), F.lit(CONVOY_COUNTS)), F.lit(60.0), F.split("vehicle_list", ","), say)
        )
    if loops is not None:
        say = F.format_string("%s: %d visits to %s", F.col("vehicle").cast("string"), "visits", F.col("plaza").cast("string"))
        parts.append(_alert(loops, "LOCATION_LOOP", 50 + 5 * F.least(F.col("visits"), F.lit(10)), F.lit(60.0), F.array(F.col("vehicle").cast("string")), say))
    parts = [p.filter(F.col("score") >= s.alert_score) for p in parts]
    if mismatches is not None:
        say = F.format_string("%s: plate differs at %s", F.col("vehicle").cast("string"), F.col("plaza").cast("string"))
        parts.append(_alert(mismatches, "VEHICLE_IDENTITY_MISMATCH", F.lit(88.0), F.lit(80.0), F.array(F.col("vehicle").cast("string")), say))
    if bridges is not None:
        parts.append(_alert(bridges, "GRAPH_BRIDGE_ENTITY", F.lit(72.0), F.lit(70.0), F.array(F.col("id").cast("string")), F.concat(F.lit("bridge: "), F.col("id").cast("string"))))
    if clusters is not None:
        say = F.format_string("community %d of %d entities", F.col("community_id").cast("long"), F.col("size").cast("long"))
        parts.append(_alert(clusters, "EMERGING_ENTITY_CLUSTER", F.lit(65.0), F.lit(60.0), F.array(F.col("community_id").cast("string")), say))
    if not parts:
        raise ValueError("alerts: no findings given")
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    order = [F.desc("score"), F.desc("confidence"), "alert_type", F.array_join("entities", ","), "summary"]
    kept = union.orderBy(*order).limit(s.alert_limit) if s.alert_limit else union
    return numbered(kept, "alert_id", "ALT-%05d", order)


def emerging_clusters(communities: DataFrame, least: int = 12) -> DataFrame:
    """Communities of at least ``max(least, 75th percentile)`` members (``community_id, size``)."""
    p75 = communities.agg(F.floor(F.percentile("size", 0.75)).alias("p75")).scalar()
    return communities.filter(F.col("size") >= F.greatest(F.lit(least), p75))


def structural_alerts(ranked: DataFrame, bridges: DataFrame, most: int = 12, most_bridges: int = 6) -> DataFrame:
    """``NET-001`` onward: the highest ranked CRITICAL and HIGH entities, then bridges as MEDIUM."""
    pattern = F.when(F.col("degree") >= 0.3, "hub").when(F.col("betweenness") > 0.1, "broker").otherwise("connected")
    top = ranked.filter(F.col("risk_tier").isin("CRITICAL", "HIGH")).orderBy(F.desc("composite_score"), "id").limit(most)
    top = top.select(F.lit(0).alias("part"), F.col("id").cast("string").alias("subject"), F.col("risk_tier").alias("severity"), pattern.alias("pattern"), F.col("composite_score").alias("weight"))
    few = bridges.orderBy("src", "dst").limit(most_bridges)
    few = few.select(F.lit(1).alias("part"), F.concat_ws(" - ", F.col("src").cast("string"), F.col("dst").cast("string")).alias("subject"), F.lit("MEDIUM").alias("severity"), F.lit("bridge").alias("pattern"), F.lit(0.0).alias("weight"))
    return numbered(top.unionByName(few), "alert_id", "NET-%03d", ["part", F.desc("weight"), "subject"]).drop("part", "weight")
