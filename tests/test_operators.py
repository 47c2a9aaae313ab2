"""Hand-built graphs, planted patterns with boundary rows, rules, sources, media."""

from __future__ import annotations

import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casewell.operators import analytics, detectors, graph, media, resolution, rules, tables, timeline
from casewell.operators.components import connected_components
from casewell.sources import generate
from casewell.sources import tables as files

T0 = dt.datetime(2026, 9, 1, 8)


def at(minutes: float) -> dt.datetime:
    return T0 + dt.timedelta(minutes=minutes)


def edges(spark, *pairs):
    return spark.createDataFrame([(min(p), max(p)) for p in pairs], "src string, dst string")


def calls(spark, rows):
    return spark.createDataFrame([(i, a, b, t) for i, (a, b, t) in enumerate(rows)], "call_id long, entity_a string, entity_b string, ts timestamp_ntz")


def crossings(spark, rows):
    return spark.createDataFrame([(i, v, p, t) for i, (v, p, t) in enumerate(rows)], "crossing_id long, vehicle string, plaza string, ts timestamp_ntz")


def test_spike_needs_enough_days(spark):
    quiet = [("a", f"x{d}", at(d * 1440)) for d in range(7)]
    burst = [("a", f"y{k}", at(7 * 1440 + k)) for k in range(20)]
    found = detectors.communication_spikes(calls(spark, quiet + burst)).filter("entity = 'a'").collect()
    assert [(str(r.day), r.n) for r in found] == [("2026-09-08", 20)]
    assert detectors.communication_spikes(calls(spark, quiet)).count() == 0  # no variance


def test_outlier_and_constant_sender(spark):
    rows = [("s", 100.0)] * 5 + [("s", 101.0)] * 5 + [("s", 5000.0)] + [("c", 7.0)] * 12 + [("t", 1.0), ("t", 900.0)]
    p = spark.createDataFrame([(i, s, a, T0) for i, (s, a) in enumerate(rows)], "payment_id long, sender string, amount double, ts timestamp_ntz")
    assert [(r.sender, r.amount) for r in detectors.amount_outliers(p).collect()] == [("s", 5000.0)]


def test_chain_boundaries(spark):
    rows = [("a", "b", at(0))] + [("b", f"c{m}", at(m)) for m in (0, 1, 29, 30, 31)] + [("b", "a", at(2)), ("b", "b", at(3))]
    found = {r.c: r.gap_min for r in detectors.contact_chains(calls(spark, rows)).filter("a = 'a' and b = 'b'").collect()}
    assert found == {"c1": 1.0, "c29": 29.0, "c30": 30.0, "b": 3.0}


def test_convoy_boundaries(spark):
    rows = [("v1", "p", at(0)), ("v2", "p", at(20)), ("v3", "q", at(0)), ("v4", "q", at(0)), ("v5", "r", at(0)), ("v6", "r", at(20.1))]
    found = {(r.plaza, r.vehicle_list) for r in detectors.coordinated_movement(crossings(spark, rows)).collect()}
    assert found == {("p", "v1,v2"), ("q", "v3,v4")}


def test_loop_boundaries(spark):
    rows = [("v", "p", at(0)), ("v", "p", at(60)), ("v", "p", at(48 * 60)), ("w", "p", at(0)), ("w", "p", at(60)), ("w", "p", at(48 * 60 + 1))]
    found = detectors.location_loops(crossings(spark, rows)).collect()
    assert [(r.vehicle, r.visits) for r in found] == [("v", 3)]


def test_alerts_are_numbered_and_capped(spark):
    loops = detectors.location_loops(crossings(spark, [(f"v{i}", "p", at(k)) for i in range(5) for k in range(3)]))
    out = detectors.alerts(loops=loops, s=detectors.Settings(alert_limit=3)).collect()
    assert sorted(r.alert_id for r in out) == ["ALT-00001", "ALT-00002", "ALT-00003"]
    assert {(r.score, r.severity) for r in out} == {(65.0, "MEDIUM")}


def test_rules(spark):
    moves = spark.createDataFrame([(1, "p", at(0), "CR"), (2, "p", at(2), "DR"), (3, "p", at(12), "DR"), (4, "p", at(13), "DR"), (5, "p", at(1), "DR")], "id long, person string, ts timestamp_ntz, kind string")
    assert {r.debit_id for r in rules.rapid_layering(moves).collect()} == {2, 3}
    paid = spark.createDataFrame([("p", 41000.0, at(0)), ("p", 45000.0, at(60)), ("p", 49000.0, at(90)), ("q", 45000.0, at(0)), ("q", 49001.0, at(1)), ("q", 45000.0, at(2))], "person string, amount double, ts timestamp_ntz")
    assert [(r.person, r.n) for r in rules.structuring(paid).collect()] == [("p", 3)]


# --- graphs --------------------------------------------------------------------------------------

PATH = [("a", "b"), ("b", "c"), ("c", "d")]
BARBELL = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]


def brute_bridges(pairs):
    def parts(ps):
        root = {v: v for p in pairs for v in p}
        for _ in root:
            for a, b in ps:
                root[a] = root[b] = min(root[a], root[b])
        return len(set(root.values()))

    return {(min(p), max(p)) for p in pairs if parts([q for q in pairs if q != p]) > parts(pairs)}


@pytest.mark.parametrize("pairs", [PATH, BARBELL, [("a", "b"), ("b", "c"), ("a", "c")], [("a", "b"), ("c", "d")], [("h", x) for x in "abcd"]])
def test_bridges(spark, pairs):
    assert {(r.src, r.dst) for r in analytics.bridges(edges(spark, *pairs)).collect()} == brute_bridges(pairs)


def test_betweenness_by_hand(spark):
    found = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, *PATH)).collect()}
    assert found == {"a": 0.0, "b": 0.6667, "c": 0.6667, "d": 0.0}
    star = {r.id: r.betweenness for r in analytics.betweenness(edges(spark, *[("h", x) for x in "abcd"])).collect()}
    assert star["h"] == 1.0 and star["a"] == 0.0


def test_degree_and_eigenvector(spark):
    star = edges(spark, *[("h", x) for x in "abcd"])
    assert {r.id: r.degree for r in analytics.degree(star).collect()}["h"] == 1.0
    e = {r.id: r.eigenvector for r in analytics.eigenvector(star).collect()}
    assert abs(e["h"] - 0.7071) < 1e-3 and abs(e["a"] - 0.3536) < 1e-3


def test_communities(spark):
    found = {}
    for r in analytics.communities(edges(spark, *BARBELL)).collect():
        found.setdefault(r.community_id, set()).add(r.id)
    assert sorted(map(sorted, found.values())) == [["a", "b", "c"], ["d", "e", "f"]]
    labels = analytics.label_communities(edges(spark, *BARBELL))
    assert labels.count() == 6


def test_components_do_not_depend_on_order(spark):
    pairs = [(str(i), str(i + 1)) for i in range(40)] + [("x", "y"), ("z", "z")]
    for rows in (pairs, pairs[::-1]):
        found = {r.node: r.root for r in connected_components(spark.createDataFrame(rows, "a string, b string")).collect()}
        assert {v for k, v in found.items() if k.isdigit()} == {"0"}
        assert (found["x"], found["y"], found["z"]) == ("x", "x", "z")
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_neighbourhoods_and_paths(spark):
    e = edges(spark, *BARBELL)
    assert {(r.id, r.distance) for r in graph.within_hops(e, "a", 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert graph.within_hops(e, "?", 2).count() == 0
    assert graph.ego_graph(e, "a").count() == 3
    p = graph.shortest_path(e, "a", "f").first()
    assert (p.path, p.length) == (["a", "c", "d", "f"], 3)
    assert graph.shortest_path(e, "a", "f", most=2).count() == 0
    assert graph.shortest_path(e, "a", "?").count() == 0
    assert graph.shortest_path(e, "a", "a").first().length == 0


def test_edge_merge_and_alias_merge(spark):
    rows = [("A", "B", "r", "c1", i, f"e{i}") for i in range(30)] + [("B", "A", "s", "c2", 99, None), ("A", "A", "r", "c1", 1, None), (None, "B", "r", "c1", 1, None)]
    m = graph.merge_edges(spark.createDataFrame(rows, "src string, dst string, relation string, case_id string, seq long, evidence string"))
    e = m.first()
    assert m.count() == 1 and (e.src, e.dst, e.weight, e.relation_types, e.case_ids, len(e.evidence)) == ("A", "B", 31.0, ["r", "s"], ["c1", "c2"], 25)
    aliases = spark.createDataFrame([("B", "A")], "alias string, canonical string")
    assert graph.apply_aliases(m, aliases).count() == 0


def test_case_graph_from_generated_tables(spark):
    c = generate.cases(spark, 5)
    rows = c.select(
        F.col("FIR_No").alias("case_id"), "seq",
        *[F.col(f"{r}_{x}" if not (r == "Accused" and x == "Name") else "Accused_Name_Alias").alias(f"{r.lower()}_{x.lower()}") for r in graph.ROLES for x in ("Name", "Contact", "Vehicles")],
    )
    e = graph.merge_edges(graph.case_mentions(rows))
    kinds = {r.type for r in graph.nodes_of(e).select("type").distinct().collect()}
    assert {"PERSON", "PHONE", "CASE"} <= kinds
    bank = generate.child_table(c, "Bank_Statement_Records").select(
        F.col("Person").alias("person"), F.col("Account_Number").alias("account"), F.col("Counterparty_Account_UPI").alias("counterparty"), F.col("Type_CR_DR").alias("kind"),
        F.col("Case_ID").alias("case_id"), F.lit(1).alias("seq"), F.col("Channel").alias("detail"),
    )
    moved = graph.bank_mentions(bank)
    assert moved.filter("relation = 'TRANSFERRED_TO' and (src is null or dst is null)").count() == bank.filter("counterparty = 'N/A'").count()


# --- resolution ----------------------------------------------------------------------------------

PEOPLE = [
    ("r1", "Mohd. Imran Khan", "9876543210", "Thane", ["MH1"], "C1"),
    ("r2", "Mohammad Imran Khan", "9876543210", "Thane", [], "C2"),
    ("r3", "M. Khan", "9876543210", "Pune", [], "C3"),
    ("r4", "Suresh Patil", "9000000001", "Vashi", ["MH9"], "C1"),
    ("r5", "", None, None, [], None),
    ("r6", "", None, None, [], None),
]


def people(spark):
    return spark.createDataFrame(PEOPLE, "record_id string, name string, phone string, address string, vehicles array<string>, case_id string")


def test_resolution(spark):
    p = people(spark)
    pairs = resolution.candidate_pairs(p)
    assert {(r.a, r.b) for r in pairs.collect()} == {("r1", "r2"), ("r1", "r3"), ("r2", "r3")}
    scored = resolution.score_pairs(p, pairs)
    by = {(r.a, r.b): r for r in scored.collect()}
    # equal comparable names, phone, address; different case; vehicles only on one side
    assert by["r1", "r2"].score == round(3.2016338 + 9.9366379 + 2.4150375 - 0.8300750, 3) and by["r1", "r2"].decision == "MATCH"
    placed = {r.record_id: r.entity_id for r in resolution.clusters(p, scored).collect()}
    assert placed["r1"] == placed["r2"] == "r1" and placed["r4"] == "r4" and placed["r5"] == "r5"
    found = {r.entity_id: r for r in resolution.entities(p, scored, resolution.clusters(p, scored)).collect()}
    assert found["r1"].confidence == 1.0 and found["r4"].n_pairs == 0
    assert found["r1"].canonical_name == "Mohammad Imran Khan"


# --- tables, timeline, files ---------------------------------------------------------------------


def test_balance_never_falls_below_the_floor(spark):
    rows = spark.createDataFrame([("a", 1, -600.0), ("a", 2, 100.0), ("a", 3, -50.0)], "k string, n long, x double")
    found = tables.running_balance(rows, "k", "n", "x", 1000, 500).orderBy("n").collect()
    assert [r.balance for r in found] == [500.0, 600.0, 550.0]


def test_search_and_defaults(spark):
    rows = spark.createDataFrame([("Foo", "2026-01-01"), (None, "2026-01-02"), ("foo", "bad")], "a string, day string")
    assert tables.search(rows, "FOO").count() == 2
    assert tables.search(rows, "", day="day", start="2026-01-01").count() == 2
    assert tables.search(rows, "foo", day="day", end="2026-01-01").count() == 1
    assert tables.find_column(rows, "missing", "DAY") == "day"


def test_report_lines(spark):
    rows = spark.createDataFrame([(0, "x"), (1, "CASE ID: C1"), (2, "[1] a"), (3, "[2] b"), (4, "CASE ID: C2"), (5, "[1] c")], "line_no long, text string")
    header = F.nullif(F.regexp_extract("text", r"CASE ID: (\w+)", 1), F.lit(""))
    finding = F.nullif(F.regexp_extract("text", r"\] (\w+)", 1), F.lit(""))
    assert {(r.case_id, r.finding) for r in timeline.report_lines(rows, header, finding).collect()} == {("C1", "a"), ("C1", "b"), ("C2", "c")}


def test_generated_tables_are_reproducible_and_read_back(spark, tmp_path):
    assert set(generate.COLUMNS) == set(generate.all_tables(spark, 1)) and len(generate.COLUMNS) == 29
    written = generate.write_all(spark, f"file://{tmp_path}", 4)
    assert "Call_Recording" in written
    back = files.read_table(spark, f"file://{tmp_path}", "Call_Recording")
    made = generate.child_table(generate.cases(spark, 4), "Call_Recording")
    assert back.count() == made.count() == 200
    assert dict(back.dtypes)["Duration (s)"] == "bigint" and dict(back.dtypes)["Calling Number (A-Party)"] == "string"
    number = generate.register_case(spark, f"file://{tmp_path}", {"District": "Thane", "nonsense": 1})
    assert number == "FIR/2026/0005" and files.next_case_number(spark, f"file://{tmp_path}") == "FIR/2026/0006"
    assert not files.write_csv(made.limit(0), f"file://{tmp_path}/none.csv") and not files.exists(spark, f"file://{tmp_path}/none.csv")


def test_audio(spark):
    tone = media.tone_fixture([(1, 0), (2, 440), (1, 0), (1, 880)])
    f = spark.createDataFrame([("t.wav", len(tone), bytearray(tone)), ("bad.wav", 3, bytearray(b"abc"))], "path string, length long, content binary")
    rows = {r.path: r.result for r in media.analyze(f, "audio", media.audio_analysis, "C1").collect()}
    parts = [(s.start, s.end) for s in rows["t.wav"].segments]
    assert len(parts) == 2 and abs(parts[0][0] - 1) < 0.1 and abs(parts[0][1] - 3) < 0.1 and abs(parts[1][0] - 4) < 0.1
    assert rows["t.wav"].duration == 5.0 and len(rows["t.wav"].mfcc_mean) == 13
    assert rows["bad.wav"].error


def exif_fixture() -> bytes:
    import struct

    def entry(tag, form, count, value):
        return struct.pack("<HHI4s", tag, form, count, value)

    text = b"Canon\0"
    gps_at, text_at = 8 + 2 + 24 + 4, 8 + 2 + 24 + 4 + 2 + 48 + 4
    lat_at = text_at + 8
    first = struct.pack("<H", 2) + entry(0x010F, 2, len(text), struct.pack("<I", text_at)) + entry(0x8825, 4, 1, struct.pack("<I", gps_at)) + b"\0" * 4
    gps = struct.pack("<H", 4) + entry(1, 2, 2, b"S\0\0\0") + entry(2, 5, 3, struct.pack("<I", lat_at)) + entry(3, 2, 2, b"E\0\0\0") + entry(4, 5, 3, struct.pack("<I", lat_at + 24)) + b"\0" * 4
    body = b"II*\0" + struct.pack("<I", 8) + first + gps + text.ljust(8, b"\0") + struct.pack("<6I", 19, 1, 30, 1, 0, 1) + struct.pack("<6I", 72, 1, 0, 1, 36, 1)
    app = b"Exif\0\0" + body
    return b"\xff\xd8\xff\xe1" + (len(app) + 2).to_bytes(2, "big") + app + b"\xff\xd9"


def test_image_metadata():
    found = media.exif(exif_fixture())
    assert found["make"] == "Canon" and found["lat"] == -19.5 and round(found["lon"], 4) == 72.01
    assert media.exif(b"\xff\xd8\xff\xd9") == {} and media.exif(b"") == {} and media.exif(b"II*\0\xff\xff\xff\xff") == {}


def test_movie_header():
    import struct

    mvhd = struct.pack(">I4sIIIII", 8 + 20, b"mvhd", 0, 0, 0, 1000, 5500)
    box = struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd
    assert media.movie(box) == {"duration": 5.5}
    assert media.movie(b"\0\0") == {}


def test_a_path_of_consecutive_ids_takes_few_rounds(spark, monkeypatch):
    from casewell.operators import components

    rounds, keep = [], components.stored
    monkeypatch.setattr(components, "stored", lambda df, label, **k: rounds.append(label) or keep(df, label, **k))
    path = spark.range(5000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.connected_components(path).agg(F.count(F.lit(1)), F.max("root")).first()
    assert tuple(found) == (5001, 0) and rounds.count("hooks") < 25


def test_running_sums_and_fills_over_ranges(spark):
    from itertools import accumulate

    from casewell.operators import frames

    rows = spark.range(1000).select((F.col("id") * 7 % 1009).alias("k"), F.when(F.col("id") % 3 == 0, F.col("id")).alias("v"))
    found = frames.running(rows, ["k"], {"n": F.lit(1), "s": F.col("k")}, part_rows=50).orderBy("k").collect()
    assert [r.n for r in found] == list(range(1, 1001)) and [r.s for r in found] == list(accumulate(r.k for r in found))
    few, one = (Counter((r.k, r.v) for r in frames.forward_fill(rows, "v", "k", part_rows=n).collect()) for n in (37, 10_000))
    assert few == one
    assert frames.numbered(rows.limit(0), "no", "N-%03d", ["k"]).count() == 0
