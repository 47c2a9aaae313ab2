"""Measures of a graph: degree, betweenness, eigenvector, bridges, communities, ranking."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casewell.functions.values import risk_tier
from casewell.storage import discard, scratch, stored

from .brandes import search_from
from .components import coded, connected_components, decoded, numbered_edges, spanning_forest, sums_to_end
from .frames import PART_ROWS, edge_totals, hand_on, in_ranges, running
from .graph import both_ways
from .greedy import merged

#: Up to this many edges they may be broadcast as whole numbers, or a component be one task; other ways beyond.
MOST_EDGES = 5_000_000
SOURCES = 256  # whose frontiers advance together
FEW_WAYS = 1_000  # of a component that shares its task with others
HUB = 1_000_000  # neighbours whose labels one task counts


def degree(edges: DataFrame) -> DataFrame:
    """``id, n_neighbours, degree``: neighbours over the other nodes, to four digits."""
    counts = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_neighbours"))
    n = counts.agg(F.count(F.lit(1))).scalar()
    share = F.when(n > 1, F.col("n_neighbours") / (n - 1)).otherwise(1.0)
    return counts.withColumn("degree", F.round(share, 4))


def betweenness(edges: DataFrame, most: int = MOST_EDGES, sources: int = SOURCES) -> DataFrame:
    """``id, betweenness``: exact, unweighted, normalized, to four digits.

    No shortest way leaves a component, so a search costs what its component has, not what the graph
    has. Components of up to ``most`` edges are searched by tasks that hold one of them and some of its
    sources; in larger ones ``sources`` sources at a time advance as rows by joins. Nothing is collected."""
    ways = stored(both_ways(edges.filter("src is not null and dst is not null and src <> dst")).distinct(), "ways", narrow=True)
    with scratch(edges.sparkSession) as keep:
        own = both_ways(edges).select(F.col("src").alias("id")).filter("id is not null").distinct()
        twin = keep(_twins(ways, own))
    kinds = twin.groupBy("kind").agg(F.count(F.lit(1)).alias("size"))
    kinds = stored(_numbers(kinds.select(F.col("kind").alias("id"), "size")), "kinds", narrow=True)
    n = twin.count()
    # one of each kind stands for it; what meets it counts for as many as it has
    src, dst = (kinds.select(F.col("id").alias(c), F.col("no").alias(x)) for c, x in (("src", "a"), ("dst", "b")))
    numbered = stored(ways.join(src, "src").join(dst, "dst").select("a", "b"), "ways", narrow=True)
    root = connected_components(numbered).withColumnRenamed("node", "a")
    placed = stored(numbered.join(root, "a"), "ways", narrow=True)
    sizes = kinds.select("no", "size")
    shape = stored(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n_ways"), F.count_distinct("a").alias("n_nodes")), "shapes", narrow=True)
    near, far = shape.filter(F.col("n_ways") <= 2 * most), shape.filter(F.col("n_ways") > 2 * most)
    parts = _searched(placed, sizes, near)
    if not far.isEmpty():
        beyond = placed.join(far.select("root"), "root")
        again = beyond.select(F.col("a").alias("id")).distinct().join(sizes.withColumnRenamed("no", "id"), "id")
        again = stored(_numbers(again), "beyond", narrow=True)
        a, b = (again.select(F.col("id").alias(c), F.col("no").alias(f"{c}2")) for c in ("a", "b"))
        beyond = stored(beyond.join(a, "a").join(b, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b")), "ways", narrow=True)
        rows = _advanced(beyond, again.select("no", "size"), again.count(), sources)
        parts = parts.unionByName(again.select("id", "no").join(rows, "no").select(F.col("id").alias("no"), "total"))
    # each pair is met from both of its ends, which cancels the 2 of 2 / ((n - 1) (n - 2))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    found = kinds.join(parts, "no", "left").select(F.col("id").alias("kind"), "total")
    return twin.join(found, "kind").select("id", F.round(F.coalesce("total", F.lit(0.0)) * scale, 4).alias("betweenness"))


def _twins(ways: DataFrame, own: DataFrame) -> DataFrame:
    """``id, kind``, stored: nodes of the same neighbours are one kind, named by the least of them. Shortest ways lead
    through twins alike, so one search serves them all. Neighbours are told by their number and the sums of two
    64-bit hashes, of which one set of neighbours in 2^64 and more pairs would agree by chance."""
    marks = [F.sum(F.xxhash64(*c).cast("decimal(20,0)")) for c in ((F.col("dst"),), (F.lit(1), F.col("dst")))]
    known = ways.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), marks[0].alias("x"), marks[1].alias("y"))
    known = stored(known, "neighbours", narrow=True)
    least = known.groupBy("n", "x", "y").agg(F.min("id").alias("kind"))
    named = known.join(least, ["n", "x", "y"]).select("id", "kind")
    alone = own.join(known.select("id"), "id", "left_anti").select("id", F.col("id").alias("kind"))
    return stored(named.unionByName(alone), "twins", narrow=True)


def _numbers(ids: DataFrame) -> DataFrame:
    """``id, no``: from 0 without gaps."""
    return running(ids, ["id"], {"no": F.lit(1).cast("long")}).withColumn("no", F.col("no") - 1)


def _searched(ways: DataFrame, sizes: DataFrame, shape: DataFrame) -> DataFrame:
    """``no, total`` of each kind's nodes by searches from one node of every kind within its component ``root`` of ``ways``
    (``a, b, root``), for the components of ``shape``. A component goes to as many tasks as its share of all
    searches asks for, and they divide its sources; small components share a task."""
    tasks = 3 * ways.sparkSession.sparkContext.defaultParallelism
    work = F.col("n_nodes") * F.col("n_ways").cast("double")
    whole = shape.agg(F.sum(work).alias("w"), F.sum(F.when(F.col("n_ways") <= FEW_WAYS, F.col("n_ways"))).alias("few")).first()
    packs = max((whole.few or 0) // (10 * FEW_WAYS), 1)
    few = F.col("n_ways") <= FEW_WAYS
    blocks = F.when(few, 1).otherwise(F.least("n_nodes", F.greatest(F.lit(1), F.ceil(work * tasks / (whole.w or 1.0))))).cast("int")
    pack = F.when(few, -1 - F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root"))
    dealt = shape.select("root", pack.alias("pack"), blocks.alias("blocks"))
    once = ways.filter("a < b").join(dealt, "root").select("pack", "blocks", "a", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    size = sizes.filter("size > 1")
    for c in ("a", "b"):
        once = once.join(size.select(F.col("no").alias(c), F.col("size").alias(f"size_{c}")), c, "left").withColumn(f"size_{c}", F.coalesce(f"size_{c}", F.lit(1)))
    # many more partitions than tasks, so that few hold two blocks: few rows are much work here
    found = once.repartition(16 * tasks, "pack", "block").groupBy("pack", "block").applyInPandas(_search, "no long, part double")
    return found.groupBy("no").agg(F.sum("part").alias("total"))


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    """``no, part``: the searches from a block's sources over the edges of its component."""
    blocks, block = int(pdf["blocks"].iloc[0]), int(pdf["block"].iloc[0])
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    size = np.ones(len(names))
    size[ends] = np.concatenate([pdf["size_a"].to_numpy(), pdf["size_b"].to_numpy()])
    a, b = ends[: len(a)], ends[len(a) :]
    total = search_from(np.arange(block, len(names), blocks), a, b, size)
    some = np.flatnonzero(total)
    return pd.DataFrame({"no": names[some], "part": total[some]})


def _advanced(ways: DataFrame, sizes: DataFrame, n: int, sources: int) -> DataFrame:
    """``no, total`` of each kind's nodes by frontiers as rows ``s, v, ways``: one node of a kind as source, kind and number of shortest ways to it.
    A block of sources goes out level by level, a join and an aggregate each, in which a node is new
    unless it lies in the last two levels; and back again, summing what each node hands to the
    level before. A block's rows are ``sources`` times the nodes at most."""
    spark, totals = ways.sparkSession, []
    ways = stored(ways.join(sizes.select(F.col("no").alias("a"), "size"), "a"), "ways", narrow=True)
    # the source's own kind has its twins only, two steps off
    met_nodes = F.col("size") - F.when(F.col("s") == F.col("a"), 1).otherwise(0)
    for first in range(0, n, sources):
        with scratch(spark) as keep:
            start = spark.range(first, min(first + sources, n)).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("ways"))
            levels = [stored(start, "level", narrow=True)]
            while True:
                many = met_nodes if len(levels) > 1 else F.lit(1)
                met = levels[-1].join(ways, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("ways") * many).alias("ways"))
                known = levels[-1].select("s", "v")
                if len(levels) == 2:
                    known = known.union(levels[0].join(sizes.filter("size = 1"), F.col("s") == F.col("no")).select("s", "v"))
                elif len(levels) > 2:
                    known = known.union(levels[-2].select("s", "v"))
                new = stored(met.join(known, ["s", "v"], "left_anti"), "level")
                if new.isEmpty():
                    break
                levels.append(new)
            gains, below = [], None
            for level in levels[:0:-1]:
                if below is None:
                    here = level.withColumn("gain", F.lit(0.0))
                else:
                    sent = below.select("s", "v", ((1 + F.col("gain")) / F.col("ways")).alias("c")).join(ways, F.col("v") == F.col("a"))
                    sent = sent.groupBy("s", F.col("b").alias("v")).agg(F.sum(F.col("c") * met_nodes).alias("c"))
                    here = level.join(sent, ["s", "v"], "left").select("s", "v", "ways", (F.col("ways") * F.coalesce("c", F.lit(0.0))).alias("gain"))
                below = stored(here, "gains")
                gains.append(below.select("s", "v", "gain"))
            some = reduce(DataFrame.unionByName, gains) if gains else levels[0].select("s", "v", F.lit(0.0).alias("gain"))
            some = some.join(sizes, F.col("s") == F.col("no")).groupBy("v").agg(F.sum(F.col("gain") * F.col("size")).alias("total"))
            totals.append(keep(stored(some.withColumnRenamed("v", "no"), "totals", narrow=True)))
        if len(totals) == 16:  # so that no plan grows with the number of blocks
            whole = stored(_added(totals), "totals", narrow=True)
            discard(*totals)
            totals = [whole]
    return _added(totals) if totals else ways.sparkSession.range(0).select(F.col("id").alias("no"), F.lit(0.0).alias("total"))


def _added(totals: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, totals).groupBy("no").agg(F.sum("total").alias("total"))


def eigenvector(edges: DataFrame, rounds: int = 1000, tolerance: float = 1e-6, settle: bool = True, digits: int = 4) -> DataFrame:
    """``id, eigenvector``: power iteration with a multiple of the identity added, from equal values, until the sum
    of changes is below ``n * tolerance``; zeros for all without convergence; to four digits. Without ``settle``
    the values after ``rounds`` rounds with the identity itself, whatever they still change.

    The multiple is half the eigenvalue that the first rounds estimate. It moves no eigenvector, but the
    opposite eigenvalue, which a graph of two sides has, then fades by a third a round instead of hardly.

    Twins have equal values in all rounds, so kinds of them (``_twins``) are what is iterated, each counted by its size. Their
    links stay where they are stored; a round is one join of them with the values, in which a hot
    node is split, and one aggregate. Only the values move, and those of the round before go."""
    ways = stored(both_ways(edges).filter("src is not null and dst is not null").distinct(), "ways", narrow=True)
    with scratch(edges.sparkSession) as keep:
        own = both_ways(edges).select(F.col("src").alias("id")).filter("id is not null").distinct()
        twin = keep(_twins(ways, own))
    kinds = stored(_numbers(twin.groupBy(F.col("kind").alias("id")).agg(F.count(F.lit(1)).alias("size"))), "kinds", narrow=True)
    n = twin.count()
    if not n:
        return twin.select("id", F.lit(0.0).alias("eigenvector"))
    to = twin.join(kinds.select(F.col("id").alias("kind"), F.col("no").alias("b")), "kind").select(F.col("id").alias("dst"), "b")
    links = ways.join(kinds.select(F.col("id").alias("src"), F.col("no").alias("a")), "src").join(to, "dst")
    links = stored(links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("w")), "links", narrow=True)
    now = stored(kinds.select("no", "size", F.lit(1.0).alias("x")), "values", narrow=True)
    norm = float(n)  # the values of a round are x / norm
    good, shift = not settle, 1.0
    none = [F.lit(None).cast(t).alias(c) for c, t in (("was", "double"), ("size", "long"))]
    for no in range(rounds):
        # sorted on both sides: values sent to all tasks would pass through the driver every round
        sent = links.hint("merge").join(now.select(F.col("no").alias("b"), "x"), "b").select(F.col("a").alias("no"), (F.col("x") * F.col("w")).alias("x"), *none)
        sent = sent.unionByName(now.select("no", (F.col("x") * shift).alias("x"), F.col("x").alias("was"), "size"))
        new = sent.groupBy("no").agg((F.sum("x") / norm).alias("x"), (F.max("was") / norm).alias("was"), F.max("size").alias("size"))
        new = stored(new, "values", narrow=True)
        norm = new.agg(F.sqrt(F.sum(F.col("size") * F.col("x") * F.col("x")))).first()[0] or 1.0
        off = new.agg(F.sum(F.col("size") * F.abs(F.col("x") / norm - F.col("was")))).first()[0]
        discard(now)
        now = new
        if settle and no < 3:
            shift = max(1.0, (norm - shift) / 2)
        if settle and off < n * tolerance:
            good = True
            break
    value = F.col("x") / norm if good else F.lit(0.0)
    found = kinds.join(now.select("no", F.round(value, digits).alias("eigenvector")), "no").select(F.col("id").alias("kind"), "eigenvector")
    return twin.join(found, "kind").select("id", "eigenvector")


def _by_component(edges: DataFrame) -> DataFrame:
    roots = connected_components(edges, "src", "dst")
    return stored(edges.select("src", "dst").distinct().join(roots.withColumnRenamed("node", "src"), "src"), "parts")


def bridges(edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``src, dst`` of the edges whose removal disconnects their component, for graphs of any size.

    Only edges of a spanning forest can be bridges, and one is a bridge unless another edge joins the
    two sides that it separates. Every other edge has a label of 128 random bits, and a node the
    exclusive sum of its edges' labels. Summed over one side of a forest edge the labels within the side
    cancel, and what is left are those of edges across: zero only if there are none (or by a chance of
    2^-128). A side is a stretch of the tour around its tree, so the sums follow from
    sums along the tour, which pointer doubling finds. Loops and null ends are left out."""
    with scratch(edges.sparkSession) as keep:
        ends = edges.filter("src is not null and dst is not null and src <> dst")
        pairs = stored(ends.select(F.least("src", "dst").alias("ea"), F.greatest("src", "dst").alias("eb")).distinct(), "pairs", narrow=True)
        forest = spanning_forest(pairs, "ea", "eb")
        others = pairs.join(forest.select("ea", "eb"), ["ea", "eb"], "left_anti").withColumns({"x": F.xxhash64("ea", "eb"), "y": F.xxhash64("eb", "ea", F.lit(1))})
        marks = others.select(F.col("ea").alias("u"), "x", "y").union(others.select("eb", "x", "y")).groupBy("u").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
        arcs = _tour(forest, part_rows)
        # a node's mark lies on its arc to its first neighbour
        marked = arcs.filter("v = first").join(stored(marks, "marks", narrow=True), "u").select("id", "x", "y")
        cells = arcs.join(stored(marked, "marked", narrow=True), "id", "left").select("id", "next", F.coalesce("x", F.lit(0).cast("long")).alias("x"), F.coalesce("y", F.lit(0).cast("long")).alias("y"))
        after = sums_to_end(cells, "x", "y")
        there = arcs.filter("u < v").select("id", "u", "v").join(after, "id").select("u", "v", "x", "y")
        back = arcs.filter("u > v").select("id", F.col("v").alias("u"), F.col("u").alias("v")).join(after, "id").select("u", "v", F.col("x").alias("x2"), F.col("y").alias("y2"))
        out = there.join(back, ["u", "v"]).filter("x = x2 and y = y2").select(F.col("u").alias("src"), F.col("v").alias("dst"))
        return keep(stored(out, "bridges", narrow=True))


def _tour(forest: DataFrame, part_rows: int) -> DataFrame:
    """``id, u, v, first, next``, stored: an arc for each way of a forest edge, with the ``id`` of the arc that follows it on
    the tour around its tree; ``first`` is the first neighbour of ``u``. The arc after ``u`` to ``v`` leaves ``v`` for
    the neighbour after ``u``. Neighbours are ordered by ranges, so a node of any degree is many
    tasks. Each tour ends where it would enter its root's first arc again."""
    ways = forest.select(F.col("ea").alias("u"), F.col("eb").alias("v")).union(forest.select("eb", "ea"))
    placed = in_ranges(ways, ["u", "v"], part_rows)
    here = Window.partitionBy("__part", "u")
    edge = edge_totals(placed, ["u"], {"__first": F.min("v")})
    along = Window.partitionBy("u").orderBy("__part")
    edge = edge.select("u", "__part", F.lead("__first").over(along).alias("__later"), F.min("__first").over(Window.partitionBy("u")).alias("__least"))
    placed = placed.withColumns({"__next": F.lead("v").over(here.orderBy("v")), "__own": F.min("v").over(here)})
    placed = hand_on(placed, ["u"], stored(edge, "handed", narrow=True))
    first = F.coalesce("__least", "__own")
    arcs = placed.select("u", "v", first.alias("first"), F.coalesce("__next", "__later", first).alias("turn"), F.coalesce("__next", "__later").isNull().alias("last"))
    arcs = stored(arcs.withColumn("id", F.monotonically_increasing_id()), "arcs", narrow=True)
    roots = ways.select("u").distinct().join(forest.select(F.col("node").alias("u")), "u", "left_anti").withColumn("__root", F.lit(True))
    # entering u from v goes on to u's next neighbour; at a root's last neighbour the tour ends
    entered = arcs.join(stored(roots, "roots", narrow=True), "u", "left").filter("not (last and coalesce(__root, false))").select(F.col("v").alias("u"), F.col("u").alias("v"), "turn")
    after = arcs.select(F.col("u").alias("v"), F.col("v").alias("turn"), F.col("id").alias("next"))
    follows = stored(entered.join(after, ["v", "turn"]).select("u", "v", "next"), "follows", narrow=True)
    return stored(arcs.select("id", "u", "v", "first").join(follows, ["u", "v"], "left"), "tour", narrow=True)


def communities(edges: DataFrame, most: int = MOST_EDGES) -> DataFrame:
    """``id, community_id, size``: greedy modularity, merging the pair of communities that gains
    most until none gains, the least nodes first on ties. Components are independent once the number of
    all edges is known, so each of up to ``most`` edges is a group of its own; larger ones are contracted
    (``contracted_communities``), which merges many pairs at once. Communities are numbered by size, then least
    member."""
    parts = _by_component(edges)
    shape = stored(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "shapes", narrow=True)
    found = shape.agg(F.sum("n").alias("m"), F.count_if(F.col("n") <= most).alias("near"), F.count_if(F.col("n") > most).alias("far")).first()
    if found.far and not found.near:
        return contracted_communities(edges)
    m = max(found.m or 0, 1)

    def of_part(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf["src"]) | set(pdf["dst"]))
        number, n = {v: i for i, v in enumerate(names)}, len(names)
        a, b = np.array([number[x] for x in pdf["src"]]), np.array([number[x] for x in pdf["dst"]])
        a, b = a[a != b], b[a != b]
        now = merged(a, b, n, m)
        return pd.DataFrame({"id": names, "head": [names[i] for i in now]})

    kind = edges.schema["src"].dataType.simpleString()
    near = parts.join(shape.filter(F.col("n") <= most).select("root"), "root")
    # partitions by number: few rows are much work here, so that small ones are not to be put together
    near = near.repartition(min(max(4 * found.near, 1), 1_000), "root").groupBy("root").applyInPandas(of_part, f"id {kind}, head {kind}")
    if found.far:
        near = near.unionByName(_contracted(parts.join(shape.filter(F.col("n") > most).select("root"), "root"), m))
    return _numbered(stored(near, "communities"))


def _numbered(placed: DataFrame) -> DataFrame:
    sizes = placed.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    sizes = running(sizes, [F.desc("size"), "head"], {"community_id": F.lit(1)})
    return placed.join(sizes, "head").select("id", F.col("community_id").cast("int").alias("community_id"), "size")


def contracted_communities(edges: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """``id, community_id, size`` by contraction, for graphs of any size: each round every community looks
    for the neighbour with which merging gains most modularity (least id on ties). Those whose choice is
    a community that is chosen back, or the less of two that chose each other, join it, in
    order of what they gain and as long as they still gain with all that come before them added. Then
    edges are summed between the communities left. Modularity grows with every join, and the
    best pair of all always joins. Sums along the joiners of one community are made by ranges, so
    a community that all others choose is many tasks."""
    return _numbered(_contracted(edges, part_rows=part_rows))


def _contracted(edges: DataFrame, m: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``id, head``, stored, by contraction; ``m`` edges in all, those of ``edges`` if it is not given."""
    with scratch(edges.sparkSession) as keep:
        pairs = edges.filter("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
        links = stored(pairs.filter("a <> b").withColumn("w", F.lit(1).cast("long")), "links", narrow=True)
        m = F.lit(m or links.count()).cast("decimal(20,0)")
        both = links.select("a", "b").union(links.select("b", "a"))
        share = stored(both.groupBy(F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("d")), "shares", narrow=True)
        own = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
        place = stored(own.select(F.col("v").alias("id"), F.col("v").alias("head")), "places", narrow=True)
        while True:
            hook = _joins(links, share, m, part_rows)
            if hook.isEmpty():
                return keep(place)
            moved = place.join(hook.select(F.col("v").alias("head"), "to"), "head", "left").select("id", F.coalesce("to", "head").alias("head"))
            left, right = hook.select(F.col("v").alias("a"), F.col("to").alias("a2")), hook.select(F.col("v").alias("b"), F.col("to").alias("b2"))
            linked = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"), "w").filter("x <> y")
            linked = linked.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("w").alias("w"))
            shared = share.join(hook.select("v", "to"), "v", "left").groupBy(F.coalesce("to", "v").alias("v")).agg(F.sum("d").alias("d"))
            now = stored(moved, "places", narrow=True), stored(linked, "links", narrow=True), stored(shared, "shares", narrow=True)
            discard(place, links, share)
            place, links, share = now


def _joins(links: DataFrame, share: DataFrame, m: Column, part_rows: int) -> DataFrame:
    """``v, to``, stored: which communities join which in a round; no ``to`` is a ``v``. Gains are
    ``2 m w - d_v d_to`` in whole numbers."""
    number = "decimal(38,0)"
    d = lambda c: F.col(c).cast("decimal(19,0)")
    left, right = share.select(F.col("v").alias("a"), F.col("d").alias("da")), share.select(F.col("v").alias("b"), F.col("d").alias("db"))
    gains = links.join(left, "a").join(right, "b").withColumn("gain", (2 * m * d("w") - d("da") * d("db")).cast(number))
    gains = stored(gains.filter("gain > 0"), "gains", narrow=True)
    ways = gains.select(F.col("a").alias("v"), F.col("b").alias("to"), "gain", "w", F.col("da").alias("dv")).unionByName(gains.select(F.col("b").alias("v"), F.col("a").alias("to"), "gain", "w", F.col("db").alias("dv")))
    best = ways.groupBy("v").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "to", "w", "dv")).alias("best"))
    best = stored(best.select("v", "best.*"), "choices", narrow=True)
    chosen = best.select(F.col("v").alias("to"), F.col("to").alias("theirs"))
    met = best.join(chosen, "to")
    # heads: of two that chose each other the less one
    heads = stored(met.filter("theirs = v and to < v").select("to").distinct(), "heads", narrow=True)
    taken = share.select(F.col("v").alias("to"), F.col("d").alias("dt"))
    wish = best.join(heads, "to", "left_semi").join(heads.select(F.col("to").alias("v")), "v", "left_anti").join(taken, "to")
    order = ["to", "loss", "v"]
    placed = in_ranges(wish.select(*order, "w", "dv", "dt"), order, part_rows)
    before = F.coalesce(F.sum("dv").over(Window.partitionBy("__part", "to").orderBy("loss", "v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = Window.partitionBy("to").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge_totals(placed, ["to"], {"n": F.sum("dv")}).withColumn("__more", F.sum("n").over(earlier)).drop("n")
    summed = hand_on(placed.withColumn("__before", before), ["to"], stored(edge, "handed", narrow=True))
    grown = d("dt") + (F.col("__before") + F.coalesce("__more", F.lit(0))).cast("decimal(19,0)")
    hook = summed.filter((2 * m * d("w") - d("dv") * grown).cast(number) > 0).select("v", "to")
    return stored(hook, "joins", narrow=True)


def label_communities(edges: DataFrame, rounds: int = 5, hub: int = HUB) -> DataFrame:
    """``id, community_id, size`` by label propagation, for graphs of any size: every node takes the
    most frequent label of its neighbours and itself, the least one on ties.

    Nodes are numbered in order of their ids, so the least number is the least label. In the first round all labels differ, so
    it is one aggregate of the links. In later rounds a node's labels are shuffled once and counted where they arrive; those of a
    node of more than ``hub`` neighbours are dealt by label to as many tasks as they ask for."""
    with scratch(edges.sparkSession) as keep:
        names, pairs = numbered_edges(edges, "src", "dst")
        n = max(names.count(), 1)
        ways = pairs.select(F.col("a").alias("id"), F.col("b").alias("near")).union(pairs.filter("a <> b").select("b", "a"))
        met = ways.groupBy("id").agg(F.min("near").alias("near"), F.max(F.col("near") == F.col("id")).alias("loop"), F.count(F.lit(1)).alias("n"))
        met = stored(names.select(F.col("no").alias("id")).join(met, "id", "left"), "met")
        # who links to itself hears its own label twice
        label = met.select("id", F.when(F.col("loop") | F.lit(rounds < 1), F.col("id")).otherwise(F.least("id", "near")).alias("head"))
        label = stored(label, "labels")
        hubs = stored(met.filter(F.col("n") > hub).select("id", F.ceil(F.col("n") / hub).alias("parts")), "hubs", narrow=True)
        by = ["id"] if hubs.isEmpty() else ["id", "part"]
        for _ in range(rounds - 1):
            sent = label.select(F.col("id").alias("near"), "head").hint("shuffle_hash")
            heard = ways.join(sent, "near").select("id", "head").unionByName(label)
            if "part" in by:
                heard = heard.join(hubs, "id", "left").withColumn("part", F.expr("pmod(xxhash64(head), coalesce(parts, 1))")).drop("parts")
            votes = heard.repartition(*by).groupBy(*by, "head").agg(F.count(F.lit(1)).alias("n"))
            # more votes first: a node has n + 1 at most
            best = votes.groupBy(*by).agg(F.min(coded(F.lit(n + 1) - F.col("n"), F.col("head"), n)).alias("best")).groupBy("id").agg(F.min("best").alias("best"))
            now = stored(best.select("id", decoded("best", n)[1].alias("head")), "labels")
            discard(label)
            label = now
        found = _numbered(label).withColumnRenamed("id", "no")
        return keep(stored(names.join(found, "no").select("id", "community_id", "size"), "communities", narrow=True))


def ranking(degrees: DataFrame, between: DataFrame, eigen: DataFrame, community: DataFrame | None = None, most: int | None = 25) -> DataFrame:
    """``id, degree, betweenness, eigenvector, composite_score, risk_tier, community_id``: weights 0.3,
    0.5, 0.2 on the rounded measures, at most 100, two digits; the highest ``most``."""
    rows = degrees.select("id", "degree").join(between, "id").join(eigen, "id")
    score = F.round(F.least(F.lit(100.0), (0.5 * F.col("betweenness") + 0.3 * F.col("degree") + 0.2 * F.col("eigenvector")) * 100), 2)
    rows = rows.withColumn("composite_score", score).withColumn("risk_tier", risk_tier(F.col("composite_score")))
    if community is not None:
        rows = rows.join(community.select("id", "community_id"), "id", "left")
    rows = rows.withColumn("community_id", F.coalesce("community_id", F.lit(1)) if community is not None else F.lit(1))
    return rows.orderBy(F.desc("composite_score"), "id").limit(most) if most else rows
