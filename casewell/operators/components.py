"""Connected components, spanning forests and list sums, for edges that fit no single machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.storage import discard, stored

from .frames import running

#: Below this many nodes a pair of their numbers is one long; decimals beyond.
MOST_CODED = 3_000_000_000


def numbered_edges(edges: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """``id, no`` of all ends, numbered from 0 without gaps in order of the ids, and ``a <= b``: the numbers of the ends of
    each edge that has both, once each; both stored. What follows sorts, hashes and shuffles numbers instead of names."""
    ids = edges.select(F.col(a).alias("id")).union(edges.select(b)).filter("id is not null").distinct()
    names = running(ids, ["id"], {"no": F.lit(1).cast("long")}).select("id", (F.col("no") - 1).alias("no"))
    names = stored(names, "names", narrow=True)
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    for c, no in (("x", "a"), ("y", "b")):  # hashed: the many edges are not sorted by name
        ends = ends.join(names.select(F.col("id").alias(c), F.col("no").alias(no)).hint("shuffle_hash"), c)
    return names, stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "numbered")


def coded(high: Column, low: Column, n: int) -> Column:
    """``high * n + low``, of whole numbers with ``low < n`` and ``high <= n``: they order as the pair does, and aggregates
    keep them in place, where a struct would have all rows sorted."""
    kind = "long" if n < MOST_CODED else "decimal(19,0)"
    return (high.cast(kind) * F.lit(n).cast(kind) + low.cast(kind)).cast("long" if n < MOST_CODED else "decimal(38,0)")


def decoded(code: str, n: int) -> tuple[Column, Column]:
    """``high, low`` of ``coded``."""
    return F.expr(f"cast({code} div {n} as long)"), F.expr(f"cast({code} % {n} as long)")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the least node of the component of each node that has an edge.

    Every round deals its own hash-random ranks to the nodes that are left. A node hooks to the
    one of least rank among its neighbours and itself, chains of hooks are shortened once, and
    the edges are rewritten between the hooks. The ranks are drawn afresh, so no order of the ids,
    a path of consecutive ones included, makes a bad case: the nodes left shrink by a factor of
    two and more a round in expectation, and rounds grow with the logarithm of a component's
    size. A round writes its hooks and its edges, both of the size of what is left; the hooks
    of all rounds are joined from the last to the first, which costs about as much as the first
    one alone. Nothing is collected, and a lost executor costs one round at most.

    An edge to itself gives its node; null ends are left out; an empty table gives no rows.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null")
    pairs = stored(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges", narrow=True)
    links, rounds, done = pairs.filter("a <> b"), [], []
    while not links.isEmpty():
        no = F.lit(len(rounds))

        def ranked(c: str, no: Column = no) -> Column:
            return F.struct(F.xxhash64(c, no).alias("rank"), F.col(c).alias("node"))

        ways = links.select(F.col("a").alias("v"), F.col("b").alias("w")).union(links.select("b", "a"))
        hook = ways.groupBy("v").agg(F.min(ranked("w")).alias("best")).select("v", F.least("best", ranked("v"))["node"].alias("to"))
        further = hook.select(F.col("v").alias("to"), F.col("to").alias("further"))
        hook = stored(hook.join(further, "to").select("v", F.col("further").alias("to")), "hooks", narrow=True)
        left, right = hook.select(F.col("v").alias("a"), F.col("to").alias("a2")), hook.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        moved = links.join(left, "a").join(right, "b").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
        links = stored(moved.filter("a <> b").distinct(), "edges", narrow=True)
        rounds.append(hook)
        done.append(links)
    loops = pairs.filter("a = b").select(F.col("a").alias("node"))
    if not rounds:
        return loops.withColumn("root", F.col("node"))
    place = rounds[-1]
    for i, hook in enumerate(reversed(rounds[:-1]), 1):
        later = place.select(F.col("v").alias("to"), F.col("to").alias("last"))
        place = hook.join(later, "to", "left").select("v", F.coalesce("last", "to").alias("to"))
        if i % 4 == 0:  # so that no plan grows with the number of rounds
            place = stored(place, "hooks", narrow=True)
            done.append(place)
    place = stored(place, "places", narrow=True)
    least = stored(place.groupBy("to").agg(F.min("v").alias("root")), "roots", narrow=True)
    named = place.join(least, "to").select(F.col("v").alias("node"), "root")
    alone = loops.join(place, loops["node"] == place["v"], "left_anti").withColumn("root", F.col("node"))
    out = stored(named.unionByName(alone), "components", narrow=True)
    discard(pairs, *rounds, *done, place, least)
    return out


def spanning_forest(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, ea, eb``: an edge ``ea < eb`` of the table for every node but one of each component, the edges of a
    spanning forest; stored. The node of a component that has no row is its root.

    Each round a node hooks to the neighbour of least rank if that is less than its own. Ranks fall along
    hooks, so their edges close no circle, and each tree of hooks is one node of the next round: pointers
    double until they are at its root, of whose depth they take the logarithm. Only nodes of less rank
    than all their neighbours are left, so rounds grow with the logarithm of a component, in stars and
    paths alike. Links keep the least edge of the table between their ends.
    """
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a is not null and b is not null and a <> b")
    pairs = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stored(pairs.select("a", "b", F.struct(F.col("a").alias("ea"), F.col("b").alias("eb")).alias("edge")), "links", narrow=True)
    done, rounds = [], []
    while not links.isEmpty():
        no = F.lit(len(rounds))

        def rank(c: str, no: Column = no) -> Column:
            return F.struct(F.xxhash64(c, no).alias("rank"), F.col(c).alias("node"))

        ways = links.select(F.col("a").alias("v"), F.col("b").alias("w"), "edge").union(links.select("b", "a", "edge"))
        best = ways.groupBy("v").agg(F.min(F.struct(rank("w").alias("to"), "edge")).alias("best"))
        hook = stored(best.select("v", "best.edge", F.when(F.col("best.to") < rank("v"), F.col("best.to.node")).otherwise(F.col("v")).alias("to")), "hooks", narrow=True)
        rounds.append(hook)
        hook = hook.select("v", "to")
        while True:
            further = hook.select(F.col("v").alias("to"), F.col("to").alias("further"))
            again = further.select(F.col("to").alias("further"), F.col("further").alias("last"))
            jumped = stored(hook.join(further, "to").join(again, "further").select("v", F.col("last").alias("to"), (F.col("last") != F.col("further")).alias("moved")), "hooks", narrow=True)
            done.append(jumped)
            hook = jumped.select("v", "to")
            if jumped.filter("moved").isEmpty():
                break
        left, right = hook.select(F.col("v").alias("a"), F.col("to").alias("a2")), hook.select(F.col("v").alias("b"), F.col("to").alias("b2"))
        moved = links.join(left, "a").join(right, "b").select(F.col("a2").alias("x"), F.col("b2").alias("y"), "edge").filter("x <> y")
        moved = moved.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.min("edge").alias("edge"))
        done.append(links)
        links = stored(moved, "links", narrow=True)
    done.append(links)
    out = links.select(F.col("a").alias("node"), "edge.ea", "edge.eb")
    for hook in rounds:
        out = out.unionByName(hook.filter("to <> v").select(F.col("v").alias("node"), "edge.ea", "edge.eb"))
    out = stored(out, "forest", narrow=True)
    discard(*done, *rounds)
    return out


def sums_to_end(cells: DataFrame, *values: str) -> DataFrame:
    """``id`` and the values: for each cell of linked lists (``id, next``, null at an end, and whole numbers) the
    bitwise exclusive sums of the values of all cells after it; stored. Pointers double every round, so
    rounds are the logarithm of the longest list, each a join of plain shuffles."""
    after = cells.select(F.col("id").alias("next"), *[F.col(v).alias(f"__{v}") for v in values])
    first = cells.select("id", "next").join(after, "next", "left")
    now = stored(first.select("id", "next", *[F.coalesce(f"__{v}", F.lit(0).cast("long")).alias(v) for v in values]), "lists", narrow=True)
    while not now.filter("next is not null").isEmpty():
        further = now.select(F.col("id").alias("next"), F.col("next").alias("__next"), *[F.col(v).alias(f"__{v}") for v in values])
        both = now.join(further, "next", "left")
        moved = both.select("id", F.col("__next").alias("next"), *[F.col(v).bitwiseXOR(F.coalesce(f"__{v}", F.lit(0).cast("long"))).alias(v) for v in values])
        moved = stored(moved, "lists", narrow=True)
        discard(now)
        now = moved
    return now.drop("next")
