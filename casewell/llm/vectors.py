"""Nearest neighbours with a hierarchical k-means tree and best-bin-first search.

The upper levels of the tree are fitted on a bounded sample; every row is filed under the cell that
a descent by nearest centre reaches. Cells that hold too many rows get further levels, each
fitted on a bounded sample of its own cell, until a cell holds about ``LEAF_ROWS`` rows or
vectors that cannot be told apart, so cells do not grow with the table. A query keeps the nodes
in a priority queue by the distance of their centres and takes the nearest first; a leaf is
taken in the order of the greatest distance on its way down. Each leaf it takes is a visit. How
many visits are needed is measured: for a bounded set of calibration rows, which are not among
the queries where there are others, the exact neighbours over all rows are found by brute
force, and visits are widened until the calibrated recall is reached.

Cells are split into blocks of bounded size on the side of rows and on the side of queries, and a
block of rows meets a block of queries in one task, so a cell that holds a third of all rows is
many tasks. Distances are computed on the original vectors in double precision.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hash_sample, stored

SAMPLE = 20_000  # vectors, about, that a tree is fitted on: the upper one, and that of each cell split further
BRANCH = 16
LEAF_ROWS = 256  # rows a leaf should hold; a cell of BRANCH times as many is split, into at most SAMPLE / 8 leaves
LEVELS = 5  # trees below each other; SAMPLE / 8 leaves each
CELL_BITS = 12  # of a cell's number for each level
CALIBRATION = 100  # queries whose exact neighbours are found
RECALL = 0.97
BLOCK = 4096  # rows or queries of a block
FIRST_VISITS = 256
BROADCAST_CELLS = 100_000


class Tree:
    """Centres of all nodes; children of a node are consecutive."""

    def __init__(self, x: np.ndarray, leaves: int, branch: int = BRANCH):
        self.centre = [x.mean(0) if len(x) else np.zeros(x.shape[1])]
        self.first, self.count = [0], [0]
        open_ = [(-len(x), 0, np.arange(len(x)))]
        n_leaves = 1
        rng = np.random.default_rng(7)
        while open_ and n_leaves < leaves:
            _, node, rows = heapq.heappop(open_)
            k = min(branch, leaves - n_leaves + 1, len(rows) // 2)
            if k < 2:
                continue
            centres, owner = _kmeans(x[rows], k, rng)
            if len(centres) < 2:
                continue
            self.first[node], self.count[node] = len(self.centre), len(centres)
            n_leaves += len(centres) - 1
            for c in range(len(centres)):
                heapq.heappush(open_, (-int((owner == c).sum()), len(self.centre), rows[owner == c]))
                self.centre.append(centres[c])
                self.first.append(0)
                self.count.append(0)
        self.centre = np.array(self.centre)
        leaves = [i for i, n in enumerate(self.count) if not n]
        self.number = np.zeros(len(self.count), np.int64)
        self.number[leaves] = np.arange(1, len(leaves) + 1)  # of leaves, from 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector, by descent to the nearest centre (the first one on ties)."""
        out = np.zeros(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if not self.count[node]:
                out[rows] = node
                continue
            c = self.centre[self.first[node] : self.first[node] + self.count[node]]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(self.first[node] + k, rows[near == k]) for k in range(self.count[node])]
        return out

    def visits(self, q: np.ndarray, most: int | None = None) -> list[tuple[int, float]]:
        """Leaves in the order in which best-bin-first takes them, ``most`` at most, each with the greatest
        distance taken so far: leaves of several trees merge by it as one queue would take them."""
        queue, out, far = [(0.0, 0)], [], 0.0
        while queue and (most is None or len(out) < most):
            d, node = heapq.heappop(queue)
            far = max(far, d)
            if not self.count[node]:
                out.append((node, far))
                continue
            at = self.first[node]
            d = ((self.centre[at : at + self.count[node]] - q) ** 2).sum(1)
            for k in range(self.count[node]):
                heapq.heappush(queue, (float(d[k]), at + k))
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Lloyd's rounds; empty clusters are dropped."""
    centres = np.unique(x[rng.choice(len(x), k, replace=False)], axis=0)
    owner = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        near = ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)
        used, owner = np.unique(near, return_inverse=True)
        centres = np.array([x[owner == c].mean(0) for c in range(len(used))])
    return centres, owner


def usable(v: Column, dim: int | None = None) -> Column:
    """Neither null, empty nor zero, no null or non-finite component, and of the given dimension."""
    ok = ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ok = v.isNotNull() & (F.size(v) > 0) & ok & F.exists(v, lambda c: c != 0)
    return F.coalesce(ok & (F.size(v) == dim) if dim else ok, F.lit(False))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _nearest(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per query (by position): ids and distances of its k nearest, nearest first, ties to smaller ids."""
    for i in range(len(q)):
        d = np.sqrt(((x - q[i]) ** 2).sum(1))
        d[ids == q_ids[i]] = np.inf
        cut = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
        some = np.flatnonzero((d <= cut) & (d < np.inf))
        best = some[np.lexsort((ids[some], d[some]))[:k]]
        yield i, ids[best], d[best]


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]], q_ids: np.ndarray) -> pa.Table:
    n = [len(r[1]) for r in rows]
    join = lambda j, kind: np.concatenate([r[j] for r in rows]) if rows else np.zeros(0, kind)
    return pa.table(
        {
            "query_id": pa.array(np.repeat(q_ids[[r[0] for r in rows]] if rows else np.zeros(0, np.int64), n), pa.int64()),
            "vec_id": pa.array(join(1, np.int64), pa.int64()),
            "score": pa.array(join(2, np.float64), pa.float64()),
        }
    )


FOUND = "query_id long, vec_id long, score double"


def exact_neighbours(rows: DataFrame, q_ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Brute force over all rows for a bounded set of queries, by blocks of rows."""
    dim = q.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast((q_ids, q))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q = shared.value
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                yield from _found(list(_nearest(q, q_ids, _matrix(part.column(1), dim), ids, k)), q_ids).to_batches()

    return top_k(rows.select("vec_id", "vec").mapInArrow(scan, FOUND), k)


def top_k(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Index:
    """Rows filed under cells, the upper tree, and the trees of the cells that are split further.

    ``filed`` has ``vec_id, vec, asks, cell``; ``trees`` has ``cell, tree`` (a pickled ``Tree``) or is None.
    A cell's number has ``CELL_BITS`` for the leaf taken on each level."""

    def __init__(self, rows: DataFrame, total: int, dim: int, sample: int, leaf_rows: int):
        self.dim, self.kind = dim, rows.schema["vec"].dataType.simpleString()
        most = sample // 8
        some = hash_sample(rows, total, sample, "vec_id").select("vec_id", "vec").toArrow().sort_by("vec_id")
        self.top = rows.sparkSession.sparkContext.broadcast(Tree(_matrix(some.column("vec"), dim), int(np.clip(total / leaf_rows, 1, most))))
        top = self.top

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                tree = top.value
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.number[tree.leaf_of(_matrix(b.column(1), dim))])], [*b.schema.names, "cell"])

        self.filed = stored(rows.select("vec_id", "vec", "asks").mapInArrow(file, f"{self._row()}, cell long"), "filed")
        self.trees: DataFrame | None = None
        closed: DataFrame | None = None
        for _ in range(1, LEVELS):
            large = self.filed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > leaf_rows * BRANCH)
            large = stored(large if closed is None else large.join(closed, "cell", "left_anti"), "large", narrow=True)
            if large.isEmpty():
                break
            new = stored(self._fitted(large, sample, leaf_rows), "trees")
            done = new.filter("not split").select("cell")
            closed = done if closed is None else closed.unionByName(done)
            new = new.filter("split").select("cell", "tree")
            self._refile(new.join(large, "cell"))
            self.trees = new if self.trees is None else self.trees.unionByName(new)

    def _row(self) -> str:
        return f"vec_id long, vec {self.kind}, asks boolean"

    def _fitted(self, large: DataFrame, sample: int, leaf_rows: int) -> DataFrame:
        """``cell, tree, split`` of cells (``cell, rows``), each on about ``sample`` of its rows."""
        dim = self.dim

        def fit(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("vec_id")
            tree = Tree(_matrix(rows.column("vec"), dim), int(np.clip(rows.column("rows")[0].as_py() / leaf_rows, 2, sample // 8)))
            return pa.table({"cell": pa.array([key[0].as_py()], pa.int64()), "tree": pa.array([pickle.dumps(tree)], pa.binary()), "split": pa.array([len(tree.count) > 1])})

        parts = 1 << 30
        few = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(parts)) < parts * F.least(F.lit(1.0), sample / F.col("rows"))
        some = self.filed.join(_few(large), "cell").filter(few).select("cell", "vec_id", "vec", "rows")
        return some.groupBy("cell").applyInArrow(fit, "cell long, tree binary, split boolean")

    def _refile(self, trees: DataFrame) -> None:
        """Rows of the cells in ``trees`` (``cell, tree, rows``) to the leaves of these; a block of rows at a time."""
        dim, names = self.dim, ["vec_id", "vec", "asks", "cell"]

        def file(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
            if not rows.num_rows:
                return pa.schema([*rows.schema]).empty_table().select(names)
            tree = pickle.loads(trees.column("tree")[0].as_py())
            leaf = tree.number[tree.leaf_of(_matrix(rows.column("vec"), dim))]
            return rows.select(names[:3]).append_column("cell", pa.array((key[0].as_py() << CELL_BITS) + leaf))

        blocks = F.ceil(F.col("rows") / (4 * BLOCK)).cast("int")
        cells = stored(trees.select("cell", blocks.alias("blocks")), "cells", narrow=True)
        left = self.filed.join(_few(cells), "cell").withColumn("block", _block("vec_id", "blocks")).select(*names, "block")
        right = trees.select("cell", "tree", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        moved = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(file, f"{self._row()}, cell long")
        stay = self.filed.join(_few(cells.select("cell")), "cell", "left_anti").select(names)
        old, self.filed = self.filed, stored(stay.unionByName(moved), "filed")
        discard(old)

    def visits(self, asks: DataFrame, most: int) -> DataFrame:
        """``query_id, q, cell, far`` of the first ``most`` leaves of each row of ``asks`` (``query_id, q``)."""
        dim, top = self.dim, self.top
        names, schema = ["query_id", "q", "cell", "far"], f"query_id long, q {self.kind}, cell long, far double"

        def listed(rows: pa.RecordBatch | pa.Table, lists: list, base: np.ndarray, least: np.ndarray, tree: Tree) -> pa.Table:
            n = [len(v) for v in lists]
            pick = np.repeat(np.arange(rows.num_rows), n)
            leaf, far = (np.array([x[k] for v in lists for x in v], kind) for k, kind in ((0, np.int64), (1, np.float64)))
            own = pa.table([pa.array(rows.column(c).to_pylist(), rows.schema.field(c).type) for c in ("query_id", "q")], names[:2])
            return own.take(pa.array(pick)).append_column("cell", pa.array(base[pick] + tree.number[leaf])).append_column("far", pa.array(np.maximum(far, least[pick])))

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    part = b.slice(at, 64)
                    none = np.zeros(part.num_rows)
                    yield from listed(part, [top.value.visits(v, most) for v in _matrix(part.column(1), dim)], none.astype(np.int64), none, top.value).to_batches()

        def further(key: tuple, rows: pa.Table, trees: pa.Table) -> pa.Table:
            if not rows.num_rows or not trees.num_rows:
                return pa.table({"query_id": pa.array([], pa.int64()), "q": pa.array([], rows.schema.field("q").type), "cell": pa.array([], pa.int64()), "far": pa.array([], pa.float64())})
            tree = pickle.loads(trees.column("tree")[0].as_py())
            base = np.full(rows.num_rows, key[0].as_py() << CELL_BITS, np.int64)
            return listed(rows, [tree.visits(v, most) for v in _matrix(rows.column("q"), dim)], base, rows.column("far").to_numpy(), tree)

        out = stored(asks.select("query_id", "q").mapInArrow(first, schema), "visits")
        if self.trees is None:
            return out
        best = Window.partitionBy("query_id").orderBy("far", "cell")
        inner = stored(self.trees.select("cell"), "inner", narrow=True)
        while True:
            out = out.withColumn("turn", F.row_number().over(best)).filter(F.col("turn") <= most).drop("turn")
            out = stored(out.join(_few(inner).withColumn("inner", F.lit(True)), "cell", "left"), "visits")
            open_ = out.filter("inner")
            if open_.isEmpty():
                return out.select(names)
            asked = open_.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
            asked = stored(asked, "asked", narrow=True)
            left = open_.join(_few(asked), "cell").withColumn("block", _block("query_id", "blocks")).select(*names, "block")
            right = self.trees.join(_few(asked), "cell").select("cell", "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
            more = left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(further, schema)
            out = stored(out.filter("inner is null").select(names).unionByName(more), "visits")


def _few(cells: DataFrame) -> DataFrame:
    """A stored table of a row a cell, broadcast if there are few."""
    return F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells


def _block(c: str, n: str) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(2)), F.col(n)).cast("int")


def needed_visits(index: Index, asked: DataFrame, k: int, recall: float) -> int:
    """Leaves that the rows ``asked`` (``query_id, q``, a bounded number) have to visit to find ``recall`` of
    their exact neighbours: visits are widened until so many of them lie in visited cells."""
    rows = asked.toArrow().sort_by("query_id")
    truth = exact_neighbours(index.filed, rows.column("query_id").to_numpy(), _matrix(rows.column("q"), index.dim), k)
    truth = stored(truth.join(index.filed.select("vec_id", "cell"), "vec_id").select("query_id", "cell"), "truth", narrow=True)
    total, most = truth.count(), FIRST_VISITS
    turn = F.row_number().over(Window.partitionBy("query_id").orderBy("far", "cell"))
    while True:
        visited = index.visits(asked, most).withColumn("turn", turn).select("query_id", "cell", "turn")
        hits = truth.join(visited, ["query_id", "cell"]).groupBy("turn").count().collect()  # at most a row a visit
        if sum(r["count"] for r in hits) >= recall * total:
            break
        if visited.groupBy("query_id").count().filter(F.col("count") >= most).isEmpty():
            break  # every leaf is visited
        most *= 4
    found = 0
    for r in sorted(hits):
        found += r["count"]
        if found >= recall * total:
            return r["turn"]
    return most


def nearest_neighbours(
    vectors: DataFrame,
    queries: Column,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    k: int = 10,
    recall: float = RECALL,
    sample: int = SAMPLE,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """``query_id long, rank int, vec_id long, score double``: the ``k`` nearest rows found for each
    row for which ``queries`` holds, by Euclidean distance, nearest first, ties to the smaller id.

    All rows but the query's own are candidates. Vectors that ``usable`` refuses and rows without
    an id take no part; the dimension is that of most usable vectors, others take no part. Of
    several rows of one id, which no answer could tell apart, the least vector is taken. An
    empty table, or no query, gives no rows; extra columns are ignored, whatever their names.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    dims = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = dims["dim"], dims["count"]
    rows = rows.filter(F.size("vec") == dim)
    if not rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        rows = rows.groupBy("vec_id").agg(F.min("vec").alias("vec"), F.max("asks").alias("asks"))
    index = Index(rows, total, dim, sample, leaf_rows)
    filed, kind = index.filed, index.kind
    asking = filed.filter("asks").select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    n = {r["asks"]: r["count"] for r in filed.groupBy("asks").count().collect()}
    if not n.get(True):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    others = filed.filter(F.col("asks") == (False not in n)).select(F.col("vec_id").alias("query_id"), F.col("vec").alias("q"))
    most = needed_visits(index, stored(hash_sample(others, n.get(False, n[True]), CALIBRATION, "query_id"), "asked"), k, recall)
    visits = index.visits(asking, most)

    row_blocks = filed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("row_blocks"))
    query_blocks = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("query_blocks"))
    blocks = _few(stored(row_blocks.join(query_blocks, "cell"), "blocks", narrow=True))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = filed.join(blocks, "cell").select("vec_id", "vec", "cell", _block("vec_id", "row_blocks").alias("rb"), every("query_blocks").alias("qb"))
    right = visits.join(blocks, "cell").select("query_id", "q", "cell", _block("query_id", "query_blocks").alias("qb"), every("row_blocks").alias("rb"))

    def meet(rows_: pa.Table, asks: pa.Table) -> pa.Table:
        if not rows_.num_rows or not asks.num_rows:
            return _found([], np.zeros(0, np.int64))
        ids, q_ids = rows_.column("vec_id").to_numpy(), asks.column("query_id").to_numpy()
        return _found(list(_nearest(_matrix(asks.column("q"), dim), q_ids, _matrix(rows_.column("vec"), dim), ids, k)), q_ids)

    on = ["cell", "rb", "qb"]
    return top_k(left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(meet, FOUND), k)
