"""SimHash near-dedup: fingerprints of word shingles, linked through BK-trees.

Equal fingerprints are one class, and only distinct ones are searched. Two of them that differ
in ``radius`` bits at most agree on one of ``radius + 1`` blocks of bits, so the distinct
fingerprints are dealt into shards by each block: a shard are those that agree on a block, and every
link lies within one. A shard with more than ``MOST_NODES`` is dealt again by blocks of the bits that
its fingerprints have not yet in common. That ends by counting: a shard with b common bits
holds ``2^(64 - b)`` distinct fingerprints at most, so no shard is large after five rounds, whatever
the group of copies. Shards of one fingerprint have no links and go.

Each shard is a BK-tree, grown in the task that sorts the shard. Up to ``BROADCAST_NODES`` nodes,
which are counted first, the trees are broadcast and the distinct fingerprints search them where they
lie, following only edges within the radius. Beyond that number nothing of this is
broadcast or collected: each tree is searched by its own fingerprints in the task that grew it. Both
give the same links. A task hands on at most one link for each fingerprint and run, so the links of
a ball of copies do not grow with the pairs in it, and components are found by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.operators.components import connected_components

from .bktree import bounds, grow, hung, joined
from .common import arrow_rows, discard, scratch, stored, trimmed

WORDS = 3
SEED = 42
RADIUS = 2
BITS = 64
MOST_NODES = 8192  # of a shard's tree
BROADCAST_NODES = 1 << 20  # of all trees together: 32 MB
PIECE_WORDS = 200_000  # of a text, hashed together
RUN_ROWS = 1 << 16  # of shards grown together
BATCH_ROWS = 500

_LANES = np.uint64(0x0101010101010101)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit: eight bits at a time in the bytes of a word, 255 hashes in a sum."""
    counts = np.zeros(BITS, np.int64)
    cuts = np.arange(0, len(hashes), 255)
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & _LANES, cuts)
        counts[k::8] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it. Words are what is not ASCII white
    space, A-Z in lower case; fewer words than a shingle are one shingle; no words give zero."""
    found = text.lower().split()  # of bytes: ASCII letters and ASCII white space alone
    if not found:
        return 0
    width, n, counts = min(words, len(found)), 0, np.zeros(BITS, np.int64)
    for i in range(0, len(found) - width + 1, PIECE_WORDS):
        piece = found[i : i + PIECE_WORDS + width - 1]
        whole = b" ".join(piece)
        ends = np.cumsum(np.fromiter(map(len, piece), np.int64, len(piece)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(piece) - width + 1]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        counts += _bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` for every row, stored; ``fp`` is the fingerprint as a signed number. A null text is empty."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            fps = np.fromiter((fingerprint(b.as_py() or b"") for b in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return stored(rows.mapInArrow(run, f"doc_id {kind}, fp long"), "fingerprints")  # as many tasks as the texts ask for


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")


def _cut(mask: int, parts: int) -> list[int]:
    """``mask`` with each of ``parts`` blocks of the bits it lacks."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    size = [len(free) // parts + (p < len(free) % parts) for p in range(parts)]
    ends = np.cumsum(size)
    return [mask | sum(1 << i for i in free[e - s : e]) for s, e in zip(size, ends, strict=True) if s]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _dealt(rows: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """``mask, value, fp``: each row under every block its mask is cut by."""
    again = F.array().cast("array<bigint>")
    for m in masks:
        cut = F.array(*[F.lit(_signed(x)).cast("long") for x in _cut(m, parts)])
        again = F.when(F.col("mask") == F.lit(_signed(m)).cast("long"), cut).otherwise(again)
    out = rows.select("fp", F.explode(again).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def shards(distinct: DataFrame, radius: int = RADIUS, most_nodes: int = MOST_NODES) -> tuple[list[DataFrame], int]:
    """Stored tables ``mask, value, fp`` of shards of two to ``most_nodes`` fingerprints, and the rows of
    all. ``distinct`` has distinct ``fp``. Shards of fewer free bits than ``radius + 1`` are not cut
    further: they have ``2^radius`` fingerprints at most."""
    parts, masks, out, total = radius + 1, [0], [], 0
    rows = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        dealt = _dealt(rows, masks, parts)
        dealt = stored(dealt.distinct() if masks != [0] else dealt, "dealt", narrow=True)  # one shard may be reached two ways
        masks = sorted({c for m in masks for c in _cut(m, parts)})
        sizes = stored(dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1"), "shard-sizes", narrow=True)
        end = min(BITS - m.bit_count() for m in masks) < parts
        large = F.lit(False) if end else F.col("__n") > most_nodes
        placed = stored(dealt.join(sizes, ["mask", "value"]).select("mask", "value", "fp", large.alias("__large")), "shards", narrow=True)
        discard(dealt, sizes)
        n = placed.filter("not __large").count()
        if n:
            out.append(placed.filter("not __large").drop("__large"))
            total += n
        rows = placed.filter("__large").select("mask", "fp")
        held = [r[0] for r in rows.select("mask").distinct().collect()]  # at most one for each mask of the round
        if not held:
            return out, total
        masks = [m for m in masks if _signed(m) in held]


def _by_shard(table: DataFrame) -> DataFrame:
    return table.repartition("mask", "value").sortWithinPartitions("mask", "value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mask, value and fingerprint of whole shards, ``RUN_ROWS`` rows at a time and a shard more at most."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        held.append(tuple(np.asarray(c).astype(np.int64) for c in batch.columns))
        if sum(len(h[0]) for h in held) < RUN_ROWS:
            continue
        mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        last = bounds(mask, value)[-2]  # the last shard may go on
        if last:
            yield mask[:last], value[:last], fp[:last].view(np.uint64)
        held = [(mask[last:], value[last:], fp[last:])]
    if held:
        mask, value, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        if len(mask):
            yield mask, value, fp.view(np.uint64)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = joined(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _links_within(table: DataFrame, radius: int) -> DataFrame:
    """Links ``a, b`` of the shards of ``table``, each tree searched where it grows."""

    @trimmed
    def run(batches):
        for mask, value, fp in _runs(batches):
            cuts = bounds(mask, value)
            tree, _, _ = grow(fp, cuts)
            q, node = tree.within(fp, np.repeat(cuts[:-1], np.diff(cuts)), radius)
            other = q != node
            yield _links(fp[q[other]], fp[node[other]])

    return _by_shard(table).mapInArrow(run, "a long, b long")


def _grown(table: DataFrame) -> DataFrame:
    """``mask, value, fp, parent, distance``: the nodes of the shards' trees, grown in tasks; ``parent`` is
    the parent's fingerprint, a root's own."""

    @trimmed
    def run(batches):
        for mask, value, fp in _runs(batches):
            _, parent, distance = grow(fp, bounds(mask, value))
            signed = fp.view(np.int64)
            columns = (mask, value, signed, signed[parent], distance.astype(np.int8))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["mask", "value", "fp", "parent", "distance"])

    return _by_shard(table).mapInArrow(run, "mask long, value long, fp long, parent long, distance byte")


def _forest(nodes: pa.Table) -> tuple:
    """All trees as arrays: the trees, and for each mask the values of its shards and their roots."""
    mask, value, fp, parent, distance = (c.to_numpy() for c in nodes.columns)
    order = np.lexsort((fp, value, mask))
    mask, value, fp, parent, distance = mask[order], value[order], fp[order], parent[order], distance[order].astype(np.int64)
    cuts = bounds(mask, value)
    shard = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    # the parent's place: the nodes are sorted by shard and fingerprint
    wanted = np.lexsort((parent, shard))
    place, both = np.empty(len(fp), np.int64), np.concatenate([fp, parent])
    rank = np.unique(both, return_inverse=True)[1]
    key = shard * (rank.max(initial=0) + 1) + rank[: len(fp)]
    place[wanted] = np.searchsorted(key, (shard * (rank.max(initial=0) + 1) + rank[len(fp) :])[wanted])
    roots = np.full(len(cuts) - 1, -1)
    own = place == np.arange(len(fp))
    roots[shard[own]] = place[own]
    where = {}
    starts = bounds(mask[cuts[:-1]])
    for s, e in zip(starts[:-1], starts[1:], strict=True):
        where[int(mask[cuts[s]])] = (value[cuts[s:e]], roots[s:e])
    return hung(fp.view(np.uint64), place, distance), where


def _links_of_broadcast(distinct: DataFrame, tables: list[DataFrame], radius: int) -> DataFrame:
    """Links ``a, b`` of ``distinct`` with the trees of all shards, which every task gets."""
    spark = distinct.sparkSession
    nodes = pa.concat_tables([_grown(t).toArrow() for t in tables])  # BROADCAST_NODES rows at most
    trees = spark.sparkContext.broadcast(_forest(nodes))

    @trimmed
    def run(batches):
        tree, where = trees.value
        for batch in batches:
            fp = np.asarray(batch.column(0)).astype(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for mask, (values, roots) in where.items():
                mine = fp & np.int64(mask)
                at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
                has = np.flatnonzero(values[at] == mine)
                queries = fp[has].view(np.uint64)
                q, node = tree.within(queries, roots[at[has]], radius)
                a, b = queries[q], tree.values[node]
                found.append((a[a != b], b[a != b]))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _links(a, b)

    out = stored(distinct.select("fp").mapInArrow(run, "a long, b long"), "links", narrow=True)
    trees.destroy()
    return out


def link_components(docs: DataFrame, radius: int = RADIUS, most_nodes: int = MOST_NODES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``: fingerprints that differ in ``radius``
    bits at most are linked, and a component has the least id of all rows it reaches.

    A null or empty text, or one of white space, has the fingerprint zero, which links like any other; a
    very long text is hashed whole. Rows that repeat an id are rows of their own. A null id names no
    component; a component of null ids alone has a null one. An empty table gives no rows. Columns
    besides id and text take no part, whatever their names."""
    with scratch(docs.sparkSession) as keep:
        return keep(stored(_components(fingerprints(docs), radius, most_nodes, broadcast_nodes), "simhash", narrow=True))


def _components(rows: DataFrame, radius: int, most_nodes: int, broadcast_nodes: int) -> DataFrame:
    """The rows of ``link_components``, of ``doc_id, fp``."""
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes", narrow=True)
    tables, total = shards(classes, radius, most_nodes)
    if not tables:
        place = classes.select("fp", F.col("least").alias("component_id"))
    else:
        if total <= broadcast_nodes:
            links = _links_of_broadcast(classes, tables, radius)
        else:
            links = stored(_links_within(_all(tables), radius), "links", narrow=True)
        member = connected_components(links).select(F.col("node").alias("fp"), "root")
        named = stored(classes.join(member, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "members", narrow=True)
        least = named.groupBy("root").agg(F.min("least").alias("component_id"))
        place = named.join(least, "root").select("fp", "component_id")
    place = stored(place, "components", narrow=True)  # so that the join below splits a fingerprint of many rows
    return rows.join(place, "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
