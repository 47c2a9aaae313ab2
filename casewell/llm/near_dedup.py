"""MinHash near-dedup by improved consistent weighted sampling over TF-IDF shingles.

Weight of a shingle in a text: ``(1 + ln tf) * idf`` with ``idf = (2 + ln(N / df)) / (2 + ln(N / T))``
over N texts, the document frequency counted over all of them. It is exact down to T, a
``RARE`` part of all pairs of a text and one of its shingles (one text in 800 where texts have 330
shingles); below T, and that is where the shingles of single texts and of small groups of copies
are, the idf is 1. By counting, at most ``1 / RARE`` shingles reach T however large the corpus
is, so their table can be broadcast, and it keeps two copies from being judged by the few shingles
they do not share, as those would outweigh all others. On tables of some hundred texts T is 1
and every idf is exact.

Texts with the same weighted shingles are one node from the start. 64 samples in 16 bands of 4
make the buckets. In a bucket all nodes are compared to its least node, not to each other, by
the exact weighted Jaccard similarity of their texts. In buckets that still hold several
components, two facts bound what is left: ``1 - J`` is a metric, so two nodes within 0.2 of each
other have distances to the bucket's least node that differ by 0.2 at most; and what two nodes
share weighs no more than either's weight that occurs in any other node of these buckets, but has
to be ``0.8 / 1.8`` of both weights. Nodes that no other node can match leave; the rest are
compared to the node of their bucket with the least weight of its own, its centre, and what each
has of the centre's shingles is kept as bits. Bits that one of two nodes lacks bound what they
share more tightly; pairs of different components that no bound excludes are compared one by
one. No link between two nodes that share a bucket is lost.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewell.operators.components import connected_components

from .common import Sieve, arrow_rows, discard, give_back, stored, trimmed
from .shingles import chunks, mix64, shingles

SIMILARITY = 0.8
BANDS, ROWS = 16, 4
SMOOTH = 2
RUN = 1 << 20  # pairs of a text and a shingle in a run of texts
SHINGLE_BYTES = 6  # of text, about, for a shingle
RARE = 4 / RUN  # of all such pairs: shingles with fewer texts share one idf
FILTER_BITS = 1 << 27  # of the largest filter of possible shingles, 16 MB
BLOCK_MEMBERS = 256  # nodes compared to one text in one go
EPSILON = 1e-9
ARROW_ROWS = 1000


def _gamma_quantiles(n: int = 65_536) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution, by bisection of 1 - exp(-x) (1 + x)."""
    q = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        mid = (low + high) / 2
        less = 1 - np.exp(-mid) * (1 + mid) < q
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    return (low + high) / 2


class Weights:
    """Log weights of shingles; ``hashes`` and ``df`` of those in ``least`` texts or more, sorted by hash."""

    def __init__(self, total: int, least: float, hashes: np.ndarray, df: np.ndarray):
        order = np.argsort(hashes.astype(np.uint64))
        self.hashes = hashes[order].astype(np.uint64)
        part = np.minimum(df[order], total)  # of copies of a hash
        self.log_idf = np.log((SMOOTH + np.log(total / np.maximum(part, least))) / (SMOOTH + math.log(max(total, 1) / least))) if len(hashes) else np.zeros(0)

    def log(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        out = np.log1p(np.log(tf))
        if len(self.hashes):
            at = np.searchsorted(self.hashes, h)
            at[at == len(self.hashes)] = 0
            found = self.hashes[at] == h
            out[found] += self.log_idf[at[found]]
        return out


def rare_below(pairs: int) -> float:
    """T: a shingle in fewer texts has the idf of one in T, where texts and their shingles are ``pairs``."""
    return max(1.0, RARE * pairs)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Shingles of runs of texts, in how many texts of the run each is, and their sum, which is ``RUN``
    at least but in a task that has no more."""
    held, kept, n = None, [], 0

    def counted() -> tuple[np.ndarray, np.ndarray, int]:
        h, c = np.unique(np.concatenate(kept), return_counts=True)
        return h, c, int(c.sum())

    for batch in batches:
        for _, _, at, raw in chunks(batch.column(0)):
            kept.append(shingles(at, raw)[0])
            n += len(kept[-1])
            if n >= RUN:
                if held is not None:
                    yield held
                held, kept, n = counted(), [], 0
    if kept:
        rest = counted()
        if held is not None:
            h = np.concatenate([held[0], rest[0]])
            c = np.concatenate([held[1], rest[1]])
            own, at = np.unique(h, return_inverse=True)
            rest = own, np.bincount(at, c, len(own)).astype(np.int64), held[2] + rest[2]
        held = rest
    if held is not None:
        yield held


def _document_frequency(texts: DataFrame, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """T, the shingles in T texts or more, and in how many. ``size`` is the texts' bytes: tables of many
    small partitions are read in tasks that hold some runs each, as a task of less than a run hands
    on nearly all it has.

    Two passes over the texts, whatever they are. A shingle that has its part of all pairs has
    that part of the pairs of some run of texts, so the first pass hands on only what does
    there. A bitmap of these, bounded in size, lets the second pass count just them; what it
    lets pass besides is counted and dropped, so a full bitmap costs a shuffle and no result.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, c, m in _runs(batches):
            h = h[c >= RARE * m].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([*h, None], pa.int64()), pa.array([*np.zeros(len(h), np.int64), m], pa.int64())], ["h", "m"])

    texts = texts.select("text").coalesce(max(size // (4 * SHINGLE_BYTES * RUN), 1))
    possible = stored(texts.mapInArrow(trimmed(local), "h long, m long").groupBy("h").agg(F.sum("m").alias("m")), "possible", narrow=True)
    pairs = possible.filter("h is null").agg(F.sum("m")).first()[0] or 0
    possible, least = possible.filter("h is not null"), rare_below(pairs)
    bits = min(max(1 << (64 * possible.count()).bit_length(), 1 << 15), FILTER_BITS)
    place = F.pmod("h", F.lit(bits))
    marked = possible.groupBy(F.shiftright(place, 15).alias("block")).agg(F.bitmap_construct_agg(place.bitwiseAND(F.lit((1 << 15) - 1))).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in marked.collect():  # at most FILTER_BITS
        table[r["block"] * 4096 : (r["block"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, low = shared.value, np.uint64(len(shared.value) * 8 - 1)
        for h, c, _ in _runs(batches):
            at = (h & low).astype(np.int64)
            some = (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(h[some].astype(np.int64)), pa.array(c[some].astype(np.int64))], ["h", "df"])

    counted = texts.mapInArrow(trimmed(count), "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))
    got = counted.filter(F.col("df") >= least).toPandas()  # at most 1 / RARE rows
    return least, got["h"].to_numpy(np.int64), got["df"].to_numpy(np.int64)


def content_hash(h: np.ndarray, tf: np.ndarray, cuts: np.ndarray, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """One number for each text's shingles and counts; texts without any have 0."""
    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64(h * np.uint64(factor) + tf.astype(np.uint64)))])
    out = mix64(total[cuts[1:]] - total[cuts[:-1]] + np.diff(cuts).astype(np.uint64))
    return np.where(np.diff(cuts) > 0, out | np.uint64(1), np.uint64(0)).astype(np.int64)


def consistent_samples(h: np.ndarray, log_weight: np.ndarray, cuts: np.ndarray, samples: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Improved consistent weighted sampling: for each text (with at least one shingle) and
    sample, the least ``ln a`` of its shingles, ``ln a = ln c - r (t - beta) - r`` with
    ``t = floor(ln w / r + beta)``. It is a function of the sampled shingle and its ``t``, so
    two texts share a sample when these values are equal."""
    r_of, log_c_of = tables
    out = np.empty((samples, len(cuts) - 1), np.float32)
    log_weight = log_weight.astype(np.float32)
    flat = not log_weight.any()
    seeds = mix64(np.arange(1, samples + 1, dtype=np.uint64))
    for k in range(samples):
        x = (h + seeds[k]) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        r = r_of[(x >> np.uint64(48)).astype(np.int64)]
        beta = ((x >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        shift = -beta if flat else np.floor(log_weight / r + beta) - beta
        log_a = log_c_of[((x >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (shift + np.float32(1))
        out[k] = np.minimum.reduceat(log_a, cuts[:-1])
    return out


def _sketch(texts: DataFrame, weights, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_hash, node, check, buckets``; node 0 and no buckets for texts without words. ``check``
    is a second number for the same shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiles = _gamma_quantiles()
        tables = (quantiles.astype(np.float32), np.log(quantiles).astype(np.float32))
        w = weights.value
        for batch in batches:
            for i, j, at, raw in chunks(batch.column(2)):
                h, tf, cuts = shingles(at, raw)
                node, check = content_hash(h, tf, cuts), content_hash(h, tf, cuts, 0xD6E8FEB86659FD93)
                full = np.flatnonzero(np.diff(cuts) > 0)
                lists = np.zeros((j - i, bands), np.int64)
                if len(full):
                    own = np.append(cuts[full], len(h))
                    sig = consistent_samples(h, w.log(h, tf), own, bands * rows, tables).view(np.uint32).astype(np.uint64)
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for s in sig[b * rows : (b + 1) * rows]:
                            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + s)
                        lists[full, b] = key.astype(np.int64)
                sizes = np.where(np.diff(cuts) > 0, bands, 0)
                buckets = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(lists[full].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], batch.column(1)[i:j], pa.array(node), pa.array(check), buckets], ["doc_id", "text_hash", "node", "check", "buckets"]
                )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.select("doc_id", "text_hash", "text").mapInArrow(trimmed(run), f"doc_id {kind}, text_hash long, node long, check long, buckets array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    k = np.searchsorted(b[0], a[0])
    k[k == len(b[0])] = 0
    same = b[0][k] == a[0]
    shared = np.minimum(a[1][same], b[1][k[same]]).sum()
    total = a[1].sum() + b[1].sum() - shared
    return float(shared / total) if total > 0 else 0.0


def _texts_of(asked: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, text`` of some nodes; only their texts are shuffled."""
    where = stored(nodes.join(asked, "node").select("node", "doc_id", "text_hash"), "asked", narrow=True)
    key = ["doc_id", "text_hash"]
    some = Sieve(where, key).mark(texts.select(*key, "text"), [F.col(c) for c in key], "__maybe").filter("__maybe").drop("__maybe")
    return stored(some.join(where, key).dropDuplicates(["node"]).select("node", "text"), "texts")


def _weighted_sets(texts: pa.Array, w: Weights) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, _, at, raw in chunks(texts):
        h, tf, cuts = shingles(at, raw)
        x = np.exp(w.log(h, tf))
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            yield h[s:e], x[s:e]


def _against(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, weights, judge: Callable, schema: str) -> DataFrame:
    """``a, b`` and what ``judge`` says of their sets, for each pair of nodes, stored.

    Nodes are sorted behind the text of the ``b`` they are compared to, blocks of ``BLOCK_MEMBERS``
    at most, so a text travels once for a block and not once for a pair, and a ``b`` with a third
    of all nodes is many tasks, each of which holds one set at a time."""
    pairs = stored(pairs.select("a", "b").distinct(), "pairs", narrow=True)
    found = _texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, texts)
    sizes = stored(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("blocks")), "sizes", narrow=True)
    some = F.pmod(F.xxhash64("a", F.lit(3)), F.col("blocks")).cast("int")
    members = pairs.join(sizes, "b").withColumn("block", some).join(found.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "text")
    heads = sizes.join(found.withColumnRenamed("node", "b"), "b")
    heads = heads.select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("a"), "text")
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "array<bigint>": pa.list_(pa.int64())}[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, head = weights.value, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for a, b, x in zip(part.column(2).to_pylist(), part.column(0).to_pylist(), _weighted_sets(part.column(3), w), strict=True):
                    if a is None:
                        head = x[0].copy(), x[1].copy()
                    else:
                        out.append((a, b, *judge(x, head)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = members.unionByName(heads).repartition("b", "block").sortWithinPartitions("b", "block", F.col("a").isNotNull())
    out = stored(rows.select("b", "block", "a", "text").mapInArrow(trimmed(run), schema), "compared")
    discard(pairs, found, sizes)
    return out


def _similarity(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """``a, b`` to ``a, b, similarity``, the lesser node first."""
    out = _against(pairs, nodes, texts, weights, lambda x, y: (weighted_jaccard(x, y),), "a long, b long, similarity double")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity").dropDuplicates(["a", "b"])


def _against_centre(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """``a`` (a node), ``b`` (a centre) to ``a, b, similarity, mask, light``: which of the centre's
    shingles the node has, as bits, and the least weight of one of them in the node."""

    def judge(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[float, list[int], float]:
        has = np.isin(y[0], x[0], assume_unique=True)
        shared = x[1][np.isin(x[0], y[0], assume_unique=True)]
        bits = np.packbits(np.pad(has, (0, -len(has) % 64)), bitorder="little")
        return weighted_jaccard(x, y), bits.view(np.int64).tolist(), float(shared.min()) if len(shared) else 0.0

    return _against(pairs, nodes, texts, weights, judge, "a long, b long, similarity double, mask array<bigint>, light double")


def _shareable(asked: DataFrame, nodes: DataFrame, texts: DataFrame, weights) -> DataFrame:
    """``node, weight, shareable``: the weight of a node's shingles, and of those that another of the
    asked nodes has as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = list(_weighted_sets(part.column(1), w))
                node = np.repeat(part.column(0).to_numpy(), [len(x[0]) for x in sets])
                h, x = (np.concatenate([s[k] for s in sets]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(h.astype(np.int64)), pa.array(x)], ["node", "h", "w"])

    rows = _texts_of(asked, nodes, texts).mapInArrow(trimmed(run), "node long, h long, w double")
    own = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.first("node").alias("node"), F.first("w").alias("w")).filter("n = 1")
    own = own.groupBy("node").agg(F.sum("w").alias("own"))
    whole = rows.groupBy("node").agg(F.sum("w").alias("weight"))
    return stored(whole.join(own, "node", "left").select("node", "weight", (F.col("weight") - F.coalesce("own", F.lit(0.0))).alias("shareable")), "shareable", narrow=True)


def _nodes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows``, and ``node, doc_id, text_hash, n``: one of the texts of each node, and their number. Where
    texts of one node differ in the second number, 64 bits were too few, and the node is told
    apart by both."""

    def grouped(rows: DataFrame) -> DataFrame:
        one, lo, hi = F.min(F.struct("doc_id", "text_hash")).alias("one"), F.min("check").alias("lo"), F.max("check").alias("hi")
        real = rows.filter("node <> 0 and doc_id is not null").groupBy("node").agg(one, F.count(F.lit(1)).alias("n"), lo, hi)
        return stored(real.select("node", "one.*", "n", "lo", "hi"), "nodes")

    nodes = grouped(rows)
    clash = nodes.filter("lo <> hi").select("node").withColumn("clash", F.lit(True))
    if not clash.isEmpty():
        both = F.when(F.col("clash"), F.xxhash64("node", "check").bitwiseOR(F.lit(1))).otherwise(F.col("node"))
        rows = stored(rows.join(clash, "node", "left").withColumn("node", both).drop("clash"), "sketch")
        nodes = grouped(rows)
    return rows, nodes.drop("lo", "hi")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, text_hash, class_id, class_size, n_compared_links, kept``.

    ``class_id`` is the least id of the class, ``class_size`` its rows, ``n_compared_links`` the node's
    compared neighbours of at least ``similarity``; the row of the least id is kept (rows that
    repeat it as well). Texts without words, null ones included, and rows without an id are
    classes of their own. Equal texts are one node, very long ones are read whole, ties go to the
    least id. An empty table gives no rows; extra columns are ignored, whatever their names.

    The texts are read eight times: for their number and size, for the shingles that are possibly frequent,
    for their counts, for the samples, and four times for the texts of compared nodes, which alone are written.
    """
    with arrow_rows(docs.sparkSession, ARROW_ROWS):  # every Python stage ends in a written table
        return _near_duplicates(docs, id_col, text_col, similarity, bands, rows)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, similarity: float, bands: int, rows: int) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    total, size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    weights = spark.sparkContext.broadcast(Weights(total, *_document_frequency(texts, size)))  # at most 1 / RARE shingles
    give_back()
    rows_ = stored(_sketch(texts, weights, bands, rows), "sketch")
    rows_, nodes = _nodes(rows_)
    real = rows_.filter("node <> 0 and doc_id is not null")
    lists = real.select("node", "buckets").dropDuplicates(["node"]).select("node", F.explode("buckets").alias("bucket"))
    size = lists.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"))
    members = stored(lists.join(stored(size.filter("n > 1"), "buckets", narrow=True), "bucket"), "members")  # bucket, node, n, lead

    def pairs_of(a: Column, b: Column) -> list[Column]:
        return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]

    close = F.col("similarity") >= similarity
    first = _similarity(members.filter("node <> lead").select(F.col("node").alias("a"), F.col("lead").alias("b")), nodes, texts, weights)
    roots = connected_components(first.filter(close))

    def mixed(labels: DataFrame, own: DataFrame) -> DataFrame:
        """Members of the buckets that still hold several components."""
        out = own.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
        out = stored(out, "placed", narrow=True)
        some = out.groupBy("bucket").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("bucket")
        return stored(out.join(stored(some, "mixed", narrow=True), "bucket"), "rest", narrow=True)

    rest = mixed(roots, members.filter("n > 2").select("bucket", "node", "lead"))
    shares = _shareable(rest.select("node").distinct(), nodes, texts, weights)
    rest = rest.drop("root").join(shares.filter(F.col("shareable") >= similarity * F.col("weight") - EPSILON), "node")
    measured = first.select(F.col("a").alias("__a"), F.col("b").alias("__b"), (1 - F.col("similarity")).alias("far"))
    same = (F.least("node", "lead") == F.col("__a")) & (F.greatest("node", "lead") == F.col("__b"))
    rest = rest.join(measured, same, "left").select("bucket", "node", "weight", "shareable", F.coalesce("far", F.lit(0.0)).alias("far"))
    rest = mixed(roots, stored(rest, "rest", narrow=True))

    # all of what is left in a bucket against its node with the least weight of its own
    best = F.min(F.struct((-F.col("shareable") / F.col("weight")).alias("s"), "node"))
    middle = stored(rest.groupBy("bucket").agg(best.alias("m")).select("bucket", F.col("m.node").alias("middle")), "centre", narrow=True)
    rest = stored(rest.join(middle, "bucket").filter("node <> middle"), "rest")
    centred = _against_centre(rest.select(F.col("node").alias("a"), F.col("middle").alias("b")).distinct(), nodes, texts, weights)
    second = centred.select(*pairs_of(F.col("a"), F.col("b")), "similarity").dropDuplicates(["a", "b"])
    done = stored(first.unionByName(second.join(first, ["a", "b"], "left_anti")), "done")
    roots = connected_components(done.filter(close))

    # the nodes outside a bucket's largest component against all of the bucket; a pair that shares
    # several buckets is met in the least of them only
    masks = centred.select(F.col("a").alias("node"), F.col("b").alias("middle"), "mask", "light")
    rest = mixed(roots, rest.drop("root")).join(masks, ["node", "middle"])
    sizes = rest.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"))
    own = rest.groupBy("node").agg(F.collect_set("bucket").alias("all"))
    rest = rest.join(stored(sizes.select("bucket", F.col("m.root").alias("major")), "sizes", narrow=True), "bucket").join(stored(own, "own", narrow=True), "node")
    rest = stored(rest.withColumn("minor", F.col("root") != F.col("major")).drop("major"), "rest")
    other = rest.select("bucket", *[F.col(c).alias(f"{c}2") for c in ("node", "root", "weight", "shareable", "far", "all", "minor", "mask", "light")])
    needed = similarity / (1 + similarity) * (F.col("weight") + F.col("weight2")) - EPSILON

    def lacks(x: str, y: str) -> Column:
        """Weight, at least, of what ``x`` shares with the centre and ``y`` does not."""
        bits = F.zip_with(f"mask{x}", f"mask{y}", lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q))))
        return F.aggregate(bits, F.lit(0), lambda n, k: n + k) * F.col(f"light{x}")

    different = (F.col("root") != F.col("root2")) & ((F.col("node") < F.col("node2")) | ~F.col("minor2"))
    metric = F.abs(F.col("far") - F.col("far2")) <= 1 - similarity + EPSILON
    enough = (F.least("shareable", "shareable2") >= needed) & (F.col("shareable") - lacks("", "2") >= needed) & (F.col("shareable2") - lacks("2", "") >= needed)
    here = F.array_min(F.array_intersect("all", "all2")) == F.col("bucket")
    third = rest.filter("minor").join(other, "bucket").filter(different & metric & enough & here).select(*pairs_of(F.col("node"), F.col("node2")))
    done = done.unionByName(_similarity(third.join(done, ["a", "b"], "left_anti"), nodes, texts, weights))
    links = stored(done.filter(close).select("a", "b"), "links", narrow=True)
    roots = connected_components(links)

    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "doc_id", "n", "root")
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    named = named.select("node", "root").join(classes, "root").join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n_compared_links")), "node", "left")
    named = stored(named.select("node", "class_id", "class_size", F.coalesce("n_compared_links", F.lit(0)).alias("n_compared_links")), "classes", narrow=True)
    alone = rows_.filter("node = 0 or doc_id is null").select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(0).cast("long").alias("n_compared_links"), F.lit(True).alias("kept")
    )
    return (
        real.select("doc_id", "text_hash", "node")
        .join(named, "node")
        .select("doc_id", "text_hash", "class_id", "class_size", "n_compared_links", (F.col("doc_id") == F.col("class_id")).alias("kept"))
        .unionByName(alone)
    )
