"""Prefix trie of conversations from polynomial rolling fingerprints.

A turn is its role and text, told apart by its SHA-256 from the first step on, so that texts are
read once and never shuffled. The fingerprint of a conversation's first d turns is
``sum of turn_i * BASE^i`` modulo 2^64: a running sum, made by NumPy scans over segments of
``SEGMENT`` turns and completed by the sums of the segments before, so that a conversation of any
length is many tasks. Depth and fingerprint group candidates. Copies of a turn collapse to one row
a task before a group meets, which is what makes a common first turn a small group.

In each group every distinct turn, with the fingerprint of the turns before it, is compared to
that of the representative, the smallest member. If all agree in all groups, then equal
fingerprints are equal prefixes, by induction along the turns. Turns that differ from their
representative's get another number, the scan is made again, and so on until none differ.

Rolling up needs no walk up the tree, whose depth has no bound: the members of a node are the
conversations that pass it, so each conversation hands what it has from a turn on to the node
of that turn, all in one aggregate. A childless node has one smallest member, which passes all
ancestors of the node once: its leaf. Of the turns of all members from a node down, each node below
keeps one copy, that of its smallest member; what a conversation hands on as saved are the
bytes of its turns at which it is not the smallest member, which are the first ones of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewell.operators.frames import in_ranges

from .common import discard, scratch, stored, trimmed

BASE = 0x9E3779B97F4A7C15
SEGMENT = 4096  # turns of a conversation that one scan goes along
RANGE_ROWS = 500_000  # turns that one task sorts
EVERY, MOST_SHARED = 5, 9

_M32 = 0xFFFFFFFF


def digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn; the role's length keeps roles and texts apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered_turns(turns: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``conv_id, place, digest, bytes``, stored: the turns of each conversation numbered from 1 by turn, null
    first, ties by role and digest. The whole table is sorted by ranges, and a conversation that goes
    on in a range is counted on, so no conversation is one task. Rows without a conv_id are left out."""
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        digest(F.col("role"), F.col("text")).alias("digest"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest"), F.asc("row")]
    placed = in_ranges(rows, order, range_rows)
    own = F.row_number().over(Window.partitionBy("__part", "conv_id").orderBy(*order[1:])).cast("long")
    counted = placed.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = counted.select("conv_id", "__part", F.sum("n").over(before).alias("__before")).filter("__before > 0")  # one for each range at most
    out = placed.withColumn("place", own).join(F.broadcast(carried), ["conv_id", "__part"], "left")
    return stored(out.select("conv_id", (F.col("place") + F.coalesce("__before", F.lit(0))).alias("place"), "digest", "bytes"), "turns")


def rebuilt(turns: DataFrame, every: int = EVERY, most_shared: int = MOST_SHARED) -> DataFrame:
    """``conv_id, depth, digest, bytes``, stored: every conversation c with the first h turns of c - c % ``every``
    in place of its own first h, h = crc32(c) % ``most_shared``, and a row of depth 0. ``turns`` as of
    ``numbered_turns``. A base that is missing gives no turns, a shorter one those it has."""
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most_shared).cast("long")
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = stored(convs.withColumns({"h": shared, "base": F.col("conv_id") - F.col("conv_id") % every}), "conversations", narrow=True)
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(lengths, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "conversations", narrow=True)
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("place") < most_shared)).withColumnRenamed("conv_id", "base")
    head = heads.join(convs, "base").filter("place <= h").select("conv_id", F.col("place").alias("depth"), "digest", "bytes")
    own = turns.filter("place > 0").join(convs, "conv_id").filter("place > h").select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "digest", "bytes")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    return stored(head.unionByName(own).unionByName(root), "rebuilt")


def wrapped_sum(a: Column, b: Column) -> Column:
    """Sum of two 64-bit numbers modulo 2^64."""
    low = a.bitwiseAND(F.lit(_M32)) + b.bitwiseAND(F.lit(_M32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(_M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(_M32)))


def _powers(exponents: np.ndarray) -> np.ndarray:
    """BASE to the given powers, modulo 2^64, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(BASE), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * square, out)
            square, left = square * square, left >> np.uint64(1)
    return out


def _scan(rolling: bool):
    """A batch function: running sums of ``number``, times ``BASE^depth`` if ``rolling``, and of bytes along each
    segment, over rows sorted by conversation, segment and depth. It is one running sum over a
    batch, less what it was where the segment began; a segment that goes on in the next batch is
    carried over."""

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fp_so_far, bytes_so_far = None, np.uint64(0), 0
        for batch in batches:
            conv, depth, seg, number, size = (np.asarray(batch.column(c)).astype(np.int64) for c in ("conv_id", "depth", "segment", "number", "bytes"))
            if not len(conv):
                continue
            part = number.view(np.uint64) * _powers(depth) if rolling else number.view(np.uint64)
            total, total_bytes = np.cumsum(part, dtype=np.uint64), np.cumsum(size)
            new = np.ones(len(conv), bool)
            new[1:] = (conv[1:] != conv[:-1]) | (seg[1:] != seg[:-1])
            new[0] = last != (conv[0], seg[0])
            first = np.flatnonzero(new)
            base = np.append(total[first] - part[first], np.negative(fp_so_far))  # the last: the segment of the batch before
            base_bytes = np.append(total_bytes[first] - size[first], -bytes_so_far)
            segment = np.cumsum(new) - 1
            fp, upto = total - base[segment], total_bytes - base_bytes[segment]
            last, fp_so_far, bytes_so_far = (conv[-1], seg[-1]), fp[-1], int(upto[-1])
            same = ("conv_id", "depth", "segment", "digest", "bytes")
            made = [pa.array(x) for x in ((fp - part).view(np.int64), fp.view(np.int64), upto)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in same], *made], names=[*same, "prev", "fp", "upto"])

    return run


SCANNED = "conv_id long, depth long, segment long, digest binary, bytes long, prev long, fp long, upto long"


def fingerprinted(steps: DataFrame, segment: int = SEGMENT, rolling: bool = True) -> DataFrame:
    """``steps`` (``conv_id, depth, digest, bytes, number``) with ``prev`` and ``fp``, the fingerprints of the turns
    before a step and up to it, and ``upto``, the bytes up to it; stored."""
    dealt = steps.withColumn("segment", F.floor(F.col("depth") / segment))
    dealt = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "depth")
    scanned = stored(dealt.mapInArrow(_scan(rolling), SCANNED), "scan")
    ends = scanned.filter(F.col("depth") % segment == segment - 1)
    if ends.isEmpty():
        return scanned
    # what the segments before one sum to: the same scan along the segments' own sums
    totals = ends.select("conv_id", F.col("segment").alias("depth"), "digest", F.col("upto").alias("bytes"), F.col("fp").alias("number"))
    summed = fingerprinted(totals, segment, rolling=False)
    offsets = summed.select("conv_id", (F.col("depth") + 1).alias("segment"), F.col("fp").alias("__fp"), F.col("upto").alias("__upto"))
    later = scanned.filter("segment > 0").join(offsets, ["conv_id", "segment"])
    later = later.withColumns({"prev": wrapped_sum(F.col("prev"), F.col("__fp")), "fp": wrapped_sum(F.col("fp"), F.col("__fp")), "upto": F.col("upto") + F.col("__upto")}).drop("__fp", "__upto")
    out = stored(scanned.filter("segment = 0").unionByName(later), "scan")
    discard(scanned)
    return out


def verified(steps: DataFrame, bits: int = 64, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """``steps`` (``conv_id, depth, digest, bytes``) with fingerprints that are equal for equal prefixes alone, and the
    nodes ``depth, fp, prev, bytes, conv_id, n_convs``, both stored. ``bits`` of a turn's first number, for tests."""
    number = F.xxhash64("digest")
    number = F.shiftrightunsigned(number, 64 - bits) if bits < 64 else number
    now = steps.withColumn("number", F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(number))
    for again in range(1, 1000):
        scanned = fingerprinted(now, segment)
        turns = scanned.groupBy("depth", "fp", "prev", "digest", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
        turns = stored(turns, "distinct-turns")
        split = turns.groupBy("depth", "fp").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("conv_id", "prev", "digest")).alias("rep")).filter("n > 1")
        split = stored(split.select("depth", "fp", "rep"), "collisions", narrow=True)
        if split.isEmpty():
            discard(split)
            return scanned, turns
        other = turns.join(split, ["depth", "fp"]).filter("prev <> rep.prev or digest <> rep.digest").select("conv_id", "depth", "fp", "prev", "digest")
        other = stored(other.select("depth", "fp", "prev", "digest").withColumn("__other", F.lit(True)), "other-turns", narrow=True)
        before = now.select("conv_id", "depth", "number")
        moved = scanned.join(other, ["depth", "fp", "prev", "digest"], "left").join(before, ["conv_id", "depth"])
        number = F.when(F.col("__other"), F.xxhash64("digest", "prev", F.lit(again))).otherwise(F.col("number"))
        now = stored(moved.select("conv_id", "depth", "digest", "bytes", number.alias("number")), "steps")
        discard(scanned, turns, split, other)
    raise RuntimeError("fingerprints of different turns stay equal")  # a thousand times by chance: never


@trimmed
def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids, over rows sorted by node and id: only the hash is kept."""
    at, running = None, None
    for batch in batches:
        done = []
        for depth, fp, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (depth, fp) == at:
                running.update(b",%d" % conv)
                continue
            if at is not None:
                done.append((*at, running.hexdigest()))
            at, running = (depth, fp), hashlib.sha256(b"%d" % conv)
        yield _ends(done)
    yield _ends([(*at, running.hexdigest())] if at is not None else [])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    d, f, s = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(s, pa.string())], names=["depth", "fp", "ends_sha256"])


def trie(turns: DataFrame, every: int = EVERY, most_shared: int = MOST_SHARED, bits: int = 64, segment: int = SEGMENT, range_rows: int = RANGE_ROWS) -> DataFrame:
    """A row for each node, see ``op11_prefix_trie`` for the columns.

    ``turns`` has ``conv_id, turn, role, text``. Null roles and texts are empty; null turns come first; equal turn
    numbers are ordered by role and digest, and rows that repeat each other are turns of their own.
    Rows without a conv_id belong to no conversation and are left out. Very long texts are hashed whole.
    An empty table gives no rows, not even a root. Other columns take no part, whatever their names.

    ``ends_sha256`` is one hash along all ids that end at a node, so the ids of a node are streamed
    through one task in order, of which it keeps the hash alone."""
    with scratch(turns.sparkSession) as keep:
        return keep(stored(_rolled_up(*verified(rebuilt(numbered_turns(turns, range_rows), every, most_shared), bits, segment)), "trie"))


def _rolled_up(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``trie``, of verified steps and their nodes."""
    node = ["depth", "fp"]
    children = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("prev").alias("fp")).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, node, "left").fillna(0, ["n_children"]), "nodes", narrow=True)
    whole = steps.groupBy("conv_id").agg(F.sum("bytes").alias("bytes"), F.max(F.struct("depth", "fp")).alias("end"))
    own = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    convs = whole.join(own, "conv_id", "left").select("conv_id", "end", (F.col("bytes") - F.coalesce("own", F.lit(0))).alias("copied"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    convs = stored(convs, "conversations", narrow=True)
    saved = F.greatest(F.col("copied") - (F.col("upto") - F.col("bytes")), F.lit(0))
    rolled = steps.join(convs, "conv_id").groupBy(*node).agg(F.sum(saved).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    ends = convs.select("end.depth", "end.fp", "conv_id").repartition("depth", "fp").sortWithinPartitions("depth", "fp", "conv_id")
    ends = ends.mapInArrow(_hash_ends, "depth long, fp long, ends_sha256 string")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("prev"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(stored(rolled, "rolled", narrow=True), node).join(stored(ends, "ends", narrow=True), node, "left").join(parents, ["depth", "prev"], "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
