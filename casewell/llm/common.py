"""What the training-data operators share: tables, shared-folder storage, bounded bit sieves."""

from __future__ import annotations

import ctypes
import gc
import json
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from functools import reduce, wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewell.storage import discard, new_path, scratch, shared_dir, stored, table

__all__ = ["Sieve", "arrow_rows", "ascii_lower", "discard", "drop_keys", "give_back", "hash_sample", "literal_rows", "new_path", "scratch", "shared_dir", "stored", "table", "trimmed", "whole_texts"]


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Batches of ``n`` rows between the JVM and Python for the jobs run inside, so that whole texts
    take little memory on both sides; the session's own setting comes back after."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def whole_texts(spark: SparkSession, n: int = 1000) -> None:
    """At most ``n`` rows in a batch between the JVM and Python from now on: for operators whose
    Python runs when their result is read. Batches of whole texts otherwise take hundreds of MB
    beside the heap. A smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= n:
        spark.conf.set(name, str(n))


def give_back() -> None:
    """Free what is no longer used, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """A batch function that gives memory back when its task ends: Spark keeps its Python workers, and
    what their allocators hold counts against the executor until the next task."""

    @wraps(run)
    def whole(batches):
        yield from run(batches)
        give_back()

    return whole


def hash_sample(rows: DataFrame, total: int, most: int, *key: str) -> DataFrame:
    """All rows if there are ``most`` at most, else about ``most`` of them, those of the smallest key
    hashes. Each task filters its own rows, so what a driver collects does not grow with the tasks."""
    if total <= most:
        return rows
    parts = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(*key, F.lit(17)), F.lit(parts)) < int(parts * (most / total)))


def literal_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of the driver's, as one literal that the JVM reads."""
    return spark.range(0, 1, 1, 1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


class Sieve:
    """Which keys may be in a set: a Bloom filter cut into blocks of 32,768 bits, made by aggregation.

    It is sized by the number of keys, 16 bits each with four hashes within a block, so that under
    one stranger in a hundred passes; ``MOST_BLOCKS`` blocks (16 MB), which hold ten million keys,
    bound what is broadcast. Beyond that more strangers pass. A miss is certain at any size; a hit
    has to be checked by an exact join, so the bound costs time and never rows."""

    BLOCK, KEY_BITS, MOST_BLOCKS = 32768, 16, 4096

    def __init__(self, keys: DataFrame, on: list[str]):
        """``keys`` is read twice: a stored table."""
        self.blocks = min(max(-(-keys.count() * self.KEY_BITS // self.BLOCK), 1), self.MOST_BLOCKS)
        block, places = self._places([F.col(c) for c in on])
        bits = keys.select(block.alias("__sieve_no"), F.explode(F.array(*places)).alias("v"))
        self.rows = bits.groupBy("__sieve_no").agg(F.bitmap_construct_agg("v").alias("__sieve_bits"))

    def _places(self, key: list[Column]) -> tuple[Column, list[Column]]:
        h = F.xxhash64(*key, F.lit(2))
        return F.pmod(F.xxhash64(*key), F.lit(self.blocks)), [F.shiftrightunsigned(h, 15 * i).bitwiseAND(F.lit(self.BLOCK - 1)) for i in range(4)]

    def mark(self, df: DataFrame, key: list[Column], flag: str) -> DataFrame:
        """``df`` with the boolean ``flag``: the key may be in the set."""
        block, places = self._places(key)

        def bit(at: Column) -> Column:
            byte = F.conv(F.hex(F.substring("__sieve_bits", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            return F.getbit(byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1

        hit = F.col("__sieve_bits").isNotNull()
        for at in places:
            hit = hit & bit(at)
        return (
            df.withColumn("__sieve_at", block)
            .join(F.broadcast(self.rows.withColumnRenamed("__sieve_no", "__sieve_at")), "__sieve_at", "left")
            .withColumn(flag, F.coalesce(hit, F.lit(False)))
            .drop("__sieve_at", "__sieve_bits")
        )


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)])


def drop_keys(docs: DataFrame, gone: DataFrame, key: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows whose key is in ``gone`` (a stored table, columns named as in ``key``;
    null equals null). Rows that miss the sieve pass without a shuffle. Of those that hit it the
    keys alone are joined exactly; the few that turn out to be strangers make a sieve of their
    own, and only their rows are shuffled whole."""
    ours, theirs = [f"__k_{n}" for n in key], [f"__g_{n}" for n in key]
    marked = Sieve(gone, list(key)).mark(docs, list(key.values()), "__sieve_hit")
    hits = marked.filter("__sieve_hit").select([c.alias(n) for n, c in zip(ours, key.values(), strict=True)])
    known = gone.select([F.col(n).alias(g) for n, g in zip(key, theirs, strict=True)])
    spared = stored(hits.join(known, _same(ours, theirs), "left_anti").distinct(), "spared", narrow=True)
    rest = marked.filter("not __sieve_hit").select(docs.columns)
    if spared.isEmpty():
        return rest
    again = Sieve(spared, ours).mark(docs, list(key.values()), "__sieve_hit").filter("__sieve_hit").withColumns(dict(zip(theirs, key.values(), strict=True)))
    return rest.unionByName(again.join(spared, _same(theirs, ours), "left_semi").select(docs.columns))
