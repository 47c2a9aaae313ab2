"""Storage that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


_scratch: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the
    session. Only in local mode (tests), where the session names none, one is made; on a cluster
    a folder of one machine would lose rows, so that is refused."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    scala = spark.sparkContext._jsc.sc().getCheckpointDir()
    if scala.isDefined():
        return scala.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="casewell-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def _remove(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the JVM may be gone before this runs
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/casewell-{label}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    for made in _scratch:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes what is stored inside when it ends, but for the tables handed to what it yields."""
    made: list[str] = []
    _scratch.append(made)

    def keep(table: DataFrame) -> DataFrame:
        made.remove(table._stored_at)
        return table

    try:
        yield keep
    finally:
        _scratch.remove(made)
        for path in made:
            _remove(spark, path)


def stored(df: DataFrame, label: str, narrow: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: the lineage is cut,
    lost executors lose nothing, and later readers prune columns. ``narrow`` is for tables of a
    few short columns: they go to as many files as two waves of tasks write, where a file for
    each shuffle partition would mostly be empty."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df = df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made, once nothing reads them any more."""
    for t in tables:
        _remove(t.sparkSession, t._stored_at)
