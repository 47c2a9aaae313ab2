"""Case tables as files: typed reading, writing, appending, numbering."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewell.functions.text import clean_na
from casewell.operators.frames import PART_ROWS, running
from casewell.storage import stored

EMBED_AT_ONCE = 100
FILE_ROWS = 100_000  # a CSV file whose texts may hold line ends is read by one task
#: Columns that are not text, of all tables; times stay text until they are parsed.
LONGS = frozenset(
    "Year Days_Offset_N Informant_Age Victim_Age Number_of_Accused Accused_Height_cm Total_Property_Value_INR Amount_INR Balance_INR Amount Risk_Score Age"
    " Gross_Total_Income_INR High_Value_SFT_Txns_INR Taxable_Value_INR Route_Distance_KM Sanctioned_Limit_INR Overdue_Amount_INR Total_Directorships_Held"
    " Declared_Annual_Income_INR Revenue_FY1_INR Revenue_FY2_INR".split()
) | {"Duration (s)", "Private Port", "Public Port", "Destination Port", "Volume In (Bytes)", "Volume Out (Bytes)", "Toll Fee (INR)"}
DOUBLES = frozenset({"Accused_Vehicle_Identified_Probability", "Income_to_SFT_Ratio"})


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV table with header. All columns are read as text - inferred types would break phone
    numbers - cleaned of the marks for missing values, and cast. A path that does not exist is
    an empty table with the same columns."""
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(text).option("header", True).option("escape", '"').option("multiLine", True).option("enforceSchema", False).csv(path) if exists(spark, path) else spark.createDataFrame([], text)
    kind = lambda c: "long" if c in LONGS else "double" if c in DOUBLES else "string"
    return rows.select(*[clean_na(F.col(f"`{c}`")).try_cast(kind(c)).alias(c) for c in columns])


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    from .generate import COLUMNS

    return read_csv(spark, f"{base}/{name}.csv", COLUMNS[name])


def write_csv(rows: DataFrame, path: str, append: bool = False) -> bool:
    """Overwrite, or append to, a CSV table, in files of ``FILE_ROWS`` rows at most; nothing is written for no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("append" if append else "overwrite").option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)
    return True


def write_download(rows: DataFrame, path: str) -> None:
    """A CSV as spreadsheets take it: quoted where needed, lines end in CR LF, one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def write_json(rows: DataFrame, path: str, by: tuple[str, ...] = ()) -> None:
    """JSON lines, appended in folders of the partition columns if any are named."""
    writer = rows.write.mode("append" if by else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def write_report(rows: DataFrame, path: str, text_col: str = "report") -> None:
    rows.select(text_col).write.mode("overwrite").text(path)


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], text_col: str = "chunk", batch: int = EMBED_AT_ONCE) -> DataFrame:
    """``chunks`` with ``embedding array<float>`` by ``embed``, a function of a list of texts that runs on the
    executors, ``batch`` texts a call. Null texts are embedded as empty ones."""

    @F.pandas_udf("array<float>")
    def of_texts(texts: pd.Series) -> pd.Series:
        filled = texts.fillna("").tolist()
        return pd.Series([v for at in range(0, len(filled), batch) for v in embed(filled[at : at + batch])], dtype="object")

    return chunks.withColumn("embedding", of_texts(F.col(text_col)))


def put_vectors(vectors: DataFrame, path: str, batch: int, key: str = "vec_id") -> bool:
    """Write a batch of a vector store as a unit; False if a batch of that number is there already.

    A batch is a folder, and it counts once Spark has committed the write and marked the folder.
    A write that was killed leaves a folder without the mark, which readers pass by and a repeated write
    replaces; a repeated write of a committed batch does nothing. Of rows that repeat a key within a
    batch the greatest stays."""
    spark, folder = vectors.sparkSession, f"{path}/batch={batch:010d}"
    if exists(spark, f"{folder}/_SUCCESS"):
        return False
    others = [c for c in vectors.columns if c != key]
    rows = vectors.groupBy(key).agg(F.max(F.struct(*others)).alias("row")).select(key, "row.*")
    rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    return True


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches of a store that were committed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/_SUCCESS")
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) or []
    return sorted(int(f.getPath().getParent().getName().removeprefix("batch=")) for f in found)


def vectors_of(spark: SparkSession, path: str, schema, key: str = "vec_id") -> DataFrame:
    """The rows of all committed batches, for each key those of the latest batch that has it; an empty store
    has none. Only keys and batch numbers are shuffled to find the latest, and only if there are several."""
    numbers = committed_batches(spark, path)
    if not numbers:
        return spark.createDataFrame([], schema)
    parts = [spark.read.schema(schema).parquet(f"{path}/batch={n:010d}").withColumn("__batch", F.lit(n)) for n in numbers]
    rows = reduce(DataFrame.unionByName, parts)
    if len(numbers) == 1:
        return rows.drop("__batch")
    latest = rows.groupBy(F.col(key).alias("__key")).agg(F.max("__batch").alias("__last"))
    return rows.join(latest, (rows[key] == latest["__key"]) & (rows["__batch"] == latest["__last"]), "left_semi").drop("__batch")


def embed_into(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], path: str, batches: int, key: str = "vec_id", text_col: str = "chunk", first: int = 0) -> int:
    """Embed ``chunks`` into a vector store in ``batches`` batches by hash of the key, each committed as a unit; the
    number of batches written. A job that is repeated embeds only what was not committed."""
    made = 0
    for i in range(batches):
        if first + i in committed_batches(chunks.sparkSession, path):
            continue
        some = chunks.filter(F.pmod(F.xxhash64(key), F.lit(batches)) == i)
        made += put_vectors(embedded(some, embed, text_col).select(key, "embedding"), path, first + i, key)
    return made


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str, part_rows: int = PART_ROWS) -> None:
    """A graph of any size as node-link JSON lines: ``nodes`` (``id`` and more) in order of ids, each with its
    number ``no`` from 0, and ``links`` with ``source`` and ``target``, the numbers of their ends, in order of
    these. Tasks write ranges of the order, file by file; nothing is collected. Edges with an end
    that is no node are left out."""
    numbered = running(nodes, ["id"], {"no": F.lit(1).cast("long")}, part_rows).withColumn("no", F.col("no") - 1)
    numbered = stored(numbered, "nodes")
    numbered.repartitionByRange("no").sortWithinPartitions("no").write.mode("overwrite").json(f"{path}/nodes")
    ends = numbered.select("id", "no")
    links = edges.join(ends.select(F.col("id").alias("src"), F.col("no").alias("source")), "src").join(ends.select(F.col("id").alias("dst"), F.col("no").alias("target")), "dst")
    links = stored(links.drop("src", "dst"), "links")
    links.repartitionByRange("source", "target").sortWithinPartitions("source", "target").write.mode("overwrite").json(f"{path}/links")


def read_node_link(spark: SparkSession, path: str, node_schema: str, link_schema: str, numbers: bool = False) -> tuple[DataFrame, DataFrame]:
    """Nodes (``no`` and the schema's columns) and edges ``src, dst`` (and the schema's columns) of such an export; with
    ``numbers`` also their ``source`` and ``target`` as they stand there."""
    nodes = spark.read.schema(f"no long, {node_schema}").json(f"{path}/nodes")
    links = spark.read.schema(f"source long, target long{', ' if link_schema else ''}{link_schema}").json(f"{path}/links")
    ends = nodes.select("no", "id")
    edges = links.join(ends.select(F.col("no").alias("source"), F.col("id").alias("src")), "source").join(ends.select(F.col("no").alias("target"), F.col("id").alias("dst")), "target")
    return nodes, edges.select("src", "dst", *[c for c in links.columns if numbers or c not in ("source", "target")])


def next_case_number(spark: SparkSession, base: str, year: int = 2026) -> str:
    """``FIR/<year>/0001`` after the number of cases there are."""
    return f"FIR/{year}/{read_table(spark, base, 'complete_fir_dataset').count() + 1:04d}"


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, modificationTime, length, content`` of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``value``: a row per whole text file."""
    return spark.read.text(path, wholetext=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, text`` of one report, numbered within its file."""
    return read_reports(spark, path).select(F.posexplode(F.split("value", "\n")).alias("line_no", "text"))
