"""Text chunks, similarity search and numbered context."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1500, 150
SEPARATORS = ("\n\n", "\n", " ", "")
STRONG, TOP = 0.5, 5
REFUSAL = "The records do not answer this."


def stride_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, chunk_no, text``: windows of ``size`` characters that overlap, all native."""
    step = size - overlap
    length = F.length(text_col)
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((length - overlap) / step).cast("int") - 1, F.lit(0)))
    rows = docs.filter(length > 0).select(id_col, text_col, F.posexplode(starts).alias("chunk_no", "__k"))
    return rows.select(id_col, "chunk_no", F.substring(text_col, F.col("__k") * step + 1, F.lit(size)).alias("chunk"))


def split_text(text: str, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters cut at the coarsest separator that works, merged up to
    the size again; a chunk begins with the last pieces of the one before, ``overlap`` at most."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    pieces: list[str] = []
    for part in [text[i : i + size] for i in range(0, len(text), size)] if sep == "" else text.split(sep):
        pieces += [part] if len(part) <= size or not finer else split_text(part, size, overlap, finer)
    chunks, held, total = [], [], 0
    for p in pieces:
        if held and total + len(sep) + len(p) > size:
            chunks.append(sep.join(held))
            while held and (total > overlap or total + len(sep) + len(p) > size):
                total -= len(held.pop(0)) + (len(sep) if held else 0)
        total += len(p) + (len(sep) if held else 0)
        held.append(p)
    if held:
        chunks.append(sep.join(held))
    return [c for c in (c.strip() for c in chunks) if c]


def text_chunks(docs: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``id, chunk_no, chunk`` at separators, batch by batch."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, nos, out = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for n, c in enumerate(split_text(t or "", size, overlap)):
                    ids.append(i)
                    nos.append(n)
                    out.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(nos, pa.int32()), pa.array(out, pa.string())], [id_col, "chunk_no", "chunk"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"{id_col} {kind}, chunk_no int, chunk string")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def retrieve(vectors: DataFrame, question: list[float], k: int = TOP, threshold: float = STRONG, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``id, similarity, rank, strong``: the ``k`` most similar rows to one question, and whether each
    reaches the threshold. The limit is applied in every task before one task merges."""
    q = F.array(*[F.lit(float(x)) for x in question])
    best = vectors.select(id_col, cosine(F.col(vec_col), q).alias("similarity")).filter("similarity is not null").orderBy(F.desc("similarity"), id_col).limit(k)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("similarity"), id_col))
    return best.select(id_col, F.round("similarity", 6).alias("similarity"), rank.alias("rank"), (F.col("similarity") >= threshold).alias("strong"))


def context(excerpts: DataFrame, text_col: str, order: str) -> DataFrame:
    """One row: excerpts as numbered text."""
    numbered = F.struct(F.col(order).alias("n"), F.concat(F.lit("[Excerpt "), F.col(order).cast("string"), F.lit("]\n"), F.col(text_col)).alias("t"))
    return excerpts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(numbered)), lambda x: x["t"]), "\n\n").alias("context"))


def answer_or_refuse(found: DataFrame) -> DataFrame:
    """One row: whether any strong excerpt supports an answer, and the refusal if none does."""
    strong = F.coalesce(F.bool_or("strong"), F.lit(False))
    return found.agg(strong.alias("answerable"), F.when(~strong, REFUSAL).alias("refusal"))
