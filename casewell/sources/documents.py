"""Pages of PDF files, where a parser can be imported; OCR where its programs are installed."""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .tables import read_binary


def _needed(*modules: str) -> None:
    missing = [m for m in modules if importlib.util.find_spec(m) is None]
    if missing:
        raise NotImplementedError(f"this needs {', '.join(missing)}, which is not installed")


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """``path, page, text`` of all pages of all PDF files under a path."""
    _needed("pypdf")
    return pdf_pages(read_binary(spark, path, "*.pdf"))


def pdf_pages(files: DataFrame) -> DataFrame:
    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pypdf

        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(range(len(texts)), pa.int32()), pa.array(texts, pa.string())], ["path", "page", "text"])

    return files.select("path", "content").mapInArrow(pages, "path string, page int, text string")


def ocr_page(content: bytes, page: int = 0, languages: str = "mar+hin+eng") -> str:
    """Text of one page read from its picture; empty if the page cannot be drawn."""
    _needed("pdf2image", "pytesseract")
    from pdf2image import convert_from_bytes
    from pytesseract import image_to_string

    drawn = convert_from_bytes(content, dpi=300, first_page=page + 1, last_page=page + 1)
    return image_to_string(drawn[0], lang=languages) if drawn else ""
