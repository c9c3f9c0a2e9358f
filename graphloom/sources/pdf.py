"""PDF files as pages, by a pluggable parser."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class PDFError(Exception):
    """A file can't be read as a PDF."""


@dataclass(frozen=True)
class Parsed:
    pages: list[str]
    title: str = ""
    author: str = ""
    subject: str = ""
    extra: dict[str, str] = field(default_factory=dict)


Parser = Callable[[bytes], Parsed]


def fitz_parser(data: bytes) -> Parsed:
    """Parses with PyMuPDF, where it is installed."""
    try:
        import fitz
    except ImportError as e:
        raise PDFError("no PDF parser is installed") from e
    try:
        with fitz.open(stream=data, filetype="pdf") as doc:
            meta = doc.metadata or {}
            return Parsed(
                [page.get_text() for page in doc], meta.get("title") or "", meta.get("author") or "", meta.get("subject") or ""
            )
    except Exception as e:
        raise PDFError(str(e)) from e


def files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, length``; an empty path is an error."""
    if not path:
        raise ValueError("the path is empty")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def parse(found: DataFrame, parser: Parser = fitz_parser) -> DataFrame:
    """``path, page_count, title, author, subject, file_size, pages, error`` of each file; pages keep blank ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, length in zip(pdf["path"], pdf["content"], pdf["length"], strict=True):
                try:
                    p = parser(bytes(content))
                    rows.append((path, len(p.pages), p.title, p.author, p.subject, length, p.pages, None))
                except Exception as e:  # noqa: BLE001  a bad file has a row of its own
                    rows.append((path, 0, None, None, None, length, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page_count", "title", "author", "subject", "file_size", "pages", "error"])

    schema = (
        "path string, page_count int, title string, author string, subject string, file_size bigint, "
        "pages array<string>, error string"
    )
    return found.mapInPandas(run, schema)


def pages(parsed: DataFrame) -> DataFrame:
    """``doc_id, page_number, text``: pages from 1; the file's path is the document's id."""
    flat = parsed.where("error is null").select(F.col("path").alias("doc_id"), F.posexplode("pages").alias("i", "text"))
    return flat.select("doc_id", (F.col("i") + 1).alias("page_number"), "text")


def page_texts(parsed: DataFrame) -> DataFrame:
    """``path, pages``: each file's pages as a list."""
    return parsed.where("error is null").select("path", "pages")


def full_text(parsed: DataFrame) -> DataFrame:
    """``path, text``: a file's pages joined by a blank line."""
    return parsed.where("error is null").select("path", F.array_join("pages", "\n\n").alias("text"))


def validity(parsed: DataFrame) -> DataFrame:
    """``path, is_valid``: named .pdf in either case, readable, and not without pages."""
    ok = F.lower("path").endswith(".pdf") & F.col("error").isNull() & (F.col("page_count") > 0)
    return parsed.select("path", ok.alias("is_valid"))


def info(parsed: DataFrame) -> DataFrame:
    """``path, page_count, title, author, subject, file_size`` of readable files, whatever they are named."""
    return parsed.where("error is null").select("path", "page_count", "title", "author", "subject", "file_size")


def read_pages(spark: SparkSession, path: str, parser: Parser = fitz_parser) -> DataFrame:
    """Pages of one file or folder; raises for an empty path, a missing one, or a file that isn't readable."""
    try:
        found = files(spark, path)
        parsed = parse(found, parser)
        bad = parsed.where("error is not null").select("path", "error").limit(1).collect()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    if bad:
        raise PDFError(f"{bad[0].path}: {bad[0].error}")
    return pages(parsed)
