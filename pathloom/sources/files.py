"""Reading documents and question tables, writing results and graph tables."""

from __future__ import annotations

import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.evaluation import averages

# The columns that a question table must have.
REQUIRED = ("Question", "Answer", "Source Docs", "Question Type", "Source Chunk Type")
Extractor = Callable[[bytes], str | None]


def read_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf", extract: dict[str, Extractor] | None = None) -> DataFrame:
    """(path, text) of the files of a folder, not of its subfolders; ``extract`` gives a reader by lower-case ending.

    Other endings are read as UTF-8, and PDF files by :func:`pdf_text` unless
    ``extract`` says otherwise.  A file that cannot be read or holds no text is
    left out.
    """
    readers = {"pdf": pdf_text} | dict(extract or {})

    @F.pandas_udf("string")
    def text_of(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(path: str, content: bytes) -> str | None:
            try:
                ending = path.rsplit(".", 1)[-1].lower()
                return readers[ending](content) if ending in readers else content.decode("utf-8")
            except Exception:  # noqa: BLE001  (an unreadable file counts as empty)
                return None

        return pd.Series([one(p, c) for p, c in zip(paths, contents, strict=True)], dtype=object)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return files.select("path", text_of("path", "content").alias("text")).where(F.length("text") > 0)


def pages_to_text(pages: list[str | None]) -> str:
    """Pages of a document as one text: each that is not empty, followed by a line feed."""
    return "".join(f"{p}\n" for p in pages if p)


def pdf_text(content: bytes) -> str | None:
    """The text of a PDF file, page by page; needs the package pypdf where it runs, and gives nothing without it."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return pages_to_text([page.extract_text() for page in PdfReader(io.BytesIO(content)).pages])


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question table from CSV: all columns text, nulls empty; required columns must be there."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"the question table lacks {', '.join(missing)}")
    return df.na.fill("")


def write_results(df: DataFrame, path: str, by_method: bool = True) -> None:
    """Quoted CSV, one folder a method, or all methods in one file."""
    writer = (df if by_method else df.coalesce(1)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    (writer.partitionBy("method") if by_method else writer).csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    averages(df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_graph(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet; chunks by method, so a search of one method reads only its files."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("method") if "method" in df.columns else writer).parquet(f"{folder}/{name}")


def read_graph(spark: SparkSession, folder: str, names: tuple[str, ...] = ("documents", "chunks", "next_chunk", "entities", "mentions")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def page(df: DataFrame, order: list[str], skip: int, limit: int) -> DataFrame:
    """One page of an ordered table; for parity only, as Spark reads all partitions at once."""
    return df.orderBy(*order).offset(skip).limit(limit)
