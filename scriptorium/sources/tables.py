"""Scans. Readers stay lazy: filters and column choices reach the Parquet scan."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ordinals(df: DataFrame, group: str, key: str, width: int = 65_536) -> DataFrame:
    """Adds ordinal: the 0-based place in order of the group and an integer key. Rows meet in ranges of keys only.

    A range of `width` keys of a group is numbered by itself; offsets come from the ranges' counts, a table of one row
    for so many rows.
    """
    parts = df.withColumn("_part", F.floor(F.col(key) / width))
    counts = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(group, "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), before.alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_part").orderBy(key)) - 1
    numbered = parts.withColumn("_place", place).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & F.col("_part").eqNullSafe(F.col("_p")))
    return numbered.select(*df.columns, (F.col("_before") + F.col("_place")).cast("long").alias("ordinal"))



CHUNK_SCHEMA = "chunk_id string, doc_id string, book string, text string, n_tokens int, page_start int, page_end int, cite_page int, cite_kind string, breadcrumb array<string>, chunker string, parent_id string"
GOLDEN_SCHEMA = "qid string, question string, question_type string, difficulty string, answerable boolean, ground_truth_answer string, ground_truth_contexts array<struct<book:string,page_start:int,page_end:int>>, notes string, expected_behaviour string"


def read_chunks(spark: SparkSession, path: str, chunker: str) -> DataFrame:
    """Chunks of one strategy; parents are another partition and are not read. JSON lines or Parquet by the path's name."""
    reader = spark.read.schema(CHUNK_SCHEMA)
    df = reader.json(path) if path.endswith((".json", ".jsonl")) else reader.parquet(path)
    return df.where(F.col("chunker") == chunker)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One folder a strategy and book; rewriting a book leaves the others."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunker", "book").parquet(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden or candidate items; the fixed schema is the projection that drops working fields."""
    return spark.read.schema(GOLDEN_SCHEMA).json(path).withColumn("expected_behaviour", F.coalesce("expected_behaviour", F.lit("answer")))


def write_golden(items: DataFrame, path: str) -> None:
    items.write.mode("overwrite").json(path)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by `order`: caches, per-question results, manifests."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and those old ones whose key is not among them."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


class PagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.parser = options["path"], get_parser(options.get("parser", "text"))

    def partitions(self) -> list[InputPartition]:
        import glob

        return [InputPartition(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import time

        for number in range(self.parser.page_count(partition.value)):
            began = time.perf_counter()
            try:
                text, error = self.parser.extract_page(partition.value, number), None
            except Exception as e:
                text, error = "", f"{type(e).__name__}: {e}"
            yield partition.value, self.parser.name, number, text, (time.perf_counter() - began) * 1000, error


class PagesSource(DataSource):
    """Format `pages`: one row a page of every file that `path` matches; a page that fails has its error and no text."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "path string, parser string, page_num int, text string, elapsed_ms double, error string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(dict(self.options))


class OutlineReader(PagesReader):
    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for seq, (level, title, page) in enumerate(self.parser.extract_toc(partition.value)):
            yield partition.value, self.parser.name, seq, level, title, page


class OutlineSource(PagesSource):
    """Format `outline`: one row an outline entry of every file that `path` matches, pages from 0."""

    @classmethod
    def name(cls) -> str:
        return "outline"

    def schema(self) -> str:
        return "path string, parser string, seq int, level int, title string, page int"

    def reader(self, schema) -> OutlineReader:
        return OutlineReader(dict(self.options))


class TextParser:
    """Plain text with form feeds between pages; its outline is the file beside it that ends in .toc (level, title, page by tabs)."""

    name = "text"

    def page_count(self, path: str) -> int:
        return open(path, encoding="utf-8").read().count("\f") + 1

    def extract_page(self, path: str, page: int) -> str:
        return open(path, encoding="utf-8").read().split("\f")[page]

    def extract_toc(self, path: str) -> list[tuple[int, str, int]]:
        if not os.path.exists(f"{path}.toc"):
            return []
        with open(f"{path}.toc", encoding="utf-8") as lines:
            return [(int(level), title, int(page)) for level, title, page in (line.rstrip("\n").split("\t") for line in lines)]


class PdfParser(TextParser):
    """pypdf, where it is installed: (level, title, 0-based page) outline entries, one level deeper for each nested list."""

    name = "pypdf"

    def _open(self, path: str):
        import pypdf

        return pypdf.PdfReader(path)

    def page_count(self, path: str) -> int:
        return len(self._open(path).pages)

    def extract_page(self, path: str, page: int) -> str:
        return self._open(path).pages[page].extract_text() or ""

    def extract_toc(self, path: str) -> list[tuple[int, str, int]]:
        reader = self._open(path)
        found, work = [], [(1, iter(reader.outline))]
        while work:
            level, entries = work[-1]
            entry = next(entries, None)
            if entry is None:
                work.pop()
            elif isinstance(entry, list):
                work.append((level + 1, iter(entry)))
            else:
                found.append((level, entry.title, reader.get_destination_page_number(entry)))
        return found


class MuPdfParser(TextParser):
    """PyMuPDF, where it is installed; `sort` orders blocks by position. Its outline pages count from 1."""

    def __init__(self, sort: bool = False):
        self.sort, self.name = sort, "pymupdf_sorted" if sort else "pymupdf"

    def _open(self, path: str):
        import fitz

        return fitz.open(path)

    def page_count(self, path: str) -> int:
        return len(self._open(path))

    def extract_page(self, path: str, page: int) -> str:
        return self._open(path)[page].get_text("text", sort=self.sort)

    def extract_toc(self, path: str) -> list[tuple[int, str, int]]:
        return [(level, title, page - 1) for level, title, page in self._open(path).get_toc()]


class PlumberParser(TextParser):
    """pdfplumber, where it is installed; it has no outline."""

    name = "pdfplumber"

    def extract_toc(self, path: str) -> list[tuple[int, str, int]]:
        return []

    def page_count(self, path: str) -> int:
        import pdfplumber

        with pdfplumber.open(path) as pdf:
            return len(pdf.pages)

    def extract_page(self, path: str, page: int) -> str:
        import pdfplumber

        with pdfplumber.open(path) as pdf:
            return pdf.pages[page].extract_text() or ""


PARSERS = {"text": TextParser, "pypdf": PdfParser, "pymupdf": MuPdfParser, "pymupdf_sorted": lambda: MuPdfParser(True), "pdfplumber": PlumberParser}


def get_parser(name: str):
    if name not in PARSERS:
        raise KeyError(f"unknown parser {name!r}; known: {sorted(PARSERS)}")
    return PARSERS[name]()
