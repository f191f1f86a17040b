"""Sources outside of files: relational tables, pages by HTTP, texts of PDF files."""

from __future__ import annotations

import shutil
import sqlite3
import subprocess
import time
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """A table of an SQLite file, read in ranges of its row ids. Options: path (a file that all tasks see), table, schema, parts."""

    @classmethod
    def name(cls) -> str:
        return "quaestor_sqlite"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema) -> DataSourceReader:
        return _SqliteReader(dict(self.options), [f.name for f in schema.fields])


class _SqliteReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True)

    def _table(self) -> str:
        return '"' + self.options["table"].replace('"', '""') + '"'

    def partitions(self) -> Sequence[InputPartition]:
        with self._open() as c:
            low, high = c.execute(f"select coalesce(min(rowid), 0), coalesce(max(rowid), -1) from {self._table()}").fetchone()
        parts = max(1, min(int(self.options.get("parts", 8)), high - low + 1))
        edges = [low + (high + 1 - low) * k // parts for k in range(parts + 1)]
        return [_Range(a, z) for a, z in zip(edges, edges[1:], strict=False)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        names = ", ".join('"' + c.replace('"', '""') + '"' for c in self.columns)
        with self._open() as c:
            yield from c.execute(f"select {names} from {self._table()} where rowid >= ? and rowid < ?", (partition.low, partition.high))


def relational(spark: SparkSession, url: str, table: str, schema: str | None = None, **options: str) -> DataFrame:
    """A relational table: sqlite:/path by the source above (schema needed), any other url by JDBC. JDBC reads in parallel with
    the options partitionColumn, lowerBound, upperBound and numPartitions."""
    if url.startswith("sqlite:"):
        spark.dataSource.register(SqliteSource)
        return spark.read.format(SqliteSource.name()).options(path=url.removeprefix("sqlite:"), table=table, schema=schema or "", **options).load()
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


@dataclass
class Answer:
    """What a request gives: a status and a body."""

    status: int
    body: str = ""


class Refused(Exception):
    """A request that failed for good."""


def fetch(get: Callable[[str], Answer], url: str, retries: int = 5, ignored: Collection[int] = (), wait: Callable[[float], None] = time.sleep) -> Answer:
    """The answer to a request; errors are tried again, `retries` times, after 4 seconds times one more each time, 5 if there were
    too many requests. Statuses in `ignored` are answers. 404 is final."""
    left = retries
    while True:
        try:
            answer = get(url)
        except OSError as e:
            answer = Answer(0, str(e))
        if 200 <= answer.status < 400 or answer.status in ignored:
            return answer
        if answer.status == 404 or not left:
            raise Refused(f"{answer.status} {url}")
        wait((5 if answer.status == 429 else 4) * (6 - left))
        left -= 1


def pages(urls: DataFrame, get: Callable[[str], Answer], retries: int = 5, ignored: Collection[int] = (), wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(url, status, body, error): each distinct url of column url asked once, by the tasks. Write the result: a plan that is run
    again asks again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url in f["url"]:
                try:
                    a = fetch(get, url, retries, ignored, wait)
                    out.append((url, a.status, a.body, None))
                except Refused as e:
                    out.append((url, None, None, str(e)))
            yield pd.DataFrame(out, columns=["url", "status", "body", "error"]).astype({"status": "Int64"})

    return urls.where("url is not null").select("url").distinct().mapInPandas(run, "url string, status long, body string, error string")


def layout_text(content: bytes) -> str:
    """The laid-out text of a PDF file by the pdftotext program, a form feed after each page."""
    program = shutil.which("pdftotext")
    if program is None:
        raise FileNotFoundError("pdftotext")
    return subprocess.run([program, "-layout", "-", "-"], input=content, capture_output=True, check=True, timeout=600).stdout.decode("utf-8", "replace")


def pdf_lines(files: DataFrame, text: Callable[[bytes], str] = layout_text) -> DataFrame:
    """(path, page, lines, error) of PDF files (path, content), as spark.read.format("binaryFile") gives them: a row a page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path, content in zip(f["path"], f["content"], strict=True):
                try:
                    found = text(bytes(content)).split("\f")
                    found = found[:-1] if found and not found[-1].strip() else found
                    out += [(path, i + 1, p.split("\n"), None) for i, p in enumerate(found)]
                except Exception as e:  # noqa: BLE001  one bad file must not end the others
                    out.append((path, None, None, repr(e)))
            yield pd.DataFrame(out, columns=["path", "page", "lines", "error"]).astype({"page": "Int64"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, lines array<string>, error string")


def dossier_sources(years: DataFrame, feed: DataFrame, known: DataFrame, active: DataFrame, split: Sequence[str], everything: bool = False) -> DataFrame:
    """(url): what there is to read. everything: the links of the lists by year (items of column link). Else the feed's new
    references (title, link; cut at a star), and the sources (reference, url) of active procedures that aren't split."""
    if everything:
        return years.select(F.trim("link").alias("url")).where("url <> ''")
    new = feed.select(F.substring_index("title", "*", 1).alias("reference"), F.col("link").alias("url")).join(known.select("reference"), "reference", "left_anti")
    kept = active.where(~F.col("reference").isin(*split)) if split else active
    return new.select("url").unionByName(kept.select("url"))


def associated(items: DataFrame, by_document: DataFrame, by_pdf: DataFrame, by_page: DataFrame) -> DataFrame:
    """items (id, kind, reference, url, pdf) with the procedures that each belongs to. Opinions take the one that their PDF names
    (pdf, reference); others those of their document (document, reference), else, unless the url is a PDF's, the one that the page
    names (url, reference) if it names just one. An empty array: none."""
    opinion = F.col("kind").isin("opinions", "opinions-shadow")
    of_document = by_document.groupBy("document").agg(F.array_sort(F.collect_set("reference")).alias("__documents"))
    of_pdf = by_pdf.groupBy("pdf").agg(F.min("reference").alias("__pdf"))
    of_page = by_page.groupBy("url").agg(F.min("reference").alias("__page"), F.count_distinct("reference").alias("__n")).where("__n = 1").drop("__n")
    rows = items.join(of_document, items.reference == of_document.document, "left").drop("document").join(of_pdf, "pdf", "left").join(of_page, "url", "left")
    page = F.when(~F.contains("url", F.lit("+DOC+PDF+")) & F.col("__page").isNotNull(), F.array("__page"))
    found = F.when(opinion, F.when(F.col("__pdf").isNotNull(), F.array("__pdf"))).otherwise(F.coalesce("__documents", page))
    return rows.select(*items.columns, F.coalesce(found, F.array().cast("array<string>")).alias("dossiers"))
