"""Paged sources as a Spark data source: pages are fetched by the tasks that read them, in batches and as streams.

The service is the caller's function ``fetch(page)``: the records of page 1, 2, ... as a list of dicts, and an empty list after the
last. It travels to the executors by value. A page that still fails after some tries fails its task, never
leaves a gap: a batch is read whole or not at all, and a stream goes on at the last page that was committed.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import text as X


class _Pages(InputPartition):
    def __init__(self, first: int, step: int, end: int | None):
        """Pages first, first + step, ... below end; without an end until one is empty."""
        self.first, self.step, self.end = first, step, end


def paged_source(name: str, fetch: Callable[[int], list[dict]], schema: str, tries: int = 3, wait: float = 0.5) -> type[DataSource]:
    """A data source of that name, to be given to ``spark.dataSource.register``.

    Records become rows of the schema by name; fields that a record lacks are null, others are left out, and lists or
    dicts in text columns become JSON. Options: ``readers`` (tasks of a batch, 8) and ``first`` (the first page, 1).

    A batch needs no count of pages: of n readers the i-th takes every n-th page from the i-th on until one is empty. A stream's
    offset is the next page; its service must list the oldest first, and a page counts once it is full or followed by another, so that
    records added later to the last page are not missed. What is full is for the service to say: a short last page is left for
    the next run unless the option ``last`` is true.
    """
    columns = [part.strip().split(None, 1) for part in schema.split(",")]
    names, texts = [c for c, _ in columns], {c for c, kind in columns if kind.lower() == "string"}

    def got(page: int) -> list[dict]:
        for left in reversed(range(tries)):
            try:
                return fetch(page)
            except Exception:
                if not left:
                    raise
                time.sleep(wait * 2 ** (tries - 1 - left))
        return []

    def row(record: dict) -> tuple:
        plain = lambda c, v: json.dumps(v, ensure_ascii=False, sort_keys=True) if isinstance(v, (list, dict)) else str(v)
        return tuple(plain(c, v) if (v := record.get(c)) is not None and c in texts else v for c in names)

    def rows(part: _Pages) -> Iterator[tuple]:
        page = part.first
        while part.end is None or page < part.end:
            records = got(page)
            if not records and part.end is None:
                return
            yield from map(row, records)
            page += part.step

    class Batch(DataSourceReader):
        def __init__(self, options):
            self.readers, self.first = int(options.get("readers", 8)), int(options.get("first", 1))

        def partitions(self):
            return [_Pages(self.first + i, self.readers, None) for i in range(self.readers)]

        def read(self, partition):
            return rows(partition)

    class Stream(DataSourceStreamReader):
        def __init__(self, options):
            self.readers, self.first, self.last = int(options.get("readers", 8)), int(options.get("first", 1)), options.get("last", "false") == "true"
            self.known = self.first

        def initialOffset(self):
            return {"page": self.first}

        def latestOffset(self):
            # The first page that must not be read yet; found by doubling and halving, so with few requests.
            low, step = self.known, 1
            there = lambda page: bool(got(page))
            if not there(low):
                return {"page": low}
            while there(low + step):
                step *= 2
            good, bad = low + step // 2, low + step
            while bad - good > 1:
                mid = (good + bad) // 2
                good, bad = (mid, bad) if there(mid) else (good, mid)
            return {"page": good + 1 if self.last else good}

        def partitions(self, start, end):
            return [_Pages(page, self.readers, end["page"]) for page in range(start["page"], min(start["page"] + self.readers, end["page"]))]

        def read(self, partition):
            return rows(partition)

        def commit(self, end):
            self.known = max(self.known, end["page"])

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Batch(self.options)

        def streamReader(self, schema):
            return Stream(self.options)

    return Paged


def read_pages(spark: SparkSession, name: str, fetch, schema: str, readers: int = 8, **how) -> DataFrame:
    """All records of the pages, as one batch."""
    spark.dataSource.register(paged_source(name, fetch, schema, **how))
    return spark.read.format(name).option("readers", readers).load()


def stream_pages(spark: SparkSession, name: str, fetch, schema: str, readers: int = 8, last: bool = False, **how) -> DataFrame:
    """The records of the pages as a stream that resumes at the page after the last committed one; a batch takes all that is there."""
    spark.dataSource.register(paged_source(name, fetch, schema, **how))
    return spark.readStream.format(name).option("readers", readers).option("last", str(last).lower()).load()


#: Fields of a record that hold what a row needs, in order of preference.
REGISTER = "citation string, document_number string, title string, type string, document_type string, publication_date string, html_url string, pdf_url string, executive_order_number string"


def register_documents(records: DataFrame, reference: str, days: int = 62) -> DataFrame:
    """(citation, title, document_type, publication_date, url) of executive orders among presidential documents and
    of notices that name the budget office or a memorandum, published in the days up to the reference day."""
    first = lambda *cols: F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))
    title, kind = F.lower(F.coalesce("title", F.lit(""))), F.upper(F.coalesce("type", F.lit("")))
    order = (kind == "PRESDOCU") & (title.contains("executive order") | (F.coalesce("executive_order_number", F.lit("")) != ""))
    notice = (kind == "NOTICE") & (title.contains("omb") | title.contains("memorandum"))
    published = F.left(F.coalesce("publication_date", F.lit("")), F.lit(10))
    inside = X.date_window(X.iso_prefix(published), F.to_date(F.lit(reference)), days)
    return records.where((order | notice) & F.coalesce(inside, F.lit(False))).select(
        first("citation", "document_number").alias("citation"), F.coalesce("title", F.lit("")).alias("title"), first("type", "document_type").alias("document_type"), published.alias("publication_date"), first("html_url", "pdf_url").alias("url")
    )


def version_documents(records: DataFrame, reference: str, days: int = 62) -> DataFrame:
    """The distinct (citation, title, publication_date, url) published in the days up to the reference day."""
    published = X.iso_prefix(F.col("publication_date"))
    rows = records.where(F.coalesce(X.date_window(published, F.to_date(F.lit(reference)), days), F.lit(False)))
    return rows.select("citation", "title", F.left("publication_date", F.lit(10)).alias("publication_date"), "url").distinct()


def landed_pages(records: DataFrame, folder: str, page_col: str = "page") -> Callable[[int], list[dict]]:
    """Writes records as JSON by page and gives the function that fetches a page of them: a stand-in for a service, or a replay of what one gave."""
    records.write.partitionBy(page_col).json(folder)

    def fetch(page: int) -> list[dict]:
        import pyarrow.fs as pafs

        files, path = pafs.FileSystem.from_uri(folder)
        found = files.get_file_info(pafs.FileSelector(f"{path}/{page_col}={page}", allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda i: i.path):
            if info.path.endswith(".json"):
                with files.open_input_stream(info.path) as f:
                    out += [json.loads(line) for line in f.read().decode().splitlines()]
        return out

    return fetch
