"""Scans: workbooks of named tables, delimited files, JSON inventories, landed feeds, pages, graph seeds."""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X


class Catalog:
    """Named tables, found without regard to case and surrounding spaces."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = {k.strip().lower(): v for k, v in tables.items()}

    def get(self, name: str) -> DataFrame | None:
        return self.tables.get(name.strip().lower())

    def first(self, *names: str) -> DataFrame:
        for n in names:
            if (df := self.get(n)) is not None:
                return df
        raise KeyError(f"none of {', '.join(names)} is among {', '.join(sorted(self.tables))}")

    def profile(self, spark: SparkSession) -> DataFrame:
        """(sheet, columns, rows)."""
        parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("sheet"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "rows") for n, df in self.tables.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def register(self, prefix: str = "") -> None:
        for n, df in self.tables.items():
            df.createOrReplaceTempView(prefix + n.replace(" ", "_"))


class _SheetPartition(InputPartition):
    pass


class WorkbookSource(DataSource):
    """A worksheet as text columns, one partition a sheet; needs the optional openpyxl."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _rows(self):
        import openpyxl

        book = openpyxl.load_workbook(self.options["path"], read_only=True, data_only=True)
        return book[self.options.get("sheet", book.sheetnames[0])].iter_rows(values_only=True)

    def schema(self) -> str:
        head = next(iter(self._rows()))
        return ", ".join(f"`{c}` string" for c in head)

    def reader(self, schema) -> DataSourceReader:
        source = self

        class Reader(DataSourceReader):
            def partitions(self):
                return [_SheetPartition(0)]

            def read(self, partition):
                rows = iter(source._rows())
                next(rows)
                for r in rows:
                    yield tuple(None if v is None else str(v) for v in r)

        return Reader()


def workbook(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    if importlib.util.find_spec("openpyxl") is None:
        raise ImportError("reading workbooks needs openpyxl; convert the sheet to CSV or Parquet instead")
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").option("sheet", sheet).load(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, TSV, JSON or Parquet by suffix."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "tsv"):
        return spark.read.option("header", True).option("sep", "\t" if suffix == "tsv" else ",").option("multiLine", True).option("escape", '"').csv(path)
    return spark.read.json(path) if suffix in ("json", "jsonl") else spark.read.parquet(path)


def paragraphs(df: DataFrame, least: int = 50) -> DataFrame:
    """Each row as one paragraph; rows shorter than least characters go."""
    text = F.concat_ws(" ", *[F.trim(F.col(c).cast("string")) for c in df.columns])
    return df.select(F.trim(text).alias("paragraph")).where(F.char_length("paragraph") >= least)


def components_with_defaults(df: DataFrame, order: str) -> DataFrame:
    """Component id, name and source with defaults COMP-n, Unnamed component and Unknown source."""
    d = lambda c, x: F.coalesce(X.usable(F.col(c)), x)
    return df.select(d("component_id", F.concat(F.lit("COMP-"), F.col(order).cast("string"))).alias("component_id"), d("name", F.lit("Unnamed component")).alias("name"), d("source", F.lit("Unknown source")).alias("source"))


def named_sources(df: DataFrame) -> DataFrame:
    """Sources with a name."""
    return df.where(X.usable(F.col("source_name")).isNotNull())


def json_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(section, component, description) of a JSON map from sections to lists."""
    kind = "map<string,array<struct<component:string,description:string>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("m"))
    rows = raw.select(F.explode("m").alias("section", "items")).select("section", F.explode("items").alias("i"))
    return rows.select("section", "i.*")


def pages_text(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, main)."""
    return pages.select("page_id", X.html_title(F.col("html")).alias("title"), X.html_text(F.col("html")).alias("text"), X.html_main(F.col("html")).alias("main"))


def federal_documents(landed: DataFrame, reference: str, days: int = 62) -> DataFrame:
    """Presidential documents and budget-office notices of the window, newest first."""
    d = landed.withColumn("published", X.iso_prefix(F.col("publication_date")))
    keep = (F.col("document_type") == "Presidential Document") | F.col("title").rlike("(?i)management and budget|\\bOMB\\b")
    return d.where(keep & X.date_window(F.col("published"), F.to_date(F.lit(reference)), days)).orderBy(F.desc("published"), "citation")


def versions(landed: DataFrame, reference: str, days: int = 62) -> DataFrame:
    """One row a citation, the newest of the window, newest first."""
    d = landed.withColumn("published", X.iso_prefix(F.col("publication_date"))).where(X.date_window(F.col("published"), F.to_date(F.lit(reference)), days))
    return d.groupBy("citation").agg(F.max_by(F.struct(*[c for c in d.columns if c != "citation"]), "published").alias("s")).select("citation", "s.*").orderBy(F.desc("published"), "citation")


def sitemap_cases(xml: DataFrame) -> DataFrame:
    """(url, citation, title) of the case pages of a sitemap (xml)."""
    urls = xml.select(F.explode(F.regexp_extract_all("xml", F.lit("<loc>\\s*([^<\\s]+)\\s*</loc>"), F.lit(1))).alias("url")).distinct().where(X.case_url(F.col("url")))
    return urls.select("url", X.case_citation(F.col("url")).alias("citation"), X.slug_title(F.col("url")).alias("title"))


def linked_directives(pages: DataFrame) -> DataFrame:
    """(page_id, url, label, date): links with a memorandum number or label and the first date after them."""
    pattern = "(?is)<a\\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>([^<]{0,200})"
    parts = F.arrays_zip(*[F.regexp_extract_all("html", F.lit(pattern), F.lit(g)).alias(n) for g, n in ((1, "url"), (2, "label"), (3, "after"))])
    rows = pages.select("page_id", F.explode(parts).alias("l")).select("page_id", "l.url", F.trim(F.regexp_replace("l.label", "<[^>]+>", "")).alias("label"), X.find_date(F.col("l.after")).alias("date"))
    return rows.withColumn("memo", F.nullif(F.regexp_extract("label", "\\bM-\\d{2}-\\d{2}\\b", 0), F.lit("")))


def order_range(spark: SparkSession, oldest: int, newest: int) -> DataFrame:
    """The order numbers to fetch."""
    return spark.range(oldest, newest + 1).select(F.col("id").alias("order_number"))


def pdf_pages(spark: SparkSession, path: str, parse) -> DataFrame:
    """(path, page, text) of binary files; parse takes bytes and yields (page, text). No parser is bundled."""

    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(p, n, t) for p, c in zip(b["path"], b["content"], strict=True) for n, t in parse(bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, page int, text string")


def fetched(urls: DataFrame, fetch) -> DataFrame:
    """(url, status, content): each address once through fetch(url) -> (status, content), which the caller supplies."""

    def run(batches):
        for b in batches:
            got = [fetch(u) for u in b["url"]]
            b["status"], b["content"] = [g[0] for g in got], [g[1] for g in got]
            yield b[["url", "status", "content"]]

    return urls.select("url").distinct().mapInPandas(run, "url string, status int, content string")


def graph_seed(spark: SparkSession, nodes_csv: str, edges_csv: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; category codes stay text, edges with unknown ends are dropped, equal edges once."""
    nodes = spark.read.option("header", True).schema("label string, id string, name string, type string, categoryCode string, date date, citation string").csv(nodes_csv)
    edges = spark.read.option("header", True).schema("src string, rel_type string, dst string").csv(edges_csv).distinct()
    ids = nodes.select("id")
    return nodes, edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "rel_type", "dst")


def run_script(spark: SparkSession, script: str) -> None:
    """The statements of a SQL script, one by one."""
    for s in script.split(";"):
        if s.strip():
            spark.sql(s)
