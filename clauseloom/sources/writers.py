"""Sinks and report builders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.records import numbered


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "parquet") -> dict[str, str]:
    """One folder a table."""
    out = {}
    for name, df in tables.items():
        out[name] = f"{path}/{name}"
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if format == "csv" else getattr(writer, format))(out[name])
    return out


#: Rows of data that a worksheet holds.
SHEET_ROWS = 1_048_574


def sheets(df: DataFrame, *order: str, rows: int = SHEET_ROWS) -> DataFrame:
    """Sanitised cells with sheet and row, both from 1: rows in the order fill one worksheet after the other, none is left out."""
    cells = [F.to_json(c) if t.startswith(("array", "map", "struct")) else X.excel_cell(F.col(c)) if t == "string" else F.col(c) for c, t in df.dtypes]
    at = numbered(df.withColumns({c: x for x, c in zip(cells, df.columns, strict=True)}), "_at", *order)
    return at.select(*df.columns, (F.floor((F.col("_at") - 1) / rows) + 1).cast("int").alias("sheet"), (F.pmod(F.col("_at") - 1, F.lit(rows)) + 1).cast("int").alias("row"))


def csv_with_mark(df: DataFrame, path: str) -> None:
    """CSV whose first header carries a byte-order mark."""
    first, *rest = df.columns
    df.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").option("header", True).csv(path)


def keyword_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """One cell of the distinct keywords of several array columns."""
    return df.withColumn("keywords", F.array_join(X.distinct_folded(F.concat(*columns)), "; ")).drop(*columns)


def stage(df: DataFrame, path: str, request: str, response: str) -> None:
    """JSON lines of a request and its response, not yet applied."""
    df.select(F.current_timestamp().alias("timestamp"), F.col(request).alias("request"), F.col(response).alias("response"), F.lit(False).alias("applied")).write.mode("append").json(path)


def pair_report(scored: DataFrame, least: float = 0.1) -> DataFrame:
    """A text block for each component (a) with its partners (b) by falling score."""
    line = F.format_string("  - %s (%.4f)", F.col("b").cast("string"), F.col("score"))
    rows = scored.where(F.col("score") > least).groupBy("a").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), line.alias("line")))).alias("x"))
    return rows.select("a", F.concat(F.col("a").cast("string"), F.lit("\n"), F.array_join(F.transform("x", lambda t: t["line"]), "\n")).alias("report"))


def best_and_rest(scored: DataFrame, n: int = 3) -> DataFrame:
    """The n best partners of each component and how many more there are."""
    w = W.partitionBy("a")
    r = scored.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "b"))).withColumn("more", F.greatest(F.count("*").over(w) - n, F.lit(0)))
    return r.where(F.col("rank") <= n)


def governance_outputs(components: DataFrame, alignments: DataFrame) -> dict[str, DataFrame]:
    """Dashboard counts and the document by document matrix in long form."""
    dash = components.groupBy("type").agg(F.count("*").alias("n"), F.avg("priority").alias("mean_priority"))
    return {"dashboard": dash, "matrix": alignments.groupBy("doc_a", "doc_b").agg(F.count("*").alias("n"))}
