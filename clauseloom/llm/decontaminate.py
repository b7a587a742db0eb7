"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared after lower-casing, with every run of other characters than
letters and digits as one space. An item of m characters may differ in k = error_rate m edits (a space at both ends, so that
words are whole, counts too); it is cut in k + 1 pieces, of which one must stand unchanged in any passage within that distance.
One automaton finds the pieces of many items in a pass over the document; around each hit Myers' bit-parallel distance decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, lean, materialize, public_id, row_id, worker_cache

_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 parts of nearly equal length with their offsets."""
    n = len(item)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def least_distance(item: str, window: str) -> int:
    """The least edit distance between item and any substring of window."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << m - 1
    up, down, score, best = full, 0, m, m
    for c in window:
        eq = masks.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | ~(xh | up) & full
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            best = min(best, score)
        ph, mh = ph << 1 & full, mh << 1 & full
        up = mh | ~(xv | ph) & full
        down = ph & xv
    return best


class Matcher:
    """Finds the items that stand in a text within their error budgets."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = normal(text)
            if not item:
                continue
            errors, item = int(error_rate * len(item)), f" {item} "
            self.items.append((item_id, item, errors))
            for at, piece in pieces(item, errors):
                places.setdefault(piece, []).append((len(self.items) - 1, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str | None) -> dict[int, int]:
        """The least distance for each item that is found."""
        found: dict[int, int] = {}
        text = f" {normal(text)} "
        if self.empty or len(text) < 3:
            return found
        tried: set[tuple[int, int]] = set()
        for end, (length, where) in self.automaton.iter(text):
            for number, at in where:
                item_id, item, errors = self.items[number]
                start = end + 1 - length - at  # where the item begins if there are no edits
                if found.get(item_id) == 0 or (number, start) in tried:
                    continue
                tried.add((number, start))
                if text.startswith(item, max(start, 0)) and start >= 0:
                    found[item_id] = 0
                elif errors:
                    d = least_distance(item, text[max(0, start - errors) : max(0, start + len(item) + errors)])
                    if d <= errors and d < found.get(item_id, errors + 1):
                        found[item_id] = d
        return found


def _scan(items, error_rate: float):
    out = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        if kept.get("matcher_of") != items.id:
            kept["matcher"], kept["matcher_of"] = Matcher(items.value, error_rate), items.id
        find = kept["matcher"].find
        for b in batches:
            rows = [(did, th, item, d) for did, th, text in zip(b["did"].to_pylist(), b["th"].to_pylist(), b["text"], strict=True) for item, d in find(text.as_py()).items()]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield batch(out, did=cols[0], th=cols[1], item_id=cols[2], distance=cols[3])

    return run, "did long, th long, item_id long, distance int"


class _Items:
    """A broadcast list of items and a name by which workers know its automaton."""

    def __init__(self, spark, rows: list[tuple[int, str]]):
        import uuid

        self.id, self._held = uuid.uuid4().hex, spark.sparkContext.broadcast(rows)

    @property
    def value(self):
        return self._held.value

    def drop(self) -> None:
        self._held.unpersist()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = 0.05, broadcast_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, distance): each document and test item that stands in it within error_rate of its length.

    Items too short for an edit must stand unchanged; empty and null items match nothing. The items are sent to the tasks in
    groups of at most about broadcast_chars characters, one group at a time with a pass of its own over the documents, so
    neither the driver nor a task ever holds more. Documents without a match and null texts have no row; repeated ids and items
    give one row. Other columns are not read.
    """
    found = _hits(docs, benchmark, id_col, text_col, error_rate, broadcast_chars)
    best = found.groupBy("did", "item_id").agg(F.min("distance").alias("distance"))
    return best.select(public_id("did").alias(id_col), "item_id", "distance")


def _hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", error_rate: float = 0.05, broadcast_chars: int = 2_000_000) -> DataFrame:
    """(did, th, item_id, distance) of every row and item, th the hash of the row's text."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    source = docs.select(row_id(id_col).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    total = tests.agg(F.coalesce(F.sum(F.char_length("text") + 64), F.lit(0))).first()[0]
    groups = total // broadcast_chars + 1
    found = None
    for g in range(groups):
        rows = [(r.item_id, r.text) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).collect()]
        items = _Items(spark, rows)
        run, schema = _scan(items, error_rate)
        hits = source.mapInArrow(lean(run), schema)
        if groups > 1:
            hits = materialize(hits)
            items.drop()
        found = hits if found is None else found.unionByName(hits)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs without a contaminated text; other rows under the same id stay."""
    bad = materialize(_hits(docs, benchmark, id_col, text_col, **params).select(F.col("did").alias("_cl_id"), F.col("th").alias("_cl_th")).distinct())
    keyed = docs.withColumns({"_cl_id": row_id(id_col), "_cl_th": F.xxhash64(F.col(text_col).cast("string"))})
    return keyed.join(bad, ["_cl_id", "_cl_th"], "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
