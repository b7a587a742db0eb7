"""Exact line deduplication across documents.

A line's key is the line without the ASCII white space at both ends, A-Z lower-cased. The lines of a
key of at least ``min_chars`` code points that is found in at least ``min_docs`` documents stay only in
the document with the largest id.

One record for each (key, document) goes to range partitions ordered by (key hash, id descending), so a
key that a third of all rows hold spans many partitions. Each task streams its records: the first
document of a key is the one that keeps its lines. Only a task's first run, and a last run that has not
shown ``min_docs`` documents, need the neighbours; they carry at most two summary rows a task, which are
merged and broadcast. What comes back for each document is a compressed keep bitmap, never text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import batch, lean, materialize, public_id, row_id

_WS = b" \t\n\x0b\x0c\r"
_RUNS = pa.schema([("kind", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("pos", pa.binary()), ("top", pa.list_(pa.int64()))])
_DROP, _OPEN, _SUMMARY = 0, 1, 2


def _keys(min_chars: int):
    out = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("pos", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2, ids, ths, poss = [], [], [], [], []
            for did, th, text in zip(b["did"].to_pylist(), b["th"].to_pylist(), b["text"], strict=True):
                found: dict[bytes, list[int]] = {}
                for i, line in enumerate((text.as_py() or "").split("\n")):
                    if len(line) >= min_chars:
                        key = line.encode("utf-8", "surrogatepass").strip(_WS).lower()
                        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                            found.setdefault(key, []).append(i)
                for key, at in found.items():
                    d = xxhash.xxh3_128_intdigest(key)
                    h1.append((d >> 64) - 2**63)
                    h2.append((d & (2**64 - 1)) - 2**63)
                    ids.append(did)
                    ths.append(th)
                    poss.append(np.array(at, "<i4").tobytes())
            yield batch(out, h1=h1, h2=h2, did=ids, th=ths, pos=poss)

    return run, "h1 long, h2 long, did long, th long, pos binary"


def _streams(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        key, top, waiting, first = None, [], [], True

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * len(_RUNS)
            out.clear()
            return batch(_RUNS, **dict(zip(_RUNS.names, cols, strict=True)))

        for b in batches:
            for h1, h2, did, th, pos in zip(*(b[c].to_pylist() for c in ("h1", "h2", "did", "th", "pos")), strict=True):
                if (h1, h2) != key:
                    if key is not None and first:
                        out.append((_SUMMARY, *key, 0, 0, b"", top))
                        first = False
                    key, top, waiting = (h1, h2), [], []
                if did not in top and len(top) < min_docs:
                    top.append(did)
                if first:
                    out.append((_OPEN, h1, h2, did, th, pos, None))
                elif did != top[0] and len(top) >= min_docs:
                    out += [(_DROP, h1, h2, *w, None) for w in waiting]
                    waiting = []
                    out.append((_DROP, h1, h2, did, th, pos, None))
                elif did != top[0]:
                    waiting.append((did, th, pos))
            if len(out) > 20_000:
                yield flush()
        if key is not None:
            out.append((_SUMMARY, *key, 0, 0, b"", top))
            out += [(_OPEN, *key, *w, None) for w in waiting]
        yield flush()

    return run, "kind int, h1 long, h2 long, did long, th long, pos binary, top array<long>"


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("keep", pa.binary())])
    for b in batches:
        maps = []
        for parts in b["parts"].to_pylist():
            at = np.frombuffer(b"".join(parts), "<i4")
            keep = np.ones((int(at.max()) // 8 + 1) * 8, bool)
            keep[at] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield batch(out, did=b["did"], th=b["th"], keep=maps)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_id(id_col).alias("did"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).cast("string").alias("text"))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(did, th, keep) of the documents that lose lines: keep is a zlib-compressed bitmap, one bit a line; lines after its end stay.

    did is the id (a null id counts as the smallest), th the text's xxhash64, so that rows which repeat an id
    with another text have bitmaps of their own; for counting they are one document. Null and empty texts have
    one empty line, which always stays. Other columns are not read.
    """
    rows, schema = _keys(min_chars)
    keys = materialize(_source(docs, id_col, text_col).mapInArrow(lean(rows), schema))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("did").desc(), F.col("th")]
    stream, schema = _streams(min_docs)
    runs = materialize(keys.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lean(stream), schema))
    # At most two rows a task.
    edges = runs.where(F.col("kind") == _SUMMARY).groupBy("h1", "h2").agg(F.array_distinct(F.flatten(F.collect_list("top"))).alias("top"))
    edges = edges.where(F.size("top") >= min_docs).select("h1", "h2", F.array_max("top").alias("keeper"))
    opened = runs.where(F.col("kind") == _OPEN).join(F.broadcast(edges), ["h1", "h2"]).where(F.col("did") != F.col("keeper"))
    drops = runs.where(F.col("kind") == _DROP).select("did", "th", "pos").unionByName(opened.select("did", "th", "pos"))
    return drops.groupBy("did", "th").agg(F.collect_list("pos").alias("parts")).mapInArrow(lean(_bitmaps), "did long, th long, keep binary")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = pa.schema([("did", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])
    for b in batches:
        total, dropped, kept = [], [], []
        for text, keep in zip(b["text"], b["keep"], strict=True):
            lines = (text.as_py() or "").split("\n")
            total.append(len(lines))
            if keep.is_valid:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep.as_py()), np.uint8))
                stay = [line for i, line in enumerate(lines) if i >= len(bits) or bits[i]]
                dropped.append(len(lines) - len(stay))
                lines = stay
            else:
                dropped.append(0)
            kept.append("\n".join(lines))
        yield batch(out, did=b["did"], n_lines=total, n_dropped=dropped, text=kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) for every row of docs, text being the kept lines."""
    masks = keep_bitmaps(docs, id_col, text_col, min_chars, min_docs)
    joined = _source(docs, id_col, text_col).join(masks, ["did", "th"], "left").select("did", "text", "keep")
    return joined.mapInArrow(lean(_apply), "did long, n_lines long, n_dropped long, text string").select(public_id("did").alias(id_col), "n_lines", "n_dropped", F.col("text").alias(text_col))


def apply_to_documents(docs: DataFrame, **params) -> DataFrame:
    """docs with text (and n_chars, where present) after the deduplication; other columns as they were."""
    masks = keep_bitmaps(docs, **params)
    kept = F.col("_cl_kept")
    keyed = docs.withColumns({"_cl_did": row_id(), "_cl_th": F.xxhash64(F.col("text"))})
    masks = masks.select(F.col("did").alias("_cl_did"), F.col("th").alias("_cl_th"), F.col("keep").alias("_cl_keep"))
    joined = keyed.join(masks, ["_cl_did", "_cl_th"], "left")

    @F.pandas_udf("string")
    def cut(text, keep):
        import pandas as pd

        done = []
        for t, k in zip(text, keep, strict=True):
            if t is not None and k is not None:
                lines, bits = t.split("\n"), np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8))
                t = "\n".join(line for i, line in enumerate(lines) if i >= len(bits) or bits[i])
            done.append(t)
        return pd.Series(done, dtype=object)

    out = joined.withColumn("_cl_kept", cut(F.col("text"), F.col("_cl_keep")))
    cols = {"text": kept, "n_chars": F.char_length(kept).cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[cols[c].alias(c) if c in cols else F.col(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k)
GROUP BY doc_id
"""


