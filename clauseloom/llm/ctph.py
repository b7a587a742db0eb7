"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last WINDOW bytes ends a chunk where it is block size - 1 modulo the block size;
each chunk gives one of 64 letters. The block size starts near length / 64 and is halved until there are
enough chunks, and the fingerprint is ``size:letters:letters of twice the size``. Two fingerprints are
compared by insert/delete distance where their block sizes are equal or a factor of two apart.
Both hashes come from one prefix sum over the bytes, so a text takes a few vector operations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import U64, batch, lean, powers, prefix_sums, public_id, range_hash, row_id

WINDOW, LETTERS, LEAST = 7, 64, 3
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def _letters(s: np.ndarray, ends: np.ndarray, limit: int) -> str:
    """A letter for each chunk; beyond limit - 1 chunks the rest of the text is one."""
    n = len(s) - 1
    ends = ends[: limit - 1]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate(([0], ends[:-1]))
    return _ALPHABET[(range_hash(s, starts, ends) >> U64(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: bytes) -> str:
    """Fingerprint of the bytes; equal bytes have equal ones. No bytes: '3::'."""
    n = len(data)
    if not n:
        return f"{LEAST}::"
    s = prefix_sums(np.frombuffer(data, np.uint8))
    size = LEAST
    while size * LETTERS < n:
        size *= 2
    w = min(WINDOW, n)
    # The window's hash at each end from w on; short starts have no boundary.
    roll = ((s[w:] - s[:-w]) * powers(n + 1)[: n + 1 - w] * U64(0x9FB21C651E98DF25)) >> U64(32)
    while True:
        ends = np.flatnonzero(roll % U64(size) == U64(size - 1)) + w
        if size == LEAST or len(ends) >= LETTERS // 2:
            break
        size //= 2
    double = ends[roll[ends - w] % U64(2 * size) == U64(2 * size - 1)]
    return f"{size}:{_letters(s, ends, LETTERS)}:{_letters(s, double, LETTERS // 2)}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        if (u := v & at.get(c, 0)):
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _share(a: str, b: str, run: int = 4) -> bool:
    """Long letter strings must have a run of letters in common, or what they share is chance."""
    if min(len(a), len(b)) < 2 * run:
        return True
    grams = {a[i : i + run] for i in range(len(a) - run + 1)}
    return any(b[i : i + run] in grams for i in range(len(b) - run + 1))


def likeness(x: str, y: str) -> float:
    """1 for equal fingerprints, else 1 - insert/delete distance / length, the best over compatible block sizes; 0 if there are none."""
    if x == y:
        return 1.0
    (n, a1, a2), (m, b1, b2) = x.split(":"), y.split(":")
    n, m = int(n), int(m)
    pairs = [(a1, b1), (a2, b2)] if n == m else [(a2, b1)] if m == 2 * n else [(a1, b2)] if n == 2 * m else []
    best = 0.0
    for a, b in pairs:
        if a and b and _share(a, b):
            best = max(best, 2 * _common(a, b) / (len(a) + len(b)))
    return best


_OUT = pa.schema([("did", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by (bucket, halo, id, text). Each row that is no halo meets the row after it."""
    held = None  # (id, text, bytes, fingerprint)

    def row(own, nxt):
        did, text, data, print_ = own
        n = len(text)
        half = n // 2
        edited = (text[: n - half] + nxt[1][:half]).encode("utf-8", "surrogatepass")
        other = print_ if edited == data else fingerprint(edited)
        return did, n, hashlib.sha256(edited).hexdigest(), print_, other, likeness(print_, other), likeness(print_, nxt[3])

    for b in batches:
        rows = []
        for did, halo, text in zip(b["did"].to_pylist(), b["halo"].to_pylist(), b["text"].to_pylist(), strict=True):
            text = text or ""
            data = text.encode("utf-8", "surrogatepass")
            now = (did, text, data, fingerprint(data))
            if held is not None:
                rows.append(row(held, now))
            held = None if halo else now
        cols = list(zip(*rows, strict=True)) or [[]] * len(_OUT)
        yield batch(_OUT, **dict(zip(_OUT.names, cols, strict=True)))
    if held is not None:
        raise RuntimeError("a bucket has no row after its last")


def fingerprints_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its fingerprint, that of its edited text, and their likeness and that to the next row.

    Order is (id, text), null ids first; after the last row comes the first. A null text counts as empty. Rows
    go to buckets of ids, and the first row of each bucket goes to the bucket before it as well, so the texts
    shuffle once. Other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(row_id(id_col).alias("did"), F.col(text_col).cast("string").alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted({int(x) for x in (docs.select(row_id(id_col).cast("double").alias("x")).approxQuantile("x", [i / n for i in range(1, n)], 0.2 / n) or [])})
    bucket = F.lit(0)
    if cuts:
        array = F.array(*[F.lit(c).cast("long") for c in cuts])
        bucket = F.size(F.filter(array, lambda c: c <= F.col("did")))
    # One row a bucket: where its ids begin.
    first = [r.did for r in source.groupBy(bucket.alias("b")).agg(F.min("did").alias("did")).orderBy("b").collect()]
    at = {b: i for i, b in enumerate(first)}
    if not first:
        return spark.createDataFrame([], "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("did", id_col)
    heads = source.where(F.col("did").isin(first)).groupBy("did").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    place = F.create_map(*[F.lit(x) for b, i in at.items() for x in (b, (i - 1) % len(first))])
    halo = heads.select(place[F.col("did")].cast("int").alias("bucket"), F.lit(1).alias("halo"), "did", "text")
    # Buckets without rows are skipped: a row's bucket is the number of filled ones that begin at or before it.
    begins = F.array(*[F.lit(b).cast("long") for b in first])
    own = source.select((F.size(F.filter(begins, lambda c: c <= F.col("did"))) - 1).alias("bucket"), F.lit(0).alias("halo"), "did", F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.unionByName(halo).repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "halo", "did", "text")
    out = dealt.mapInArrow(lean(_pairs), "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("did", public_id("did")).withColumnRenamed("did", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
