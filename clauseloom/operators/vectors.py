"""Exact cosine search and joins over embeddings: blocks of vectors meet as matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors that are held at once.
BLOCK = 2048


def _rows(df: DataFrame, key: str, vector: str, block: Column, salt: Column, kind: int) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(block.alias("block"), salt.alias("salt"), F.lit(kind).alias("kind"), F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))


def _meet(select, schema: str):
    """Rows come ordered by (block, salt, kind): a block's held vectors (kind 0), and after them those that meet all of these."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def unit(vectors: list) -> np.ndarray:
        x = np.array(vectors, np.float64)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, keys, held, matrix = None, [], [], None
        for b in batches:
            at = list(zip(*(b[c].to_pylist() for c in ("block", "salt", "kind")), strict=True))
            ids, vectors = b["key"].to_numpy(), b["v"].to_pylist()
            start, out = 0, []
            while start < len(at):
                end = start
                while end < len(at) and at[end] == at[start]:
                    end += 1
                if at[start][:2] != group:
                    group, keys, held, matrix = at[start][:2], [], [], None
                if at[start][2] == 0:
                    keys.extend(ids[start:end].tolist())
                    held.append(unit(vectors[start:end]))
                elif held:
                    matrix = np.vstack(held) if matrix is None else matrix
                    out.append(select(np.array(keys), ids[start:end], matrix @ unit(vectors[start:end]).T))
                start = end
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)

    return run


def vector_search(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest corpus rows of each query by cosine, (query, id, score, rank); a query's own key is left out, ties go to the smaller id.

    Blocks of queries meet every row once, as matrix products; of a batch of rows each query keeps its k best before the shuffle. Null vectors are left out.
    """
    spark = queries.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-queries.count() // BLOCK))
    salts = max(1, n // blocks)
    every = lambda z: F.explode(F.sequence(F.lit(0), F.lit(z - 1)))
    place = lambda z: F.pmod(F.xxhash64(key), F.lit(z)).cast("int")
    held = _rows(queries, key, vector, place(blocks), F.lit(0), 0).withColumn("salt", every(salts))
    met = _rows(corpus, key, vector, F.lit(0), place(salts), 1).withColumn("block", every(blocks))

    def best(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        scores = np.where(keys[:, None] == ids[None, :], -np.inf, scores)
        order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
        rows = np.repeat(np.arange(len(keys)), order.shape[1])
        flat = order.ravel()
        good = np.isfinite(scores[rows, flat])
        return keys[rows[good]], ids[flat[good]], scores[rows[good], flat[good]]

    dealt = held.unionByName(met).repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "kind")
    schema = "query long, id long, score double"
    found = dealt.mapInArrow(_meet(best, schema), schema)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def cosine_pairs(vectors: DataFrame, threshold: float = 0.5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, score) of all pairs a < b with a cosine of at least threshold; null vectors are left out.

    Keys are dealt to blocks; each pair of blocks meets in one task as a matrix product, so every vector is sent once for each block.
    """
    spark = vectors.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-vectors.count() // BLOCK))
    own = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    # Block i is held where i <= j and block j meets it there.
    held = _rows(vectors, key, vector, own, F.lit(0), 0).withColumn("salt", F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))))
    met = _rows(vectors, key, vector, F.lit(0), own, 1).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("salt"))))

    def near(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray):
        i, j = np.nonzero(scores >= threshold)
        a, b, s = keys[i], ids[j], scores[i, j]
        return np.minimum(a, b), np.maximum(a, b), s

    schema = "a long, b long, score double"
    dealt = held.unionByName(met).repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "kind")
    # Within one block a pair is seen from both sides.
    return dealt.mapInArrow(_meet(near, schema), schema).where("a < b").groupBy("a", "b").agg(F.max("score").alias("score"))
