"""Nearest neighbours by stable projections, a kd-tree and a chi-square stopping test.

Vectors of length one are projected to a few dimensions by random normal weights. A pair at distance d is then at
a projected distance whose square is d squared times a chi-square variable of as many degrees. A search takes projected neighbours in
order of their distance and verifies each on the original vectors; once the projected distance passes
``d_k sqrt(q)``, with d_k the distance of the k-th best so far and q the chi-square quantile of the wanted confidence, a vector
that is nearer than d_k and not yet seen is less likely than 1 - confidence, and the search ends.

Rows of one vector are one candidate with its smallest ids, so a vector that a third of the rows hold costs one
row. The top of a kd-tree, fitted on a bounded sample of projections, deals all vectors to cells; a large cell has several
blocks. In a first round each query searches one block of its own cell, which gives it a bound for d_k. In a second round
it goes to the blocks of those cells whose box of projections the test cannot rule out for that bound. Within a block the leaves of a kd-tree are visited by
their distance to the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import lean, stage_dir

#: Projected dimensions (an even number), confidence of the stopping test, vectors of a leaf.
DIMS, CONFIDENCE, LEAF = 8, 0.98, 32
#: Projections (64 bytes each) that the top of the tree is fitted on, the most cells, the vectors of a block.
SAMPLE, MOST_CELLS, BLOCK = 50_000, 4096, 1 << 15
#: Groups that the rows of one vector are counted in before they meet.
_SALTS = 32
#: Projections and boxes are rounded; this much more (squared) is searched.
_SLACK = 1e-12


def chi_square_quantile(p: float, dims: int) -> float:
    """The value below which a chi-square variable of an even number of degrees lies with probability p."""

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def _matrix(col: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two, so that squares stay in range."""
    rows = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def _project(rows: np.ndarray, dims: int) -> np.ndarray:
    weights = np.random.default_rng([20240229, rows.shape[1]]).standard_normal((rows.shape[1], dims))
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None] @ weights


def _by_length(col: pa.Array) -> Iterator[np.ndarray]:
    size = np.diff(col.offsets.to_numpy())
    for n in np.unique(size):
        yield np.flatnonzero(size == n)


def _projections(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _by_length(b["vec"]):
                p = _project(_matrix(b["vec"].take(pa.array(at))), dims)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), dims).cast(pa.list_(pa.float64()))], ["proj"])

    return run


def fit_cells(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete kd-tree of so many levels: the dimension and the value that each inner node splits at, in level order."""
    axis, value = np.zeros(2**depth - 1, np.int64), np.zeros(2**depth - 1)
    own = [points]
    for node in range(2**depth - 1):
        p = own[node]
        if len(p):
            axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
            value[node] = np.median(p[:, axis[node]])
        right = p[:, axis[node]] >= value[node]
        own += [p[~right], p[right]]
        own[node] = None
    return axis, value


def cell_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    axis, value = tree
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] >= value[node])
    return node - len(axis)


_LISTS = pa.list_(pa.float64())
_PLACED = pa.schema([("vec", _LISTS), ("ids", pa.list_(pa.int64())), ("asked", pa.bool_()), ("size", pa.int32()), ("cell", pa.int32()), ("proj", _LISTS)])


def _place(tree, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in _by_length(b["vec"]):
                own = b.take(pa.array(at))
                rows = _matrix(own["vec"])
                p = _project(rows, dims)
                proj = pa.FixedSizeListArray.from_arrays(pa.array(p.reshape(-1)), dims).cast(_LISTS)
                yield pa.RecordBatch.from_arrays([own["vec"], own["ids"], own["asked"], pa.array(np.full(len(p), rows.shape[1], np.int32)), pa.array(cell_of(p, tree).astype(np.int32)), proj], schema=_PLACED)

    return run


class _Block:
    """The vectors of a block in the leaves of a kd-tree."""

    def __init__(self, table: pa.Table, dims: int):
        self.rows = _matrix(table["vec"].combine_chunks())
        self.norm = np.sqrt((self.rows * self.rows).sum(axis=1))
        self.proj = table["proj"].combine_chunks().flatten().to_numpy().reshape(-1, dims)
        self.ids = table["ids"].to_pylist()
        leaves, open_ = [], [np.arange(len(self.rows))]
        while open_:
            at = open_.pop()
            if len(at) <= LEAF:
                leaves.append(at)
                continue
            p = self.proj[at]
            axis = np.argmax(p.max(axis=0) - p.min(axis=0))
            order = at[np.argpartition(p[:, axis], len(at) // 2)]
            open_ += [order[: len(at) // 2], order[len(at) // 2 :]]
        self.leaves = leaves
        self.low, self.high = (np.array([f(self.proj[x], axis=0) for x in leaves]) for f in (np.min, np.max))

    def search(self, row: np.ndarray, proj: np.ndarray, bound: float, k: int, reach: float) -> tuple[list[tuple[float, int]], float]:
        """The k best (score, id) that are found, and the square of the distance of the k-th (bound, if fewer are nearer)."""
        norm = np.sqrt((row * row).sum())
        away = np.maximum(np.maximum(self.low - proj, proj - self.high), 0)
        away = (away * away).sum(axis=1)
        order = np.argsort(away)
        best: list[tuple[float, int]] = []
        at, step = 0, 1
        while at < len(order) and away[order[at]] <= reach * bound + _SLACK:
            seen = np.concatenate([self.leaves[i] for i in order[at : at + step]])
            gap = self.proj[seen] - proj
            seen = seen[(gap * gap).sum(axis=1) <= reach * bound + _SLACK]
            score = (self.rows[seen] * row).sum(axis=1) / (self.norm[seen] * norm)
            # What is farther than the bound, here or from an earlier block, is not among the k best.
            worst = max(best[-1][0] if len(best) == k else -inf, 1 - bound / 2 - _SLACK)
            new = [(s, i) for j, s in zip(seen.tolist(), score.tolist(), strict=True) if s >= worst for i in self.ids[j]]
            if new:
                best = sorted(best + new, key=lambda x: (-x[0], x[1]))[:k]
                if len(best) == k:
                    bound = min(bound, max(0.0, 2 - 2 * best[-1][0]))
            at, step = at + step, min(2 * step, 64)
        return best, bound


_FOUND = pa.schema([("vid", pa.int64()), ("bound", pa.float64()), ("ids", pa.list_(pa.int64())), ("scores", _LISTS)])


def _search(k: int, dims: int, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            keys = list(zip(*(b[c].to_pylist() for c in ("size", "cell", "sub", "kind")), strict=True))
            cuts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]] + [len(keys)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                part = b.slice(i, j - i)
                if keys[i][:3] != now:
                    now, held, block = keys[i][:3], [], None
                if keys[i][3] == 0:
                    held.append(part)
                    continue
                if block is None:
                    block, held = _Block(pa.Table.from_batches(held), dims) if held else False, []
                rows, proj = _matrix(part["vec"]), part["proj"].flatten().to_numpy().reshape(-1, dims)
                out = [block.search(r, p, inf if d is None else d, k, reach) if block else ([], d) for r, p, d in zip(rows, proj, part["bound"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part["vid"], pa.array([d for _, d in out], pa.float64()), pa.array([[x for _, x in best] for best, _ in out], pa.list_(pa.int64())), pa.array([[s for s, _ in best] for best, _ in out], _LISTS)], schema=_FOUND)

    return run


_SENT = pa.schema([("size", pa.int32()), ("cell", pa.int32()), ("sub", pa.int32()), ("kind", pa.int32()), ("vid", pa.int64()), ("vec", _LISTS), ("ids", pa.list_(pa.int64())), ("proj", _LISTS), ("bound", pa.float64())])


def _route(cells: dict, dims: int, reach: float):
    """Each query goes to the blocks, other than the one it has searched, of the cells that may hold nearer vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, own = b["size"].to_pylist(), list(zip(b["cell"].to_pylist(), b["sub"].to_pylist(), strict=True))
            proj = b["proj"].flatten().to_numpy().reshape(-1, dims)
            bound = b["bound"].to_numpy(zero_copy_only=False)
            for i in range(len(b)):
                number, blocks, low, high = cells[size[i]]
                away = np.maximum(np.maximum(low - proj[i], proj[i] - high), 0)
                near = np.flatnonzero((away * away).sum(axis=1) <= reach * bound[i] + _SLACK)
                to = [(int(number[c]), s) for c in near for s in range(blocks[c])]
                to = [x for x in to if x != own[i]]
                for at in range(0, len(to), 4096):
                    part = to[at : at + 4096]
                    n = len(part)
                    again = b.slice(i, 1).take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([again["size"], pa.array([c for c, _ in part], pa.int32()), pa.array([s for _, s in part], pa.int32()), pa.array(np.ones(n, np.int32)), again["vid"], again["vec"], again["ids"], again["proj"], again["bound"]], schema=_SENT)

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest by cosine of each row whose id is divisible by ``every``, nearest first, ties by id.

    Candidates are all rows but those of the query's own id. Each of the true neighbours is found with a probability of about
    ``confidence`` or more; scores are exact, in double precision. Rows without an id and vectors that are null, empty, zero or hold null, NaN or
    infinite components take no part. Repeated rows of (id, vector) count once; an id with several vectors asks with each. Vectors are compared
    with those of their own length only. With fewer than k candidates all are given; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    home = stage_dir(spark, "neighbours")
    reach = chi_square_quantile(confidence, dims)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vec = F.col(vec_col).cast("array<double>")
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))) & F.exists("vec", lambda x: x != 0)
    source = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & whole).withColumn("asked", F.expr(f"id % {every} = 0"))
    total = source.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = source.where(F.xxhash64("id") % 1_000_000_007 < F.lit(int(share * 1_000_000_007))) if share < 1 else source
    sample = drawn.select("vec").mapInArrow(lean(_projections(dims)), "proj array<double>").collect()
    sample = np.unique(np.array([r.proj for r in sample]).reshape(-1, dims), axis=0)
    wanted = min(MOST_CELLS, max(2 * parts, -(-total // BLOCK)), max(1, len(sample) // LEAF))
    tree = fit_cells(sample, wanted.bit_length() - 1 if wanted & (wanted - 1) == 0 else wanted.bit_length())

    # Of equal vectors the smallest k + 1 ids, queries apart; in groups first, so that those of a common vector do not meet in one task.
    w = W.partitionBy("vec", "asked", "salt").orderBy("id")
    few = source.withColumn("salt", F.spark_partition_id() % _SALTS).withColumn("_r", F.dense_rank().over(w)).where(F.col("_r") <= k + 1)
    distinct = few.groupBy("vec").agg(F.slice(F.sort_array(F.collect_set("id")), 1, k + 1).alias("ids"), F.max("asked").alias("asked"))
    placed = distinct.mapInArrow(lean(_place(tree, dims)), "vec array<double>, ids array<long>, asked boolean, size int, cell int, proj array<double>")
    placed.withColumn("vid", F.monotonically_increasing_id()).write.parquet(f"{home}/vectors")
    placed = spark.read.parquet(f"{home}/vectors")
    # One row for each cell and length of vectors.
    ends = [f(F.col("proj")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(dims)]
    boxes = placed.groupBy("size", "cell").agg(F.count("*").alias("n"), *ends).collect()
    cells = {}
    for size in {b["size"] for b in boxes}:
        own = [b for b in boxes if b["size"] == size]
        cells[size] = (np.array([b.cell for b in own]), [-(-b.n // BLOCK) for b in own], *(np.array([[b[f"{name}{i}"] for i in range(dims)] for b in own]) for name in ("low", "high")))
    blocks = spark.createDataFrame([(b["size"], b.cell, -(-b.n // BLOCK)) for b in boxes], "size int, cell int, blocks long")
    placed = placed.join(F.broadcast(blocks), ["size", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vid"), F.col("blocks")).cast("int")).drop("blocks")
    cols = _SENT.names
    held = placed.withColumns({"kind": F.lit(0), "bound": F.lit(None).cast("double")}).select(*cols)
    asked = placed.where("asked").withColumn("kind", F.lit(1))

    def searched(queries: DataFrame) -> DataFrame:
        dealt = held.unionByName(queries).repartition("size", "cell", "sub").sortWithinPartitions("size", "cell", "sub", "kind")
        return dealt.mapInArrow(lean(_search(k + 1, dims, reach)), "vid long, bound double, ids array<long>, scores array<double>")

    searched(asked.withColumn("bound", F.lit(None).cast("double")).select(*cols)).write.parquet(f"{home}/first")
    first = spark.read.parquet(f"{home}/first")
    sent = asked.join(first.select("vid", F.coalesce("bound", F.lit(inf)).alias("bound")), "vid").select(*cols)
    second = searched(sent.mapInArrow(lean(_route(cells, dims, reach)), "size int, cell int, sub int, kind int, vid long, vec array<double>, ids array<long>, proj array<double>, bound double"))
    pairs = first.unionByName(second).select("vid", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("vid", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))
    best = W.partitionBy("vid").orderBy(F.desc("score"), "id")
    tops = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    tops = tops.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "score"))).alias("tops"))
    tops = tops.join(placed.where("asked").select("vid", "vec"), "vid").select("vec", "tops")
    queries = source.where("asked").select(F.col("id").alias("query_id"), "vec").distinct()
    own = queries.join(tops, "vec").select("query_id", F.slice(F.filter("tops", lambda t: t["id"] != F.col("query_id")), 1, k).alias("tops"))
    return own.select("query_id", F.posexplode("tops").alias("rank", "t")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias(id_col), F.col("t.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
