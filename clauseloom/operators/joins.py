"""Pair generation and similarity joins. Pairs come from inverted indexes or blocks, not from products, wherever scores allow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .records import numbered, once


# ---- TF-IDF -------------------------------------------------------------------------------------------
def tfidf(docs: DataFrame, tokens: Column, key: str = "doc_id", fit_on: DataFrame | None = None, copies: str | None = None) -> DataFrame:
    """(key, term, df, w) with smooth idf ln((1 + n) / (1 + df)) + 1 and L2 norm.

    fit_on (key, term) gives the documents that idf is fitted on (M03); terms that it lacks are dropped. Documents
    without tokens have no rows but count for n. copies names a column of docs, unique by key: a row stands for so many documents.
    """
    if copies is not None:
        terms = docs.select(key, copies, F.explode(tokens).alias("term")).groupBy(key, copies, "term").agg(F.count("*").alias("tf"))
        df, n = terms.groupBy("term").agg(F.sum(copies).alias("df")), docs.agg(F.sum(copies).alias("n"))
        return _weighted(terms.drop(copies), df, n, key)
    # Texts are dealt by key before they are cut, which moves less than their terms; terms has each (key, term) once.
    terms = docs.repartition(key).select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count(key).alias("df")) if fit_on is None else fit_on.groupBy("term").agg(F.countDistinct(key).alias("df"))
    n = (docs if fit_on is None else fit_on).agg(F.countDistinct(key).alias("n"))
    return _weighted(terms, df, n, key)


def _weighted(terms: DataFrame, df: DataFrame, n: DataFrame, key: str) -> DataFrame:
    weighted = terms.join(df, "term").crossJoin(F.broadcast(n)).withColumn("x", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(W.partitionBy(key)))
    return weighted.select(key, "term", "df", (F.col("x") / norm).alias("w"))


#: Postings of a term that meet in one task, about, on each side.
CELL = 2048
#: Rows of the right side that follow one another for each left row of a cell, about.
RUN = 128


def meet(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, parts: int | None = None) -> DataFrame:
    """The join of two sides on a term, postings of frequent terms dealt over cells of about CELL by CELL rows; parts is the number of tasks.

    A term of z and y rows makes ceil(z / CELL) by ceil(y / CELL) cells, which are hashed apart, so no term is one
    task's load. Terms of one side alone are left out before.
    """
    x, y, at = _in_cells(left, right, on, left_key, right_key, parts)
    return x.join(y, at).drop("_i", "_j")


def _in_cells(left: DataFrame, right: DataFrame, on: str, left_key: str, right_key: str, parts: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of meet, dealt, and the columns of a cell."""
    sizes = left.groupBy(on).agg(F.count("*").alias("_z")).join(right.groupBy(on).agg(F.count("*").alias("_y")), on)
    sizes = sizes.select(on, F.ceil(F.col("_z") / CELL).cast("int").alias("_gi"), F.ceil(F.col("_y") / CELL).cast("int").alias("_gj"))
    own = lambda key, g: F.pmod(F.xxhash64(key), F.col(g)).cast("int")
    every = lambda g: F.explode(F.sequence(F.lit(0), F.col(g) - 1))
    x = left.join(sizes, on).withColumn("_i", own(left_key, "_gi")).withColumn("_j", every("_gj")).drop("_gi", "_gj")
    y = right.join(sizes, on).withColumn("_j", own(right_key, "_gj")).withColumn("_i", every("_gi")).drop("_gi", "_gj")
    # A cell's work is its product, not its bytes, so small cells are not put together.
    n, at = parts or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), [on, "_i", "_j"]
    return x.repartition(n, *at), y.repartition(n, *at), at


#: Documents whose postings are held at once.
BLOCK = 8192
#: The same for a join of a table with itself, where every document is sent to all blocks.
HELD = 32768


def _index(rows: list) -> tuple:
    """An inverted index of (key, terms, weights): terms, where their postings start and stop, owners and weights of postings, keys."""
    sizes = np.array([len(t) for _, t, _ in rows])
    term, w = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    order = np.argsort(term, kind="stable")
    term, owner = term[order], np.repeat(np.arange(len(rows)), sizes)[order]
    first = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    return term[first], first, np.append(first[1:], len(term)), owner, w[order], np.array([r[0] for r in rows])


def _hits(every: np.ndarray, starts: np.ndarray, stops: np.ndarray, t: np.ndarray) -> tuple:
    """Which terms of a row the index has, how many postings each of these has, and the postings."""
    place = np.minimum(np.searchsorted(every, t), len(every) - 1)
    hit = every[place] == t
    lo, n = starts[place[hit]], (stops - starts)[place[hit]]
    ends = np.cumsum(n)
    return hit, n, np.repeat(lo - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def _held_postings(threshold: float):
    """Rows come ordered by (block, part, kind): a block's documents (kind 0), which become an inverted index, and after them those that meet it."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held = None, [], None
        for b in batches:
            found: list[tuple] = []
            ends = b["terms"].offsets.to_numpy()
            terms, weights = b["terms"].values.to_numpy(), b["ws"].values.to_numpy()
            at = zip(*(b[c].to_pylist() for c in ("block", "part", "kind", "own", "key")), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            for block, part, kind, own, key, lo, hi in at:
                if (block, part) != group:
                    group, rows, held = (block, part), [], None
                t, w = terms[lo:hi], weights[lo:hi]
                if kind == 0:
                    rows.append((key, t, w))
                    continue
                if held is None:
                    if not rows:
                        continue
                    held, rows = _index(rows), []
                every, starts, stops, owner, ws, keys = held
                hit, n, postings = _hits(every, starts, stops, t)
                if not len(postings):
                    continue
                score = np.bincount(owner[postings], weights=ws[postings] * np.repeat(w[hit], n), minlength=len(keys))
                near = np.flatnonzero(score >= threshold)
                # Within a block a pair is met from both sides and counts once.
                near = near[keys[near] < key] if own == block else near
                found.append((np.minimum(keys[near], key), np.maximum(keys[near], key), score[near]))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run, "a long, b long, score double"


def cosine_join(weights: DataFrame, threshold: float, key: str = "doc_id") -> DataFrame:
    """(a, b, score) of all pairs a < b with cosine of at least threshold > 0, all found; key is a whole number.

    Documents are packed vectors (64-bit hashes of terms, weights). A block of them is held as an inverted index, and every document of the same
    and of later blocks meets it once: scores add up in an array, so no candidate pair is ever a row. A task holds a block and a batch.
    """
    spark = weights.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = weights.groupBy(F.col(key).cast("long").alias("key")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))).alias("v"))
    packed = once(spark)(packed.select("key", F.col("v.t").alias("terms"), F.col("v.w").alias("ws")))
    # The pairs of blocks are the tasks: enough for all shuffle partitions, and a document goes to blocks + 1 of them.
    blocks = max(-(-packed.count() // HELD), math.isqrt(2 * n))
    own = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    rows = packed.withColumn("own", own)
    # Block i is held for each later block j, which meets it as part j.
    held = rows.select(F.col("own").alias("block"), F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))).alias("part"), F.lit(0).alias("kind"), "own", "key", "terms", "ws")
    met = rows.select(F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"), F.col("own").alias("part"), F.lit(1).alias("kind"), "own", "key", "terms", "ws")
    run, schema = _held_postings(threshold)
    return held.unionByName(met).repartition(n, "block", "part").sortWithinPartitions("block", "part", "kind").mapInArrow(run, schema)


#: Documents whose words one task counts, about.
SLICE = 8192
#: Pairs that a task holds before it gives them on, about.
GIVEN = 1 << 18


def planes(numbers: np.ndarray) -> bytes:
    """Whole numbers of 32 bits, byte by byte of all of them, as most high bytes are zero and shrink to nothing."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def packed_sets(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Ids in order, as steps, and their counts."""
    return planes(np.concatenate((np.diff(ids, prepend=0), counts)))


def unpacked_sets(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = from_planes(packed)
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.int32), both[n:]


def cells(rows: DataFrame, blocks: int, block: str, *columns: str) -> DataFrame:
    """Each pair of blocks (0 to blocks - 1) as a task: (kind, same, columns) of the earlier block's rows (kind 0), then of the later one's (kind 1).

    same says that both are one block. A row goes to blocks + 1 tasks.
    """
    own = F.col(block)
    held = rows.withColumn("_other", F.explode(F.sequence(own, F.lit(blocks - 1)))).withColumn("kind", F.lit(0))
    met = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), own))).withColumn("kind", F.lit(1))
    late, early = F.greatest(own, "_other"), F.least(own, "_other")
    both = held.unionByName(met).select((late.cast("long") * (late + 1) / 2 + early).cast("int").alias("_cell"), "kind", (own == F.col("_other")).alias("same"), *columns)
    return both.repartitionById(blocks * (blocks + 1) // 2, "_cell").drop("_cell").sortWithinPartitions("kind")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _words_counted():
    """One slice of (slice, key, terms), terms with repeats: a row for each key with numbers of terms and their counts, and a row with the slice's terms and in how many keys each is."""
    out = pa.schema([("slice", pa.int32()), ("key", pa.int64()), ("ids", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32())), ("terms", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes, terms, at = [], [], [], None
        for b in batches:
            if b.num_rows:
                ends = b["terms"].offsets.to_numpy()
                keys.append(b["key"].to_numpy())
                sizes.append(np.diff(ends))
                terms.append(b["terms"].values.to_numpy()[ends[0] : ends[-1]])
                at = b["slice"][0].as_py()
        if at is None or not sum(map(len, terms)):
            return
        names, own = np.unique(np.concatenate(keys), return_inverse=True)
        every, term = np.unique(np.concatenate(terms), return_inverse=True)
        # Rows of one key are one document.
        pair, tf = np.unique(np.repeat(own, np.concatenate(sizes)) * len(every) + term, return_counts=True)
        own, term = np.divmod(pair, len(every))
        key, first = np.unique(own, return_index=True)
        listed = lambda values, kind: pa.ListArray.from_arrays(pa.array(np.append(first, len(own)), pa.int32()), pa.array(values, kind))
        docs = [pa.array(np.full(len(key), at), pa.int32()), pa.array(names[key]), listed(term, pa.int32()), listed(tf, pa.int32()), pa.nulls(len(key), pa.list_(pa.int64()))]
        yield from pa.Table.from_arrays(docs, schema=out).to_batches(max_chunksize=1024)
        yield pa.RecordBatch.from_pylist([{"slice": at, "tfs": np.bincount(term, minlength=len(every)), "terms": every}], schema=out)

    return run, "slice int, key long, ids array<int>, tfs array<int>, terms array<long>"


def _named(blocks: int, firsts: np.ndarray, idfs: np.ndarray, single: float):
    """The keys of a slice with the numbers that terms have in the whole table: those that other keys have too, packed, and the norm over all terms."""
    out = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("norm", pa.float64()), ("v", pa.binary())])

    def run(docs: pa.Table, names: pa.Table) -> pa.Table:
        found = []
        known = np.zeros(1 + max((c.values.to_numpy().max() for c in docs["ids"].chunks if len(c.values)), default=0), np.int64)
        for pos, number in zip(names["pos"].chunks, names["id"].chunks, strict=True):
            known[pos.flatten().to_numpy()] = number.flatten().to_numpy()
        idf = np.where(known > 0, np.append(idfs, single)[np.searchsorted(firsts, known, "right") - 1], single)
        block = (docs["slice"][0].as_py() if len(docs) else 0) % blocks
        for key, ids, tfs in zip(docs["key"].to_pylist(), docs["ids"], docs["tfs"], strict=True):
            t, tf = ids.values.to_numpy(), tfs.values.to_numpy()
            x = tf * idf[t]
            shared = known[t] > 0
            order = np.argsort(known[t][shared])
            found.append((block, key, float(np.sqrt((x * x).sum())), packed_sets(known[t][shared][order], tf[shared][order])))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True) if found else [[]] * 4, out, strict=True)], schema=out)

    return run, "block int, key long, norm double, v binary"


def _held_prefixes(threshold: float, firsts: np.ndarray, idfs: np.ndarray):
    """Rows of cells: the held block's documents, of which the rarest terms are indexed, and those that meet it with all their terms.

    Terms are numbered from the rarest on. What follows a held document's indexed terms has a norm below the threshold; that norm by the norm of what the other
    one has from there on bounds what is missing, and only scores that may still reach the threshold are completed.
    """
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])
    # The bounds are rounded, so they have a margin.
    least = threshold - 1e-6

    def weighed(norm: float, packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, tf = unpacked_sets(packed)
        w = tf * idfs[np.searchsorted(firsts, ids, "right") - 1] / norm
        return ids, w, np.append(np.sqrt(np.cumsum((w * w)[::-1])[::-1]), 0.0)

    def index(rows: list) -> tuple:
        keys, n, rest = np.array([r[0] for r in rows]), np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        sizes = np.array([len(r[1]) for r in rows])
        ids, w = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
        every, local = np.unique(ids, return_inverse=True)
        local, first = local.astype(np.int32), np.cumsum(sizes) - sizes
        head, tail = ranges(first, n), ranges(first + n, sizes - n)
        order = np.argsort(local[head], kind="stable")
        starts = np.searchsorted(local[head][order], np.arange(len(every) + 1))
        owner, ws = np.repeat(np.arange(len(rows)), n)[order], w[head][order]
        after = np.append(ids, 0)[np.minimum(first + n, len(ids))]
        return keys, every, starts, owner, ws, rest, after, np.cumsum(sizes - n) - (sizes - n), sizes - n, local[tail], w[tail], np.zeros(len(every))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, found, many = [], None, [], 0
        for b in batches:
            for kind, same, key, norm, v in zip(*(b[c].to_pylist() for c in ("kind", "same", "key", "norm", "v")), strict=True):
                ids, w, rest = weighed(norm, v)
                n = int((rest >= least).sum())
                if not n:
                    continue
                if kind == 0:
                    rows.append((key, ids, w, n, float(rest[n])))
                    continue
                if held is None:
                    if not rows:
                        return
                    held, rows = index(rows), []
                keys, every, starts, owner, ws, rests, after, first, sizes, terms, weights, dense = held
                place = np.minimum(np.searchsorted(every, ids), len(every) - 1)
                hit = every[place] == ids
                place, mine = place[hit], w[hit]
                counts = starts[place + 1] - starts[place]
                postings = ranges(starts[place], counts)
                score = np.bincount(owner[postings], weights=ws[postings] * np.repeat(mine, counts), minlength=len(keys))
                near = np.flatnonzero(score + rests >= least)
                # Within a block a pair is met from both sides and counts once.
                near = near[keys[near] < key] if same else near
                near = near[score[near] + rests[near] * rest[np.searchsorted(ids, after[near])] >= least]
                if not len(near):
                    continue
                dense[place] = mine
                at = ranges(first[near], sizes[near])
                score = score[near] + np.bincount(np.repeat(np.arange(len(near)), sizes[near]), weights=dense[terms[at]] * weights[at], minlength=len(near))
                dense[place] = 0
                near, score = near[score >= threshold], score[score >= threshold]
                found.append((np.minimum(keys[near], key), np.maximum(keys[near], key), score))
                many += len(near)
                if many > GIVEN:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)
                    found, many = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    return run, "a long, b long, score double"


def tfidf_join(docs: DataFrame, tokens: Column, threshold: float, key: str = "doc_id") -> DataFrame:
    """cosine_join of the tfidf of docs, all pairs found, with few bytes for each document; key is a whole number.

    A text moves once, to its slice, where its words are counted; after that only numbers of terms and counts move, in blocks of HELD documents. Terms are
    numbered over the whole table, the rarest first, so what a number weighs is a short list, one entry for each document frequency. Terms of one document
    count for its norm alone.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.where(F.col(key).isNotNull()).withColumn("key", F.col(key).cast("long"))
    total = docs.select("key").distinct().count()
    blocks = max(1, -(-total // HELD), math.isqrt(2 * n))
    slices = blocks * -(-max(n, -(-total // SLICE)) // blocks)
    dealt = docs.withColumn("slice", F.pmod(F.xxhash64("key"), F.lit(slices)).cast("int")).repartitionById(slices, "slice")
    run, schema = _words_counted()
    counted = once(spark)(dealt.select("slice", "key", F.transform(tokens, lambda t: F.xxhash64(t)).alias("terms")).mapInArrow(run, schema))
    words = counted.where("terms IS NOT NULL").select("slice", F.posexplode(F.arrays_zip("terms", "tfs")).alias("pos", "t")).select("slice", "pos", "t.terms", "t.tfs")
    often = words.groupBy("terms").agg(F.sum("tfs").alias("df")).where("df > 1")
    ids = numbered(often, "id", "df", "terms")
    # One row for each document frequency, at most about the square root of twice the number of words.
    idf = F.log((1 + F.lit(total)) / (1 + F.col("df"))) + 1
    steps = ids.groupBy("df").agg(F.min("id").alias("id")).select("id", idf.alias("idf")).orderBy("id").collect()
    firsts, idfs = np.array([r["id"] for r in steps], np.int64), np.array([r["idf"] for r in steps], np.float64)
    known = words.join(ids.select("terms", F.col("id").cast("int").alias("id")), "terms").groupBy("slice").agg(F.collect_list(F.struct("pos", "id")).alias("d")).select(F.col("slice").alias("at"), "d.pos", "d.id")
    run, schema = _named(blocks, firsts, idfs, math.log((1 + total) / 2) + 1)
    packed = once(spark)(counted.where("terms IS NULL").select("slice", "key", "ids", "tfs").groupBy("slice").cogroup(known.groupBy("at")).applyInArrow(run, schema))
    run, schema = _held_prefixes(threshold, firsts, idfs)
    return cells(packed, blocks, "block", "key", "norm", "v").mapInArrow(run, schema)


#: Stands for a null key while pairs are looked for.
_NO_KEY = -(2**63)


def _meet_held(how: str, least: float, shared: int):
    """Rows come ordered by (block, part, kind): a block of one side (kind 0), held as an inverted index, and after it rows of the other side that meet it.

    how is dot (sums of products from least on), sets (Jaccard from least on, at least shared common terms) or bags (sums of the lesser counts above 1).
    """
    out = pa.schema([("h", pa.int64()), ("m", pa.int64()), ("score", pa.float64()), ("nh", pa.int64()), ("nm", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows, held, sizes = None, [], None, np.zeros(0)
        for b in batches:
            found: list[tuple] = []
            ends, terms = b["terms"].offsets.to_numpy(), b["terms"].values.to_numpy()
            weights = b["ws"].values.to_numpy() if how == "dot" else None
            at = zip(*(b[c].to_pylist() for c in ("block", "part", "kind", "key")), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            for block, part, kind, key, lo, hi in at:
                if (block, part) != group:
                    group, rows, held = (block, part), [], None
                t = terms[lo:hi]
                if how == "bags":
                    t, w = np.unique(t, return_counts=True)
                else:
                    w = weights[lo:hi] if how == "dot" else np.ones(hi - lo)
                if kind == 0:
                    if len(t):
                        rows.append((key, t, w))
                    continue
                if held is None:
                    if not rows:
                        continue
                    held, sizes, rows = _index(rows), np.array([len(r[1]) for r in rows]), []
                every, starts, stops, owner, ws, keys = held
                hit, n, postings = _hits(every, starts, stops, t)
                if not len(postings):
                    continue
                theirs = np.repeat(w[hit], n)
                each = {"dot": lambda: ws[postings] * theirs, "sets": lambda: None, "bags": lambda: np.minimum(ws[postings], theirs)}[how]()
                score = np.bincount(owner[postings], weights=each, minlength=len(keys))
                if how == "sets":
                    near = np.flatnonzero((score >= shared) & (score / (sizes + len(t) - score) >= least))
                else:
                    near = np.flatnonzero(score >= least if how == "dot" else score > 1)
                found.append((keys[near], np.full(len(near), key), score[near], sizes[near], np.full(len(near), len(t))))
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return run, "h long, m long, score double, nh long, nm long"


def _between(left: DataFrame, right: DataFrame, how: str, least: float = 0.0, shared: int = 1, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, score, na, nb) of two sides (key, terms, and ws for dot) that share a term; keys are whole numbers.

    The smaller side is held in blocks as inverted indexes, and every row of the other side meets each block once: scores add up in an array,
    so no candidate pair is ever a row. The price is the larger side once for each block. sizes are the numbers of rows, where the caller knows them.
    """
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nl, nr = sizes or (left.count(), right.count())
    swap = nr < nl
    blocks = max(1, -(-min(nl, nr) // BLOCK))
    parts = max(1, n // blocks)
    key = F.coalesce(F.col("key").cast("long"), F.lit(_NO_KEY))
    deal = lambda k, salt: F.pmod(F.xxhash64("key", "terms", F.lit(salt)), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rest = ["terms", "ws"] if how == "dot" else ["terms"]
    side = lambda df, block, part, kind: df.select(block.alias("block"), key.alias("key"), *rest).select("*", part.alias("part"), F.lit(kind).alias("kind"))
    held = side(right if swap else left, deal(blocks, 0), every(parts), 0)
    met = side(left if swap else right, every(blocks), deal(parts, 7), 1)
    run, schema = _meet_held(how, least, shared)
    dealt = held.unionByName(met).repartition(n, "block", "part").sortWithinPartitions("block", "part", "kind")
    h, m = ("b", "a") if swap else ("a", "b")
    found = dealt.mapInArrow(run, schema).toDF(h, m, "score", f"n{h}", f"n{m}")
    known = lambda c: F.nullif(F.col(c), F.lit(_NO_KEY)).alias(c)
    return found.select(known("a"), known("b"), "score", "na", "nb")


def cosine_between(left: DataFrame, right: DataFrame, threshold: float, left_key: str, right_key: str, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Pairs of two sides of (key, term, w) that share a term, from the threshold > 0 on."""
    pack = lambda df, k: df.groupBy(F.col(k).alias("key")).agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), F.col("w").cast("double").alias("w"))).alias("v")).select("key", F.col("v.t").alias("terms"), F.col("v.w").alias("ws"))
    return _between(pack(left, left_key), pack(right, right_key), "dot", threshold, sizes=sizes).select("a", "b", "score")


def top_k(scored: DataFrame, k: int, by: str = "a", score: str = "score", tie: str = "b") -> DataFrame:
    """The k best rows of each group; ties go to the smaller tie column."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), tie))).where(F.col("rank") <= k)


# ---- token sets ----------------------------------------------------------------------------------------
def token_sets(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, terms): the distinct words of each row as 64-bit hashes."""
    return df.select(F.col(key).alias("key"), F.transform(F.array_distinct(tokens), lambda w: F.xxhash64(w)).alias("terms"))


def token_bags(df: DataFrame, tokens: Column, key: str) -> DataFrame:
    """(key, terms): all words of each key as 64-bit hashes."""
    words = df.select(F.col(key).alias("key"), F.transform(tokens, lambda w: F.xxhash64(w)).alias("terms"))
    return words.groupBy("key").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def overlap_join(left: DataFrame, right: DataFrame, shared: int = 1, least: float = 0.0, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, shared, na, nb) of all pairs of token_sets with at least shared > 0 common words and a Jaccard of at least least."""
    return _between(left, right, "sets", least, shared, sizes).select("a", "b", F.col("score").cast("long").alias("shared"), F.col("na").cast("int").alias("na"), F.col("nb").cast("int").alias("nb"))


def jaccard_join(left: DataFrame, right: DataFrame, threshold: float, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Pairs with a token Jaccard of at least threshold > 0."""
    return overlap_join(left, right, 1, threshold, sizes).withColumn("score", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))


def multiset_overlap(left: DataFrame, right: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """(a, b, score) with the sum of the lesser counts of each shared word, above 1, from token_bags."""
    return _between(left, right, "bags", sizes=sizes).select("a", "b", F.col("score").cast("long").alias("score"))


# ---- pairs ----------------------------------------------------------------------------------------------
def directed_pairs(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """P25: each pair in both directions; columns are names that exist as a_ and b_."""
    side = lambda p, q: F.struct(*[F.col(f"{p}_{c}").alias(f"enabling_{c}") for c in columns], *[F.col(f"{q}_{c}").alias(f"dependent_{c}") for c in columns])
    rest = [c for c in pairs.columns if c not in {f"{s}_{n}" for s in "ab" for n in columns}]
    both = F.array(F.struct(F.lit("A->B").alias("direction"), side("a", "b").alias("s")), F.struct(F.lit("B->A").alias("direction"), side("b", "a").alias("s")))
    return pairs.select(*rest, F.explode(both).alias("d")).select(*rest, "d.direction", "d.s.*")


def candidate_pairs(left: DataFrame, right: DataFrame, source: str = "source", name: str = "name") -> DataFrame:
    """Pairs of different sources and components that share a name token; columns get a_ and b_.

    Scores of pairs without a common token are not of interest, so the product is never built. Tokens are ordered, the most frequent first, and a pair
    comes from the first token that it shares, so pairs are neither shuffled nor held.
    """
    pre = lambda df, p: df.distinct().select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    tokens = lambda df: df.select(F.explode(F.array_distinct(X.tfidf_tokens(F.col(name)))).alias("token"))
    often = tokens(left).unionByName(tokens(right)).groupBy("token").agg(F.count("*").alias("n"))

    def side(df: DataFrame, p: str) -> DataFrame:
        # Sources that are the same by either rule have the same key.
        keys = {f"_{p}": F.xxhash64(*[f"{p}_{c}" for c in df.columns]), f"_source_{p}": X.source_key(F.col(f"{p}_{source}")), f"_name_{p}": F.lower(F.trim(X.blank(F.col(f"{p}_{name}"))))}
        rows = pre(df, p).withColumns(keys)
        each = rows.select("*", F.explode(F.array_distinct(X.tfidf_tokens(F.col(f"{p}_{name}")))).alias("token")).join(often, "token")
        ranked = each.groupBy(*rows.columns).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "token"))).alias("ts"))
        listed = ranked.select(*rows.columns, F.col("ts.token").alias("ts"))
        return listed.select(*rows.columns, F.posexplode("ts").alias("at", "token"), "ts").withColumn(f"_before_{p}", F.slice("ts", 1, F.col("at"))).drop("ts", "at")

    new = (F.size("_before_a") == 0) | (F.size("_before_b") == 0) | ~F.arrays_overlap("_before_a", "_before_b")
    x, y, at = _in_cells(side(left, "a"), side(right, "b"), "token", "_a", "_b")
    # The pairs of a cell come by the left source and by runs of the right side, the same run for each left row, so that a file of them is small.
    packed = lambda df, p, by: df.groupBy(*at, by).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in at])).alias(f"_{p}s")).drop(by)
    run = F.pmod(F.xxhash64("_b", F.lit(7)), F.lit(max(1, CELL // RUN)))
    both = packed(x.withColumn("_by", F.col("_source_a")), "a", "_by").join(packed(y.withColumn("_by", run), "b", "_by"), at)
    met = both.select("_bs", F.inline("_as")).select("*", F.inline("_bs")).drop("_bs").where(new)
    met = met.where("_source_a != _source_b and _name_a != _name_b")
    return met.select(*[f"a_{c}" for c in left.columns], *[f"b_{c}" for c in right.columns])


def unordered_pairs(df: DataFrame, key: str, on: list[str]) -> DataFrame:
    """Pairs i < j of the rows that agree on the blocking columns, with A_ and B_ columns."""
    side = lambda p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    cond = F.col(f"A_{key}") < F.col(f"B_{key}")
    for c in on:
        cond &= F.col(f"A_{c}") == F.col(f"B_{c}")
    return side("A").join(side("B"), cond)


def block_keys(source: Column, component: Column) -> Column:
    """Three cheap keys of a normalised (source, component)."""
    head = lambda c, n: F.left(c, F.lit(n))
    first = lambda c: F.element_at(F.split(c, " "), 1)
    return F.array_distinct(F.array(*[F.concat_ws("|", F.lit(str(i)), f(component), f(source)) for i, f in enumerate((lambda c: head(c, 12), first, lambda c: head(c, 5)))]))


# ---- lookups ----------------------------------------------------------------------------------------------
def last_value(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of the last row of each key; earlier rows lose."""
    return df.where(X.usable(F.col(value)).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def backfill(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Blank values are filled from another row of the same key."""
    known = last_value(df, key, value, order).withColumnRenamed(value, "_known")
    return df.join(known, key, "left").withColumn(value, F.coalesce(X.usable(F.col(value)), F.col("_known"))).drop("_known")


def by_priority(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first table that has the key."""
    tagged = [df.withColumn("_priority", F.lit(i)) for i, df in enumerate(sources)]
    both = tagged[0]
    for df in tagged[1:]:
        both = both.unionByName(df, allowMissingColumns=True)
    rank = F.row_number().over(W.partitionBy(key).orderBy("_priority"))
    return both.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_priority")


def denormalise(alignments: DataFrame, components: DataFrame, sources: DataFrame) -> DataFrame:
    """Alignments with both components and both sources, role by role."""
    out = alignments
    for role in ("enabling", "dependent"):
        c = components.select(*[F.col(x).alias(f"{role}_{x}") for x in components.columns])
        s = sources.select(*[F.col(x).alias(f"{role}_{x}") for x in sources.columns if x != "source_id"], F.col("source_id").alias(f"{role}_source_id"))
        out = out.join(c, f"{role}_component_id", "left").join(s, f"{role}_source_id", "left")
    return out
