"""Near-duplicate documents by a multi-index Hamming join over MinHash signatures.

A document's set holds its distinct word shingles. Equal sets are one node, known by a hash of the set; ids play no part until components
are reported. A node's signature has ``K`` values of 16 bits (from the minima of K hash functions); two sets of similarity s
differ in about (1 - s) K of them. The positions are split in ``M`` chunks; of two signatures that differ in at
most ``FAR`` = 2 M - 1 positions, some chunk differs in at most one (pigeonhole), so they share a key among the chunk's variants
with one position left out. Every pair up to that distance is found, and nothing but the sizes of the sets, which
bound the similarity, and the distance itself, read from two bits of each position, drops a pair before its full sets are
compared. With K = 64 and M = 16 a pair of similarity 0.8 lies beyond distance 31 with probability 0.0000001.

Rows of a key are streamed in key order from range partitions, so a frequent key spans tasks. Short runs
give their pairs; long runs
give one star, and their rows are kept. Pairs are confirmed on the full sets, components are found by
alternating large-star and small-star steps, and then the kept rows of keys that still hold several
components are taken up again: what is outside a key's largest component is held, in blocks of sets, against
all of the key's rows. So no pair inside a component is ever needed, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import NULL_ID, U64, batch, lean, materialize, mix, public_id, row_id, shingle_sets, slices

K, M = 64, 16
#: The distance up to which all pairs are found.
FAR = 2 * M - 1
#: Columns of a signature's visible bits.
_BITS = ("b0", "b1")
_BITS_DDL = ", ".join(f"{c} long" for c in _BITS)
#: Runs of up to so many rows give all their pairs.
SHORT = 12
#: So many sets, about, are held at once against other rows of their keys.
BLOCK = 4096
#: Rows of a key meet in cells of about so many by so many rows.
CELL = 2000
#: Links of a part while components are sought.
EDGES = 4096
_rng = np.random.default_rng(41)
_MUL = _rng.integers(1, 2**63, K, dtype=np.uint64) * U64(2) + U64(1)
_ADD = _rng.integers(1, 2**63, K, dtype=np.uint64)
_CHUNKS = np.array_split(np.arange(K), M)
_EMPTY = np.iinfo(np.uint16).max


def signatures(sh: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(n, K) values of 16 bits of the minima; rows without shingles have the largest value everywhere."""
    n = len(off) - 1
    sig = np.full((n, K), _EMPTY, np.uint16)
    full = np.flatnonzero(off[1:] > off[:-1])
    if len(full):
        at = off[:-1][full]
        for k in range(K):
            sig[full, k] = (np.minimum.reduceat((sh ^ _ADD[k]) * _MUL[k], at) >> U64(24)).astype(np.uint16)
    return sig


def _sets(width: int):
    out = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("sig", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(*at) for at in slices(whole["text"])):
                sh, off = shingle_sets(b["text"], width)
                sums = []
                for c in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
                    x = np.zeros(len(sh) + 1, U64)
                    np.cumsum(mix(sh ^ U64(c)), out=x[1:])
                    sums.append((x[off[1:]] - x[off[:-1]]).view(np.int64))
                sig = signatures(sh, off)
                yield batch(out, did=b["did"], th=b["th"], n=np.diff(off), s1=sums[0], s2=sums[1], sig=[r.tobytes() for r in sig])

    return run, "did long, th long, n long, s1 long, s2 long, sig binary"


_KEYS = pa.schema([("key", pa.int64()), ("did", pa.int64()), ("n", pa.int32()), *[(c, pa.int64()) for c in _BITS]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """K rows a node: for each chunk, each variant with one position left out, which the last six bits of the key tell."""
    for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows, 1024)):
        sig = np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, K)
        terms = mix(sig.astype(U64) + (np.arange(1, K + 1, dtype=np.uint64) << U64(32)))
        seen = {c: np.repeat(x, K) for c, x in visible(sig).items()}
        keys = np.empty((len(sig), K), U64)
        for c, at in enumerate(_CHUNKS):
            total = terms[:, at].sum(axis=1, dtype=U64)
            for k in at:
                keys[:, k] = mix(total - terms[:, k] + U64(((int(k) + 1) * 0xC2B2AE3D27D4EB4F + c) & (2**64 - 1))) & U64(2**64 - K) | U64(k)
        did, n = b["did"].to_numpy(), b["n"].to_numpy().astype(np.int32)
        yield batch(_KEYS, key=keys.ravel().view(np.int64), did=np.repeat(did, K), n=np.repeat(n, K), **seen)


def visible(sig: np.ndarray) -> dict[str, np.ndarray]:
    """Two bits of each position, of 32 positions as one 64-bit integer each."""
    own = (sig & np.uint16(3)).astype(U64).reshape(len(sig), len(_BITS), 32) << (np.arange(32, dtype=np.uint64) * U64(2))
    both = np.bitwise_or.reduce(own, axis=2).view(np.int64)
    return {c: both[:, i] for i, c in enumerate(_BITS)}


def _alike(a: dict, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sizes allow the similarity and the positions that show a difference are at most FAR; never false for a pair that has both."""
    n1, n2 = a["n"][i].astype(np.int64), a["n"][j].astype(np.int64)
    ok = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    apart = np.zeros(len(i), np.int64)
    for c in _BITS:
        x = a[c][i].view(U64) ^ a[c][j].view(U64)
        apart += np.bitwise_count((x | (x >> U64(1))) & U64(0x5555555555555555))
    return ok & (apart <= FAR)


def _first_shared(sig: np.ndarray, i: np.ndarray, j: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """Whether two signatures are at most FAR apart and the key with position left_out is the first that they share."""
    ok = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        some = slice(at, at + (1 << 14))
        same = (sig[i[some]] == sig[j[some]]).reshape(-1, M, K // M)
        shared = (same.sum(axis=2, keepdims=True, dtype=np.int8) - same == K // M - 1).reshape(-1, K)
        first = np.where(shared.any(axis=1), shared.argmax(axis=1), -1)
        ok[some] = (first == left_out[some]) & (np.count_nonzero(same.reshape(-1, K), axis=1) >= K - FAR)
    return ok


def _runs(percent: int):
    """Streams rows ordered by (key, did). kind 0: a candidate pair (did, other); kind 1: a row of a long or cut run."""
    out = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("did", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), *[(c, pa.int64()) for c in _BITS]])
    names = ("key", "did", "n", *_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the rows of the last run so far; of a long one only the first row
        last_long, first_key = False, None

        def pairs(i, j, a):
            ok = _alike(a, i, j, percent) & (a["did"][i] != a["did"][j])
            i, j = i[ok], j[ok]
            z = len(i)
            return batch(out, kind=np.zeros(z, np.int32), key=np.zeros(z, np.int64), did=a["did"][i], other=a["did"][j], n=np.zeros(z, np.int32), **{c: np.zeros(z, np.int64) for c in _BITS})

        def kept(i, a):
            z = len(i)
            return batch(out, kind=np.ones(z, np.int32), key=a["key"][i], did=a["did"][i], other=np.zeros(z, np.int64), n=a["n"][i], **{c: a[c][i] for c in _BITS})

        def settle(a, starts, sizes, long_first: bool, cut):
            """All pairs of short runs; for long ones the star, and their rows."""
            order = np.arange(len(a["key"]))
            run_no = np.repeat(np.arange(len(starts)), sizes)
            is_long = sizes > SHORT
            if long_first:
                is_long[0] = True
            short_rows = ~is_long[run_no]
            for d in range(1, SHORT):
                i = order[:-d][(run_no[:-d] == run_no[d:]) & short_rows[:-d]]
                if not len(i):
                    break
                yield pairs(i, i + d, a)
            i = order[~short_rows & (order != starts[run_no])]
            if len(i):
                yield pairs(starts[run_no][i], i, a)
            keep = is_long | cut
            keep &= sizes > 0
            rows = order[keep[run_no]]
            if long_first:
                rows = rows[rows != 0]  # it has been kept before
            if len(rows):
                yield kept(rows, a)

        for b in batches:
            if not b.num_rows:
                continue
            a = {c: b[c].to_numpy() for c in names}
            if rest is not None:
                a = {c: np.concatenate((rest[c], a[c])) for c in names}
            key = a["key"]
            if first_key is None:
                first_key = key[0]
            starts = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1))
            sizes = np.diff(np.concatenate((starts, [len(key)])))
            tail = starts[-1]
            if len(starts) > 1:
                head = {c: a[c][:tail] for c in names}
                yield from settle(head, starts[:-1], sizes[:-1], last_long, head["key"][starts[:-1]] == first_key)
                a, last_long = {c: a[c][tail:] for c in names}, False
            if len(a["key"]) > 4096:
                yield from settle(a, np.array([0]), np.array([len(a["key"])]), last_long, np.array([True]))
                a, last_long = {c: a[c][:1] for c in names}, True
            rest = a
        if rest is not None:
            yield from settle(rest, np.array([0]), np.array([len(rest["key"])]), last_long, np.array([True]))

    return run, f"kind int, key long, did long, other long, n int, {_BITS_DDL}"


def _set_bytes(width: int):
    out = pa.schema([("did", pa.int64()), ("body", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(*at) for at in slices(whole["text"])):
                sh, off = shingle_sets(b["text"], width)
                yield batch(out, did=b["did"], body=[sh[i:j].tobytes() for i, j in zip(off[:-1], off[1:], strict=True)])

    return run, "did long, body binary"


def _confirm(percent: int):
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            left, right = [], []
            for a, b, x, y in zip(r["a"].to_pylist(), r["b"].to_pylist(), r["x"], r["y"], strict=True):
                x, y = (np.frombuffer(t.as_buffer(), U64) for t in (x, y))
                both = np.sort(np.concatenate((x, y)))
                both = int(np.count_nonzero(both[1:] == both[:-1]))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    left.append(a)
                    right.append(b)
            yield batch(out, a=left, b=right)

    return run, "a long, b long"


def _against_block(percent: int):
    """Rows come ordered by (block, salt, kind). kind 0: a block's sets, some hundreds; kind 1: sets to hold against all of them."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets, table = None, [], [], None
        for r in batches:
            left, right = [], []
            for g, kind, did, body in zip(zip(r["block"].to_pylist(), r["salt"].to_pylist(), strict=True), r["kind"].to_pylist(), r["did"].to_pylist(), r["body"], strict=True):
                if g != group:
                    group, ids, sets, table = g, [], [], None
                own = np.frombuffer(body.as_buffer(), U64)
                if kind == 0:
                    ids.append(did)
                    sets.append(own)
                    continue
                if table is None:
                    sizes = np.array([len(x) for x in sets])
                    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                    order = np.argsort(flat, kind="stable")
                    table = flat[order], owner[order], sizes, np.array(ids)
                flat, owner, sizes, names = table
                lo, hi = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
                n = hi - lo
                at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                both = np.bincount(owner[at], minlength=len(sizes))
                for other in names[(100 * both >= percent * (sizes + len(own) - both)) & (names != did)].tolist():
                    left.append(min(did, other))
                    right.append(max(did, other))
            yield batch(out, a=left, b=right)

    return run, "a long, b long"


def components(links: DataFrame) -> DataFrame:
    """(id, component): for each id in links (a, b) the smallest id reachable. Alternates large-star and small-star steps.

    Neither step makes more rows than its links have ends. Links are read and stored in parts of about EDGES, as far as there are
    partitions, so that few links do not cost a file and a task for each shuffle partition in each round.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())

    def with_least(e: DataFrame) -> DataFrame:
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return e.join(low, "u")

    def both(e: DataFrame, *ends: tuple[str, str]) -> DataFrame:
        return e.select(F.explode(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ends])).alias("e")).select("e.*")

    def stars(e: DataFrame) -> DataFrame:
        large = with_least(both(e, ("u", "v"), ("v", "u"))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return both(with_least(large), ("v", "m"), ("u", "m")).where("u != v").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(edges)
    while True:
        parts = 2 + seen[0] // EDGES
        edges = materialize(stars(edges.coalesce(parts)).coalesce(parts))
        now = mark(edges)
        if now == seen:
            return both(edges, ("u", "v"), ("v", "v")).distinct().select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: sets of word shingles, linked from percent / 100 of the union on.

    A null or empty text and one without words has an empty set and is linked with nothing; a text with fewer
    words than width has one shingle. Rows that repeat an id are one document and lie in one component; rows with a null
    id are documents of their own. A component is named by its smallest id and keeps that id's rows; one without any id
    has a null name and keeps one row. Other columns are not read.
    """
    rows = classes_of_rows(docs, id_col, text_col, width, percent)
    return rows.select(public_id("did").alias(id_col), F.col("n").alias("n_shingles"), public_id("component").alias("component_id"), "kept")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that near_duplicates keeps."""
    rows = materialize(classes_of_rows(docs, id_col, text_col, width, percent))
    gone = rows.groupBy("did", "th").agg(F.max("kept").alias("kept"), F.max("n").alias("n"), F.count("*").alias("z"))
    # A kept row without an id may have exact copies that go.
    again = gone.where((F.col("did") == F.lit(NULL_ID)) & F.col("kept") & (F.col("n") > 0) & (F.col("z") > 1)).select("th")
    keyed = docs.withColumns({"_cl_id": row_id(id_col), "_cl_th": F.xxhash64(F.col(text_col).cast("string"))})
    left = keyed.join(gone.where("not kept").select(F.col("did").alias("_cl_id"), F.col("th").alias("_cl_th")), ["_cl_id", "_cl_th"], "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    several = (F.col("_cl_id") == F.lit(NULL_ID)) & F.col("_cl_again").isNotNull()
    left = left.join(again.select(F.col("th").alias("_cl_th"), F.lit(True).alias("_cl_again")), "_cl_th", "left")
    return left.where(~several).unionByName(left.where(several).dropDuplicates(["_cl_th"])).select(*docs.columns)


def classes_of_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(did, th, n, component, kept) for every row, th the hash of its text."""
    spark = docs.sparkSession
    n_out = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col).cast("string")
    source = docs.select(row_id(id_col).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    sets, schema = _sets(width)
    sets = source.mapInArrow(lean(sets), schema).withColumn("node", F.when(F.col("n") > 0, F.xxhash64("s1", "s2", "n")))
    sets = materialize(sets.withColumn("row", F.monotonically_increasing_id()))
    full = sets.where("n > 0")
    real = F.when(F.col("did") != F.lit(NULL_ID), F.col("did"))
    nodes = full.groupBy("node", "n").agg(F.min(F.struct("did", "th")).alias("rep"), F.min_by("sig", "did").alias("sig"), F.min(real).alias("least"))
    nodes = materialize(nodes)
    # Below this size another set cannot be similar enough.
    least = next(k for k in range(1, 10_000) if 100 * k >= percent * (k + 1)) if percent < 100 else 1 << 30
    order = ["key", "did"]
    rows = nodes.where(F.col("n") >= least).select(F.col("node").alias("did"), "n", "sig").mapInArrow(lean(_keys), f"key long, did long, n int, {_BITS_DDL}")
    stream, schema = _runs(percent)
    found = materialize(rows.repartitionByRange(n_out, *order).sortWithinPartitions(*order).mapInArrow(lean(stream), schema))
    pairs = found.where("kind = 0").select(F.least("did", "other").alias("a"), F.greatest("did", "other").alias("b")).distinct()
    long_rows = found.where("kind = 1").select("key", "did", "n", *_BITS)
    asked = pairs.select(F.col("a").alias("did")).unionByName(pairs.select(F.col("b").alias("did"))).unionByName(long_rows.select("did")).distinct()
    bodies, schema = _set_bytes(width)
    # Each node's set is made again from one row, which copies under the same id repeat.
    asked = nodes.join(asked.withColumnRenamed("did", "node"), "node", "left_semi").select(F.col("rep.did").alias("did"), F.col("rep.th").alias("th"), "node")
    bodies = source.join(asked, ["did", "th"]).select(F.col("node").alias("did"), "text").mapInArrow(lean(bodies), schema)
    bodies = materialize(bodies.groupBy("did").agg(F.min("body").alias("body")) if _repeats(sets) else bodies)
    check, schema = _confirm(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        x, y = bodies.select(F.col("did").alias("a"), F.col("body").alias("x")), bodies.select(F.col("did").alias("b"), F.col("body").alias("y"))
        return materialize(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(lean(check), schema))

    links = confirmed(pairs)
    one = sets.where(F.col("did") != F.lit(NULL_ID)).groupBy("did").agg(F.min("node").alias("first"), F.count("*").alias("z")).where("z > 1 and first is not null")
    one = materialize(one.select("did", "first"))
    repeated = not one.isEmpty()
    if repeated:
        links = links.unionByName(full.join(one, "did").select(F.col("node").alias("a"), F.col("first").alias("b")).where("a != b").distinct())
    classes = components(links)
    # A row of a key that two tasks share is counted once.
    long_rows = materialize(long_rows.distinct())
    placed = long_rows.join(classes.withColumnRenamed("id", "did"), "did", "left").withColumn("component", F.coalesce("component", "did"))
    more = _across(placed, bodies, percent, n_out, nodes.select(F.col("node").alias("did"), "sig"))
    if more is not None:
        classes = components(classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more))
    placed = materialize(nodes.select("node", "least").join(classes.withColumnRenamed("id", "node"), "node", "left"))
    linked = placed.where("component is not null").select("node", "least", F.col("component").alias("class"))
    named = linked.groupBy("class").agg(F.min("least").alias("named"))
    linked = _spread_join(linked, named, "class", by="node").select("node", "class", "named")
    placed = materialize(linked.unionByName(placed.where("component is null").select("node", F.col("node").alias("class"), F.col("least").alias("named"))))
    if repeated:
        sets = sets.join(one, "did", "left").withColumn("node", F.coalesce("first", "node"))
    out = sets.select("did", "th", "n", "row", "node").join(placed, "node", "left")
    nameless = out.where("class is not null and named is null")
    component = F.when(F.col("class").isNull(), F.col("did")).otherwise(F.coalesce("named", F.lit(NULL_ID)))
    if placed.where("named is null").isEmpty():
        return out.select("did", "th", "n", component.alias("component"), (F.col("did") == component).alias("kept"))
    stays = nameless.groupBy("class").agg(F.min("row").alias("stays"))
    kept = F.when(F.col("class").isNull() | F.col("named").isNotNull(), F.col("did") == component).otherwise(F.col("row") == F.col("stays"))
    return out.join(stays, "class", "left").select("did", "th", "n", component.alias("component"), kept.alias("kept"))


def _repeats(sets: DataFrame) -> bool:
    """Whether an id has the same text several times."""
    return not sets.groupBy("did", "th").count().where("count > 1").isEmpty()


def _meet(percent: int):
    """Streams rows ordered by cell (key, i, j). Of a cell, rows outside the key's largest component (side i) meet all rows (side j).

    Gives (block, kind, did) for what sizes and visible distances let be near a row of another component: kind 0 is a row of side i in its
    own block, kind 1 a row of side j in the block of the row that it may be near. With signatures, a pair counts in the first key
    that it shares: where that key is short, the pair has been confirmed or not, where it is long, the pair meets there.
    """
    out = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("did", pa.int64())])
    names = ("key", "i", "j", "own_i", "own_j", "did", "n", *_BITS, "component", "block")

    def arrays(b: pa.RecordBatch) -> dict:
        a = {c: b[c].to_numpy() for c in names}
        return a if b["sig"].null_count else a | {"sig": np.frombuffer(b"".join(b["sig"].to_pylist()), np.uint16).reshape(-1, K)}

    def once(block: list, did: list) -> tuple[np.ndarray, np.ndarray]:
        both = np.unique(np.stack((np.concatenate(block), np.concatenate(did)), axis=1), axis=0)
        return both[:, 0], both[:, 1]

    def cell(a: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(kind, block, did) of one cell, some rows of side i at a time against all of side j."""
        left = np.flatnonzero(a["own_i"] == a["i"])
        left = left[np.argsort(a["block"][left], kind="stable")]
        right = np.flatnonzero(a["own_j"] == a["j"])
        for at in range(0, len(left) if len(right) else 0, 256):
            some = left[at : at + 256]
            x, y = np.repeat(some, len(right)), np.tile(right, len(some))
            ok = (a["component"][x] != a["component"][y]) & _alike(a, x, y, percent)
            if "sig" in a:
                at = np.flatnonzero(ok)
                ok[at] = _first_shared(a["sig"], x[at], y[at], a["key"][x[at]] & (K - 1))
            ok = ok.reshape(len(some), len(right))
            asks = some[ok.any(axis=1)]
            if not len(asks):
                continue
            yield 0, a["block"][asks], a["did"][asks]
            block = a["block"][some]
            starts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1))
            b, r = np.nonzero(np.logical_or.reduceat(ok, starts, axis=0))
            yield 1, block[starts][b], a["did"][right][r]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in chain(batches, (None,)):
            if b is not None:
                a = arrays(b)
                rest = a if rest is None else {c: np.concatenate((rest[c], a[c])) for c in a}
            if rest is None or not len(rest["key"]):
                continue
            new = np.ones(len(rest["key"]), bool)
            new[1:] = (rest["key"][1:] != rest["key"][:-1]) | (rest["i"][1:] != rest["i"][:-1]) | (rest["j"][1:] != rest["j"][:-1])
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(new))
            if b is not None:  # the last cell may go on
                starts, ends = starts[:-1], ends[:-1]
            found: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
            waiting = 0
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                for kind, block, did in cell({c: v[lo:hi] for c, v in rest.items()}):
                    found[kind][0].append(block)
                    found[kind][1].append(did)
                    waiting += len(did)
                if waiting > 100_000 or (waiting and hi == ends[-1]):
                    for kind, (block, did) in found.items():
                        if block:
                            block, did = once(block, did)
                            yield batch(out, block=block, kind=np.full(len(did), kind, np.int32), did=did)
                    found, waiting = {0: ([], []), 1: ([], [])}, 0
            cut = ends[-1] if len(ends) else 0
            rest = {c: v[cut:] for c, v in rest.items()}

    return run, "block long, kind int, did long"


def _spread_join(rows: DataFrame, by_key: DataFrame, key: str, how: str = "inner", by: str = "did", salts: int = 16) -> DataFrame:
    """rows joined with by_key, which has few rows a key: a key's rows go to several tasks, by the hash of another column."""
    copies = by_key.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(by, F.lit(-3)), F.lit(salts)).cast("int")).join(copies, [key, "_salt"], how).drop("_salt")


def _across(placed: DataFrame, bodies: DataFrame, percent: int, n_out: int, sigs: DataFrame | None = None) -> DataFrame | None:
    """All links between components that share a key; None where no key holds several.

    Of a key with z rows, r of them outside its largest component, the r rows meet the z rows in cells of about CELL by CELL, so
    that about z * ceil(r / CELL) + r * z / CELL rows are dealt: the largest component is never held against itself. The r rows
    lie in blocks of about BLOCK sets; a cell gives, for each block, only the rows whose sizes and visible distances allow a link with
    one of the block's rows. These then meet the block's full sets at once, and no pairs are listed. With the signatures (did, sig) of
    the rows, a cell leaves a pair to the first key that it shares, so that rows of many common keys are not given by each of them.
    """
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("z"))
    size = parts.groupBy("key").agg(F.sum("z").alias("z"), F.max("z").alias("top"), F.max_by("component", F.struct("z", "component")).alias("main"), F.count("*").alias("parts"))
    marked = _spread_join(placed, size.where("parts > 1"), "key")
    outside = F.col("component") != F.col("main")
    key = F.struct("key", F.ceil(F.col("z") / CELL).cast("int").alias("g"), F.ceil((F.col("z") - F.col("top")) / CELL).cast("int").alias("h"), outside.alias("outside"))
    # A row has at most K keys.
    rows = materialize(marked.groupBy("did", "n", *_BITS, "component").agg(F.collect_list(key).alias("keys"), F.min(F.when(outside, F.col("key"))).alias("home")))
    asking = rows.where("home is not null").count()
    if not asking:
        return None
    blocks = max(1, asking // BLOCK)
    # Rows that share their least key come to one block, as far as its size allows.
    block = F.pmod(F.xxhash64(F.when(F.lit(blocks) > 1, F.col("home"))), F.lit(blocks)).alias("block")
    part = lambda salt, n: F.pmod(F.xxhash64("did", F.lit(salt)), F.col(n)).cast("int")
    signed = rows.withColumn("sig", F.lit(None).cast("binary")) if sigs is None else rows.join(sigs, "did")
    dealt = signed.select("did", "n", *_BITS, "sig", "component", block, F.explode("keys").alias("k")).select("did", "n", *_BITS, "sig", "component", "block", "k.*")
    dealt = dealt.withColumn("own_i", F.when(F.col("outside"), part(-2, "h")).otherwise(-1)).withColumn("own_j", part(-4, "g"))
    cell = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.transform(upto("h"), lambda i: cell(i, F.col("own_j")))
    left = F.transform(upto("g"), lambda j: cell(F.col("own_i"), j))
    cells = F.when(F.col("outside"), F.array_distinct(F.concat(right, left))).otherwise(right)
    dealt = dealt.withColumn("c", F.explode(cells)).select("key", "c.i", "c.j", "own_i", "own_j", "did", "n", *_BITS, "sig", "component", "block")
    meet, schema = _meet(percent)
    met = materialize(dealt.repartition(n_out, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(meet), schema).distinct())
    held, members = met.where("kind = 0"), met.where("kind = 1")
    # A block is copied to several tasks only as far as its copies stay at most twice the rows that meet it.
    salts = max(1, min(n_out // blocks, 2 * members.count() // max(1, held.count())))
    members = members.select("block", F.pmod(F.xxhash64("did"), F.lit(salts)).alias("salt"), "kind", "did")
    held = held.select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "kind", "did")
    rows = held.unionByName(members).join(bodies, "did").select("block", "salt", "kind", "did", "body")
    check, schema = _against_block(percent)
    return materialize(rows.repartition(n_out, "block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(lean(check), schema).distinct())


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2, percent=80)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Components by the closure of all links; the smallest id reachable names a component.
SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
d AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] ELSE ws END) AS sh FROM w),
s AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM d),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, len(sh) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM d LEFT JOIN m ON m.a = d.doc_id"""
