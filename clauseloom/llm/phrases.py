"""Phrase collocation mining on compressed position bitmaps.

Each task reads texts into shards of one language, a list of word positions in which a free position stands between
pieces, and stores for each word of a shard the bitmap of its positions. A bitmap is a list of 16-bit words
that are not empty, each behind the number of words it stands after the one before. Popcounts summed over the
shards are the counts of words.

A phrase grows by shifting its bitmap (of the positions of its last word) by one and ANDing it with another; free positions
keep phrases within pieces. In the first round over the stored shards words grow to pairs, in the second pairs grow
depth-first to longer phrases: a phrase is ANDed with the pair that begins with its last word. After each round the popcounts
are summed over the shards, and the phrases that are frequent enough in the whole corpus are marked in a filter of a fixed size.
The next round grows only what is marked. A filter has no false negatives, so no frequent phrase gets lost, and what it lets through
by chance is dropped by its sum; with more phrases than the filter can tell apart the rounds grow more and find the same.

Only counts move: a row for each phrase and task, so a word or pair that every text holds is no one's load.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import U64, lean, mix, stage_dir, text_bytes

#: Positions of a shard; a piece is never cut, so a longer piece is a longer shard.
SHARD = 1 << 18
_BITS, _FAR = 16, 65535
#: ANDs that are done at a time, and bitmap words of the phrases that grow together.
_STEP, _GROWN = 1 << 20, 1 << 15
#: Bits of a filter, 16 MB whatever the input.
FILTER = 1 << 27
#: A-Z lower-cased; the ends of pieces become line feeds, tabs become spaces.
_FOLD = bytes(ord("\n") if chr(c) in ".,;:!?\n\x0b\x0c\r" else ord(" ") if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pack(item: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps from entries in any order: the items in order, n + 1 byte offsets, and the bitmaps end to end."""
    item, block, bits = merged(item, block, bits)
    first = np.ones(len(item), bool)
    first[1:] = item[1:] != item[:-1]
    gap = block.copy()
    gap[1:] -= np.where(first[1:], 0, block[:-1])
    # A gap too long for 16 bits is walked over empty words.
    hops = gap // _FAR
    at = np.cumsum(hops + 1) - 1
    out = np.zeros((int(at[-1]) + 1 if len(at) else 0, 2), "<u2")
    out[:, 0] = _FAR
    out[at, 0], out[at, 1] = gap % _FAR, bits
    starts = (at - hops)[first]
    return item[first], 4 * np.append(starts, len(out)), out.reshape(-1).view(np.uint8)


def merged(item: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by (item, block), those of one place put together."""
    order = np.lexsort((block, item))
    item, block, bits = item[order], block[order], bits[order]
    new = np.ones(len(item), bool)
    new[1:] = (item[1:] != item[:-1]) | (block[1:] != block[:-1])
    return (item[new], block[new], np.bitwise_or.reduceat(bits, np.flatnonzero(new))) if len(item) else (item, block, bits)


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries (row, block, bits) of a column of bitmaps."""
    data, off = text_bytes(col.cast(pa.large_binary()).view(pa.large_string()))
    words = data.view("<u2").reshape(-1, 2)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off) // 4)
    run = np.cumsum(words[:, 0], dtype=np.int64)
    begin = off[:-1] // 4
    block = run - np.where(begin > 0, run[np.minimum(begin, len(run)) - 1], 0)[row] if len(run) else run
    full = words[:, 1] > 0
    return row[full], block[full], words[full, 1]


def shifted(item: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every position moves on by one, over the end of a bitmap word where it must."""
    stay, over = (bits << 1).astype("<u2"), bits >> (_BITS - 1)
    a, b = stay > 0, over > 0
    return np.append(item[a], item[b]), np.append(block[a], block[b] + 1), np.append(stay[a], over[b]).astype("<u2")


def anded(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(item of a, item of b, block, bits) where bitmaps of a and b share positions; b is in order of block."""
    item, block, bits = a
    lo, hi = np.searchsorted(b[1], block, "left"), np.searchsorted(b[1], block, "right")
    upto = np.cumsum(hi - lo)
    out, at = [], 0
    while at < len(block):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _STEP, "right")))
        n = (hi - lo)[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[at:to], n)
        both = bits[i] & b[2][j]
        hit = both > 0
        out.append((item[i[hit]], b[0][j[hit]], block[i[hit]], both[hit]))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, "<u2"),)


def _binary(off: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


_SHARDS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary()))])


def _shards(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, list]] = {}
        total = 0

        def given(lang):
            vocabulary, at = held.pop(lang)
            if vocabulary:
                at = np.array(at, np.int64)
                place = np.flatnonzero(at >= 0)
                _, off, data = pack(at[place], place >> 4, (1 << (place & 15)).astype("<u2"))
                cols = [pa.array(list(vocabulary), pa.binary()).view(pa.string()), pa.array(np.bincount(at[place], minlength=len(vocabulary))), _binary(off, data)]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), *(pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in cols)], schema=_SHARDS)

        for b in batches:
            data, off = text_bytes(b["text"])
            for i, lang in enumerate(b["lang"].to_pylist()):
                vocabulary, at = held.setdefault(lang, (defaultdict(count().__next__), []))
                before = len(at)
                for piece in data[off[i] : off[i + 1]].tobytes().translate(_FOLD).split(b"\n"):
                    if words := [x for x in piece.split(b" ") if x]:
                        at.extend(map(vocabulary.__getitem__, words))
                        at.append(-1)
                        if len(at) >= size:
                            total -= before
                            yield from given(lang)
                            vocabulary, at = held[lang] = defaultdict(count().__next__), []
                            before = 0
                total += len(at) - before
                while total > 2 * size:
                    # Many languages at once: the fullest shard goes.
                    most = max(held, key=lambda x: len(held[x][1]))
                    total -= len(held[most][1])
                    yield from given(most)
        for lang in list(held):
            yield from given(lang)

    return run


def _word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    return np.array([xxhash.xxh3_64_intdigest(w, seed) for w in words], U64)


def _pair_hashes(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return mix(u * U64(0x9E3779B97F4A7C15) + v)


def _marked(marks: np.ndarray, h: np.ndarray) -> np.ndarray:
    h = h % U64(FILTER)
    return (marks[(h >> U64(6)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where words and pairs are marked: the number of a 64-bit word and its bit."""
    for b in batches:
        found = []
        for lang, phrase in zip(b["lang"].to_pylist(), b["phrase"].cast(pa.binary()).to_pylist(), strict=True):
            h = _word_hashes(lang, phrase.split(b" "))
            found.append(h[0] if len(h) == 1 else _pair_hashes(h[:1], h[1:])[0])
        h = np.array(found, U64) % U64(FILTER)
        yield pa.RecordBatch.from_arrays([pa.array((h >> U64(6)).astype(np.int32)), pa.array((U64(1) << (h & U64(63))).view(np.int64))], ["word", "bit"])


def marks(phrases: DataFrame) -> np.ndarray:
    """The filter of these words or pairs; at most FILTER / 64 rows come to the driver."""
    rows = phrases.select("lang", "phrase").mapInArrow(lean(_places), "word int, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(FILTER // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["bit"].to_numpy()
    return out.view(U64)


_COUNTED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _counted(lang: str, parts: list[pa.Array], n: np.ndarray) -> Iterator[pa.RecordBatch]:
    step = 1 << 15
    for i in range(0, len(n), step):
        text = pc.binary_join_element_wise(*(p.slice(i, step) for p in parts), " ")
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text)), text, pa.array(n[i : i + step])], schema=_COUNTED)


def _sums(key: np.ndarray, block: np.ndarray, bits: np.ndarray):
    """Entries put together; where each key begins, and the popcount of its bitmap."""
    key, block, bits = merged(key, block, bits)
    new = np.append(0, np.flatnonzero(np.diff(key)) + 1)[: len(key)]
    n = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), new) if len(key) else np.zeros(0, np.int64)
    return key, block, bits, new, n


def _grown(word_marks, pair_marks, longest: int):
    """Without pair_marks the pairs of marked words; with them the phrases of three to longest words whose pairs are all marked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                yield from _of_shard(b["lang"][i].as_py(), b["words"][i].values, b["bits"][i].values)

    def _of_shard(lang, words, bitmaps):
        hashes = _word_hashes(lang, words.cast(pa.binary()).to_pylist())
        keep = np.flatnonzero(_marked(word_marks.value, hashes))
        words, hashes = words.take(pa.array(keep)), hashes[keep]
        items = unpack(bitmaps.take(pa.array(keep)))
        order = np.argsort(items[1], kind="stable")
        u, v, block, bits = anded(shifted(*items), tuple(x[order] for x in items))
        key, block, bits, new, n = _sums(u * max(len(words), 1) + v, block, bits)
        u, v = key[new] // max(len(words), 1), key[new] % max(len(words), 1)
        if pair_marks is None:
            yield from _counted(lang, [words.take(pa.array(u)), words.take(pa.array(v))], n)
            return
        good = _marked(pair_marks.value, _pair_hashes(hashes[u], hashes[v]))
        number = np.cumsum(good) - 1
        pair = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key))))
        own = good[pair]
        u, v = u[good], v[good]
        pairs = number[pair[own]], block[own], bits[own]
        order = np.argsort(pairs[1], kind="stable")
        yield from _deeper(lang, words, v, np.column_stack((u, v)), pairs, tuple(x[order] for x in pairs))

    def _deeper(lang, words, lasts, paths, bitmaps, by_block):
        """Phrases one word longer than the paths, each chunk of them with all that grows from it."""
        ends = np.append(np.flatnonzero(np.diff(bitmaps[0])) + 1, len(bitmaps[0]))
        at = 0
        while at < len(bitmaps[0]):
            to = int(ends[min(np.searchsorted(ends, at + _GROWN), len(ends) - 1)])
            item, pair, block, bits = anded(shifted(*(x[at:to] for x in bitmaps)), by_block)
            at = to
            key, block, bits, new, n = _sums(item * len(lasts) + pair, block, bits)
            if len(new):
                path = np.column_stack((paths[key[new] // len(lasts)], lasts[key[new] % len(lasts)]))
                yield from _counted(lang, [words.take(pa.array(c)) for c in path.T], n)
                if path.shape[1] < longest:
                    yield from _deeper(lang, words, lasts, path, (np.repeat(np.arange(len(new)), np.diff(np.append(new, len(key)))), block, bits), by_block)

    return run


def _side(counts: DataFrame, name: str) -> DataFrame:
    return counts.select("lang", F.col("phrase").alias(f"_{name}"), F.col("f").alias(name))


def _score(k: int) -> Column:
    # In decimals of 38 digits; counts up to 10^15 are safe.
    a, l, r = (f"CAST({c} AS DECIMAL(18, 0))" for c in ("f", f"l{k}", f"r{k}"))
    return F.expr(f"CAST(1000000 AS DECIMAL(7, 0)) * {a} * {a} DIV ({l} * {r})")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, top: int = 2000, cover: int = 50, lang_col: str = "lang", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the first phrases by score descending, a descending, phrase.

    Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words at spaces and tabs. Candidates
    have 2 to longest words and a occurrences within pieces, at least ``least``. The score is that of the cut with the smallest
    floor(1000000 a a / (l r)), l and r the counts of both sides; the first of equal ones counts. A candidate goes where a longer one
    contains it and has at least cover percent of its occurrences. n counts all words of the language.

    A null language is ``und``, a null or empty text has no words, repeated rows count again, an empty table gives no
    rows. Languages are compared as they are written. A text of any length is read whole; its pieces may go to several shards.
    """
    spark = docs.sparkSession
    home = stage_dir(spark, "phrases")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{home}/{name}")
        return spark.read.parquet(f"{home}/{name}")

    def frequent(df: DataFrame, name: str) -> DataFrame:
        return stored(df.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least), name)

    def grown(*filters) -> DataFrame:
        return shards.mapInArrow(lean(_grown(*(None if m is None else spark.sparkContext.broadcast(m) for m in filters), longest)), "lang string, phrase string, n long")

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    shards = stored(texts.mapInArrow(lean(_shards(shard)), "lang string, words array<string>, n array<long>, bits array<binary>"), "shards")
    totals = shards.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    words = frequent(shards.select("lang", F.explode(F.arrays_zip("words", "n")).alias("x")).select("lang", F.col("x.words").alias("phrase"), F.col("x.n").alias("n")), "words")
    word_marks = marks(words)
    by_size = {1: words, 2: frequent(grown(word_marks, None), "pairs")}
    if longest > 2:
        longer = frequent(grown(word_marks, marks(by_size[2])), "longer")
        by_size |= {m: longer.where(F.size(F.split("phrase", " ")) == m) for m in range(3, longest + 1)}
    found = inner = None
    for m in range(2, longest + 1):
        scored = by_size[m]
        for k in range(1, m):
            scored = scored.withColumns({f"_l{k}": F.substring_index("phrase", " ", k), f"_r{k}": F.substring_index("phrase", " ", k - m)})
            scored = scored.join(_side(by_size[k], f"l{k}"), ["lang", f"_l{k}"]).join(_side(by_size[m - k], f"r{k}"), ["lang", f"_r{k}"])
        cuts = [F.struct(_score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, m)]
        scored = scored.select("lang", "phrase", "f", (F.least(*cuts) if m > 2 else cuts[0]).alias("best"))
        found = scored if found is None else found.unionByName(scored)
        if m > 2:
            split = F.split("phrase", " ")
            parts = F.array(*[F.array_join(F.slice(split, i, size), " ") for size in range(2, m) for i in range(1, m - size + 2)])
            within = by_size[m].select("lang", F.explode(parts).alias("phrase"), F.col("f").alias("longer"))
            inner = within if inner is None else inner.unionByName(within)
    if inner is not None:
        found = found.join(inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("f")))
    order = (F.desc("score"), F.desc("f"), F.col("phrase"))
    flat = found.select("lang", "phrase", "f", "best.l", "best.r", "best.score")
    # Ranks of a language are found by ranges of the order, so a large language is not one task's load.
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(flat.repartitionByRange(ranges, "lang", *order).withColumn("part", F.spark_partition_id()), "ranges")
    # A row for each range and language in it.
    sizes = dealt.groupBy("lang", "part").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(W.partitionBy("lang").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("lang", "part", before.alias("before")).where(F.col("before") < top)
    own = F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))
    ranked = dealt.join(offsets, ["lang", "part"]).withColumn("rank", own + F.col("before")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
f1 AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY ALL),
f2 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, count(*) AS f FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 1)) AS i FROM w) GROUP BY ALL HAVING f >= 10),
f3 AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z, count(*) AS f FROM (SELECT lang, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w) GROUP BY ALL HAVING f >= 10),
inner2 AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM f3 UNION ALL SELECT lang, y, z, f FROM f3) GROUP BY ALL),
c AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, p.f AS l, q.f AS r, 1000000::HUGEINT * f2.f * f2.f // (p.f::HUGEINT * q.f) AS score
  FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y
  LEFT JOIN inner2 i ON i.lang = f2.lang AND i.x = f2.x AND i.y = f2.y
  WHERE i.longer IS NULL OR 100 * i.longer < 50 * f2.f
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (
    SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, a1.f AS l1, b1.f AS r1, a2.f AS l2, b2.f AS r2,
      1000000::HUGEINT * t.f * t.f // (a1.f::HUGEINT * b1.f) AS s1, 1000000::HUGEINT * t.f * t.f // (a2.f::HUGEINT * b2.f) AS s2
    FROM f3 t JOIN f1 a1 ON a1.lang = t.lang AND a1.x = t.x JOIN f2 b1 ON b1.lang = t.lang AND b1.x = t.y AND b1.y = t.z
    JOIN f2 a2 ON a2.lang = t.lang AND a2.x = t.x AND a2.y = t.y JOIN f1 b2 ON b2.lang = t.lang AND b2.x = t.z)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
