"""Phrases, funnels and nearest neighbours against brute force and SQL."""

import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from clauseloom.llm import funnels, neighbours, phrases

from ..conftest import SF
from .conftest import ROWS


def sql_rows(module, **tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    rel = con.sql(module.SQL)
    return rel.columns, rel.fetchall()


@pytest.mark.parametrize("module, table", [(phrases, "documents"), (funnels, "clicks")])
def test_same_as_sql(spark, module, table):
    cols, expected = sql_rows(module, **{table: f"{SF}/{table}.parquet"})
    got = module.query(spark, SF)
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, expected))


# Phrases


def plain_phrases(rows, least, longest, top, cover):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split(r"[\x20\x09]", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        kept = []
        for p, a in found.items():
            longer = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= cover * a for b in longer):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, text, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, text.decode(), -a, l, r, n[lang], -s))
    return out


PHRASES = ["a b c d a b c d", "a b, c a b\tc d", "A  B c. d e", "é é é é é é", "x", "", None, ";;", "a b c d e f " * 40, "one-word", "b a " * 30, "� \x00 a b", "c\x0bc c\rc c c", "the end of the line " * 25]


@pytest.mark.parametrize("longest, size, cover", [(3, 1 << 19, 50), (5, 64, 90), (2, 7, 50), (4, 200, 100)])
def test_phrases_like_brute_force(spark, longest, size, cover):
    rng = random.Random(longest)
    rows = [(t, lang) for t in PHRASES for lang in ("en", None, "fr") for _ in range(rng.randint(0, 3))]
    rows += [(" ".join(rng.choice("abcdef") + rng.choice(["", ".", ""]) for _ in range(200)), rng.choice(["en", "de"])) for _ in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    docs = docs.withColumns({c: F.lit(1) for c in ("word", "n", "shard", "bits", "path", "f", "id")})
    got = {tuple(r) for r in phrases.collocations(docs, least=4, longest=longest, top=15, cover=cover, shard=size).collect()}
    assert got == plain_phrases(rows, 4, longest, 15, cover)


def test_phrases_of_small_tables(spark, docs, empty):
    assert phrases.collocations(empty).count() == 0
    got = {tuple(r) for r in phrases.collocations(docs, least=2).collect()}
    assert got == plain_phrases([(t, "x") for _, t in ROWS], 2, 3, 2000, 50)


def test_bitmaps_over_long_gaps():
    item = np.array([3, 3, 3, 1, 1])
    block = np.array([0, 70_000, 200_000, 65_535, 65_536])
    bits = np.array([1, 0x8000, 5, 2, 4], "<u2")
    items, off, data = phrases.pack(item, block, bits)
    rows = phrases.unpack(phrases._binary(off, data))
    assert items.tolist() == [1, 3]
    assert [x.tolist() for x in rows] == [[0, 0, 1, 1, 1], [65_535, 65_536, 0, 70_000, 200_000], [2, 4, 1, 0x8000, 5]]


# Funnels


def plain_funnels(rows, plans, within, percent):
    rows = {r for r in rows if None not in r}
    by = defaultdict(list)
    for client, kind, us in sorted(rows, key=lambda r: r[2]):
        by[client, kind].append(us)
    after = lambda c, k, t: next(iter(by[c, k][bisect_right(by[c, k], t) :]), None)
    found = {}
    for name, (steps, excluded) in plans.items():
        for client, kind, us in rows:
            if kind != steps[0]:
                continue
            n, gaps = found.setdefault((name, client), (Counter(), defaultdict(list)))
            n[1] += 1
            for k, step in enumerate(steps[1:], 2):
                nxt, bad = after(client, step, us), after(client, excluded, us)
                if nxt is None or nxt - us > within or bad is not None and bad <= nxt:
                    break
                n[k] += 1
                gaps[k].append(nxt - us)
                us = nxt
    depth = Counter((name, max(n)) for (name, _), (n, _) in found.items())
    most = max(len(s) for s, _ in plans.values())
    return {
        (name, client, *(n[k] if k <= len(plans[name][0]) else None for k in range(1, most + 1)), max(n), *(sorted(gaps[k])[math.ceil(percent * n[k] / 100) - 1] if n[k] else None for k in range(2, most + 1)), depth[name, max(n)])
        for (name, client), (n, gaps) in found.items()
    }


@pytest.mark.parametrize("within, span, percent", [(15 * funnels.MINUTE, 180 * funnels.MINUTE, 50), (3_000_000, 2_000_000, 90), (10**9, 7_777_777, 1)])
def test_funnels_like_brute_force(spark, within, span, percent):
    rng = random.Random(span)
    kinds = ["view", "click", "purchase", "error", "signup", "other", None]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(kinds), rng.choice([rng.randrange(40) * 1_000_000, rng.randrange(4 * 10**7), -rng.randrange(10**7), None])) for _ in range(1500)]
    rows += rows[:200]
    start = datetime(1970, 1, 1)
    stamped = [(c, k, None if us is None else start + timedelta(microseconds=us), 1, "x") for c, k, us in rows]
    events = spark.createDataFrame(stamped, "client_id long, kind string, ts timestamp_ntz, step int, funnel string").repartition(5)
    plans = funnels.FUNNELS | {"short": (("view", "click"), "error"), "one": (("signup",), None)}
    got = funnels.count_funnels(events, plans, within=within, percent=percent, span=span)
    expected = plain_funnels(rows, plans, within, percent)
    assert len(expected) > 5
    assert {tuple(r) for r in got.collect()} == expected


def test_funnels_of_an_empty_table_and_other_types(spark):
    assert funnels.count_funnels(spark.createDataFrame([], "client_id long, kind string, ts timestamp_ntz"), funnels.FUNNELS).count() == 0
    rows = [("a", "view", "2024-03-31 01:59:59.999999"), ("a", "click", "2024-03-31 02:30:00"), ("a", "view", "2024-03-31 02:30:00.000001")]
    df = spark.createDataFrame(rows, "who string, what string, at string").withColumn("at", F.col("at").cast("timestamp_ntz"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = funnels.count_funnels(df, {"f": (("view", "click", "view"), "error")}, within=60 * funnels.MINUTE, client_col="who", kind_col="what", time_col="at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [tuple(r) for r in got] == [("f", "a", 2, 1, 1, 3, 1800000001, 1, 1)]


# Nearest neighbours


def exact_neighbours(rows, k, every):
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    rows = list({(i, tuple(v)): (i, v) for i, v in rows}.values())
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = [(float(v @ w / np.sqrt(v @ v) / np.sqrt(w @ w)), i) for i, w in rows if i != q and len(w) == len(v)]
            out[q] = sorted(near, key=lambda x: (-round(x[0], 12), x[1]))[:k]
    return out


def by_query(df):
    found = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        found[r.query_id].append((r.score, r.vec_id))
    return found


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0]), (50, [1.0, 1.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]), (7, [nan, 1.0, 0.0]), (8, [inf, 1.0, 0.0])]
    rows += [(9, [None, 1.0, 1.0]), (None, [1.0, 0.0, 0.0]), (100, [1.0, 2.0]), (101, [2.0, 1.0]), (10, [-1.0, 0.0, 0.0]), (11, [1e-30, 1e-30, 0.0]), (150, None), (200, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("id", "vec", "cell", "ids", "vid")})
    got, expected = by_query(neighbours.nearest(df)), {q: v for q, v in exact_neighbours(rows, 5, 50).items() if v}
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in expected.items()}
    assert all(abs(a - b) < 1e-12 for q in got for (a, _), (b, _) in zip(got[q], expected[q], strict=True))
    assert neighbours.nearest(df.where("false")).count() == 0


def test_neighbours_of_a_common_vector_take_the_smallest_ids(spark):
    rng = np.random.default_rng(1)
    common = rng.standard_normal(16).tolist()
    rows = [(i, common if i % 3 else rng.standard_normal(16).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(20)
    got = by_query(neighbours.nearest(df))
    expected = exact_neighbours(rows, 5, 50)
    assert all([i for _, i in got[q]] == [i for _, i in expected[q]] for q in expected if q % 3)


def test_neighbours_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + rng.standard_normal(32) * (0.05 if i % 2 else 1.0)).tolist()) for i in range(4000)]
    got = by_query(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20))
    expected = exact_neighbours(rows, 5, 20)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in expected[q]}) for q in expected)
    assert hits >= 0.95 * 5 * len(expected)
    known = dict(rows)
    for q, near in got.items():
        assert near == sorted(near, key=lambda x: (-x[0], x[1])) and q not in [i for _, i in near]
        for score, i in near:
            a, b = np.array(known[q]), np.array(known[i])
            assert abs(score - a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) < 1e-12


def test_the_stopping_test_ends_a_search_early():
    rng = np.random.default_rng(3)
    import pyarrow as pa

    base = rng.standard_normal((2000, 64))
    rows = np.concatenate((base, base[:1] + 0.01 * rng.standard_normal((6, 64))))
    lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), 64).cast(pa.list_(pa.float64()))
    scaled = neighbours._matrix(lists)
    proj = neighbours._project(scaled, 8)
    table = pa.table({"vec": lists, "proj": pa.FixedSizeListArray.from_arrays(pa.array(proj.reshape(-1)), 8).cast(pa.list_(pa.float64())), "ids": [[i] for i in range(len(rows))]})
    block = neighbours._Block(table, 8)
    away = []
    counted = block.rows

    class Rows:
        def __getitem__(self, at):
            away.append(len(at))
            return counted[at]

    block.rows = Rows()
    best, bound = block.search(scaled[0], proj[0], float("inf"), 6, neighbours.chi_square_quantile(0.98, 8))
    assert {i for _, i in best} <= {0, *range(2000, 2006)} and bound < 0.1
    assert sum(away) < 500


@pytest.mark.parametrize("p, dims, x", [(0.95, 2, 5.991465), (0.95, 8, 15.507313), (0.99, 8, 20.090235), (0.98, 10, 21.160768)])
def test_chi_square_quantile(p, dims, x):
    assert abs(neighbours.chi_square_quantile(p, dims) - x) < 1e-5
