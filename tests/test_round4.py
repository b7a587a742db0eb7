"""Findings of round 4: results against plain ones, and what a query moves."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import text as X
from clauseloom.operators import graph as G
from clauseloom.operators import joins as J
from clauseloom.operators import outline as O
from clauseloom.plans import pair_queries, registry  # noqa: F401  registers queries


def shuffled(spark, run):
    """Bytes that run() writes to shuffles, and what it returns."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (found.apply(i) for i in range(found.size()))}

    before, result = stages(), run()
    return sum(n for s, n in stages().items() if s not in before), result


@pytest.mark.parametrize("held", [J.HELD, 9])
def test_tfidf_join_finds_all_pairs(spark, monkeypatch, held):
    """with repeated and null keys, texts without words, and blocks of a few documents."""
    monkeypatch.setattr(J, "HELD", held)
    monkeypatch.setattr(J, "SLICE", 5)
    monkeypatch.setattr(J, "GIVEN", 3)
    pick = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(pick.choices(words, weights=[1 / (j + 1) for j in range(40)], k=pick.choice([1, 4, 25])))) for i in range(80)]
    rows += [(100 + i, rows[i][1]) for i in range(12)] + [(5, "w1 w2 alone"), (None, "w1 w2"), (200, None), (201, ""), (202, "unique words here"), (-7, rows[3][1] + " w9")]
    texts: dict = {}
    for k, t in rows:
        if k is not None:
            texts.setdefault(k, Counter()).update((t or "").split())
    df = Counter(w for t in texts.values() for w in t)
    vec = {}
    for k, t in texts.items():
        x = {w: n * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, n in t.items()}
        vec[k] = {w: v / math.sqrt(sum(y * y for y in x.values())) for w, v in x.items()}
    score = {(a, b): sum(v * vec[b].get(w, 0) for w, v in vec[a].items()) for a in vec for b in vec if a < b}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (0.2, 0.6, 0.9):
        got = {(r["a"], r["b"]): r["score"] for r in J.tfidf_join(docs, X.tfidf_tokens(F.col("text")), least).collect()}
        want = {p for p, s in score.items() if s >= least}
        assert set(got) == want and all(abs(got[p] - score[p]) < 1e-9 for p in want) and len(want) > 10
    assert J.tfidf_join(docs.limit(0), X.tfidf_tokens(F.col("text")), 0.6).count() == 0


def test_tfidf_join_moves_few_bytes(spark, monkeypatch):
    """every copy of a document took 16 bytes for each term."""
    monkeypatch.setattr(J, "HELD", 40)
    moved, rows = shuffled(spark, lambda: registry.QUERIES["j04_tfidf_similarity_join"](spark, "/root/testdata/sf0.01").count())
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg(F.sum(F.length("text"))).first()[0]
    print("moved", moved, "of", text)
    assert rows == 643 and moved < 10 * text


@pytest.mark.parametrize("block", [G.EDGES, 12])
def test_cousins_of_odd_edges(spark, monkeypatch, block):
    """Edges between sources, sources of several kinds or none, targets of one source, null ends, a target of all sources."""
    monkeypatch.setattr(G, "EDGES", block)
    monkeypatch.setattr(G, "NAMES", 5)
    monkeypatch.setattr(G, "SPARSE", 0 if block == 12 else 16)
    monkeypatch.setattr(G, "GIVEN", 3)
    pick = random.Random(11)
    names = [f"s{i}" for i in range(24)]
    edges = [(s, f"p{pick.randrange(25)}") for s in names for _ in range(pick.choice([2, 8, 12]))] + [(s, "all") for s in names] + [(s, f"own{s}") for s in names[::2]]
    edges += [(pick.choice(names), pick.choice(names)) for _ in range(25)] + [("s1", None), (None, "p1"), (None, "p2"), (None, "all"), ("s1", None)]
    df = spark.createDataFrame(edges * 2, "src string, dst string")
    of: dict = {}
    for s, d in edges:
        if s is not None:
            of.setdefault(s, set()).add(d)
    known = {s: t - {None} for s, t in of.items()}
    near = {(a, b): known[a] & known[b] for a in of for b in of if a < b and len(known[a] & known[b]) >= 3 and b not in of[a] and a not in of[b]}
    want = {(a, b, len(c), len(of[a]) - len(c), len(of[b]) - len(c)) for (a, b), c in near.items()}
    assert len(want) > 40 and sorted(map(tuple, G.cousins(df, 3).collect())) == sorted(want)
    got = sorted((r["a"], r["b"], r["common_targets"], r["targets_of_a"]) for r in G.cousins(df, 3, named=True, rest=True).collect())
    assert got == sorted((a, b, sorted(c), sorted(known[a] - c)) for (a, b), c in near.items())
    kinds = [(s, str(i % 3)) for i, s in enumerate(names[:-2])] + [("s0", "2"), ("s5", None), ("other", "1")]
    some = spark.createDataFrame(kinds, "id string, source string")
    want = sorted((a, b, len(c)) for (a, b), c in near.items() for x, p in kinds for y, q in kinds if x == a and y == b and None not in (p, q) and p != q)
    assert sorted(map(tuple, G.cousins(df, 3, some).select("a", "b", "common").collect())) == want and want
    assert G.cousins(df.limit(0), 3).count() == 0 and G.cousins(df, 30, named=True).count() == 0


def test_pairs_of_cousins_do_not_move_before_they_are_found(spark):
    """Each pair moved once for each common target, and with its names from side to side."""
    pick = random.Random(12)
    edges = spark.createDataFrame([(f"s{i}", f"p{p}") for i in range(300) for p in pick.sample(range(80), 40)], "src string, dst string")
    moved, rows = shuffled(spark, lambda: G.cousins(edges, 27).count())
    print("moved", moved, rows)
    assert 0 < rows < 2000 and moved < 1_000_000


def test_lines_of_plans_stay_in_their_rows(spark, monkeypatch):
    """each line moved up to six times; texts of one key stand for themselves, and rows of long lines go in parts."""
    monkeypatch.setattr(O, "GIVEN", 100)
    n = 40_000
    texts = [(1, "A Title\n• one\n" + "• go\n" * n), (1, "Pillar I: X\n• two"), (None, "Some Words\nMore Words\nlower\n\n\n\nsmall\n• three"), (2, None), (3, ""), (4, "• four\nPillar II: Y\n• five")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(1).cache()
    docs.count()
    moved, rows = shuffled(spark, lambda: O.pillar_actions(docs).collect())
    got = sorted((r["action"], r["doc_id"], r["pos"], r["pillar"], r["section"]) for r in rows if r["action"] != "go")
    assert got == [("five", 4, 2, "Pillar II: Y", "Uncategorized"), ("four", 4, 0, "", "Uncategorized"), ("one", 1, 1, "", "A Title"), ("three", None, 7, "", "Some Words More Words"), ("two", 1, 1, "Pillar I: X", "Uncategorized")]
    assert moved == 0 and sum(r["action"] == "go" and r["section"] == "A Title" for r in rows) == n


def test_candidate_pairs_lie_in_small_files(spark, tmp_path):
    """where all names share a word the pairs are the result, and its order made files of them five times as large."""
    s = spark.range(3000).select("id", F.format_string("Plan n%09d", "id").alias("name"), F.pmod(F.xxhash64("id"), F.lit(25)).cast("string").alias("source"))
    J.candidate_pairs(s, s).select("a_id", "b_id").write.parquet(f"{tmp_path}/pairs")
    pairs = spark.read.parquet(f"{tmp_path}/pairs")
    n = pairs.count()
    size = sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet"))
    print("bytes a pair", size / n)
    sizes = [r["count"] for r in s.groupBy("source").count().collect()]
    assert n == 3000**2 - sum(z * z for z in sizes) == pairs.distinct().count() and size < 0.5 * n
