"""Ratio joins, greedy groups and index joins against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import fuzzy
from clauseloom.functions import text as X
from clauseloom.operators import curation as C
from clauseloom.operators import extract as E
from clauseloom.operators import graph as G
from clauseloom.operators import joins as J
from clauseloom.operators import matching as M


def edited(r, text, n):
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        text = text[:at] + r.choice(["", "x", "é", " "]) + text[at + r.randrange(2) :]
    return text


@pytest.fixture(scope="module")
def names():
    r = random.Random(5)
    words = ["audit", "plan", "data", "report", "agency", "of", "the", "risk", "review", "budget"]
    base = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(25)]
    return [edited(r, r.choice(base), r.randrange(4)) for _ in range(120)] + ["", "a", "b", "ab", "abc", "abd"]


def pairs_of(names, score, least):
    q = [(i, t) for i, t in enumerate(names) if i % 5 == 0]
    return {(i, j): score(x, y) for i, x in q for j, y in enumerate(names) if score(x, y) >= least}


def sides(spark, names):
    rows = spark.createDataFrame([*enumerate(names), (9999, None)], "key long, text string")
    return rows.where("key % 5 = 0"), rows


@pytest.mark.parametrize("scorer,least", [("sequence", 0.6), ("indel", 0.7), ("token_set", 0.64)])
def test_held_against(spark, names, monkeypatch, scorer, least):
    monkeypatch.setattr(M, "BLOCK", 7)
    score = {"sequence": fuzzy.sequence_ratio, "indel": fuzzy.indel_ratio, "token_set": fuzzy.token_set_ratio}[scorer]
    got = {(r.a, r.b): r.score for r in M.held_against(*sides(spark, names), scorer, least).collect()}
    assert got == pairs_of(names, score, least)


def test_best_pairs_and_halving(spark, names):
    q, rows = sides(spark, names)
    every = pairs_of(names, fuzzy.sequence_ratio, 0.0)
    best = {}
    for (i, j), s in sorted(every.items()):
        if s >= 0.6 and s > best.get(i, (0, -1))[0]:
            best[i] = (s, j)
    assert {r.a: (r.score, r.b) for r in M.best_match(q, rows).collect()} == best
    got = {(r.a, r.b) for r in M.ratio_pairs(q, rows, 0.5).collect()}
    assert got == {(i, j) for (i, j), s in every.items() if s > 0.5 and i != j and names[i] != names[j]}
    few = spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha delta words that are far too many to be near")], "key long, text string")
    one = few.where("key = 0")
    s = fuzzy.token_set_ratio("alpha beta gamma", "alpha delta words that are far too many to be near")
    assert [(r.a, r.b, r.score) for r in M.token_set_join(one, few, 0.99).collect()] == [(0, 1, s)]
    assert M.token_set_join(one, few, 0.99, tries=1).count() == 0


def test_copies_are_scored_once_and_found_all(spark, names, monkeypatch):
    met, held = [], M.held_against
    monkeypatch.setattr(M, "held_against", lambda q, r, *more: met.append((q.count(), r.count())) or held(q, r, *more))
    few = [*names[:12], ""]
    many = [few[i * i % len(few)] for i in range(150)]
    q, rows = sides(spark, many)
    every = pairs_of(many, fuzzy.sequence_ratio, 0.0)
    best = {i: min((-s, j) for (k, j), s in every.items() if k == i) for i in range(0, 150, 5)}
    assert {r.a: (-r.score, r.b) for r in M.best_match(q, rows).collect()} == best
    want = {(i, j) for (i, j), s in every.items() if s > 0.3 and many[i] != many[j]}
    assert {(r.a, r.b) for r in M.ratio_pairs(q, rows, 0.3).collect()} == want
    found = M.with_members(M.ratio_classes(q, rows, 0.3), q, rows).collect()
    of = {k: {r.a: r.b for r in found if r.kind == k} for k in ("query", "row")}
    pairs = {(r.a, r.b) for r in found if r.kind == "pair"}
    assert {(a, b) for a in of["query"] for b in of["row"] if (of["query"][a], of["row"][b]) in pairs} == want
    sets = {p for p, s in pairs_of(many, fuzzy.token_set_ratio, 0.64).items() if s < 1}
    assert {(r.a, r.b) for r in M.token_set_join(q, rows).collect()} == sets
    assert met and all(x <= 13 and y <= 13 for x, y in met)


def test_top_by_names_and_composites_with_copies(spark, names, monkeypatch):
    few = names[:9]
    many = [(i, few[i * i % 9], few[i % 4]) for i in range(90)]
    df = spark.createDataFrame([(i, x, x, y) for i, x, y in many], "key long, text string, name string, description string")
    q = df.where("key % 10 = 0")
    both = q.select((-1 - F.col("key")).alias("k"), "text").unionByName(df.select(F.col("key").alias("k"), "text"))
    vec: dict = {}
    for x in J.tfidf(both, X.tfidf_tokens(F.col("text")), key="k").collect():
        vec.setdefault(x.k, {})[x.term] = x.w
    got: dict = {}
    for x in M.top_by_names(q, df).collect():
        got.setdefault(x.a, set()).add((-x.score, x.b))
    for a in range(0, 90, 10):
        scored = sorted((-round(sum(w * vec.get(b, {}).get(t, 0) for t, w in vec.get(-1 - a, {}).items()), 9), b) for b in range(90))
        assert got.get(a, set()) == {(s, b) for s, b in scored[:3] if s < 0}
    score = lambda a, b: math.floor(100 * fuzzy.token_set_ratio(a, b) + 0.5)
    tops = {}
    for r in M.top_composite(q, df, head=5).collect():
        tops.setdefault(r.a, {})[r.b] = (r.name_score, r.description_score)
    for a, name, text in many[::10]:
        heads = [{many[-i][k]: s for s, i in sorted(((score(mine, x[k]), -x[0]) for x in many), reverse=True)[:5]} for k, mine in ((1, name), (2, text))]
        scored = {x[0]: (heads[0].get(x[1], 0), heads[1].get(x[2], 0)) for x in many if x[1] in heads[0] or x[2] in heads[1]}
        want = sorted(((round(0.6 * x + 0.4 * y, 6), -b) for b, (x, y) in scored.items() if max(x, y) >= 50), reverse=True)[:3]
        assert tops.get(a, {}) == {-b: scored[-b] for _, b in want}


@pytest.mark.parametrize("threshold", [0.95, 0.85, 0.6])
def test_near_values_loses_no_pair(spark, names, threshold):
    values = sorted(set(names) - {""})
    want = {(a, b) for a in values for b in values if a < b and fuzzy.indel_ratio(a, b) >= threshold}
    got = {(r.a, r.b) for r in M.near_values(spark.createDataFrame([(x,) for x in [*names, None]], "value string"), threshold).collect()}
    assert got == want and (threshold > 0.9 or len(want) > 20)


def test_greedy_groups(spark, names):
    order = {}
    for i, x in enumerate(names):
        if x:
            order.setdefault(x, i)
    group = {}
    for seed in sorted(order, key=order.get):
        if seed in group:
            continue
        for other in order:
            if other not in group and (other == seed or fuzzy.indel_ratio(seed, other) >= 0.7):
                group[other] = seed
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "value string, at long")
    assert {r.value: r.group for r in M.similar_groups(rows, 0.7).collect()} == group


def test_record_groups(spark):
    rows = [(1, "Agency Act of 1990", "Annual  Report!"), (2, "agency act of 1990", "annual report"), (3, "Agency Act of 1990.", "Annual reports"), (4, "Other", "Annual report"), (5, None, "x"), (6, None, "x")]
    got = {r.key: r.group for r in M.record_groups(spark.createDataFrame(rows, "key long, source string, component string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}
    links = {(r.a, r.b) for r in M.record_links(spark.createDataFrame(rows[:4], "key long, source string, component string")).collect()}
    assert links == {(1, 2), (1, 3), (2, 3)}


def test_top_composite(spark, names):
    rows = [(i, x, names[-1 - i]) for i, x in enumerate(names[:40])]
    df = spark.createDataFrame(rows, "key long, name string, description string")
    got = {(r.a, r.b): (r.name_score, r.description_score) for r in M.top_composite(df.where("key < 4"), df, head=5).collect()}
    score = lambda a, b: math.floor(100 * fuzzy.token_set_ratio(a, b) + 0.5)
    for a, name, text in rows[:4]:
        best = [sorted(((score(mine, theirs[k]), -theirs[0]) for theirs in rows), reverse=True)[:5] for k, mine in ((1, name), (2, text))]
        tops = [{rows[-i][k]: s for s, i in b} for k, b in ((1, best[0]), (2, best[1]))]
        scored = {r[0]: (tops[0].get(r[1], 0), tops[1].get(r[2], 0)) for r in rows if r[1] in tops[0] or r[2] in tops[1]}
        want = sorted(((0.6 * x + 0.4 * y, -b) for b, (x, y) in scored.items() if max(x, y) >= 50), reverse=True)[:3]
        assert {b for x, b in got if x == a} == {-b for _, b in want}
        assert all(got[a, -b] == scored[-b] for _, b in want)


def test_cosine_join_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 20)
    r = random.Random(2)
    docs = [(i, [r.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(r.randrange(0, 12))]) for i in range(80)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]
    w = J.tfidf(spark.createDataFrame(docs, "doc_id long, ws array<string>"), F.col("ws")).cache()
    vec: dict = {}
    for x in w.collect():
        vec.setdefault(x.doc_id, {})[x.term] = x.w
    want = {(a, b) for a in vec for b in vec if a < b and sum(x * vec[b].get(t, 0) for t, x in vec[a].items()) >= 0.6}
    got = {(x.a, x.b): x.score for x in J.cosine_join(w, 0.6).collect()}
    assert set(got) == want and len(want) > 5
    assert all(abs(s - sum(x * vec[b].get(t, 0) for t, x in vec[a].items())) < 1e-9 for (a, b), s in got.items())


@pytest.mark.parametrize("more", [False, True])
def test_two_sides_meet_in_blocks_without_candidate_rows(spark, monkeypatch, more):
    monkeypatch.setattr(J, "BLOCK", 7)
    r = random.Random(3)
    text = lambda: None if r.random() < 0.05 else " ".join(r.choice("abcdefghijk") * 2 for _ in range(r.randrange(0, 15)))
    left, right = [(i, text()) for i in range(60 if more else 20)], [(i, text()) for i in range(30)] + [(None, "aa bb cc dd")]
    x, y = (spark.createDataFrame(z, "key long, text string") for z in (left, right))
    words = X.tfidf_tokens(F.col("text"))
    bag = lambda z: (z or "").split()
    sets = {(i, j): (len(set(bag(s)) & set(bag(t))), len(set(bag(s))), len(set(bag(t)))) for i, s in left for j, t in right}
    found = J.jaccard_join(J.token_sets(x, words, "key"), J.token_sets(y, words, "key"), 0.3)
    assert {(z.a, z.b): (z.shared, z.na, z.nb) for z in found.collect()} == {k: v for k, v in sets.items() if v[0] and v[0] / (v[1] + v[2] - v[0]) >= 0.3}
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    found = J.overlap_join(J.token_sets(x, words, "key"), J.token_sets(y, words, "key"), 2, sizes=(len(left), len(right)))
    assert {(z.a, z.b): (z.shared, z.na, z.nb) for z in found.collect()} == {k: v for k, v in sets.items() if v[0] >= 2}
    bags = {(i, j): sum(min(bag(s).count(w), bag(t).count(w)) for w in set(bag(s))) for i, s in left for j, t in right}
    found = J.multiset_overlap(J.token_bags(x, words, "key"), J.token_bags(y, words, "key"))
    assert {(z.a, z.b): z.score for z in found.collect()} == {k: v for k, v in bags.items() if v > 1}
    weights = [spark.createDataFrame([(k, w, float(bag(t).count(w))) for k, t in z for w in set(bag(t))], "k long, term string, w double") for z in (left, right)]
    dots = {(i, j): sum(bag(s).count(w) * bag(t).count(w) for w in set(bag(s))) for i, s in left for j, t in right}
    assert {(z.a, z.b): z.score for z in J.cosine_between(*weights, 4, "k", "k").collect()} == {k: v for k, v in dots.items() if v >= 4}


def test_meet_deals_frequent_terms(spark, monkeypatch):
    monkeypatch.setattr(J, "CELL", 3)
    left = [(i, "xyz"[i % 3] if i % 7 else "q") for i in range(40)]
    right = [(i, "xyw"[i % 3]) for i in range(30)]
    x, y = spark.createDataFrame(left, "a long, term string"), spark.createDataFrame(right, "b long, term string")
    got = sorted((r.a, r.b, r.term) for r in J.meet(x, y, "term", "a", "b").collect())
    assert got == sorted((a, b, t) for a, t in left for b, u in right if t == u)


def test_candidate_pairs_come_once_and_without_a_shuffle_of_pairs(spark, names, monkeypatch):
    monkeypatch.setattr(J, "CELL", 5)
    rows = [(i, x, f"s{i % 4}") for i, x in enumerate(names)] + [(0, names[0], "s0"), (900, "plan of the data", None), (901, "PLAN of the data ", "The S1 Act"), (902, None, "s2")]
    df = spark.createDataFrame(rows, "id long, name string, source string")
    found = J.candidate_pairs(df, df)
    one = df.distinct()
    side = lambda p: one.select(*[F.col(c).alias(f"{p}_{c}") for c in one.columns])
    words = lambda p: X.tfidf_tokens(F.col(f"{p}_name"))
    every = side("a").crossJoin(side("b")).where(F.arrays_overlap(words("a"), words("b")))
    every = every.where(~X.same_source(F.col("a_source"), F.col("b_source")) & ~X.same_component(F.col("a_name"), F.col("b_name")))
    got = sorted(map(repr, found.select(*every.columns).collect()))
    assert got == sorted(map(repr, every.collect())) and len(got) > 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not plan[: plan.index("Join")].count("Aggregate")


def test_closeness_has_no_end_of_its_own(spark):
    edges = spark.createDataFrame([(f"n{i}", "r", f"n{i + 1}") for i in range(9)] + [("x", "r", "y")], "src string, rel_type string, dst string")
    pairs = spark.createDataFrame([("n0", "n9"), ("n3", "n3"), ("n0", "x"), ("n9", "n7")], "a string, b string")
    got = {(r.a, r.b): r.closeness for r in G.closeness(edges, pairs).collect()}
    assert got == {("n0", "n9"): 0.1, ("n3", "n3"): 1.0, ("n0", "x"): 0.0, ("n9", "n7"): 1 / 3}


def test_closeness_on_random_nets_and_leaves(spark):
    r = random.Random(4)
    net = [(f"c{i}", f"c{r.randrange(12)}") for i in range(12)] + [(f"l{i}", f"c{r.randrange(5)}") for i in range(30)] + [(f"m{i}", f"l{r.randrange(6)}") for i in range(8)] + [("p", "q"), ("z", "z")]
    near: dict = {}
    for a, b in net:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    names = [*near, "nowhere"]
    want = {}
    for a in names:
        far, front = {a: 0}, [a]
        while front:
            front = [y for x in front for y in near.get(x, ()) if y not in far and not far.update({y: far[x] + 1})]
        want |= {(a, b): 1 / (far[b] + 1) if b in far else 0.0 for b in names}
    edges = spark.createDataFrame([(a, "r", b) for a, b in net], "src string, rel_type string, dst string")
    pairs = spark.createDataFrame([*want, (None, "p")], "a string, b string")
    got = {(x.a, x.b): x.closeness for x in G.closeness(edges, pairs).collect()}
    assert got == want | {(None, "p"): 0.0}
    assert {(x.a, x.b): x.closeness for x in G.closeness(edges, pairs, 3).collect()} == {k: v if v >= 0.25 else 0.0 for k, v in got.items()}


def test_closeness_does_not_walk_from_leaves(spark, monkeypatch):
    walked, walk = [], G._walked
    monkeypatch.setattr(G, "_walked", lambda net, pairs, *more: walked.append(pairs.count()) or walk(net, pairs, *more))
    edges = spark.createDataFrame([(f"h{i % 3}", "r", f"l{i}") for i in range(60)] + [("h0", "r", "h1"), ("h1", "r", "h2"), ("h2", "r", "h0")], "src string, rel_type string, dst string")
    pairs = spark.createDataFrame([(f"l{i}", f"l{i + 1}") for i in range(59)], "a string, b string")
    assert {x.closeness for x in G.closeness(edges, pairs).collect()} == {0.25} and walked == [3]


def test_broken_chains_by_deadline(spark):
    rows = [(1, ["A"], "January 1, 2025"), (2, ["B"], "June 1, 2025"), (3, ["C"], "January 20, 2025"), (4, ["D"], "May 1, 2027"), (5, ["A"], None)]
    c = spark.createDataFrame(rows, "id long, agencies array<string>, deadline string")
    a = spark.createDataFrame([(3, 2)], "src long, dst long")
    assert {(r.a, r.b) for r in E.broken_chains(c, a).collect()} == {(1, 2), (1, 5)}


def test_clauses_and_components_of_english_texts(spark):
    text = "Sec. 1. The agency shall submit a report on funding within 30 days. It is sunny today and the sky is blue.\nThe Secretary must establish a data plan under 5 U.S.C. 552 for all programs."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = E.clauses(docs, "C").collect()
    assert {r.doc_id for r in found} == {1} and all("shall" in r.sentence or "must" in r.sentence for r in found) and any(r.citations for r in found)
    assert E.componentise(docs).where("doc_id = 1").count() >= 1
    parts = E.section_components(E.split_sections(docs, "Sec(?:tion|\\.)\\s+\\d+\\.")).collect()
    assert parts and all(len(r.description) >= 20 and len(r.name) <= 50 for r in parts)


def test_mean_of_first(spark):
    left = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, ["c"])], "pos long, words array<string>")
    right = spark.createDataFrame([(1, ["a"]), (2, ["b", "a"])], "pos long, words array<string>")
    assert C.mean_of_first(left, right, 3).first()["mean"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert C.mean_of_first(left, right.limit(0), 3).first()["mean"] == 0.0
