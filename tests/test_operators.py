"""Operators on small hand-made tables: the cases that the stand-in tables do not show."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from clauseloom.functions import fuzzy
from clauseloom.functions import similarity as S
from clauseloom.functions import text as X
from clauseloom.operators import extract as E
from clauseloom.operators import graph as G
from clauseloom.operators import joins as J
from clauseloom.operators import quality as V
from clauseloom.operators import records as R
from clauseloom.sources import readers, writers
from clauseloom.streaming import incremental as I


def one(spark, make, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("v")).first()["v"]


# Governance lineage: two clauses, statutes, a title, a memorandum with directives.
CONST1, CONST3 = "CONST_ART1_S8_CL1", "CONST_ART1_S8_CL3"
DIRECTIVES = ["DR3130-010", "DR3145-001", "DR3105-001", "DR3600-002", "DR3650-001"]
EDGES = (
    [("31_USC_901B", "DERIVES_FROM_Provision", CONST1), ("44_USC_3502_1", "DERIVES_FROM_Provision", CONST1), ("40_USC_11103_A", "DERIVES_FROM_Provision", CONST3)]
    + [("M1", "DERIVES_FROM", s) for s in ("31_USC_901B", "44_USC_3502_1", "40_USC_11103_A")]
    + [("M1", "DERIVES_FROM_Doc", f"EO_{n}") for n in (13833, 14240, 14243, 14271)]
    + [("M1", "IMPLEMENTED_BY_Doc", d) for d in DIRECTIVES]
    + [("USC_T5", "PARENT_OF_Provision", "USC_T5_CH83"), ("USC_T5", "PARENT_OF_Provision", "USC_T5_CH84"), ("USC_T5_CH83", "PARENT_OF_Provision", "USC_8336")]
    + [("USC_T5_CH84", "PARENT_OF_Provision", s) for s in ("USC_8412", "USC_8414", "USC_8461")]
    + [(s, "DERIVES_FROM_Provision", CONST1) for s in ("USC_8336", "USC_8412", "USC_8414", "USC_8461")]
    + [(s, "DERIVES_FROM_Provision", CONST3) for s in ("USC_8412", "USC_8414")]
    + [(i, "BOUND_BY", p) for i in ("OPM", "AGENCY") for p in ("USC_8336", "USC_8412", "USC_8414", "USC_8461", "CFR_5_831", "CFR_5_841", "CFR_5_842", "CFR_5_846")]
    + [("CIO", "BOUND_BY_Doc", d) for d in DIRECTIVES[:3]]
    + [(d, "IN_CATEGORY", c) for d, c in (("DR3105-001", "3100"), ("DR3107-001", "3100"), ("DR3111-001", "3100"), ("DR3130-010", "3130"), ("DR3145-001", "3130"), ("DR3600-002", "3000-3900"), ("DR3650-001", "3000-3900"))]
)
CODES = {"DR3105-001": "3100", "DR3107-001": "3100", "DR3111-001": "3100", "DR3130-010": "3130", "DR3145-001": "3130", "DR3600-002": "3600", "DR3650-001": "3650"}


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, rel_type string, dst string").cache()


def start(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_lineage(spark, edges):
    assert {r.node for r in G.walk(edges, start(spark, "USC_8412"), ["PARENT_OF_Provision"], reverse=True).collect()} == {"USC_T5_CH84", "USC_T5"}
    both = ["DERIVES_FROM_Provision", "PARENT_OF_Provision"]
    assert G.walk(edges, start(spark, "USC_8412"), both).where("node like 'CONST%'").count() == 2
    assert G.walk(edges, start(spark, "USC_T5"), both).where("node like 'CONST%'").count() == 6  # one row a path
    assert G.lineage(edges, "M1").count() == 35
    assert G.shared_obligations(edges, "OPM", "AGENCY").count() == 8
    assert G.bound_provisions(edges, "AGENCY").count() == 8
    assert G.targets(edges, "IMPLEMENTED_BY_Doc", "M1").count() == 5
    assert G.targets(edges, "BOUND_BY_Doc", "CIO").count() == 3


def test_influence(spark, edges):
    docs = spark.createDataFrame([(d, "Directive", c) for d, c in CODES.items()], "id string, type string, categoryCode string")
    got = [(r.id, r.influence, r.kind) for r in G.influence(edges, docs, "M1", "Directive", ["3100", "3130", "3000-3900"]).collect()]
    assert got == [("DR3105-001", 3, "Direct"), ("DR3130-010", 3, "Direct"), ("DR3145-001", 3, "Direct"), ("DR3600-002", 2, "Direct"), ("DR3650-001", 2, "Direct"), ("DR3107-001", 1, "Category"), ("DR3111-001", 1, "Category")]


def test_walk_ends_in_cycles(spark):
    e = spark.createDataFrame([("a", "x", "b"), ("b", "x", "a")], "src string, rel_type string, dst string")
    assert G.walk(e, start(spark, "a")).count() == 2


def test_walk_has_no_end_before_the_last_hop(spark):
    e = spark.createDataFrame([(f"n{i:02}", "PARENT_OF", f"n{i + 1:02}") for i in range(23)], "src string, rel_type string, dst string")
    got = G.walk(e, spark.createDataFrame([("n00",)], "id string"))
    assert sorted(r.hops for r in got.collect()) == list(range(1, 24))


def test_cosine_join_is_exact(spark):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"]) for _ in range(r.randint(1, 6)))) for i in range(60)] + [(99, None), (98, "")], "doc_id long, text string")
    w = J.tfidf(docs, X.tfidf_tokens(F.col("text"))).cache()
    x, y = w.select(F.col("doc_id").alias("a"), "term", F.col("w").alias("p")), w.select(F.col("doc_id").alias("b"), "term", F.col("w").alias("q"))
    every = x.join(y, "term").where("a < b").groupBy("a", "b").agg(F.sum(F.expr("p * q")).alias("s")).where("s >= 0.7")
    assert {(r.a, r.b) for r in J.cosine_join(w, 0.7).collect()} == {(r.a, r.b) for r in every.collect()}


def test_fuzzy():
    r = random.Random(2)
    for _ in range(100):
        a, b = ("".join(r.choice("abc ") for _ in range(r.randint(0, 12))) for _ in range(2))
        n, m = len(a), len(b)
        t = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert fuzzy.indel_ratio(a, b) == (2 * t[n][m] / (n + m) if n + m else 1.0)
        assert fuzzy.sequence_ratio(a, b) == difflib.SequenceMatcher(None, a, b).ratio()
    assert fuzzy.token_sort_ratio("b a", "a b") == 1.0
    assert fuzzy.token_set_ratio("a b", "a b c") == 1.0
    assert fuzzy.partial_ratio("abc", "xxabcxx") == 1.0


def test_text(spark):
    assert one(spark, X.canonical_citation, "5 U.S.C. § 552, E.O. 12866, eo 14240") == "5 USC 552, Executive Order 12866, Executive Order 14240"
    assert one(spark, X.citations, "See Executive Order 14240 and executive order 14240 and M-25-22.") == ["Executive Order 14240", "M-25-22"]
    assert one(spark, X.years, "Plan 2022-2026, FY24") == [2022, 2024, 2026]
    assert one(spark, lambda c: X.same_source(c, F.lit("X Directives")), "x instructions")
    assert one(spark, X.usable, " NaN ") is None
    assert one(spark, X.composite_id, "s", None) is None
    assert one(spark, X.policy_action, "The agency shall establish a new program office") == "Establish Office"
    assert one(spark, X.sentences, "Short. " + "This sentence is long enough to be kept, I think. No.") == ["This sentence is long enough to be kept, I think."]
    assert one(spark, X.mend_hyphens, "govern-\nment rules") == "government rules"


def test_extract(spark):
    s = "The Department of Energy shall submit a plan to reduce by 20 percent by March 1, 2026."
    assert one(spark, E.sentence_type, s) == "requirement"
    assert one(spark, E.deadline, s) == "March 1, 2026"
    assert one(spark, E.agencies, s)[0] == "Department of Energy"
    assert "percentage_target:20" in one(spark, E.metrics, s)
    docs = spark.createDataFrame([(1, "Sec. 1. Purpose. (a) One thing. (b) Two things. Sec. 2. End."), (2, None)], "doc_id long, text string")
    assert [r.component for r in E.order_sections(docs).orderBy("section", "part").collect()] == ["Purpose.", "(a) One thing.", "(b) Two things.", "End."]
    md = spark.createDataFrame([(1, "## A\n- x\n- y\n## B\n* z")], "doc_id long, text string")
    assert [(r.section, r.item) for r in E.bullets(md).orderBy("pos").collect()] == [("A", "x"), ("A", "y"), ("B", "z")]


def test_scores(spark):
    df = spark.createDataFrame([(0.80,), (0.79,), (0.50,), (0.49,)], "s double")
    assert [r.v for r in df.select(S.confidence_label(F.col("s")).alias("v")).collect()] == ["High", "Medium", "Medium", "Low"]
    with pytest.raises(Exception, match="between"):
        spark.createDataFrame([(1.5,)], "s double").select(S.confidence_label(F.col("s"))).collect()
    assert one(spark, lambda a, b: S.enabling_score(a, b), "provides data", "requires security access") > 0


def test_normalise_round_trip(spark):
    rows = [(1, "S1", "A", "short", "S2", "B", None), (2, "S1", "A", "a longer one", "S2", "B", "b"), (3, "S1", "A", "a longer two", None, "C", "c")]
    wide = spark.createDataFrame(rows, "rid int, enabling_source string, enabling_component string, enabling_description string, dependent_source string, dependent_component string, dependent_description string")
    n = R.normalise(wide, "rid")
    c = {r.component: (r.component_id, r.description) for r in n["components"].collect()}
    assert c == {"A": ("S1::A", "a longer one"), "B": ("S2::B", "b"), "C": (None, "c")}
    assert {r.rid for r in n["alignments"].collect()} == {2, 3}
    assert n["sources"].count() == 2


def test_package(spark):
    schema = "decision_question string, evidence_graph array<string>, authority_chain map<string,array<string>>, change_hypothesis string, impact_analysis map<string,array<string>>, alternatives array<string>, implementation_path array<string>, confidence struct<score:double,label:string>, source_trace array<string>"
    layers = {k: ["x"] for k in V.AUTHORITY_LAYERS}
    good = ("q", ["e"], layers, "h", {"a": ["b"]}, ["x", "y"], ["s"], (0.8, "High"), ["t"])
    bad = ("q", ["e"], {"statutory": ["x"]}, "h", {"a": ["b"]}, ["x"], ["s"], (0.8, "Low"), [])
    df = spark.createDataFrame([(good,), (bad,)], f"p struct<{', '.join(x.replace(' ', ':', 1) for x in schema.split(', '))}>")
    got = [len(r.v) for r in df.select(V.package_issues(F.col("p"), V.PACKAGE_FIELDS).alias("v")).collect()]
    assert got == [0, 7]


def test_incremental(spark, tmp_path):
    old = spark.createDataFrame([("a", "1")], "path string, hash string")
    now = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, content string")
    assert {(r.path, r.change) for r in I.changes(now, old).collect()} == {("a", "CHANGED"), ("b", "NEW")}
    now.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    I.change_stream(stream, str(tmp_path / "state"), str(tmp_path / "cp"), lambda df: seen.extend(r.path for r in df.collect())).awaitTermination()
    assert sorted(seen) == ["a", "b"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "inv.json").write_text('{"S1": [{"component": "a", "description": "d"}], "S2": []}')
    assert [tuple(r) for r in readers.json_inventory(spark, str(tmp_path / "inv.json")).collect()] == [("S1", "a", "d")]
    c = readers.Catalog({" Components ": spark.range(2)})
    assert c.get("components").count() == 2 and c.get("x") is None
    with pytest.raises(KeyError):
        c.first("x", "y")
    paths = writers.write_tables({"t": spark.range(3)}, str(tmp_path / "out"))
    assert spark.read.parquet(paths["t"]).count() == 3
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    e = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "z")], "src string, dst string")
    assert R.upsert_edges(e.limit(0), e, nodes).count() == 1


def test_columns():
    assert R.find_column(["Component Name", "URL"], ["component_name"]) == "Component Name"
    assert R.matching_column("Dependent Component", ["Enabling Source", "Dependent Source"]) == "Dependent Source"


def test_registered_models_have_the_default_sizes(spark, monkeypatch):
    from clauseloom.operators import models
    from clauseloom.plans import pair_queries, registry

    from .conftest import SF

    fitted = []
    for name in ("train_alignment", "train_text"):
        train = getattr(models, name)
        monkeypatch.setattr(pair_queries.M, name, lambda *a, _train=train, **k: fitted.append(_train(*a, **k)) or fitted[-1])
    registry.QUERIES["m22_m24_alignment_model"](spark, SF)
    registry.QUERIES["m25_m26_text_model"](spark, SF)
    forest, text = fitted
    assert forest.stages[-1].getNumTrees == 100
    assert text.stages[3].getOrDefault("vocabSize") == 10_000 and len(text.stages[3].vocabulary) > 2000


def test_discovery_of_pages_that_share_an_address(spark, tmp_path):
    from clauseloom.plans import record_queries, registry  # noqa: F401

    rows = [(0, "https://a.gov"), (1, "https://a.gov"), (4, None), (5, None), (8, "https://b.gov")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.status for r in registry.QUERIES["v23_v24_discovery"](spark, str(tmp_path)).collect()}
    assert got == {0: "KNOWN", 1: "NEW", 4: "KNOWN", 5: "NEW", 8: "KNOWN"}


def test_lineage_deals_its_product(spark, monkeypatch):
    from clauseloom.operators import joins

    monkeypatch.setattr(joins, "CELL", 3)
    edges = [("M", "IMPLEMENTED_BY_Doc", f"d{i}") for i in range(8)] * 2 + [("M", "DERIVES_FROM", f"s{i}") for i in range(7)] + [(f"s{i}", "DERIVES_FROM_Provision", f"CONST_{i % 2}") for i in range(7)] + [("M", "DERIVES_FROM_Doc", "E1"), ("N", "IMPLEMENTED_BY_Doc", "x")]
    found = G.lineage(spark.createDataFrame(edges, "src string, rel_type string, dst string"), "M")
    want = {(f"CONST_{i % 2}", f"s{i}", "M", f"d{j}") for i in range(7) for j in range(8)} | {("E1", "Executive Order", "M", f"d{j}") for j in range(8)}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "broadcast" not in plan.split("Relation")[0].lower()


def test_shared_targets_by_the_targets(spark):
    r = random.Random(8)
    links = sorted({(f"s{r.randrange(12)}", f"p{r.randrange(15)}") for _ in range(90)})
    e = spark.createDataFrame(links * 2, "src string, dst string")
    found = G.shared_targets(e, G.cousins(e, 2, named=True).select("a", "b", "common", "common_targets"))
    got = {(x.a, x.b): (x.common, x.common_targets, x.targets_of_a, x.targets_of_b) for x in found.collect()}
    of = {}
    for s, t in links:
        of.setdefault(s, set()).add(t)
    want = {(a, b): (len(of[a] & of[b]), sorted(of[a] & of[b]), sorted(of[a] - of[b]), sorted(of[b] - of[a])) for a in of for b in of if a < b and len(of[a] & of[b]) >= 2}
    assert got == want and len(want) > 20
    assert "array_intersect" not in found._jdf.queryExecution().optimizedPlan().toString()
