"""Similarity joins, lookups and graph operators over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import extract as E
from ..operators import graph as G
from ..operators import joins as J
from ..operators import models as M
from ..operators import quality as V
from ..operators import records as R
from ..operators import vectors as N
from ..sources import readers, writers
from ..streaming.incremental import remaining
from .registry import query

_RE = "[\\p{L}\\p{N}_]{2,}"


def _tfidf_sql(name: str, table: str, key: str, fit: str | None = None) -> str:
    """Common table expressions for the TF-IDF weights of a table; fit names another table's term CTE for idf."""
    return f"""
{name}_t AS (SELECT {key} AS k, unnest(regexp_extract_all(lower(coalesce(text, '')), '{_RE}')) AS term FROM {table}),
{name}_f AS (SELECT k, term, count(*) AS tf FROM {name}_t GROUP BY ALL),
{name}_d AS (SELECT term, count(DISTINCT k) AS df FROM {fit or name + '_t'} GROUP BY term),
{name}_n AS (SELECT count(DISTINCT {'k' if fit else key}) AS n FROM {fit or table}),
{name}_x AS (SELECT k, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM {name}_f JOIN {name}_d USING (term), {name}_n),
{name}_w AS (SELECT k, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS w FROM {name}_x)"""


def _weights(t):
    return J.tfidf(t.documents, X.tfidf_tokens(F.col("text")))


@query("m01_tfidf", f"WITH {_tfidf_sql('d', 'documents', 'doc_id')} SELECT k AS doc_id, term, round(w, 6) AS w FROM d_w")
def _(t):
    return _weights(t).select("doc_id", "term", F.round("w", 6).alias("w"))


@query("j04_tfidf_similarity_join", f"""
WITH {_tfidf_sql('d', 'documents', 'doc_id')},
p AS (SELECT a.k AS a, b.k AS b, sum(a.w * b.w) AS s FROM d_w a JOIN d_w b ON a.term = b.term AND a.k < b.k GROUP BY ALL HAVING sum(a.w * b.w) >= 0.6),
q AS (SELECT p.*, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.source <> y.source)
SELECT a, b, round(s, 4) AS score, CASE WHEN s >= 0.8 THEN 'High' ELSE 'Medium' END AS bucket, rank FROM q WHERE rank <= 3""")
def j04(t):
    """The flagship: TF-IDF cosine join of documents of different sources, bucketed, three best partners each."""
    src = t.documents.select("doc_id", "source")
    pairs = J.tfidf_join(t.documents, X.tfidf_tokens(F.col("text")), 0.6).withColumn("score", F.round("score", 9))
    pairs = pairs.join(src.select(F.col("doc_id").alias("a"), F.col("source").alias("sa")), "a").join(src.select(F.col("doc_id").alias("b"), F.col("source").alias("sb")), "b").where("sa != sb")
    return J.top_k(pairs, 3).select("a", "b", F.round("score", 4).alias("score"), S.confidence_bucket(F.col("score")).alias("bucket"), "rank")


_BOTH = f"""
WITH u AS (SELECT doc_id AS k, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark), {_tfidf_sql('u', 'u', 'k')},
p AS (SELECT -1 - a.k AS a, b.k AS b, sum(a.w * b.w) AS s FROM u_w a JOIN u_w b ON a.term = b.term AND a.k < 0 AND b.k >= 0 GROUP BY ALL)"""


def _sizes(t):
    return t.benchmark.count(), t.documents.count()


def _between(t, threshold):
    both = t.documents.select(F.col("doc_id").alias("k"), "text").unionByName(t.benchmark.select((-1 - F.col("item_id")).alias("k"), "text"))
    w = J.tfidf(both, X.tfidf_tokens(F.col("text")), key="k")
    left = w.where("k < 0").withColumn("k", -1 - F.col("k"))
    return J.cosine_between(left, w.where("k >= 0"), threshold, "k", "k", _sizes(t))


@query("j05_top_k_join", _BOTH + " SELECT a, b, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM p WHERE s >= 0.08) WHERE r <= 5")
def _(t):
    return J.top_k(_between(t, 0.08).withColumn("score", F.round("score", 9)), 5).select("a", "b", F.round("score", 6).alias("score"))


@query("j33_threshold_join", _BOTH + " SELECT a, b, round(s, 6) AS score FROM p WHERE s >= 0.2")
def _(t):
    return _between(t, 0.2).select("a", "b", F.round("score", 6).alias("score"))


@query("f10_curation", _BOTH + " SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS r FROM p JOIN documents d ON d.doc_id = b WHERE s >= 0.14 AND length(d.text) >= 100) WHERE r <= 2")
def _(t):
    long = t.documents.where(F.char_length("text") >= 100).select(F.col("doc_id").alias("b"))
    return J.top_k(_between(t, 0.14).join(long, "b").withColumn("score", F.round("score", 9)), 2).select("a", "b")


_SETS = f"""
WITH d AS (SELECT doc_id AS k, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_RE}')) AS ws FROM documents),
i AS (SELECT item_id AS k, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '{_RE}')) AS ws FROM benchmark),
p AS (SELECT i.k AS a, d.k AS b, len(list_intersect(i.ws, d.ws)) AS shared, len(i.ws) AS na, len(d.ws) AS nb FROM i, d)"""


def _overlap(t):
    words = X.tfidf_tokens(F.col("text"))
    return J.token_sets(t.benchmark, words, "item_id"), J.token_sets(t.documents, words, "doc_id")


@query("j08_best_match", _SETS + " SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY shared / (na + nb - shared) DESC, b) AS r FROM p WHERE shared / (na + nb - shared) >= 0.05) WHERE r = 1")
def _(t):
    return J.top_k(J.jaccard_join(*_overlap(t), 0.05, _sizes(t)), 1).select("a", "b")


@query("j12_jaccard_join", _SETS + " SELECT a, b, shared, na - shared AS left_only, nb - shared AS right_only, round(shared / (na + nb - shared), 6) AS score FROM p WHERE shared / (na + nb - shared) >= 0.1")
def _(t):
    j = J.jaccard_join(*_overlap(t), 0.1, _sizes(t))
    return j.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("left_only"), (F.col("nb") - F.col("shared")).alias("right_only"), F.round("score", 6).alias("score"))


@query("j14_j31_overlap", _SETS + " SELECT a, b, shared FROM p WHERE shared >= 2")
def _(t):
    return J.overlap_join(*_overlap(t), 2, sizes=_sizes(t)).select("a", "b", "shared")


@query("j13_multiset_overlap", f"""
WITH d AS (SELECT k, w, count(*) AS c FROM (SELECT doc_id AS k, unnest(regexp_extract_all(lower(text), '{_RE}')) AS w FROM documents) GROUP BY ALL),
i AS (SELECT k, w, count(*) AS c FROM (SELECT item_id AS k, unnest(regexp_extract_all(lower(text), '{_RE}')) AS w FROM benchmark) GROUP BY ALL)
SELECT i.k AS a, d.k AS b, sum(least(i.c, d.c)) AS score FROM i JOIN d USING (w) GROUP BY ALL HAVING sum(least(i.c, d.c)) > 1""")
def _(t):
    words = X.tfidf_tokens(F.col("text"))
    return J.multiset_overlap(J.token_bags(t.benchmark, words, "item_id"), J.token_bags(t.documents, words, "doc_id"), _sizes(t))


@query("j15_traits", _SETS + " SELECT a, b, round(0.7 * shared / (na + nb - shared) + 0.3 * 0.5, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared / (na + nb - shared) DESC, b) AS r FROM p WHERE shared > 0 AND 0.7 * shared / (na + nb - shared) + 0.15 >= 0.2003) WHERE r <= 3")
def _(t):
    # The traits give 0.15, so scores from 0.2003 on need a Jaccard above 0.07.
    p = J.overlap_join(*_overlap(t), least=0.07, sizes=_sizes(t)).withColumn("j", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    none = F.array().cast("array<string>")
    p = p.withColumn("score", 0.7 * F.col("j") + 0.3 * S.trait_signal(F.array(F.lit("x")), none, none)).where("score >= 0.2003")
    return J.top_k(p, 3, score="j").select("a", "b", F.round("score", 6).alias("score"))


@query("j07_s35_vector_search", "SELECT query, id, round(s, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank FROM (SELECT a.vec_id AS query, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id % 50 = 0)) WHERE rank <= 3")
def _(t):
    return N.vector_search(t.embeddings.where("vec_id % 50 = 0"), t.embeddings, 3).select("query", "id", F.round("score", 5).alias("score"), "rank")


@query("j32_cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.40001")
def _(t):
    return N.cosine_pairs(t.embeddings, 0.40001).select("a", "b", F.round("score", 5).alias("score"))


@query("m05_unit_cosine", "SELECT a.vec_id AS a, b.vec_id AS b, round((list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2, 5) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(t):
    x, y = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), t.embeddings.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("y"))
    return x.join(y, "a").select("a", "b", F.round(S.unit_cosine(F.col("x"), F.col("y")), 5).alias("score"))


@query("m12_jaccard", "SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS j FROM (SELECT p_partkey, string_split(lower(p_name), ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)")
def _(t):
    return t.part.select("p_partkey", F.round(S.jaccard(F.split(F.lower("p_name"), " "), F.split(F.lower("p_type"), " ")), 6).alias("j"))


@query("j01_j02_candidates", """
WITH s AS (SELECT s_suppkey AS id, s_name AS name, s_nationkey::VARCHAR AS source FROM supplier)
SELECT a.id AS a_id, b.id AS b_id FROM s a, s b WHERE lower(a.source) <> lower(b.source) AND lower(a.name) <> lower(b.name) AND len(list_intersect(regexp_extract_all(lower(a.name), '[\\p{L}\\p{N}_]{2,}'), regexp_extract_all(lower(b.name), '[\\p{L}\\p{N}_]{2,}'))) > 0""")
def _(t):
    s = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("source"))
    return J.candidate_pairs(s, s).select("a_id", "b_id")


@query("j03_p25_directed_pairs", """
WITH p AS (SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey)
SELECT x AS enabling_id, y AS dependent_id, 'A->B' AS direction FROM p UNION ALL SELECT y, x, 'B->A' FROM p""")
def _(t):
    p = J.unordered_pairs(t.supplier.select(F.col("s_suppkey").alias("id"), "s_nationkey"), "id", ["s_nationkey"])
    return J.directed_pairs(p.select(F.col("A_id").alias("a_id"), F.col("B_id").alias("b_id")), ["id"]).select("enabling_id", "dependent_id", "direction")


@query("j16_j17_denormalise", """
SELECT l_orderkey, l_linenumber, p_name AS enabling_name, s_name AS dependent_name, sn.n_name AS dependent_source FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation sn ON s_nationkey = sn.n_nationkey""")
def _(t):
    c = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("component_id"), F.col("p_name").alias("name"), F.lit(None).cast("string").alias("source_id"))
    c = c.unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("component_id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("source_id")))
    a = t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), "l_partkey").alias("enabling_component_id"), F.concat(F.lit("s"), "l_suppkey").alias("dependent_component_id"))
    d = J.denormalise(a, c, t.nation.select(F.col("n_nationkey").cast("string").alias("source_id"), F.col("n_name").alias("source")))
    return d.select("l_orderkey", "l_linenumber", "enabling_name", "dependent_name", "dependent_source")


@query("j18_j19_key_joins", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("j20_j21_last_value", "SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def _(t):
    return J.last_value(t.orders, "o_custkey", "o_orderpriority", "o_orderkey")


@query("j22_backfill", "WITH e AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS p FROM orders), k AS (SELECT o_custkey, arg_max(p, o_orderkey) FILTER (p IS NOT NULL) AS q FROM e GROUP BY 1) SELECT o_orderkey, coalesce(p, q) AS p FROM e LEFT JOIN k USING (o_custkey)")
def _(t):
    e = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("p"))
    return J.backfill(e, "o_custkey", "p", "o_orderkey").select("o_orderkey", "p")


@query("j23_by_priority", "SELECT s_nationkey AS k, 'supplier' AS kind, count(*) > 0 AS x FROM supplier GROUP BY 1 UNION ALL SELECT n_nationkey, 'nation', true FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def _(t):
    one = t.supplier.select(F.col("s_nationkey").alias("k")).distinct().withColumn("kind", F.lit("supplier"))
    return J.by_priority([one, t.nation.select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("kind"))], "k").withColumn("x", F.lit(True))


@query("j24_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("j26_j27_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(t):
    return remaining(t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("d06_block_keys", "SELECT p_partkey, '0|' || left(lower(p_name), 12) || '|' || left(lower(p_type), 12) AS head, '1|' || string_split(lower(p_name), ' ')[1] || '|' || string_split(lower(p_type), ' ')[1] AS first, '2|' || left(lower(p_name), 5) || '|' || left(lower(p_type), 5) AS short FROM part")
def _(t):
    keys = J.block_keys(X.squash(F.col("p_type")), X.squash(F.col("p_name")))
    return t.part.select("p_partkey", *[F.get(keys, i).alias(n) for i, n in enumerate(("head", "first", "short"))])


@query("j29_two_hop", "SELECT DISTINCT a.l_partkey AS part FROM lineitem a JOIN lineitem b USING (l_partkey) WHERE a.l_suppkey = 1 AND b.l_suppkey = 2")
def _(t):
    e = t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.lit("BOUND_BY").alias("rel_type"), F.col("l_partkey").alias("dst"))
    return G.shared_obligations(e, "s1", "s2").select(F.col("provision").alias("part"))


@query("v15_exceptions", """
SELECT 'same_source' AS kind, l_suppkey || '->' || l_partkey AS id FROM lineitem WHERE l_suppkey % 5 = l_partkey % 5
UNION ALL SELECT 'high_score_not_confirmed', l_suppkey || '->' || l_partkey FROM lineitem WHERE l_discount >= 0.07 AND l_returnflag <> 'R'
UNION ALL SELECT 'orphan', p_partkey::VARCHAR FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) AND p_partkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def _(t):
    a = t.lineitem.select(F.col("l_suppkey").alias("enabling_component_id"), F.col("l_partkey").alias("dependent_component_id"), (F.col("l_suppkey") % 5).alias("enabling_source"), (F.col("l_partkey") % 5).alias("dependent_source"), (F.col("l_discount") * 10).alias("score"), F.when(F.col("l_returnflag") == "R", "Confirmed").otherwise("x").alias("bucket"))
    r = V.exception_report(a.withColumn("score", F.round("score", 6)), t.part.select(F.col("p_partkey").alias("component_id")))
    return r.select("kind", F.col("id").cast("string").alias("id"))


@query("v19_output_verification", "SELECT count(*) AS rows, 0 AS self_matches, count(*) FILTER (a.s_nationkey = b.s_nationkey) AS same_source, 0 AS related_source, count(*) FILTER (a.s_suppkey % 10 >= 8) AS high, count(*) FILTER (a.s_suppkey % 10 IN (6, 7)) AS medium, count(*) FILTER (a.s_suppkey % 10 < 6) AS low FROM supplier a JOIN supplier b ON a.s_suppkey + 1 = b.s_suppkey")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a_name"), F.col("s_nationkey").cast("string").alias("a_source"))
    b = t.supplier.select((F.col("s_suppkey") - 1).alias("k"), F.col("s_name").alias("b_name"), F.col("s_nationkey").cast("string").alias("b_source"))
    return V.output_verification(a.join(b, "k").withColumn("score", F.round(F.col("k") % 10 / 10, 6))).drop("mean_score")


# ---- graph ------------------------------------------------------------------------------------------------
_EDGES = "SELECT 'R' || n_regionkey AS src, 'PARENT_OF' AS rel_type, 'N' || n_nationkey AS dst FROM nation UNION ALL SELECT 'N' || c_nationkey, 'PARENT_OF', 'C' || c_custkey FROM customer UNION ALL SELECT 'N' || s_nationkey, 'PARENT_OF', 'S' || s_suppkey FROM supplier"


def _edges(t):
    e = lambda df, p, a, q, b: df.select(F.concat(F.lit(p), a).alias("src"), F.lit("PARENT_OF").alias("rel_type"), F.concat(F.lit(q), b).alias("dst"))
    return e(t.nation, "R", "n_regionkey", "N", "n_nationkey").unionByName(e(t.customer, "N", "c_nationkey", "C", "c_custkey")).unionByName(e(t.supplier, "N", "s_nationkey", "S", "s_suppkey"))


@query("g01_g04_walk", f"WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT src AS start, dst AS node, 1 AS hops FROM e WHERE src LIKE 'R%' UNION ALL SELECT w.start, e.dst, hops + 1 FROM w JOIN e ON e.src = w.node) SELECT start, node, hops FROM w")
def _(t):
    return G.walk(_edges(t), t.region.select(F.concat(F.lit("R"), "r_regionkey").alias("id")), ["PARENT_OF"]).select("start", "node", "hops")


@query("g02_ancestors", f"WITH RECURSIVE e AS ({_EDGES}), w AS (SELECT dst AS start, src AS node, 1 AS hops FROM e WHERE dst LIKE 'S%' UNION ALL SELECT w.start, e.src, hops + 1 FROM w JOIN e ON e.dst = w.node) SELECT start, node, hops FROM w")
def _(t):
    return G.walk(_edges(t), t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("id")), reverse=True).select("start", "node", "hops")


@query("g05_closeness", """
WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT 'S' || a.s_suppkey AS a, 'S' || b.s_suppkey AS b, CASE WHEN a.s_nationkey = b.s_nationkey THEN 1 / 3.0::DOUBLE WHEN a.n_regionkey = b.n_regionkey THEN 1 / 5.0::DOUBLE ELSE 0 END AS closeness FROM s a JOIN s b ON b.s_suppkey = a.s_suppkey + 1""")
def _(t):
    p = t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("a"), F.concat(F.lit("S"), F.col("s_suppkey") + 1).alias("b")).join(t.supplier.select(F.concat(F.lit("S"), "s_suppkey").alias("b")), "b", "left_semi")
    return G.closeness(_edges(t), p).select("a", "b", "closeness")


@query("g06_undirected", f"WITH e AS ({_EDGES}) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def _(t):
    return G.undirected(_edges(t))


_AL = "SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem"


def _alignments(t):
    return t.lineitem.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


@query("a20_g07_cousins", f"""
WITH e AS ({_AL}), n AS (SELECT src, count(*) AS n FROM e GROUP BY 1), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, common, na.n - common AS only_a, nb.n - common AS only_b FROM c JOIN n na ON na.src = a JOIN n nb ON nb.src = b""")
def _(t):
    return G.cousins(_alignments(t), 3)


@query("a20_g07_shared_targets", f"""
WITH e AS ({_AL}), s AS (SELECT src, list_sort(list(dst)) AS t FROM e GROUP BY src), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, common, md5(array_to_string([z FOR z IN x.t IF list_contains(y.t, z)], ',')) AS both, md5(array_to_string([z FOR z IN x.t IF NOT list_contains(y.t, z)], ',')) AS of_a FROM c JOIN s x ON x.src = a JOIN s y ON y.src = b""")
def _(t):
    named = G.cousins(_alignments(t), 3, named=True, rest=True)
    return named.select("a", "b", "common", F.md5(F.array_join("common_targets", ",")).alias("both"), F.md5(F.array_join("targets_of_a", ",")).alias("of_a"))


@query("g08_cousins_of_other_sources", f"""
WITH e AS ({_AL}), c AS (SELECT x.src AS a, y.src AS b, count(*) AS common FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src GROUP BY ALL HAVING count(*) >= 3)
SELECT a, b, common FROM c JOIN supplier sa ON 's' || sa.s_suppkey = a JOIN supplier sb ON 's' || sb.s_suppkey = b WHERE sa.s_nationkey <> sb.s_nationkey""")
def _(t):
    s = t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("source"))
    return G.cousins(_alignments(t), 3, s).select("a", "b", "common")


@query("g09_g15_chains", f"""
WITH e AS ({_EDGES}), p AS (SELECT [x.src, x.dst, y.dst] AS path FROM e x JOIN e y ON y.src = x.dst)
SELECT array_to_string(path, '>') AS path, i - 1 AS position, path[i] AS src, path[i + 1] AS dst FROM p, (VALUES (1), (2)) v(i)""")
def _(t):
    return G.chains(_edges(t)).select(F.array_join("path", ">").alias("path"), "position", "src", "dst")


@query("g16_g17_edge_list", f"SELECT DISTINCT * FROM ({_EDGES})")
def _(t):
    return G.edge_list(_edges(t), ["PARENT_OF"])


@query("g18_section_parents", """
WITH s AS (SELECT l_orderkey AS doc, l_linenumber AS pos, (l_quantity::INT % 3) AS level FROM lineitem WHERE l_linenumber IS NOT NULL), d AS (SELECT doc, pos, max(level) AS level FROM s GROUP BY ALL)
SELECT doc, pos, (SELECT max(p.pos) FROM d p WHERE p.doc = d.doc AND p.pos < d.pos AND p.level < d.level) AS parent_pos FROM d""")
def _(t):
    s = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).agg(F.max(F.col("l_quantity").cast("int") % 3).alias("level"))
    return G.section_parents(s).select("doc", "pos", "parent_pos")


@query("k01_sheets", "SELECT o_orderkey, o_orderpriority, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS sheet, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1000 + 1 AS row FROM orders")
def _(t):
    return writers.sheets(t.orders.select("o_orderkey", "o_orderpriority"), "o_orderkey", rows=1000)


@query("k13_pair_report")
def _(t):
    return writers.pair_report(_between(t, 0.2))


@query("a28_w17_best_and_rest", _BOTH + " SELECT a, b, rank, more FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(s, 9) DESC, b) AS rank, greatest(count(*) OVER (PARTITION BY a) - 3, 0) AS more FROM p WHERE s >= 0.1) WHERE rank <= 3")
def _(t):
    return writers.best_and_rest(_between(t, 0.1).withColumn("score", F.round("score", 9))).select("a", "b", "rank", "more")


@query("s26_t04_discovered_links")
def _(t):
    from ..streaming.incremental import discovered_links

    return discovered_links(t.pages.select("page_id", F.concat(F.lit('<a href="https://www.usa.gov/'), "page_id", F.lit('">'), "html").alias("html")), t.pages.where("page_id % 2 = 0").select(F.concat(F.lit("https://www.usa.gov/"), "page_id").alias("url")))


@query("e24_rationales", "SELECT p_partkey, 'risk' AS rationale FROM part WHERE p_partkey % 3 = 0")
def _(t):
    return E.rationales(t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "a high-impact thing").otherwise("none").alias("req"), F.lit("critical").alias("txt")), "req", "txt").select("p_partkey", "rationale")


@query("e27_page_ranges", "SELECT l_orderkey AS doc_id, l_linenumber AS first_page, greatest(l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1) AS last_page FROM lineitem")
def _(t):
    b = t.lineitem.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").alias("title"))
    return E.page_ranges(b).select("doc_id", "first_page", "last_page")


@query("m22_m24_alignment_model")
def _(t):
    k = F.col("l_partkey")
    p = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("similarity"), (1 / (k % 4 + 1)).alias("closeness"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("label"))
    return M.infer(M.train_alignment(p), p, 0.5)


@query("m25_m26_text_model")
def _(t):
    d = t.documents.join(t.labels.select("doc_id", F.col("quality").alias("label")), "doc_id").select("doc_id", "text", "label")
    return M.predict_text(M.train_text(d), t.documents.select("doc_id", "text")).select("doc_id", "probability_1")


@query("p10_p13_output_order", "SELECT '' AS missing, p_name, p_partkey FROM part")
def _(t):
    return R.with_columns_in_order(t.part.select("p_partkey", "p_name"), ["missing", "p_name"], rest=True)


@query("s06_s09_defaults", "SELECT 'COMP-' || p_partkey AS component_id, coalesce(p_name, 'Unnamed component') AS name, 'Unknown source' AS source FROM part")
def _(t):
    return readers.components_with_defaults(t.part.select("p_partkey", F.lit("nan").alias("component_id"), F.col("p_name").alias("name"), F.lit(" ").alias("source")), "p_partkey")
