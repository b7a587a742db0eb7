"""Secret scan with multipart credential linking, in DataFrame functions only.

Base kinds are reported wherever they stand. Weak kinds (identifiers, secret-looking strings, endpoints)
are reported only where their complements stand within ``reach`` code points: a string needs an
identifier, an identifier needs a secret, an endpoint needs both. This is an interval join on (document, bin of
positions) whose semi joins keep at most one row a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, public_id, row_id

#: Kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "ident", "part", "endpoint")
#: Kind: pattern, group whose length counts, least length. Java and RE2 read them alike.
PATTERNS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"(AKIA[A-Z0-9]+)", 1, 20),
    "hex": (r"([0-9a-f]{24,})", 1, 24),
    "ident": (r"""((?i:client_?id|access_?key_?id|account_?id|user_?name))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)""", 2, 3),
    "part": (r"([A-Za-z0-9+/_=-]{20,})", 1, 20),
    # A scheme has at most 31 characters (of a longer run its end), so a long run of letters costs no more than its length.
    "endpoint": (r"((?:[a-z][a-z0-9+]{0,30}://[A-Za-z0-9._~:/?#@!$&()*+;=%-]+))", 1, 8),
}
_SPAN = "array<struct<kind:int,lo:int,hi:int>>"
CHUNK = 128


def spans_of(text: Column, kind: str) -> Column:
    """The kind's spans in code points, end exclusive: leftmost matches without overlap, short ones dropped."""
    pattern, group, least = PATTERNS[kind]
    number = KINDS.index(kind)
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("v"),
        F.split(text, pattern, -1).alias("gaps"),
    )

    def one(gap: Column, m: Column) -> Column:
        return F.struct(F.char_length(gap).alias("gap"), F.char_length(m).alias("own"))

    def long_enough(v: Column) -> Column:
        ok = F.char_length(v) >= least
        return ok & v.rlike("[0-9]") & v.rlike("[A-Za-z]") if kind == "part" else ok

    def chunks(s: Column) -> Column:
        """The matches with their lengths, ``CHUNK`` at a time: positions add up within a chunk and over the chunks, so the
        lists that grow by copying stay short."""
        n = F.size(s["m"])
        each = F.zip_with(F.zip_with(F.slice(s["gaps"], F.lit(1), n), s["m"], one), s["v"], lambda x, v: F.struct(x["gap"].alias("gap"), x["own"].alias("own"), long_enough(v).alias("ok")))
        return F.transform(F.array(each), lambda e: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda c: F.slice(e, c * CHUNK + 1, F.lit(CHUNK))))[0]

    def place(parts: Column) -> Column:
        sums = F.transform(parts, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["gap"] + x["own"]))
        none = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(sums, none, lambda a, x: F.struct((a["pos"] + x).alias("pos"), F.concat(a["out"], F.array(a["pos"])).alias("out")), lambda a: a["out"])

        def spans(c: Column, start: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                lo = a["pos"] + x["gap"]
                hi = lo + x["own"]
                span = F.array(F.struct(F.lit(number).alias("kind"), lo.alias("lo"), hi.alias("hi"))).cast(_SPAN)
                return F.struct(hi.alias("pos"), F.when(x["ok"], F.concat(a["out"], span)).otherwise(a["out"]).alias("out"))

            return F.aggregate(c, F.struct(start.alias("pos"), F.array().cast(_SPAN).alias("out")), step, lambda a: a["out"])

        return F.flatten(F.zip_with(parts, starts, spans))

    def of(s: Column) -> Column:
        return F.when(F.size(s["m"]) > 0, F.transform(F.array(chunks(s)), place)[0])

    return F.coalesce(F.when(text.rlike(pattern), F.transform(F.array(found), of)[0]), F.array().cast(_SPAN))


def _text_of(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["lo"].alias("lo"), s["kind"].alias("kind"), s["hi"].alias("hi"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["lo"].cast("string"), s["hi"].cast("string"))), ",")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    A null text counts as empty and has no spans. Rows that repeat both id and text have the same result; rows that
    repeat an id with another text have their own. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(row_id(id_col).alias("did"), F.xxhash64(text).alias("th"), text.alias("text"))
    rows = rows.select("did", "th", *[spans_of(F.col("text"), k).alias(k) for k in KINDS])
    rows = materialize(rows.select("did", "th", F.concat("assign", "access", "hex").alias("base"), F.concat("ident", "part", "endpoint").alias("weak")))
    parts = rows.where(F.size("weak") > 0).distinct().select("did", "th", F.explode(F.concat("base", "weak")).alias("s")).select("did", "th", "s.kind", "s.lo", "s.hi")

    def bins(lo: Column, hi: Column) -> Column:
        return F.explode(F.sequence(F.floor(lo / reach), F.floor(hi / reach))).alias("bin")

    def binned(some: DataFrame, p: str) -> DataFrame:
        return some.select("did", "th", *[F.col(c).alias(f"{p}{c}") for c in ("kind", "lo", "hi")], bins(F.col("lo"), F.col("hi")))

    # A weak span that overlaps a base one is the base one's.
    b, w = binned(parts.where("kind < 3"), "b_"), binned(parts.where("kind >= 3"), "")
    inside = w.join(b, ["did", "th", "bin"]).where("b_lo < hi and lo < b_hi").select("did", "th", "kind", "lo", "hi").distinct()
    parts = parts.join(inside, ["did", "th", "kind", "lo", "hi"], "left_anti")

    roles = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4)}

    def near(some: DataFrame, role: str) -> DataFrame:
        """The candidates with a part of the role within reach."""
        other = parts.where(roles[role]).select("did", "th", F.col("lo").alias("o_lo"), F.col("hi").alias("o_hi"), bins(F.col("lo"), F.col("hi")))
        cut = some.select("did", "th", "kind", "lo", "hi", bins(F.col("lo") - reach, F.col("hi") + reach))
        c, o = cut.alias("c"), other.alias("o")
        on = (F.col("c.did") == F.col("o.did")) & (F.col("c.th") == F.col("o.th")) & (F.col("c.bin") == F.col("o.bin")) & (F.col("o_lo") <= F.col("c.hi") + reach) & (F.col("o_hi") >= F.col("c.lo") - reach)
        return c.join(o, on, "left_semi").select("did", "th", "kind", "lo", "hi").distinct()

    kept = near(parts.where("kind = 4"), "id").unionByName(near(parts.where("kind = 3"), "secret")).unionByName(near(near(parts.where("kind = 5"), "id"), "secret"))
    linked = kept.groupBy("did", "th").agg(F.collect_list(F.struct("kind", "lo", "hi")).cast(_SPAN).alias("linked"))
    out = rows.join(linked, ["did", "th"], "left")
    every = F.concat("base", F.coalesce("linked", F.array().cast(_SPAN)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        public_id("did").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_text_of(F.col("base")), 256).alias("base_sha256"), _text_of(every).alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _matches(kind: str) -> str:
    pattern, group, least = PATTERNS[kind]
    pattern = pattern.replace("'", "''")
    extra = " AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')" if kind == "part" else ""
    return f"""
  SELECT doc_id, {KINDS.index(kind)} AS kind, '{kind}' AS name, (pos - length(m))::INT AS lo, pos::INT AS hi FROM (
    SELECT doc_id, m, v, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(regexp_extract_all(text, '{pattern}', {group})) AS v,
             unnest((regexp_split_to_array(text, '{pattern}'))[1:len(regexp_extract_all(text, '{pattern}'))]) AS gap,
             unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i
      FROM t WHERE regexp_matches(text, '{pattern}')))
  WHERE length(v) >= {least}{extra}"""


SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
every AS ({" UNION ALL ".join(_matches(k) for k in KINDS)}),
base AS (SELECT * FROM every WHERE kind < 3),
weak AS (SELECT * FROM every w WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.lo < w.hi AND w.lo < b.hi)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (
  SELECT w.* FROM weak w
  WHERE (kind = 3 OR EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.kind IN (1, 3) AND p.lo <= w.hi + 200 AND p.hi >= w.lo - 200))
    AND (kind = 4 OR EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND p.kind IN (0, 2, 4) AND p.lo <= w.hi + 200 AND p.hi >= w.lo - 200))),
b AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) AS s
  FROM base GROUP BY doc_id),
a AS (
  SELECT doc_id, string_agg(name || ':' || lo || ':' || hi, ',' ORDER BY lo, kind) AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.s, '')) AS base_sha256, coalesce(a.s, '') AS spans
FROM t LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)
"""
