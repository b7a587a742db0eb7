"""Streams with state over the shop's tables (rows arrive in two parts, each in a run of its own on one checkpoint), logged batches, row contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts
from ..operators.applied import CanonicalLog
from ..shared import shared_folder
from ..sources import paged as P
from ..streaming import stateful as S
from .registry import digest, query


def _in_runs(spark, home: str, runs: list[dict[str, DataFrame]], stream) -> DataFrame:
    """Lands the parts of each run as files and lets the stream go on over them."""
    for parts in runs:
        for name, df in parts.items():
            df.write.mode("append").parquet(f"{home}/{name}")
        landed = {name: spark.readStream.schema(df.schema).parquet(f"{home}/{name}") for name, df in parts.items()}
        S.start(stream(**landed), f"{home}/out", f"{home}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{home}/out")


@query("t12_file_events", """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'c' || client_id || CASE WHEN kind IN ('view', 'click') THEN '.py' ELSE '_prompt.txt' END AS path, ts, click_id, kind AS content
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL AND click_id IS NOT NULL AND kind <> 'signup'),
r AS (
  SELECT path, ts, click_id, content, 1::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts, click_id) AS k FROM e) WHERE k = 1
  UNION ALL
  SELECT path, ts, click_id, content, n FROM (
    SELECT e.path, e.ts, e.click_id, e.content, r.n + 1 AS n, row_number() OVER (PARTITION BY e.path ORDER BY e.ts, e.click_id) AS k
    FROM r JOIN e ON e.path = r.path AND e.ts >= r.ts + INTERVAL 90 SECOND AND e.content <> r.content) WHERE k = 1)
SELECT path, epoch_us(ts) AS us, click_id AS event_id, md5(content) AS hash, n FROM r""")
def _(t):
    # Kinds stand for contents; signups are files that are not watched. The last row only moves the watermark past all others.
    kind = F.col("kind")
    end = F.when(kind.isin("view", "click"), ".py").when(kind == "signup", ".log").when(kind.isNotNull(), "_prompt.txt")
    events = t.clicks.select(F.concat(F.lit("c"), F.col("client_id").cast("string"), end).alias("path"), F.col("ts").alias("at"), F.col("click_id").alias("event_id"), kind.alias("content"), "arrived_at")
    early = F.coalesce(F.col("arrived_at") < F.lit("2024-03-01").cast("timestamp_ntz"), F.lit(True))
    last = events.agg(F.max("at").alias("at")).select(F.lit("end.py").alias("path"), (F.col("at") + F.expr("INTERVAL 100 DAYS")).alias("at"), F.lit(0).cast("long").alias("event_id"), F.lit("").alias("content"))
    first, second = events.where(early).drop("arrived_at"), events.where(~early).drop("arrived_at")
    out = _in_runs(t.spark, shared_folder(t.spark, "file-events"), [{"events": first}, {"events": second}, {"events": last}], lambda events: S.guarded_file_events(events, rest_seconds=90, late="30 days"))
    return out.select("path", F.unix_micros("at").alias("us"), "event_id", "hash", "n")


@query("t06_decision_stream", """
WITH d AS (SELECT client_id, count(DISTINCT (valid_at, change_id)) AS history, max(valid_at) AS decided_at, arg_max(struct_pack(op := op, source := source), (valid_at, change_id)) AS last FROM client_changes WHERE client_id IS NOT NULL AND valid_at IS NOT NULL GROUP BY 1),
c AS (SELECT client_id, arg_max(balance, updated_at) AS score FROM clients WHERE client_id IS NOT NULL AND updated_at IS NOT NULL GROUP BY 1)
SELECT client_id AS match_id, c.client_id IS NOT NULL AS present, score, CASE last.op WHEN 'I' THEN 'Accept' WHEN 'D' THEN 'Reject' ELSE 'Needs Review' END AS decision,
  last.source AS notes, epoch_us(decided_at) AS decided_us, coalesce(history, 0) AS history
FROM c FULL JOIN d USING (client_id)""")
def _(t):
    op = F.col("op")
    decisions = t.client_changes.select(F.col("client_id").alias("match_id"), F.when(op == "I", "yes").when(op == "D", "n").otherwise("review").alias("decision"), F.col("source").alias("notes"), F.col("valid_at").alias("at"), F.col("change_id").alias("seq"))
    candidates = t.clients.select(F.col("client_id").alias("match_id"), F.col("balance").alias("score"), F.col("updated_at").alias("at"))
    early = F.coalesce(F.col("at") < F.lit("2024-02-15").cast("timestamp_ntz"), F.lit(True))
    # Later decisions come first, so the second run brings older ones that must not change what holds.
    runs = [{"candidates": candidates.where(early), "decisions": decisions.where(~early)}, {"candidates": candidates.where(~early), "decisions": decisions.where(early)}]
    out = _in_runs(t.spark, shared_folder(t.spark, "decisions"), runs, lambda candidates, decisions: S.decision_stream(candidates, decisions))
    return S.current(out).select("match_id", "present", "score", "decision", "notes", F.unix_micros("decided_at").alias("decided_us"), "history")


_RECORDS = """
WITH d AS (
  SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Executive Order ' WHEN page_id % 7 = 1 THEN 'OMB ' WHEN page_id % 7 = 2 THEN 'Memorandum ' ELSE '' END || coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title,
    CASE WHEN page_id % 2 = 0 THEN 'PRESDOCU' WHEN page_id % 5 = 0 THEN 'RULE' ELSE 'NOTICE' END AS type, DATE '2024-01-01' + (page_id % 150)::INT AS published, url
  FROM pages WHERE page_id IS NOT NULL)"""


def _pages(t, name: str, size: int = 25):
    """The pages table as a service: records by page number, oldest id first, without gaps."""
    from ..operators.records import numbered

    k = F.col("page_id")
    lead = F.when(k % 7 == 0, "Executive Order ").when(k % 7 == 1, "OMB ").when(k % 7 == 2, "Memorandum ").otherwise("")
    known = t.pages.where("page_id IS NOT NULL").select(
        "page_id", F.concat(lead, F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))).alias("title"),
        F.when(k % 2 == 0, "PRESDOCU").when(k % 5 == 0, "RULE").otherwise("NOTICE").alias("type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (k % 150).cast("int")).cast("string").alias("publication_date"), F.col("url").alias("html_url"), F.concat(F.lit("doc-"), k.cast("string")).alias("document_number"),
    )
    pages = numbered(known, "_n", "page_id", "html_url").withColumn("page", F.floor((F.col("_n") - 1) / size) + 1).drop("_n", "page_id")
    return P.landed_pages(pages, f"{shared_folder(t.spark, name)}/pages")


@query("s18_s24_register", _RECORDS + """
SELECT 'doc-' || page_id AS citation, title, type AS document_type, strftime(published, '%Y-%m-%d') AS publication_date, coalesce(url, '') AS url FROM d
WHERE published BETWEEN DATE '2024-02-28' AND DATE '2024-04-30' AND (type = 'PRESDOCU' AND contains(lower(title), 'executive order') OR type = 'NOTICE' AND (contains(lower(title), 'omb') OR contains(lower(title), 'memorandum')))""")
def _(t):
    return P.register_documents(P.read_pages(t.spark, "register_pages", _pages(t, "register"), P.REGISTER), "2024-04-30")


@query("s19_s20_paged_stream", _RECORDS + """
SELECT DISTINCT 'doc-' || page_id AS citation, title, strftime(published, '%Y-%m-%d') AS publication_date, url FROM d WHERE published BETWEEN DATE '2024-02-28' AND DATE '2024-04-30'""")
def _(t):
    fetch, home = _pages(t, "versions"), shared_folder(t.spark, "versions-stream")
    # The first run leaves the last page, which may still grow; the second goes on at it.
    for last in (False, True):
        stream = P.stream_pages(t.spark, "version_pages", fetch, P.REGISTER, last=last)
        S.start(stream, f"{home}/out", f"{home}/checkpoint").awaitTermination()
    records = t.spark.read.parquet(f"{home}/out").withColumnsRenamed({"html_url": "url"}).withColumn("citation", F.col("document_number"))
    return P.version_documents(records, "2024-04-30")


@query("d04_t08_bulk_apply", """
WITH one AS (SELECT p_brand, arg_max(p_name, (length(p_name), -p_partkey)) AS canonical FROM part GROUP BY p_brand),
m AS (SELECT p_brand < 'Brand#3' AS early, p_name AS value, arg_min(canonical, p_brand) AS canonical FROM part JOIN one USING (p_brand) GROUP BY ALL),
b AS (SELECT value, canonical FROM m WHERE early), l AS (SELECT value, canonical FROM m WHERE NOT early)
SELECT p_partkey, CASE WHEN b.value IS NULL THEN coalesce(l.canonical, p_name) ELSE coalesce(again.canonical, b.canonical) END AS p_name, (b.value IS NOT NULL OR l.value IS NOT NULL) AS pooled
FROM part LEFT JOIN b ON b.value = p_name LEFT JOIN l ON l.value = p_name LEFT JOIN l again ON again.value = b.canonical""")
def _(t):
    # The second batch holds the first one's groups again, which the log leaves out.
    log = CanonicalLog(t.spark, f"{shared_folder(t.spark, 'canonical')}/log")
    for groups in (t.part.where("p_brand < 'Brand#3'"), t.part):
        log.bulk_apply(groups, "p_brand", "p_name", "p_partkey", "parts")
    return log.apply(t.part, ["p_name"]).select("p_partkey", "p_name", F.col("pool").isNotNull().alias("pooled"))


_ASKED = contracts.Contract(("component_id", "current_text", "source_url"))
_ANSWERED = contracts.Contract(("updated_text", "lineage", "delta"))


def _service(asked: dict) -> object:
    """A service whose answers are right, fenced, short of a field, with a field too many, no JSON, or do not come, by the page."""
    import json

    k = int(asked["component_id"]) % 6
    answer = {"updated_text": f"{asked['source_url']} {len(asked['current_text'])}", "lineage": "service", "delta": "all"}
    if k == 1:
        answer.pop("delta")
    if k == 2:
        answer["more"] = "x"
    if k == 4:
        raise TimeoutError
    return {0: f"```json\n{json.dumps(answer)}\n```", 3: "no answer"}.get(k, answer)


def _title(asked: dict) -> dict:
    """The page's title, if it has ten characters."""
    import re

    title = re.search("<title>([^<]*)</title>", asked["current_text"])
    if title is None or len(title[1]) < 10:
        raise ValueError
    return {"updated_text": title[1], "lineage": "title", "delta": "all"}


def _stand_in(asked: dict) -> dict:
    return {"updated_text": f"Mock transformation of: {asked['current_text'][:100]}...", "lineage": "fallback", "delta": "none"}


@query("y02_row_contract", """
WITH p AS (SELECT page_id, html, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    concat_ws('; ', CASE WHEN page_id IS NULL THEN 'request: component_id is missing' END,
      CASE WHEN html IS NULL THEN 'request: current_text is missing' WHEN NOT regexp_matches(html, '\\S') THEN 'request: current_text is blank' END,
      CASE WHEN url IS NULL THEN 'request: source_url is missing' WHEN NOT regexp_matches(url, '\\S') THEN 'request: source_url is blank' END) AS wrong,
    CASE page_id % 6 WHEN 1 THEN 'service: delta is missing' WHEN 2 THEN 'service: more is unknown' WHEN 3 THEN 'service: JSONDecodeError' WHEN 4 THEN 'service: TimeoutError' END AS service FROM pages),
q AS (SELECT *, CASE WHEN wrong <> '' THEN NULL WHEN service IS NULL THEN 'service' WHEN length(title) >= 10 THEN 'title' ELSE 'stand-in' END AS level FROM p)
SELECT page_id, level, md5(CASE level WHEN 'service' THEN url || ' ' || length(html) WHEN 'title' THEN title WHEN 'stand-in' THEN 'Mock transformation of: ' || substring(html, 1, 100) || '...' END) AS updated,
  CASE level WHEN 'service' THEN 'service' WHEN 'title' THEN 'title' WHEN 'stand-in' THEN 'fallback' END AS lineage,
  CASE WHEN level IS NULL THEN wrong WHEN level = 'service' THEN '' WHEN level = 'title' THEN service ELSE service || '; title: ValueError' END AS faults FROM q""")
def _(t):
    request = {"component_id": "page_id", "current_text": "html", "source_url": "url"}
    out = contracts.transform_rows(t.pages, request, _ASKED, [("service", _service), ("title", _title), ("stand-in", _stand_in)], _ANSWERED)
    return out.select("page_id", "level", digest(F.col("updated_text")).alias("updated"), "lineage", F.array_join("faults", "; ").alias("faults"))
