"""Text operators over documents, pages and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X
from ..operators import extract as E
from ..operators import linknames, outline
from ..sources import readers
from .registry import Tables, digest, query


def scalar(name, table, key, make, sql=None):
    """Like registry.scalar; columns are made when the query runs, as they need a session."""

    def run(t: Tables):
        return getattr(t, table).select(key, *[c.alias(n) for n, c in make().items()])

    query(name, f"SELECT {key}, {sql} FROM {table}" if sql else None)(run)


T = lambda: F.col("text")
ASCII = "regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')"


def _ascii():
    return F.regexp_replace("text", "[^\\x00-\\x7F]", " ")


scalar("p01_clean_field", "documents", "doc_id", lambda: {"h": digest(X.clean_field(T()))}, "md5(translate(coalesce(text, ''), chr(9) || chr(10) || chr(13), '   ')) AS h")
scalar("p02_first_usable", "pages", "page_id", lambda: {"v": X.first_usable(F.nullif(F.col("url"), F.col("url")), F.lit(" nan "), F.col("url"))}, "trim(url) AS v")
scalar("p03_text_or_default", "pages", "page_id", lambda: {"v": X.text_or(F.nullif(F.pmod("page_id", F.lit(2)), F.lit(0)), "none")}, "CASE WHEN page_id % 2 = 0 THEN 'none' ELSE '1' END AS v")
scalar("p14_strip_controls", "documents", "doc_id", lambda: {"h": digest(X.strip_controls(T()))}, "md5(regexp_replace(text, '[\\x00-\\x1F\\x7F-\\x{9F}\\x{A0}\\x{2022}]', '', 'g')) AS h")
scalar("p15_limit_length", "documents", "doc_id", lambda: {"n": F.char_length(X.limit_length(T())).cast("long")}, "length(left(text, 3999)) AS n")
scalar("p16_ascii_quotes", "documents", "doc_id", lambda: {"h": digest(X.ascii_quotes(F.concat(F.lit("“a” ‘b’ "), T())))}, "md5(translate('“a” ‘b’ ' || text, '“”‘’', '\"\"''''')) AS h")
scalar("p17_one_space", "documents", "doc_id", lambda: {"h": digest(X.one_space(T()))}, "md5(regexp_replace(text, ' +', ' ', 'g')) AS h")
scalar("p18_p19_cell_text", "documents", "doc_id", lambda: {"h": digest(X.excel_cell(T())), "p": digest(X.printable(T()))}, "md5(left(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), 32000)) AS h, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g')) AS p")
scalar("p20_ascii_fold", "documents", "doc_id", lambda: {"h": digest(X.ascii_fold(T()))}, "md5(regexp_replace(replace(translate(text, '–—“”‘’ ', '--\"\"'''' '), '…', '...'), '[^\\x00-\\x7F]', '?', 'g')) AS h")
scalar("p21_apostrophes", "documents", "doc_id", lambda: {"h": digest(X.plain_apostrophes(T()))}, "md5(translate(text, '’‘ʼʹ`´′', repeat('''', 7))) AS h")
scalar("p22_content_lines", "documents", "doc_id", lambda: {"h": digest(X.content_lines(T()))})
scalar("p29_hyperlink", "pages", "page_id", lambda: {"v": X.strip_hyperlink(F.concat(F.lit('=HYPERLINK("'), F.col("url"), F.lit('","x")')))}, "url AS v")
scalar("x01_hyphen_words", "documents", "doc_id", lambda: {"n": F.size(X.hyphen_words(T())).cast("long"), "h": digest(F.array_join(X.hyphen_words(T()), " "))}, "len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+'), lambda w: w <> '')) AS n, md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', '', 'g'), '\\s+'), lambda w: w <> ''), ' ')) AS h")
scalar("x02_x03_squash", "documents", "doc_id", lambda: {"h": digest(X.squash(T()))}, "md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+', ' ', 'g'))) AS h")
scalar("x04_without_stops", "documents", "doc_id", lambda: {"h": digest(X.without_stops(T(), ["the", "of", "and"]))}, "md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 1 AND w NOT IN ('the', 'of', 'and')), ' ')) AS h")
_STOP = ", ".join(f"'{w}'" for w in X.STOP_REQUIREMENT)
scalar("x05_requirement_tokens", "documents", "doc_id", lambda: {"h": digest(F.array_join(X.requirement_tokens(T()), " "))}, f"md5(array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ({_STOP})), ' ')) AS h")
scalar("x06_alpha_tokens", "documents", "doc_id", lambda: {"n": F.size(X.alpha_tokens(T())).cast("long"), "h": digest(F.array_join(X.alpha_tokens(T()), " "))}, "len(regexp_extract_all(lower(text), '[a-z]{3,}')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z]{3,}'), ' ')) AS h")
scalar("x07_long_keywords", "documents", "doc_id", lambda: {"n": F.size(X.long_keywords(T())).cast("long")}, "len(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) >= 4)) AS n")
scalar("x08_x09_clean_words", "documents", "doc_id", lambda: {"h": digest(X.clean_for_words(T())), "n": F.size(X.clean_tokens(T())).cast("long")}, "md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))) AS h, len(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3)) AS n")
scalar("x10_acronyms", "documents", "doc_id", lambda: {"n": F.size(X.acronyms(_ascii())).cast("long")}, f"len(list_distinct(regexp_extract_all({ASCII}, '\\b[A-Z][A-Z0-9]+(?:-[A-Z0-9]+)*\\b'))) AS n")
scalar("x11_capital_phrases", "documents", "doc_id", lambda: {"phrases": F.size(X.capital_phrases(_ascii())).cast("long")})
scalar("x12_citations", "documents", "doc_id", lambda: {"n": F.size(X.citations(_ascii())).cast("long")})
scalar("x13_canonical_citation", "documents", "doc_id", lambda: {"h": digest(X.canonical_citation(F.concat(F.lit("5 U.S.C. § 552 E.O. 12866 "), _ascii())))})
scalar("x14_citation_context", "documents", "doc_id", lambda: {"n": F.size(X.citation_context(F.concat(F.lit("see 5 USC 552 and "), T()))).cast("long")})
scalar("x16_sentences", "documents", "doc_id", lambda: {"n": F.size(X.sentences(T())).cast("long")}, "len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), lambda s: length(s) >= 40)) AS n")
scalar("x17_guarded_sentences", "documents", "doc_id", lambda: {"n": F.size(X.guarded_sentences(T())).cast("long")})
scalar("x18_x19_mending", "documents", "doc_id", lambda: {"a": digest(X.mend_hyphens(T())), "b": digest(X.mend_scan(T()))})
scalar("x20_years", "orders", "o_orderkey", lambda: {"years": F.array_join(X.years(F.concat(F.lit("from 2022-2026, FY24, FY 2019 and "), F.date_format("o_orderdate", "yyyy"), F.lit("."))), ",")}, "array_to_string(list_sort(list_distinct([2019, 2022, 2024, 2026, year(o_orderdate)])), ',') AS years")
scalar("x21_f21_obsolete", "part", "p_partkey", lambda: {"kind": X.document_type(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Strategic Plan ", "Annual Report ", "OMB M-", "EO ", "Note ")]), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int")), F.col("p_name"))), "old": X.obsolete(F.concat(F.lit("Strategic Plan 20"), F.lpad(F.pmod("p_partkey", F.lit(50)).cast("string"), 2, "0")))}, "['Strategic Plan', 'Annual Plan/Report', 'OMB Memorandum', 'Executive Order', 'Other'][p_partkey % 5 + 1] AS kind, (2000 + p_partkey % 50) < 2026 AS old")
scalar("x22_x23_x24_dates", "orders", "o_orderkey", lambda: {"d": X.any_date(F.date_format("o_orderdate", "MM/dd/yyyy")), "f": X.find_date(F.concat(F.lit("on "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("."))), "i": X.iso_prefix(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm"))}, "o_orderdate::DATE AS d, o_orderdate::DATE AS f, o_orderdate::DATE AS i")
scalar("x25_x26_slugs", "pages", "page_id", lambda: {"t": X.slug_title(F.concat(F.lit("https://x.gov/a/the-page_no-"), F.col("page_id"), F.lit("/"))), "c": X.case_citation(F.concat(F.lit("https://x.gov/far-case-2021-"), F.lpad(F.pmod("page_id", F.lit(1000)).cast("string"), 3, "0")))}, "'The Page No ' || page_id AS t, 'FAR Case 2021-' || lpad((page_id % 1000)::VARCHAR, 3, '0') AS c")
scalar("x27_metadata", "pages", "page_id", lambda: {"m": F.to_json(X.guess_metadata(F.col("url"), F.col("html")))})
scalar("x28_triad_hash", "pages", "page_id", lambda: {"h": X.triad_hash(F.col("page_id"), F.nullif(F.col("url"), F.col("url")), F.col("url"))}, "sha256(page_id::VARCHAR || '||nan||' || url) AS h")
scalar("x29_match_id", "pages", "page_id", lambda: {"h": X.match_id(F.col("url"), F.col("page_id"))}, "left(sha1(lower(trim(url)) || '||' || page_id::VARCHAR), 16) AS h")
scalar("x30_x31_ids", "part", "p_partkey", lambda: {"h": X.component_hash(F.col("p_brand"), F.col("p_name")), "i": X.composite_id(F.col("p_brand"), F.col("p_name"))}, "'C' || left(md5(lower(trim(p_brand)) || '|' || lower(trim(p_name))), 8) AS h, p_brand || '::' || p_name AS i")
scalar("x32_decision", "events", "event_id", lambda: {"d": X.decision(F.element_at(F.array(*[F.lit(x) for x in ("Yes", "n", " ACCEPT ", "later")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int")))}, "CASE event_id % 4 WHEN 0 THEN 'Accept' WHEN 1 THEN 'Reject' WHEN 2 THEN 'Accept' ELSE 'Needs Review' END AS d")
scalar("x35_x36_actions", "documents", "doc_id", lambda: {"a": digest(X.policy_action(_ascii())), "b": digest(X.best_sentence(_ascii()))})
scalar("x39_first_words", "documents", "doc_id", lambda: {"h": digest(X.first_words(T()))}, "md5(array_to_string(list_slice(regexp_extract_all(text, '\\S+'), 1, 300), ' ')) AS h")
scalar("f12_likely_requirement", "documents", "doc_id", lambda: {"n": F.size(F.filter(X.policy_sentences(_ascii()), X.likely_requirement)).cast("long")})
scalar("f13_content_status", "pages", "page_id", lambda: {"s": X.content_status(F.col("url"), F.when(F.col("page_id") % 4 == 0, "").when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, "short").otherwise(F.col("html")))}, "CASE page_id % 4 WHEN 0 THEN 'EMPTY' WHEN 1 THEN 'EQUALS_URL' WHEN 2 THEN 'TOO_SHORT' ELSE 'OK' END AS s")
scalar("f14_f15_f18_urls", "pages", "page_id", lambda: {"gov": X.gov_host(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.epa.gov/x?"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://epa.gov.example.com/"), F.col("page_id"))).otherwise(F.col("url"))), "doc": X.document_url(F.concat(F.lit("https://x.org/a."), F.when(F.col("page_id") % 2 == 0, "pdf").otherwise("html"))), "case_page": X.case_url(F.concat(F.lit("https://x/far-case-"), F.col("page_id") + 1900, F.lit("-001")))}, "page_id % 3 = 0 AS gov, page_id % 2 = 0 AS doc, page_id + 1900 <= 9999 AS case_page")
scalar("f17_date_window", "orders", "o_orderkey", lambda: {"inside": X.date_window(F.to_date("o_orderdate"), F.to_date(F.lit("1997-06-30")))}, "o_orderdate::DATE BETWEEN DATE '1997-06-30' - 62 AND DATE '1997-06-30' AS inside")
scalar("f19_generic_name", "part", "p_partkey", lambda: {"g": X.generic_name(F.when(F.col("p_partkey") % 3 == 0, "Section").otherwise(F.col("p_name")))}, "p_partkey % 3 = 0 AS g")
scalar("s14_html_text", "pages", "page_id", lambda: {"title": X.html_title(F.col("html")), "h": digest(X.html_text(F.col("html")))}, """
  trim(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title,
  md5(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript\\b[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), chr(160), ' '), '\\s+', ' ', 'g'))) AS h""")
scalar("s15_html_main", "pages", "page_id", lambda: {"h": digest(X.html_main(F.col("html")))})
scalar("s16_lead_text", "documents", "doc_id", lambda: {"n": F.char_length(X.lead_text(T())).cast("long")})
scalar("s26_links", "pages", "page_id", lambda: {"n": F.size(X.links(F.col("html"))).cast("long")}, """len(list_distinct(regexp_extract_all(html, '(?i)href=["'']([^"''#]+)', 1))) AS n""")
scalar("e01_e05_sentences", "conversations", "conv_id", lambda: {"turn": F.col("turn"), "k": E.sentence_type(_ascii()), "agencies": F.size(E.agencies(_ascii())).cast("long"), "metrics": F.size(E.metrics(_ascii())).cast("long"), "deadline": E.deadline(_ascii())})
scalar("e12_suggested_agency", "documents", "doc_id", lambda: {"agency": E.suggested_agency(T())}, "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{'|'.join(w)}') THEN '{a}'" for a, w in E.AGENCY_TOPICS.items()) + " ELSE 'Requires interagency coordination' END AS agency")
scalar("e23_document_title", "documents", "doc_id", lambda: {"title": E.document_title(F.concat(F.when(F.col("doc_id") % 3 == 0, "9: Public Law 104-13; Public Law 104-1064.").when(F.col("doc_id") % 3 == 1, "9: Executive  Order\t12866\n").otherwise("9:"), F.regexp_replace(T(), "[A-Za-z0-9]", "")), F.when(F.col("doc_id") % 5 == 0, "short").when(F.col("doc_id") % 7 == 0, "A title of its own"), F.concat(F.lit("the_file_"), F.col("source")))},
       "CASE WHEN doc_id % 7 = 0 AND doc_id % 5 <> 0 THEN 'A title of its own' WHEN text IS NOT NULL AND doc_id % 3 = 0 THEN 'Public Law 104-1064' WHEN text IS NOT NULL AND doc_id % 3 = 1 THEN 'Executive Order 12866' ELSE 'The File Src' || substr(source, 4) END AS title")
scalar("e26_snippets", "documents", "doc_id", lambda: {"n": F.char_length(E.snippets(T(), "the")).cast("long")})
scalar("m17_m18_enabling", "documents", "doc_id", lambda: {"score": F.round(S.enabling_score(_ascii(), F.lit("requires data access")), 6), "domains": F.array_join(S.domains(_ascii()), ",")})
scalar("m19_m20_causal", "part", "p_partkey", lambda: {"score": S.causal_score(F.element_at(F.array(*[F.lit(x) for x in ("Support staff", "law of risk", "funding plan", "none")]), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int")), F.lit("risk law")), "confidence": S.causal_confidence(F.lit(0.5), F.lit(85))}, "CASE p_partkey % 4 WHEN 0 THEN 85 WHEN 1 THEN 75 WHEN 2 THEN 70 END::INT AS score, 74 AS confidence")
scalar("m21_precedent", "part", "p_partkey", lambda: {"score": S.precedent_score(F.lit("mandate"), F.lit("x"), F.col("p_partkey") % 2 == 0)}, "CASE WHEN p_partkey % 2 = 0 THEN 90 ELSE 85 END::INT AS score")
scalar("m27_m28_scores", "documents", "doc_id", lambda: {"priority": F.round(S.priority_score(T(), E.deadline(_ascii()), F.array(F.lit("Department of Energy"))), 6), "requirement": S.requirement_score(_ascii())})
scalar("m14_m15_final_score", "lineitem", "l_orderkey", lambda: {"l_linenumber": F.col("l_linenumber"), "score": F.round(S.final_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5), F.lit(1.0)), 6), "bucket": S.pair_bucket(F.round(S.final_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5), F.lit(1.0)), 6), F.col("l_linenumber") < 6, 0.705, 0.5005)}, "l_linenumber, round(l_discount * 2 + l_tax * 3 + 0.3, 6) AS score, CASE WHEN l_linenumber >= 6 THEN 'Rejected' WHEN round(l_discount * 2 + l_tax * 3 + 0.3, 6) >= 0.705 THEN 'Confirmed' WHEN round(l_discount * 2 + l_tax * 3 + 0.3, 6) >= 0.5005 THEN 'Review_Needed' ELSE 'Rejected' END AS bucket")
scalar("p24_m29_buckets", "lineitem", "l_orderkey", lambda: {"l_linenumber": F.col("l_linenumber"), "bucket": S.confidence_bucket(F.col("l_discount") * 10), "label": S.confidence_label(F.col("l_discount"))}, "l_linenumber, CASE WHEN l_discount * 10 >= 0.8 THEN 'High' WHEN l_discount * 10 >= 0.6 THEN 'Medium' ELSE 'Low' END AS bucket, CASE WHEN l_discount >= 0.8 THEN 'High' WHEN l_discount >= 0.5 THEN 'Medium' ELSE 'Low' END AS label")
scalar("m07_m30_scores", "lineitem", "l_orderkey", lambda: {"l_linenumber": F.col("l_linenumber"), "c": F.round(S.combined(F.col("l_discount"), F.col("l_tax"), F.col("l_returnflag"), F.lit("x")), 6), "p": S.linkage_priority(F.when(F.col("l_returnflag") == "R", "OMB M-1").otherwise("law"), F.col("l_tax"), 0.045)}, "l_linenumber, round(0.4 * l_discount + 0.6 * l_tax, 6) AS c, (CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END + CASE WHEN l_tax > 0.045 THEN 1 ELSE 0 END)::INT AS p")


@query("s05_paragraphs", "SELECT trim(concat_ws(' ', trim(page_id::VARCHAR), trim(url), trim(html))) AS paragraph FROM pages WHERE length(trim(concat_ws(' ', trim(page_id::VARCHAR), trim(url), trim(html)))) >= 50")
def _paragraphs(t):
    return readers.paragraphs(t.pages)


#: What stands before every second text, as the invented prose has no requirements, dates or citations of its own.
_LEAD = "The Department of Energy shall submit a report on funding under 5 USC 552 by January 15, 2027 to all. It was cold. "


def _led(t, lead: str = _LEAD):
    return t.documents.where("text is not null").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, lead).otherwise("It was cold. "), _ascii()).alias("text"))


_EVEN = "FROM documents WHERE text IS NOT NULL AND doc_id % 2 = 0"


@query("e02_componentise", f"SELECT doc_id, 0 AS pos, 'requirement' AS type, 'January 15, 2027' AS deadline, 1.0::DOUBLE AS priority, 'Department of Energy' AS agencies {_EVEN}")
def _componentise(t):
    return E.componentise(_led(t)).select("doc_id", "pos", "type", "deadline", "priority", F.array_join("agencies", ",").alias("agencies"))


@query("e13_clauses", f"SELECT doc_id, 'C-001' AS clause_id, 1 AS n {_EVEN}")
def _clauses(t):
    return E.clauses(_led(t), "C").select("doc_id", "clause_id", F.size("citations").alias("n"))


@query("e18_order_sections")
def _sections(t):
    return E.order_sections(t.documents.select("doc_id", F.concat(F.lit("Sec. 1. (a) First. (b) Second. Sec. 2. "), "text").alias("text")))


@query("e20_bullets")
def _bullets(t):
    return E.bullets(t.documents.select("doc_id", F.concat(F.lit("## Head\n- one\n"), "text").alias("text")))


@query("e16_section_components", f"SELECT doc_id, 1 AS pos, 0 AS n, 'Establish Plan' AS name, 'The Secretary shall establish a data governance plan for all programs.' AS description {_EVEN}")
def _components(t):
    return E.section_components(E.split_sections(_led(t, "Sec. 1. The Secretary shall establish a data governance plan for all programs. Sec. 2. "), "\\s*Sec\\.\\s+\\d+\\.\\s"))


@query("x38_summarise")
def _summarise(t):
    return E.summarise(t.documents).select("doc_id", digest(F.col("summary")).alias("h"))


@query("w10_context", """
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS sentence, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
b AS (SELECT *, lag(sentence) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s)
SELECT doc_id, pos, CASE WHEN len(regexp_split_to_array(before, '\\s+')) < 50 THEN md5(before) END AS context FROM b""")
def _context(t):
    s = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "sentence"))
    return E.context_sentence(s).select("doc_id", "pos", digest(F.col("context")).alias("context"))


@query("e25_link_names")
def _(t):
    return linknames.named_links(t.pages)


@query("e30_inventory", """
WITH p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS pos FROM (SELECT doc_id, list_transform(string_split(text, '. '), lambda x: trim(regexp_replace(x, '[^a-z ]', '', 'g'))) AS parts FROM documents WHERE text IS NOT NULL)),
k AS (
  SELECT *, last_value(CASE WHEN pos % 5 = 0 THEN pos END IGNORE NULLS) OVER w AS cat_at, last_value(CASE WHEN pos % 5 IN (1, 3) THEN pos END IGNORE NULLS) OVER w AS name_at
  FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
c AS (
  SELECT doc_id, name_at, 'cat' || (cat_at // 5 % 3) AS category, cat_at, max(part) FILTER (pos = name_at) AS component, coalesce(string_agg(part, ' ' ORDER BY pos) FILTER (pos > name_at AND part <> ''), '') AS description
  FROM k WHERE name_at > cat_at GROUP BY ALL),
last AS (SELECT doc_id, 'cat' || (pos // 5 % 3) AS category, max(pos) AS cat_at FROM p WHERE pos % 5 = 0 GROUP BY ALL)
SELECT doc_id, name_at::INT AS pos, category, component, md5(description) AS description FROM c JOIN last USING (doc_id, category, cat_at)""")
def _(t):
    # The parts of a text as the lines of an inventory: a category, two components, each with a line about it.
    part = lambda x: F.trim(F.regexp_replace(x, "[^a-z ]", ""))
    line = lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## cat"), (F.floor(i / 5) % 3).cast("string"))).when(i % 5 % 2 == 1, F.concat(F.lit("- **"), part(x), F.lit(":**"))).otherwise(F.concat(F.lit("- "), part(x)))
    texts = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "\\. ", -1), line), "\n").alias("text"))
    return outline.inventory(texts).withColumn("description", digest(F.col("description")))


@query("e31_pillar_actions")
def _(t):
    # Parts of a text as the lines of a plan: now and then a pillar or a title, else bullets.
    line = lambda x, i: F.when(i % 11 == 5, F.concat(F.lit("Pillar II: "), x)).when(i % 4 == 1, F.initcap(x)).when(i % 4 == 3, x).otherwise(F.concat(F.lit("\u2022 "), x))
    texts = t.documents.select("doc_id", F.array_join(F.transform(F.split("text", "[.\n]+ ?", -1), line), "\n").alias("text"))
    return outline.pillar_actions(texts)


@query("e29_numbered_sections")
def _(t):
    # Each text as layout lines, thirty a page; every seventeenth is a numbered heading.
    lines = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.posexplode(F.split("text", "[.] ?", -1)).alias("n", "text"))
    number = F.format_string("%d.%03d %s", 100 + F.col("path") % 900, F.col("n") % 1000, F.initcap(F.left(F.regexp_replace("text", "\\s+", " "), F.lit(20))))
    text = F.when(F.col("n") % 17 == 3, number).when(F.col("n") % 5 == 1, F.concat(F.lit("(a) "), F.col("text"))).otherwise(F.col("text"))
    return outline.numbered_sections(lines.select("path", F.floor(F.col("n") / 30).cast("int").alias("page"), F.col("n").alias("line"), text.alias("text"), F.lit(9.0).alias("size"), (F.col("n") % 2 == 0).alias("bold")))
