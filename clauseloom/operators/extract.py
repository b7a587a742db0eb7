"""Texts to typed components: sentences, sections, requirements, gaps. Native columns and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions import text as X

# ---- fixed values: patterns in the order in which they are tried ---------------------------------------
TYPE_PATTERNS = [
    ("requirement", r"(?:shall|must|will|required to|directed to)\s+([^\.]{10,100}?)(?:\.|;)"),
    ("requirement", r"[A-Z][^\.]{20,120}?(?:establish|create|develop|implement|provide)[^\.]{10,80}\."),
    ("deadline", r"(?:by|no later than|on or before)\s+(\w+\s+\d{1,2},\s+\d{4}|\d{1,2}/\d{1,2}/\d{4})"),
    ("deadline", r"(?:within\s+)(\d+)\s+(?:days|months|years)"),
    ("resource", r"\$\d+(?:,\d{3})*(?:\.\d{2})?\s+(?:million|billion|trillion)?"),
    ("resource", r"allocate\s+[^\.]{10,80}\.(?:resources|funding|personnel)"),
    ("report", r"submit\s+(?:a|an)?\s*report[^\.]{10,100}\.(?:to|for)"),
    ("report", r"provide\s+(?:a|an)?\s* briefing[^\.]{20,80}\."),
    ("authority", r"(?:authorize|empower|delegate)\s+[^\.]{10,100}?to\s+[^\.]{20,80}\."),
    ("authority", r"under\s+(?:the|this)\s+authority\s+of[^\.]{20,100}\."),
    ("goal", r"(?:achieve|accomplish|reach|attain)\s+[^\.]{10,80}\.(?:goal|objective|target)"),
    ("goal", r"goal\s+(?:of|is|to)\s+[^\.]{20,100}\."),
]
#: What a pattern ends with, where that is far cheaper to look for: sentences without it are not tried.
TYPE_ENDS = {TYPE_PATTERNS[1][1]: r"(?:establish|create|develop|implement|provide)[^\.]{10,80}\."}
AGENCIES = {
    "DOE": "Department of Energy", "DOC": "Department of Commerce", "DOD": "Department of Defense", "DOJ": "Department of Justice", "DOT": "Department of Transportation", "EPA": "Environmental Protection Agency",
    "HHS": "Department of Health and Human Services", "OMB": "Office of Management and Budget", "OSTP": "Office of Science and Technology Policy", "NIST": "National Institute of Standards and Technology",
    "NSF": "National Science Foundation", "USDA": "Department of Agriculture",
}
AGENCY_PATTERNS = [r"Department of \w+", r"\w+ Agency", r"\w+ Administration", r"\w+ Commission"]
METRIC_PATTERNS = [(r"(\d+)\s+(?:percent|%)", 1, "percentage_target"), (r"by\s+(\d{4})", 1, "year_target"), (r"\$\d+(?:,\d{3})*", 0, "funding_amount"), (r"\d+\s+(?:new|additional)", 0, "quantity_target"), (r"reduce\s+by\s+\d+", 0, "reduction_target")]
DEADLINE_PATTERNS = [r"by\s+(\w+\s+\d{1,2},\s+\d{4})", r"by\s+(\d{1,2}/\d{1,2}/\d{4})", r"no later than\s+(\w+\s+\d{1,2},\s+\d{4})", r"due\s+(\w+\s+\d{1,2},\s+\d{4})"]
AGENCY_TOPICS = {
    "Department of Energy": ["energy", "grid", "electric", "nuclear", "renewable"],
    "Department of Commerce": ["commerce", "trade", "business", "economic", "export"],
    "Environmental Protection Agency": ["environment", "pollution", "emissions", "clean", "epa"],
    "Department of Health and Human Services": ["health", "medical", "patient", "disease", "hhs"],
    "Office of Management and Budget": ["budget", "funding", "appropriation", "omb", "fiscal"],
}
RATIONALES = [
    ("privacy", r"\bprivacy\b", r"\b(privacy|pii|personally identifiable information)\b"),
    ("ip_and_data", r"\b(ip rights|licensing|data)\b", r"\b(data rights|ip|intellectual property|license|proprietary)\b"),
    ("risk", r"\b(high-impact|risk)\b", r"\b(risk|impact|critical|sensitive)\b"),
    ("testing", r"\b(test|monitor|performance|evaluate)\b", r"\b(test|performance|monitoring|evaluation|metric|benchmark)\b"),
    ("lock_in", r"\b(vendor lock-in|interoperability|portability)\b", r"\b(open source|standard|api|export|portable|interoperable)\b"),
]
TITLE_PATTERNS = [
    r"(?i)(\d+(?:st|nd|rd|th)\s+Century\s+[A-Za-z\s]+Act(?:\s+of\s+\d{4})?)",
    r"(?i)((?:The\s+)?[A-Z][A-Za-z\s]+Act\s+of\s+\d{4})",
    r"(?i)((?:The\s+)?[A-Z][A-Za-z\s]+\s+Act)",
    r"(?i)(Public\s+Law\s+\d+[-–]\d+)",
    r"(?i)(Title\s+\d+[A-Z]*\s+of\s+the\s+.+?\s+Code)",
    r"(?i)(\d+\s+U\.?S\.?C\.?\s+.*)",
    r"(?i)(Code\s+of\s+Federal\s+Regulations\s+.*)",
    r"(?i)(Executive\s+Order\s+\d+)",
    r"(?i)(Federal\s+Register\s+.*)",
    r"([A-Z][A-Z\s]{10,}(?:\s+[A-Z]+){1,})",
]
MODAL = r"(?i)\b(must|shall|required|deadline|effective|within\s+\d+\s+days|is\s+hereby|are\s+hereby)\b"
# ----------------------------------------------------------------------------------------------------------


def sentence_type(s: Column) -> Column:
    """The first type whose pattern the sentence has, else null."""
    def has(p: str) -> Column:
        found = F.lower(s).rlike("(?i)" + p)
        return F.lower(s).rlike("(?i)" + TYPE_ENDS[p]) & found if p in TYPE_ENDS else found

    return F.coalesce(*[F.when(has(p), F.lit(t)) for t, p in TYPE_PATTERNS])


def agencies(s: Column) -> Column:
    """Agencies by acronym or name, then by pattern, each once."""
    named = F.array_compact(F.array(*[F.when(s.contains(a) | s.contains(n), F.lit(n)) for a, n in AGENCIES.items()]))
    return F.array_distinct(F.concat(named, *[F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(0)) for p in AGENCY_PATTERNS]))


def metrics(s: Column) -> Column:
    """Measurable outcomes as kind:text."""
    def tagged(kind: str):
        return lambda m: F.concat(F.lit(kind + ":"), m)

    return F.concat(*[F.transform(F.regexp_extract_all(s, F.lit("(?i)" + p), F.lit(g)), tagged(kind)) for p, g, kind in METRIC_PATTERNS])


def deadline(s: Column) -> Column:
    """The first deadline by pattern order, else null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(s, "(?i)" + p, 1), F.lit("")) for p in DEADLINE_PATTERNS])


def componentise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Typed sentences of 20 to 500 characters with agencies, metrics, deadline and priority."""
    s = docs.select(key, F.posexplode(X.guarded_sentences(F.col(text))).alias("pos", "sentence")).where(F.char_length("sentence").between(20, 500))
    s = s.withColumn("type", sentence_type(F.col("sentence"))).where("type is not null")
    s = s.withColumns({"agencies": agencies(F.col("sentence")), "metrics": metrics(F.col("sentence")), "deadline": deadline(F.col("sentence"))})
    return s.withColumn("priority", S.priority_score(F.col("sentence"), F.col("deadline"), F.col("agencies")))


def progresses(type_a: Column, text_a: Column, text_b: Column, similarity: Column) -> Column:
    """Whether component a moves b on: resource, authority, precondition, or output as input."""
    a, b = F.lower(text_a), F.lower(text_b)
    resource = (type_a == "resource") & b.rlike("funding|budget|appropriation|allocation|resources")
    authority = (type_a == "authority") & b.rlike("authority|authorization|permission|mandate|directive")
    before = b.rlike("after\\s+(?:the|this)|following\\s+(?:the|this)|upon\\s+completion|based\\s+on") & (similarity > 0.6)
    flow = F.lit(False)
    for out, into in (("report", "based on"), ("data", "analysis of"), ("findings", "based on findings"), ("assessment", "following assessment")):
        flow |= a.contains(out) & b.contains(into)
    return F.coalesce(resource | authority | before | flow, F.lit(False))


def alignment_evidence(kind: Column, agencies_a: Column, agencies_b: Column, deadline_a: Column, deadline_b: Column) -> Column:
    """The evidence text of an alignment."""
    how = F.when(kind == "resource", "resource enables execution").when(kind == "authority", "authority grants permission").otherwise(F.concat(kind, F.lit(" supports delivery")))
    shared = F.array_intersect(agencies_a, agencies_b)
    common = F.when(F.size(shared) > 0, F.concat(F.lit("Shared agencies: "), F.array_join(shared, ", ")))
    da, db = (F.try_to_date(c, "MMMM d, yyyy") for c in (deadline_a, deadline_b))
    order = F.when(da < db, F.concat(F.lit("Sequential deadlines: "), deadline_a, F.lit(" -> "), deadline_b))
    return F.concat_ws(". ", how, common, order)


def suggested_agency(text: Column) -> Column:
    """The agency whose topics a text names first."""
    t = F.lower(text)
    return F.coalesce(*[F.when(t.rlike("|".join(words)), F.lit(name)) for name, words in AGENCY_TOPICS.items()], F.lit("Requires interagency coordination"))


def unassigned(components: DataFrame) -> DataFrame:
    """Requirements and deadlines without an agency, with a suggestion."""
    c = components.where(F.col("type").isin("requirement", "deadline") & (F.size("agencies") == 0))
    return c.withColumn("suggested_agency", suggested_agency(F.col("sentence")))


def unsupported_deadlines(components: DataFrame, alignments: DataFrame, key: str = "id") -> DataFrame:
    """Deadlines that no alignment (src, dst) supports."""
    return components.where("type = 'deadline'").join(alignments.select(F.col("dst").alias(key)), key, "left_anti")


def resource_gaps(components: DataFrame, alignments: DataFrame, key: str = "id", first: int = 10) -> DataFrame:
    """Of the first requirements those that no resource component supports."""
    resources = components.where("type = 'resource'").select(F.col(key).alias("src"))
    fed = alignments.join(resources, "src", "left_semi").select(F.col("dst").alias(key))
    return components.where("type = 'requirement'").orderBy(key).limit(first).join(fed, key, "left_anti")


def broken_chains(components: DataFrame, alignments: DataFrame, key: str = "id") -> DataFrame:
    """Pairs of components that share an agency or whose deadlines are 90 to 365 days apart, without an alignment."""
    c = components.select(F.col(key).alias("k"), "agencies", F.try_to_date("deadline", "MMMM d, yyyy").alias("due"))
    by_agency = c.select("k", F.explode("agencies").alias("g"))
    one = by_agency.select(F.col("k").alias("a"), "g").join(by_agency.select(F.col("k").alias("b"), "g"), "g").where("a < b").select("a", "b")
    month = c.where("due is not null").withColumn("m", F.floor(F.datediff("due", F.lit("1970-01-01").cast("date")) / 365))
    x = month.select(F.col("k").alias("a"), F.col("due").alias("da"), F.explode(F.array(F.col("m") - 1, F.col("m"), F.col("m") + 1)).alias("m"))
    two = x.join(month.select(F.col("k").alias("b"), F.col("due").alias("db"), "m"), "m").where("a < b and abs(datediff(da, db)) between 90 and 365").select("a", "b")
    have = alignments.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return one.unionByName(two).distinct().join(have, ["a", "b"], "left_anti")


def clauses(docs: DataFrame, prefix: str, key: str = "doc_id", text: str = "text", fallback: int = 25) -> DataFrame:
    """Numbered requirement sentences with their citations; without any, the first cited sentences."""
    s = docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence")).withColumn("citations", X.citations(F.col("sentence")))
    w = W.partitionBy(key)
    s = s.withColumn("modal", F.col("sentence").rlike(MODAL)).withColumn("any_modal", F.max("modal").over(w)).where("modal or (not any_modal and size(citations) > 0)")
    s = s.withColumn("n", F.row_number().over(w.orderBy("pos"))).where(F.col("any_modal") | (F.col("n") <= fallback))
    return s.select(key, F.concat(F.lit(prefix + "-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("clause_id"), "sentence", "citations")


def split_sections(docs: DataFrame, heading: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, heading, body) by a heading pattern; the text before the first has a null heading."""
    heads = F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(F.col(text), F.lit(heading), F.lit(0)))
    bodies = F.split(F.col(text), heading, -1)
    rows = docs.select(key, F.posexplode(F.arrays_zip(heads.alias("heading"), bodies.alias("body"))).alias("pos", "s"))
    return rows.select(key, "pos", F.trim(F.col("s.heading")).alias("heading"), F.trim(F.col("s.body")).alias("body"))


def order_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sections 'Sec. N.' of an order and their (a), (b) subsections."""
    s = split_sections(docs, "Sec(?:tion|\\.)\\s+\\d+\\.", key, text).where("heading is not null")
    sub = s.select(key, F.col("heading").alias("section"), F.posexplode(F.split("body", "(?=\\([a-z]\\)\\s)")).alias("part", "component"))
    return sub.select(key, "section", "part", F.trim("component").alias("component")).where("component != ''")


def bullets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Bullet lines with the last '## ' or 'Pillar' heading before them."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    head = F.when(F.col("line").rlike("^(##\\s|Pillar\\b|Section\\b)"), F.regexp_replace("line", "^##\\s+", ""))
    named = lines.withColumn("section", F.last(head, ignorenulls=True).over(w)).where(F.col("line").rlike("^[-*•]\\s"))
    return named.select(key, "pos", "section", F.regexp_replace("line", "^[-*•]\\s+", "").alias("item"))


def section_components(sections: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings of level 1 and 2 and requirement sentences as components; short names are rebuilt, descriptions of 20 characters at least, 50 at most a name."""
    s = sections.select(key, "pos", "heading", F.posexplode(X.policy_sentences(F.col("body"))).alias("n", "description")).where(X.likely_requirement(F.col("description")) & (F.char_length("description") >= 20))
    name = X.policy_action(F.col("description"))
    return s.select(key, "pos", "n", F.left(F.when(F.char_length(name) < 3, F.left("description", F.lit(50))).otherwise(name), F.lit(50)).alias("name"), "description")


def rationales(pairs: DataFrame, requirement: str, text: str) -> DataFrame:
    """Pairs with the reasons that both texts name, joined by a space; pairs without one go."""
    r, t = F.lower(F.col(requirement)), F.lower(F.col(text))
    found = F.concat_ws(" ", *[F.when(r.rlike(p) & t.rlike(q), F.lit(name)) for name, p, q in RATIONALES])
    return pairs.withColumn("rationale", found).where("rationale != ''")


def snippets(c: Column, word: str, reach: int = 200) -> Column:
    """The word with reach characters on both sides at each place, joined by ---."""
    # The gaps of a text are bound by a lambda, as a lambda that names their expression cuts the text anew for each place.
    def joined(gaps: Column) -> Column:
        one = F.transform(F.sequence(F.lit(1), F.size(gaps) - 1), lambda i: F.concat(F.right(F.get(gaps, i - 1), F.lit(reach)), F.lit(word), F.left(F.get(gaps, i), F.lit(reach))))
        return F.when(F.size(gaps) > 1, F.array_join(one, "---")).otherwise("")

    return F.transform(F.array(F.split(F.lower(c), word, -1)), joined)[0]


def document_title(c: Column, metadata: Column | None = None, fallback: Column | None = None, early: int = 8000) -> Column:
    """The document's own title field if it has ten characters, else the longest match of the first pattern that the early
    text has (a title block stands there, so the limit is the feature), else the fallback (a file name), without scanning errors."""
    head = F.left(c, F.lit(early))

    def longest(pattern: str) -> Column:
        found = F.transform(F.regexp_extract_all(head, F.lit(pattern), F.lit(1)), lambda m, i: F.struct((-F.char_length(m)).alias("n"), i.alias("i"), m.alias("m")))
        return F.when(F.size(found) > 0, F.array_min(found)["m"])

    known = F.when(F.char_length(metadata) >= 10, metadata) if metadata is not None else F.lit(None).cast("string")
    title = F.coalesce(known, *[longest(p) for p in TITLE_PATTERNS])
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(title, "(?<![0-9])l(?=[0-9])", "1"), "\\s+", " ")), F.lit(""))
    return F.coalesce(title, F.initcap(F.translate(fallback, "_", " "))) if fallback is not None else title


def page_ranges(bookmarks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, title, first_page, last_page): each bookmark (title, page) ends where the next begins."""
    nxt = F.lead("page").over(W.partitionBy(key).orderBy("page", "title"))
    return bookmarks.select(key, "title", F.col("page").alias("first_page"), F.greatest(F.col("page"), nxt - 1).alias("last_page"))


def layout_sections(boxes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Boxes (page, n, text, size, bold) that are larger than the document's median size or match a heading pattern, with a level."""
    w = W.partitionBy(key)
    b = boxes.withColumn("body", F.median("size").over(w))
    pattern = "^(?:(?:SEC(?:TION)?\\.?|TITLE|CHAPTER|PART|ARTICLE)\\s+[0-9IVX]+|[0-9]+(?:\\.[0-9]+)*\\.?\\s+[A-Z]|\\([a-z]\\)\\s)"
    is_head = (F.col("size") > F.col("body") * 1.1) | F.col("text").rlike(pattern) | (F.col("bold") & (F.char_length("text") < 100))
    level = F.when(F.col("size") > F.col("body") * 1.4, 1).when(F.col("size") > F.col("body") * 1.1, 2).otherwise(3)
    return b.where(is_head).select(key, "page", "n", "text", level.alias("level"))


def context_sentence(sentences: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sentence before, where it has fewer than 50 words."""
    before = F.lag("sentence").over(W.partitionBy(key).orderBy("pos"))
    return sentences.withColumn("context", F.when(F.size(F.split(before, "\\s+")) < 50, before))


def summarise(docs: DataFrame, n: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n sentences with the greatest sum of word frequencies, in reading order."""
    s = docs.select(key, F.posexplode(X.policy_sentences(F.col(text))).alias("pos", "sentence"))
    words = s.select(key, "pos", F.explode(X.alpha_tokens(F.col("sentence"))).alias("word"))
    freq = words.groupBy(key, "word").agg(F.count("*").alias("f"))
    score = words.join(freq, [key, "word"]).groupBy(key, "pos").agg(F.sum("f").alias("score"))
    best = score.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "pos"))).where(F.col("r") <= n)
    kept = s.join(best, [key, "pos"]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("x"))
    return kept.select(key, F.array_join(F.transform("x", lambda t: t["sentence"]), " ").alias("summary"))
