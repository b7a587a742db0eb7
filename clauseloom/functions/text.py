"""Text expressions: null policies, cleaning, tokenizing, extraction. All are native columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists, patterns, tables -----------------------------------------------------
STOP_REQUIREMENT = ["the", "and", "for", "with", "from", "that", "this", "into", "such", "shall", "must", "within", "will", "are", "is", "under", "subject", "section", "order", "mission", "launching"]
SAME_SOURCE_WORDS = ["instructions", "directives", "regulations", "policies", "guidance"]
CITATION_PATTERNS = [
    r"\b\d+\s*U\.?\s*S\.?\s*C\.?\s*(?:section|sec\.?|§)?\s*[\w\-\.()]*",
    r"\bExecutive\s+Order\s+\d{4,6}\b",
    r"\bE\.?\s*O\.?\s*\d{4,6}\b",
    r"\bOMB\b[^.;,\n]{0,80}",
    r"\bCircular\s+[A-Z]-\d+(?:-\d+)?\b",
    r"\bM-\d{2}-\d{2}\b",
    r"\bFederal\s+Register\b[^.;,\n]{0,80}",
    r"\bPublic\s+Law\s+\d+-\d+\b",
]
CITATION_FORMS = [
    (r"(?i)\b(\d+)\s*(U\.S\.C\.|USC|U\.S\. Code)\s*§?\s*(\d+(\.\d+)*([a-zA-Z0-9()]*)?)", "$1 USC $3"),
    (r"(?i)\b(\d+)\s*(C\.F\.R\.|CFR|Code of Federal Regulations)\s*§?\s*(\d+(\.\d+)*([a-zA-Z0-9()]*)?)", "$1 CFR $3"),
    (r"(?i)\b(E\.O\.|Executive\s*Order)\s*(\d+)", "Executive Order $2"),
    (r"(?i)\bEO\s+(\d+)\b", "Executive Order $1"),
    (r"(?i)\b(Public\s+Law|P\.L\.)\s*(\d{1,3}[-–]\d{1,4})", "Public Law $2"),
    (r"(?i)\bAct\s+of\s+(\d{4})", "Act of $1"),
    (r"(?i)\bTitle\s+(\d+)", "Title $1"),
]
POLICY_VERBS = ["establish", "develop", "implement", "create", "submit", "report", "coordinate", "modernize", "digitize", "require", "fund", "enhance", "allocate", "deliver", "plan", "strengthen", "provide", "ensure"]
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# ------------------------------------------------------------------------------------------------------


def blank(c: Column) -> Column:
    """Policy N1: null is an empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c computed once; a lambda that names an expression computes it anew for each element."""
    return F.transform(F.array(c), f)[0]


def usable(c: Column) -> Column:
    """Policy N2: trimmed text; null for null, blank and 'nan'."""
    t = F.trim(c.cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


def first_usable(*cols: Column) -> Column:
    """The first usable value of several columns, else an empty string."""
    return F.coalesce(*[usable(c) for c in cols], F.lit(""))


def text_or(c: Column, default: str) -> Column:
    """Trimmed text or the default."""
    return F.coalesce(F.trim(c.cast("string")), F.lit(default))


def clean_field(c: Column) -> Column:
    """Null to blank; tab, newline and carriage return to spaces."""
    return F.translate(blank(c), "\t\n\r", "   ")


def strip_controls(c: Column) -> Column:
    """Control characters, no-break spaces and bullets out."""
    return F.regexp_replace(c, "[\\x00-\\x1F\\x7F-\\x9F\\u00A0\\u2022]", "")


def limit_length(c: Column, n: int = 3999) -> Column:
    """P15."""
    return F.left(c, F.lit(n))


def ascii_quotes(c: Column) -> Column:
    """Typographic quotes to ASCII."""
    return F.translate(c, "“”‘’", "\"\"''")


def one_space(c: Column) -> Column:
    """Runs of spaces to one."""
    return F.regexp_replace(c, " +", " ")


def excel_cell(c: Column, n: int = 32_000) -> Column:
    """Text without control characters, cut to what a cell holds."""
    return F.left(F.regexp_replace(c.cast("string"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", ""), F.lit(n))


def printable(c: Column) -> Column:
    """Characters below 32 go, except tab, LF and CR."""
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def ascii_fold(c: Column) -> Column:
    """P20: dashes, quotes and ellipsis to ASCII, other characters to '?'."""
    t = F.replace(F.translate(c, "–—“”‘’ ", "--\"\"'' "), F.lit("…"), F.lit("..."))
    return F.regexp_replace(t, "[^\\x00-\\x7F]", "?")


def plain_apostrophes(c: Column) -> Column:
    """Seven apostrophe forms to one."""
    return F.translate(c, "’‘ʼʹ`´′", "'''''''")


def content_lines(c: Column) -> Column:
    """Menu lines and short lines without letters or digits go; blank lines collapse."""
    keep = F.filter(F.split(c, "\n"), lambda s: ~F.lower(F.trim(s)).isin("home", "menu") & ((F.char_length(F.trim(s)) >= 3) | F.trim(s).rlike("[A-Za-z0-9]") | (F.trim(s) == "")))
    return F.trim(F.regexp_replace(F.array_join(F.transform(keep, lambda s: F.trim(s)), "\n"), "\n{3,}", "\n\n"))


def strip_hyperlink(c: Column) -> Column:
    """A HYPERLINK formula to its address."""
    return F.regexp_replace(c, '(?i)^=HYPERLINK\\("([^"]*)".*$', "$1")


def snake(name: str) -> str:
    """P23."""
    return name.strip().lower().replace(" ", "_")


# ---- tokenizers ---------------------------------------------------------------------------------------
def _tokens(c: Column, drop: str, stop: list[str] | None = None, least: int = 1) -> Column:
    words = F.split(F.regexp_replace(F.lower(blank(c)), drop, " "), "\\s+")
    keep = F.filter(words, lambda w: F.char_length(w) >= least)
    return F.filter(keep, lambda w: ~w.isin(stop)) if stop else keep


def hyphen_words(c: Column) -> Column:
    """Lower-case words, hyphens kept."""
    return F.filter(F.split(F.regexp_replace(F.lower(blank(c)), "[^\\p{L}\\p{N}_\\s-]", ""), "\\s+"), lambda w: w != "")


def squash(c: Column) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^\\p{L}\\p{N}_\\s]", ""), "\\s+", " "))


def without_stops(c: Column, stop: list[str]) -> Column:
    """Punctuation to spaces, stop words out, joined again."""
    return F.array_join(_tokens(c, "[^\\p{L}\\p{N}_\\s]", stop), " ")


def requirement_tokens(c: Column) -> Column:
    """ASCII letters and digits, longer than two, 21 stop words out."""
    return _tokens(c, "[^a-z0-9\\s]", STOP_REQUIREMENT, 3)


def alpha_tokens(c: Column, stop: list[str] | None = None) -> Column:
    """Runs of three or more ASCII letters."""
    found = F.regexp_extract_all(F.lower(blank(c)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(stop)) if stop else found


def long_keywords(c: Column, stop: list[str] | None = None) -> Column:
    """Words longer than three characters."""
    return _tokens(c, "[^\\p{L}\\p{N}_\\s]", stop, 4)


def clean_for_words(c: Column) -> Column:
    """Lower case; other characters than word characters and hyphens to spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), "[^\\p{L}\\p{N}_\\s-]", " "), "\\s+", " "))


def clean_tokens(c: Column) -> Column:
    """The words of X08 longer than three."""
    return F.filter(F.split(clean_for_words(c), " "), lambda w: F.char_length(w) > 3)


def tfidf_tokens(c: Column) -> Column:
    """M01's tokens: lower-case runs of two or more word characters."""
    return F.regexp_extract_all(F.lower(blank(c)), F.lit("[\\p{L}\\p{N}_]{2,}"), F.lit(0))


def acronyms(c: Column, exclude: list[str] | None = None) -> Column:
    """Upper-case words in order, each once."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("\\b[A-Z][A-Z0-9]++\\b(?:-[A-Z0-9]++\\b)*+"), F.lit(0)))
    return F.filter(found, lambda w: ~w.isin(exclude)) if exclude else found


def distinct_folded(a: Column) -> Column:
    """Distinct without regard to case; the first spelling stays."""
    def firsts(s: Column) -> Column:
        one = F.filter(s, lambda e, i: e["low"].isNotNull() & ~e["low"].eqNullSafe(F.get(s, i - 1)["low"]))
        return F.transform(F.sort_array(F.transform(one, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])

    return bound(F.sort_array(F.transform(a, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("i"), x.alias("x")))), firsts)


def most_frequent(words: Column, k: int, least: int = 1) -> Column:
    """The k most frequent of an array's words that occur least times or more; of equals the first in it. The array is sorted in its row."""
    def runs(s: Column) -> Column:
        at = F.filter(F.transform(s, lambda e, i: F.struct(e["w"].alias("w"), e["i"].alias("first"), i.alias("at"))), lambda e: ~e["w"].eqNullSafe(F.get(s, e["at"] - 1)["w"]))
        return bound(at, lambda t: F.transform(t, lambda e, j: F.struct((e["at"] - F.coalesce(F.get(t, j + 1)["at"], F.size(s))).alias("minus"), e["first"], e["w"])))

    counted = bound(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), runs)
    best = F.slice(F.sort_array(F.filter(counted, lambda e: e["minus"] <= -least)), 1, k)
    return F.transform(best, lambda e: e["w"])


def word_runs(words: Column, size: int, stop: list[str] | None = None) -> Column:
    """The runs of size words of an array in order, without those of stop words alone."""
    def run(w: Column, i: Column) -> Column:
        parts = [w] + [F.get(words, i + k) for k in range(1, size)]
        whole = parts[-1].isNotNull()
        return F.when(whole & F.exists(F.array(*parts), lambda x: ~x.isin(stop)) if stop else whole, F.concat_ws(" ", *parts))

    return F.array_compact(F.transform(words, run))


def capital_phrases(c: Column) -> Column:
    """X11: phrases of capitalised words, and names before a bracketed acronym.

    The patterns never step back, as one that does goes a level deeper for each word and breaks on thousands of them. A run of names is
    taken with or without its acronym, so that it is read once.
    """
    one = F.regexp_extract_all(c, F.lit("\\b([A-Z][a-z]++(?:\\s++(?:[A-Z][a-z]++|[A-Z]++|of|and|the|for)\\b)++)"), F.lit(1))
    names = F.regexp_extract_all(c, F.lit("[A-Z][a-z]++(?:\\s++[A-Z][a-z]++)++(?:\\s*+\\([A-Z]{2,}+\\))?+"), F.lit(0))
    two = F.transform(F.filter(names, lambda x: x.endswith(")")), lambda x: F.regexp_replace(x, "\\s*+\\([A-Z]++\\)$", ""))
    return distinct_folded(F.concat(one, two))


def citations(c: Column) -> Column:
    """Citations of eight kinds, kind by kind, each once without regard to case."""
    every = F.concat(*[F.regexp_extract_all(blank(c), F.lit("(?i)" + p), F.lit(0)) for p in CITATION_PATTERNS])
    flat = F.transform(every, lambda x: F.trim(F.regexp_replace(x, "\\s+", " ")))
    return distinct_folded(F.filter(flat, lambda x: x != ""))


def canonical_citation(c: Column) -> Column:
    """Citations in their canonical forms."""
    return reduce(lambda acc, f: F.regexp_replace(acc, *f), CITATION_FORMS, c)


def citation_context(c: Column, pattern: str = r"\d+\s+U\.?S\.?C\.?\s*§?\s*\d+", reach: int = 100) -> Column:
    """(citation, context) with reach characters on both sides of each match."""
    found, gaps = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern, -1)
    around = lambda m, i: F.struct(m.alias("citation"), F.concat(F.right(F.get(gaps, i), F.lit(reach)), m, F.left(F.get(gaps, i + 1), F.lit(reach))).alias("context"))
    return F.transform(found, around)


def sentences(c: Column, least: int = 40) -> Column:
    """Sentences by final punctuation, single-spaced, of at least least characters."""
    parts = F.transform(F.split(blank(c), "(?<=[.!?])\\s+"), lambda s: F.trim(F.regexp_replace(s, "\\s+", " ")))
    return F.filter(parts, lambda s: F.char_length(s) >= least)


def guarded_sentences(c: Column) -> Column:
    """Sentences, with the periods of abbreviations protected."""
    held = F.regexp_replace(blank(c), "\\b(U\\.S|Mr|Mrs|Ms|Dr|Inc|Ltd|Co|No|Sec|e\\.g|i\\.e|etc)\\.", "$1\u0001")
    parts = F.split(held, "(?<=[.!?])\\s+")
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def mend_hyphens(c: Column) -> Column:
    """Words broken at a hyphen are joined, spaces collapse."""
    t = F.regexp_replace(c, "([\\p{L}\\p{N}_]+)-\\s+([\\p{L}\\p{N}_]+)", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "\\s+", " "), "([a-z])- ([a-z])", "$1$2"))


def mend_scan(c: Column) -> Column:
    """Spaces, quotes and characters that scanning confuses."""
    t = F.translate(F.regexp_replace(c, "\\s+", " "), "“”‘’|", "\"\"''I")
    return F.trim(F.regexp_replace(t, "(\\d)l(\\d)", "$11$2"))


def years(c: Column) -> Column:
    """Years of ranges, fiscal years and bare years, sorted, each once."""
    ints = lambda pattern, g: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(g)), lambda y: y.cast("int"))
    fiscal = F.transform(F.regexp_extract_all(c, F.lit("(?i)FY\\s*(\\d{2,4})"), F.lit(1)), lambda y: F.when(F.char_length(y) == 2, y.cast("int") + 2000).otherwise(y.cast("int")))
    return F.array_sort(F.array_distinct(F.concat(ints("(\\d{4})-(\\d{4})", 1), ints("(\\d{4})-(\\d{4})", 2), fiscal, ints("\\b(19\\d{2}|20\\d{2})\\b", 1))))


def document_type(title: Column) -> Column:
    """The kind of document that a title names."""
    has = lambda s: title.contains(s)
    rules = [
        (has("Strategic Plan"), "Strategic Plan"), (has("Annual") & (has("Plan") | has("Report") | has("Performance")), "Annual Plan/Report"), (has("Budget Explanatory Notes"), "Budget Explanatory Notes"),
        (title.startswith("OMB M-"), "OMB Memorandum"), (title.startswith("NIST SP"), "NIST Publication"), (title.startswith("EO "), "Executive Order"),
        (has("Data Strategy"), "Data Strategy"), (has("Learning Agenda"), "Learning Agenda"), (has("Evaluation Plan"), "Evaluation Plan"),
    ]
    return F.coalesce(*[F.when(test, F.lit(kind)) for test, kind in rules], F.lit("Other"))


def obsolete(title: Column, year: int = 2026) -> Column:
    """whether a source of that title is likely to be out of date in the year."""
    kind, last = document_type(title), F.array_max(years(title))
    limit = F.when(kind.isin("Strategic Plan", "Budget Explanatory Notes", "Data Strategy", "Learning Agenda", "Evaluation Plan"), year).when(kind == "Annual Plan/Report", year - 1).when(kind == "OMB Memorandum", 2025)
    return F.coalesce(last < limit, F.lit(False))


def any_date(c: Column) -> Column:
    """A date in one of four formats, else null."""
    return F.coalesce(*[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy")])


def find_date(c: Column) -> Column:
    """The first ISO, US or month-name date in a text."""
    tries = [("\\d{4}-\\d{2}-\\d{2}", "yyyy-MM-dd"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "M/d/yyyy"), (f"(?:{MONTHS})\\s+\\d{{1,2}},\\s+\\d{{4}}", "MMMM d, yyyy")]
    return F.coalesce(*[F.try_to_date(F.regexp_replace(F.nullif(F.regexp_extract(c, p, 0), F.lit("")), "\\s+", " "), f) for p, f in tries])


def iso_prefix(c: Column) -> Column:
    """X24."""
    return F.try_to_date(F.left(c, F.lit(10)), "yyyy-MM-dd")


def case_citation(url: Column) -> Column:
    """The case that an address names."""
    number = F.regexp_extract(url, "(?i)(20\\d{2}-\\d{3})", 1)
    return F.when(number != "", F.concat(F.lit("FAR Case "), number)).otherwise(F.lit("FAR Case"))


def slug_title(url: Column) -> Column:
    """A title from the last part of an address."""
    return F.initcap(F.translate(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), "-_", "  "))


def guess_metadata(url: Column, text: Column) -> Column:
    """Authority by host, document type by address, first date of the first 1000 characters."""
    host, low = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.lower(url)
    authority = F.when(host.contains("whitehouse.gov"), "Executive Office of the President").when(host.contains("congress.gov"), "U.S. Congress")
    authority = authority.when(host.rlike("epa\\.gov|energy\\.gov|commerce\\.gov"), F.concat(F.upper(F.element_at(F.split(host, "\\."), 1)), F.lit(" Department"))).otherwise("U.S. Government")
    kind = F.when(low.rlike("executive-order|eo-"), "Executive Order").when(low.rlike("public-law|pl-"), "Public Law").when(low.rlike("omb-memo|circular"), "OMB Memorandum").when(low.contains("strategic-plan"), "Strategic Plan").otherwise("Web Page")
    head = F.left(text, F.lit(1000))
    dates = [F.nullif(F.regexp_extract(head, p, 0), F.lit("")) for p in ("\\d{1,2}/\\d{1,2}/\\d{4}", "\\d{4}-\\d{2}-\\d{2}", f"(?:{MONTHS})\\s+\\d{{1,2}},\\s+\\d{{4}}")]
    return F.struct(authority.alias("authority"), kind.alias("doc_type"), F.coalesce(*dates, F.lit("")).alias("date"))


def triad_hash(name: Column, description: Column, source: Column) -> Column:
    """SHA-256 of the three fields; a null is written 'nan'."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(c.cast("string"), F.lit("nan")) for c in (name, description, source)]), 256)


def match_id(a: Column, b: Column) -> Column:
    """16 hex digits of the SHA-1 of both names."""
    return F.left(F.sha1(F.concat_ws("||", F.lower(F.trim(blank(a))), F.lower(F.trim(blank(b))))), F.lit(16))


def component_hash(*parts: Column) -> Column:
    """X30: 'C' and eight hex digits of an MD5."""
    return F.concat(F.lit("C"), F.left(F.md5(F.concat_ws("|", *[F.lower(F.trim(blank(p))) for p in parts])), F.lit(8)))


def composite_id(source: Column, name: Column) -> Column:
    """Source::name, null if either is."""
    return F.concat(source, F.lit("::"), name)


def decision(c: Column) -> Column:
    """The spellings of a reviewer's decision."""
    t = F.lower(F.trim(blank(c)))
    return F.when(t.isin("accept", "accepted", "a", "yes", "y"), "Accept").when(t.isin("reject", "rejected", "r", "no", "n"), "Reject").otherwise("Needs Review")


def policy_action(c: Column) -> Column:
    """X35: 'Verb Object' by the first policy verb of the list, else the first three words."""
    low = F.lower(c)
    tries = []
    for verb in POLICY_VERBS:
        p = f"\\b({verb})\\b\\s+([a-z]{{1,20}}\\s+){{0,3}}([a-z]{{3,20}})"
        tries.append(F.when(low.rlike(p), F.initcap(F.concat_ws(" ", F.regexp_extract(low, p, 1), F.regexp_extract(low, p, 3)))))
    return F.coalesce(*tries, F.initcap(F.array_join(F.slice(F.split(F.trim(c), "\\s+"), 1, 3), " ")))


def _flag(c: Column, pattern: str) -> Column:
    return F.when(c.rlike("(?i)" + pattern), 1).otherwise(0)


def policy_sentences(c: Column) -> Column:
    return F.split(c, "(?<=[.!?])\\s+(?=[A-Z0-9])")


def best_sentence(c: Column) -> Column:
    """The sentence with the highest score; of equals the first."""

    def score(s: Column) -> Column:
        words = F.size(F.split(F.trim(s), "\\s+"))
        return F.when(words.between(10, 40), 2).otherwise(0) + 3 * _flag(s, "\\b(shall|must|will|should|require|implement|establish|develop)\\b") + _flag(s, "\\b(day|week|month|year|annually|quarterly)\\b") + _flag(s, "\\b(\\d+%|\\d+\\s+percent|\\$\\d+|\\d+\\s+dollars)\\b")

    ranked = F.transform(policy_sentences(c), lambda s, i: F.struct((-score(s)).alias("k"), i.alias("i"), s.alias("s")))
    return F.element_at(F.array_sort(ranked), 1)["s"]


def first_words(c: Column, n: int = 300) -> Column:
    """X39."""
    return F.array_join(F.slice(F.regexp_extract_all(c, F.lit("\\S+"), F.lit(0)), 1, n), " ")


# ---- predicates ---------------------------------------------------------------------------------------
def source_key(c: Column) -> Column:
    """what two related sources have in common."""
    t = F.regexp_replace(F.lower(F.trim(blank(c))), "\\b(" + "|".join(SAME_SOURCE_WORDS) + ")\\b", "")
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def same_source(a: Column, b: Column) -> Column:
    return (F.lower(F.trim(blank(a))) == F.lower(F.trim(blank(b)))) | (source_key(a) == source_key(b))


def same_component(a: Column, b: Column) -> Column:
    """F03."""
    return F.lower(F.trim(blank(a))) == F.lower(F.trim(blank(b)))


def likely_requirement(c: Column) -> Column:
    """a sentence that reads like a requirement."""
    t = F.trim(c)
    words = F.size(F.split(t, "\\s+"))
    verbs = "\\b(is|are|was|were|be|being|been|shall|must|will|should|establish|develop|create|submit|report|coordinate|implement|modernize|digitize)\\b"
    acts = "\\b(establish|develop|implement|digitize|coordinate|fund|enhance|require|submit|carry out|allocate|build|deliver|modernize|report|plan|strengthen)\\b"
    actor = "\\b(The (Secretary|Agency|Department|Administrator|Office|Program|Director))\\b.+?\\b(shall|must|will|is to|is required to)\\b"
    shouting = (F.upper(t) == t) & (F.lower(t) != t) & (words < 10)
    sign = t.rlike("(?i)^(First|Second|Third|Fourth|Fifth)[\\s,:]") | t.rlike("(?i)^\\d{1,3}\\s+(U\\.?S\\.?C\\.?|H\\.?R\\.?)") | t.rlike("(?i)" + acts) | t.rlike("(?i)" + actor)
    return F.coalesce((words >= 7) & ~shouting & t.rlike("(?i)" + verbs) & sign, F.lit(False))


def content_status(url: Column, content: Column) -> Column:
    """EMPTY, EQUALS_URL, ONLY_URL, TOO_SHORT or OK."""
    t = F.trim(blank(content))
    return F.when(t == "", "EMPTY").when(t == F.trim(url), "EQUALS_URL").when(t.rlike("^https?://\\S+$"), "ONLY_URL").when(F.char_length(t) < 40, "TOO_SHORT").otherwise("OK")


def gov_host(url: Column) -> Column:
    """F14."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).rlike("(^|\\.)[a-z0-9-]+\\.gov$"), F.lit(False))


def document_url(url: Column) -> Column:
    """an address that ends in a document's extension or asks for a download."""
    path, query = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))), F.lit("")), F.coalesce(F.lower(F.try_parse_url(url, F.lit("QUERY"))), F.lit(""))
    return path.rlike("\\.(pdf|docx?|xlsx?|pptx?|csv|txt|xml)$") | query.rlike("(^|&)(download|file|attachment|doc|document)=")


def date_window(d: Column, reference: Column, days: int = 62) -> Column:
    """within so many days before the reference date."""
    return d.between(F.date_sub(reference, days), reference)


def case_url(url: Column) -> Column:
    """F18."""
    return F.coalesce(F.lower(url).rlike("far-case-\\d{4}-\\d{3}|/far/cases?/"), F.lit(False))


def generic_name(c: Column) -> Column:
    """a name that says nothing."""
    t = F.lower(F.trim(blank(c)))
    return t.rlike("^(the|this|that|these|those|it|they|section|part|item|general|other|misc(ellaneous)?|n/?a|none|unknown|untitled)$") | (F.char_length(t) < 3) | t.rlike("^[^a-z]*$")


# ---- html -----------------------------------------------------------------------------------------------
def html_text(html: Column) -> Column:
    """The text of a page without scripts, styles and tags."""
    t = html
    for tag in ("script", "style", "noscript"):
        t = F.regexp_replace(t, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    t = F.replace(F.regexp_replace(t, "<[^>]+>", " "), F.lit(" "), F.lit(" "))
    return F.trim(F.regexp_replace(t, "\\s+", " "))


def html_title(html: Column) -> Column:
    found = F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title>(.*?)</title>", 1), "\\s+", " "))
    return F.when(html.rlike("(?is)<title>.*?</title>"), found).otherwise("Untitled")


def html_main(html: Column, lines: int = 500) -> Column:
    """The first lines of text outside scripts, styles and navigation."""
    t = html
    for tag in ("script", "style", "nav", "footer", "header"):
        t = F.regexp_replace(t, f"(?is)<{tag}\\b[^>]*>.*?</{tag}>", " ")
    parts = F.transform(F.split(F.regexp_replace(t, "<[^>]+>", "\n"), "\n"), lambda s: F.trim(s))
    return F.array_join(F.slice(F.filter(parts, lambda s: s != ""), 1, lines), "\n")


def lead_text(text: Column, most: int = 800, least: int = 400) -> Column:
    """Single-spaced, cut at the last period beyond least characters of the first most."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    head = F.left(t, F.lit(most))
    at = F.lit(most) - F.instr(F.reverse(head), ".") + 1
    return F.when(F.char_length(t) <= most, t).when(head.contains(".") & (at > least), F.left(t, at)).otherwise(head)


def links(html: Column) -> Column:
    """The addresses of a page's links, each once."""
    return F.array_distinct(F.regexp_extract_all(html, F.lit("(?i)href=[\"']([^\"'#]+)"), F.lit(1)))
