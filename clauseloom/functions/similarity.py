"""Scores, buckets and heuristics over pairs of texts. Native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------------------------
CAUSAL_VERBS = ["enable", "support", "provide", "supply", "reduce", "improve", "accelerate", "facilitate", "ensure", "deliver"]
SHARED_OUTCOMES = ["compliance", "risk", "speed", "law", "performance", "priority", "outcome"]
PREREQUISITES = ["guidance", "policy", "training", "infrastructure", "funding"]
MORE_VERBS = CAUSAL_VERBS + ["authorize", "fund", "mandate", "require"]
MORE_OUTCOMES = SHARED_OUTCOMES + ["security", "interoperability", "transparency", "efficiency", "oversight"]
MORE_PREREQUISITES = PREREQUISITES + ["authorization", "approval"]
ENABLING_KEYWORDS = [
    "enable", "enables", "enabling", "support", "supports", "supporting", "provide", "provides", "providing", "require", "requires", "required", "prerequisite", "dependency", "depends", "dependent",
    "foundation", "capability", "resource", "input", "output", "deliver", "deliverable", "implement", "implements", "implementation", "integrate", "integration",
]
DOMAINS = {
    "security": ["security", "authentication", "authorization", "access", "compliance"],
    "data": ["data", "database", "analytics", "reporting", "warehouse"],
    "infrastructure": ["infrastructure", "network", "server", "cloud", "platform"],
    "application": ["application", "software", "system", "module", "interface"],
    "process": ["process", "workflow", "procedure", "policy", "governance"],
}
ENABLING_PHRASES = [(r"enables?\s+\w+", 0.15), (r"supports?\s+\w+", 0.1), (r"prerequisite\s+for", 0.2), (r"required\s+by", 0.15), (r"foundation\s+for", 0.15), (r"capability\s+to", 0.1)]
# ---------------------------------------------------------------------------------------------------------


def cosine(a: Column, b: Column) -> Column:
    """M04, M05's inner part: cosine of two numeric arrays, in double."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def unit_cosine(a: Column, b: Column) -> Column:
    """Cosine from [-1, 1] to [0, 1], clamped; null is 0."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (cosine(a, b) + 1) / 2)), F.lit(0.0))


def combined(name: Column, description: Column, a_description: Column, b_description: Column) -> Column:
    """0.4 name + 0.6 description; the name alone where a description is blank."""
    blank = (F.trim(F.coalesce(a_description, F.lit(""))) == "") | (F.trim(F.coalesce(b_description, F.lit(""))) == "")
    return F.when(blank, name).otherwise(0.4 * name + 0.6 * description)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if one has none."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def trait_signal(shared: Column, positive: Column, negative: Column) -> Column:
    """(positive - negative + 5) / 10 of the shared tokens, clamped; 0 without shared tokens."""
    pos, neg = F.size(F.array_intersect(shared, positive)), F.size(F.array_intersect(shared, negative))
    return F.when(F.size(shared) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (pos - neg + 5) / 10))).otherwise(0.0)


def final_score(text: Column, embedding: Column, enabling: Column, master: Column, weights=(0.2, 0.3, 0.4, 0.1)) -> Column:
    """The weighted score; weights that do not sum to 1 are normalised."""
    total = sum(weights)
    return sum((w / total) * s for w, s in zip(weights, (text, embedding, enabling, master), strict=True))


def pair_bucket(score: Column, valid: Column, confirmed: float = 0.75, review: float = 0.7) -> Column:
    """M15."""
    return F.when(~valid, "Rejected").when(score >= confirmed, "Confirmed").when(score >= review, "Review_Needed").otherwise("Rejected")


def confidence_bucket(score: Column) -> Column:
    """P24."""
    return F.when(score >= 0.8, "High").when(score >= 0.6, "Medium").otherwise("Low")


def confidence_label(score: Column) -> Column:
    """High from 0.80, Medium from 0.50; a score outside [0, 1] is an error."""
    bad = F.raise_error(F.lit("confidence_score must be between 0.00 and 1.00")).cast("string")
    return F.when((score < 0) | (score > 1), bad).when(score >= 0.80, "High").when(score >= 0.50, "Medium").otherwise("Low")


def domains(text: Column) -> Column:
    """The governance domains that a text names, in order."""
    found = [F.when(text.rlike("(?i)\\b(" + "|".join(words) + ")\\b"), F.lit(name)) for name, words in DOMAINS.items()]
    return F.array_compact(F.array(*found))


def enabling_score(a: Column, b: Column) -> Column:
    """Evidence in two texts that one enables the other, at most 1."""
    a, b = F.lower(a), F.lower(b)
    pattern = F.lit("\\b(" + "|".join(ENABLING_KEYWORDS) + ")\\b")
    shared = F.arrays_overlap(F.regexp_extract_all(a, pattern, F.lit(1)), F.regexp_extract_all(b, pattern, F.lit(1)))
    gives = a.rlike("\\b(provide|deliver|output)\\b") & b.rlike("\\b(require|need|input|depend)\\b")
    da, db = domains(a), domains(b)
    both = (F.size(da) > 0) & (F.size(db) > 0)
    score = F.when(shared, 0.2).otherwise(0.0) + F.when(gives, 0.3).otherwise(0.0) + F.when(both & (da != db), 0.2).when(both, 0.1).otherwise(0.0)
    for p, w in ENABLING_PHRASES:
        score = score + F.when(a.rlike(p) | b.rlike(p), w).otherwise(0.0)
    return F.least(F.lit(1.0), score)


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike("|".join(words))


def causal_score(enabling: Column, dependent: Column) -> Column:
    """85 for a causal verb, 75 for a shared outcome, 70 for a prerequisite, else null."""
    return _causal(enabling, dependent, CAUSAL_VERBS, SHARED_OUTCOMES, PREREQUISITES, F.lit(False))


def precedent_score(enabling: Column, dependent: Column, precedent: Column) -> Column:
    """Wider word lists; 90, 80 and 78 where a precedent is known."""
    return _causal(enabling, dependent, MORE_VERBS, MORE_OUTCOMES, MORE_PREREQUISITES, precedent)


def _causal(enabling, dependent, verbs, outcomes, prerequisites, precedent) -> Column:
    e, d = F.lower(enabling), F.lower(dependent)
    shared = F.exists(F.array(*[F.lit(w) for w in outcomes]), lambda w: e.contains(w) & d.contains(w))
    more = lambda plain, known: F.when(precedent, known).otherwise(plain)
    return F.when(_any(e, verbs), more(85, 90)).when(shared, more(75, 80)).when(_any(e, prerequisites), more(70, 78))


def causal_confidence(similarity: Column, causal: Column) -> Column:
    """int(0.3 similarity x 100 + 0.7 causal), for similarities from 0.05."""
    return F.when(similarity >= 0.05, (0.3 * similarity * 100 + 0.7 * causal).cast("int"))


def priority_score(text: Column, deadline: Column, agencies: Column) -> Column:
    """0.3 for a digit, 0.4 for a deadline, 0.3 for a cabinet agency."""
    cabinet = F.exists(agencies, lambda a: a.contains("Department of") | a.contains("Environmental Protection Agency") | a.contains("Office of Management and Budget"))
    return F.least(F.lit(1.0), F.when(text.rlike("[0-9]"), 0.3).otherwise(0.0) + F.when(deadline.isNotNull(), 0.4).otherwise(0.0) + F.when(cabinet, 0.3).otherwise(0.0))


def requirement_score(s: Column) -> Column:
    """Verb 3, obligation 3, time frame 2, actor 2; a requirement has 5 or more."""
    has = lambda p, n: F.when(s.rlike("(?i)\\b(" + p + ")\\b"), n).otherwise(0)
    return (
        has("establish|develop|implement|create|submit|report|coordinate|modernize|digitize|require|fund|enhance|allocate|deliver|plan|strengthen|provide|ensure", 3)
        + has("shall|must|will|should|is required to|are required to|is to|are to", 3)
        + has("\\d+\\s+days|\\d+\\s+months|\\d+\\s+years|annually|quarterly|within\\s+\\d+", 2)
        + has("agency|department|secretary|administrator|director|office", 2)
    )


def linkage_priority(source: Column, score: Column, threshold: float) -> Column:
    """2 for an order or memorandum as source, 1 for a score above the threshold."""
    return F.when(source.rlike("\\bEO\\b|Executive Order|OMB"), 2).otherwise(0) + F.when(score > threshold, 1).otherwise(0)
