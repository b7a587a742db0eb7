"""Filters, keyword matches, orders and reports over components and alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as X

# ---- fixed values: themes and their keywords, the order of severities -------------------------------------
THEMES = {
    "procurement reform": ["procurement", "acquisition", "contracting", "far"],
    "AI integration": ["artificial intelligence", "ai", "m-24-10"],
    "workforce modernization": ["workforce", "talent", "chco", "opm", "hiring"],
    "cybersecurity": ["cybersecurity", "zero trust", "cisa", "fisma", "zt"],
    "digital service delivery": ["digital service", "customer experience", "cx"],
    "records management": ["records", "nara"],
}
SEVERITIES = ["HIGH", "MEDIUM", "LOW"]
# ----------------------------------------------------------------------------------------------------------


# ---- filters --------------------------------------------------------------------------------------------
def described(pairs: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns (both names, both descriptions) are all usable."""
    for c in columns:
        pairs = pairs.where(X.usable(F.col(c)).isNotNull())
    return pairs


def split_same_source(pairs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """pairs of different sources, and the others with a Rejection_Reason; null sources are equal to each other."""
    same = F.lower(F.trim(F.col(a).cast("string"))).eqNullSafe(F.lower(F.trim(F.col(b).cast("string"))))
    return pairs.where(~same), pairs.where(same).withColumn("Rejection_Reason", F.lit("Same source document"))


def at_least(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """F05."""
    return df.where(F.col(score) >= threshold)


def theme_rows(themes: dict[str, list[str]]) -> list[tuple[str, str]]:
    return [(t, w) for t, words in themes.items() for w in words]


def theme_matches(components: DataFrame, themes: DataFrame, name: str = "name", description: str = "description") -> DataFrame:
    """(theme, keyword, name, description) where a keyword of (theme, keyword) stands in the name or description, in any case.

    A name is given once a theme, with the first keyword in alphabetical order. themes is the caller's list, far smaller than components.
    """
    hit = F.contains(F.lower(X.blank(F.col(name))), F.lower("keyword")) | F.contains(F.lower(X.blank(F.col(description))), F.lower("keyword"))
    found = components.select(name, description).join(themes.select("theme", "keyword"), hit)
    return found.groupBy("theme", name).agg(F.min(F.struct("keyword", description)).alias("m")).select("theme", "m.keyword", name, f"m.{description}")


def _whole(keyword: Column) -> Column:
    """A pattern for a keyword between word boundaries."""
    return F.concat(F.lit(r"(?U)\b\Q"), F.lower(keyword), F.lit(r"\E\b"))


def word_matches(items: DataFrame, sources: DataFrame, source: str = "source") -> DataFrame:
    """distinct (item, source, keyword) where a keyword of (item, keyword) stands in the source name as whole words."""
    hit = F.regexp_like(F.lower(F.col(source)), _whole(F.col("keyword")))
    return sources.select(source).distinct().join(items.select("item", "keyword").distinct(), hit).select("item", source, "keyword").distinct()


def mined_keywords(items: DataFrame, stop: list[str]) -> DataFrame:
    """(item, keyword): capitalised phrases and words of three letters or more of each item, lower-cased, without stop words."""
    phrases = F.regexp_extract_all(F.col("item"), F.lit(r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b|\b[a-z-]{3,}\b"), F.lit(0))
    return items.select("item", F.explode(F.array_distinct(F.transform(phrases, F.lower))).alias("keyword")).where(~F.col("keyword").isin(stop) if stop else F.lit(True))


def of_agencies(df: DataFrame, column: str, agencies: list[str]) -> DataFrame:
    """F09."""
    return df.where(F.col(column).isin(agencies))


def network_view(edges: DataFrame, enabling: str = "", dependent: str = "") -> DataFrame:
    """edges with both ends whose descriptions hold the words asked for, in any case; an empty word asks for nothing."""
    out = edges.where("enabling_component_id is not null and dependent_component_id is not null")
    for word, column in ((enabling, "enabling_description"), (dependent, "dependent_description")):
        if word.strip():
            out = out.where(F.contains(F.lower(F.col(column)), F.lit(word.strip().lower())))
    return out


def post_filters(df: DataFrame, min_score: float = 0, bucket: str | None = None, top: int | None = None, score: str = "score", tie: str = "id") -> DataFrame:
    """rows from the least score on, of one bucket, and the top best."""
    out = df.where(F.col(score) >= min_score) if min_score > 0 else df
    out = out.where(F.col("bucket") == bucket) if bucket else out
    return out.orderBy(F.desc(score), tie).limit(top) if top is not None else out


# ---- orders and labels ----------------------------------------------------------------------------------
def by_score(df: DataFrame, score: str, tie: str) -> DataFrame:
    """W13."""
    return df.orderBy(F.desc(score), tie)


def by_decision(df: DataFrame, decision: str, score: str) -> DataFrame:
    """By decision, then by falling score; nulls last in both."""
    return df.orderBy(F.asc_nulls_last(decision), F.desc_nulls_last(score))


def severity_rank(c: Column) -> Column:
    """0, 1, 2 for HIGH, MEDIUM, LOW; null for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c) - 1, F.lit(-1).cast("long"))


def labelled(df: DataFrame, **labels: str) -> DataFrame:
    """Constant label columns."""
    return df.withColumns({c: F.lit(v) for c, v in labels.items()})


def reused(candidates: DataFrame, alignments: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates (enabling, dependent) with the columns of the alignment of the same pair, null where there is none; of several the one with the greatest values."""
    known = alignments.groupBy("enabling", "dependent").agg(F.max(F.struct(*columns)).alias("_known"))
    return candidates.join(known, ["enabling", "dependent"], "left").select(*candidates.columns, *[F.col("_known")[c].alias(c) for c in columns])


# ---- keywords -------------------------------------------------------------------------------------------
def dealt(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) dealt by key, which moves less than words do: words cut afterwards are counted and ranked where they are."""
    return docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def ngram_counts(words: DataFrame, size: int, key: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """(key, phrase, n, first) of the runs of size words of (key, pos, word) that occur more than once in a text and are not all stop words."""
    w = W.partitionBy(key).orderBy("pos")
    parts = [F.col("word")] + [F.lead("word", i).over(w) for i in range(1, size)]
    runs = words.select(key, "pos", *[p.alias(f"_{i}") for i, p in enumerate(parts)]).where(F.col(f"_{size - 1}").isNotNull())
    if stop:
        other = F.lit(False)
        for i in range(size):
            other |= ~F.col(f"_{i}").isin(stop)
        runs = runs.where(other)
    return runs.groupBy(key, F.concat_ws(" ", *[f"_{i}" for i in range(size)]).alias("phrase")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n > 1")


def top_keywords(words: DataFrame, n: int = 10, key: str = "doc_id", stop: list[str] | None = None) -> DataFrame:
    """(key, keywords) the n most frequent words of each text; of equals the first in it."""
    kept = words.where(~F.col("word").isin(stop)) if stop else words
    counted = kept.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counted.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first"))).where(F.col("r") <= n)
    return best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("r", "word"))).alias("x")).select(key, F.transform("x", lambda x: x["word"]).alias("keywords"))


def atypical_keywords(words: DataFrame, scores: DataFrame, ignore: list[str], key: str = "doc_id") -> DataFrame:
    """(key, keywords): the distinct words of (key, pos, word) that are not ignored, by falling uncommonality of (word, uncommonality), then by place."""
    kept = words.where(~F.col("word").isin(ignore)) if ignore else words
    first = kept.groupBy(key, "word").agg(F.min("pos").alias("pos"))
    ranked = first.join(scores.select("word", "uncommonality"), "word", "left").fillna({"uncommonality": 0.0})
    order = F.array_sort(F.collect_list(F.struct((-F.col("uncommonality")).alias("s"), "pos", "word")))
    return ranked.groupBy(key).agg(order.alias("x")).select(key, F.array_join(F.transform("x", lambda x: x["word"]), ", ").alias("keywords"))


def keywords_and_phrases(docs: DataFrame, stop: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, keywords, phrases): up to five acronyms and then the most frequent words, ten in all; up to five capitalised phrases and
    then repeated runs of three and of two words, seven in all. Words are counted in the row of their text, so none is shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))

    def first(a: Column, b: Column, n: int) -> Column:
        return X.bound(a, lambda a: X.bound(F.transform(a, F.lower), lambda seen: F.slice(F.concat(a, F.filter(b, lambda x: ~F.array_contains(seen, x))), 1, n)))

    def found(words: Column) -> Column:
        kept = F.filter(words, lambda w: ~w.isin(stop)) if stop else words
        # Of the runs only as many as can be shown.
        runs = F.concat(*[X.most_frequent(X.word_runs(words, size, stop), 12, 2) for size in (3, 2)])
        return F.struct(
            first(F.slice(X.acronyms(t), 1, 5), X.most_frequent(kept, 10), 10).alias("keywords"), first(F.slice(X.capital_phrases(t), 1, 5), runs, 7).alias("phrases")
        )

    out = docs.select(key, X.bound(X.clean_tokens(t), found).alias("_x"))
    return out.select(key, "_x.keywords", "_x.phrases")


# ---- reports --------------------------------------------------------------------------------------------
def gaps_by_agency(gaps: DataFrame) -> DataFrame:
    """(agency, gaps, unassigned, resource, broken, priority) of gaps (gap_type, severity, suggested_agency); gaps without one are Interagency."""
    kind = lambda k: F.count_if(F.col("gap_type") == k)
    return gaps.groupBy(F.coalesce("suggested_agency", F.lit("Interagency")).alias("agency")).agg(
        F.count("*").alias("gaps"), kind("UNASSIGNED_COMPONENT").alias("unassigned"), kind("RESOURCE_MISMATCH").alias("resource"), kind("BROKEN_CHAIN").alias("broken"),
        F.when(F.count_if(F.col("severity") == "HIGH") > 0, "HIGH").otherwise("MEDIUM").alias("priority"),
    )


def leverage(components: DataFrame, alignments: DataFrame) -> DataFrame:
    """(agency, leverage): alignments (src, dst) whose source component (id, agencies) names the agency; agencies without one have 0."""
    named = components.select(F.col("id").alias("src"), F.explode(F.array_distinct("agencies")).alias("agency"))
    counted = alignments.groupBy("src").agg(F.count("*").alias("n"))
    return named.join(counted, "src", "left").groupBy("agency").agg(F.sum(F.coalesce("n", F.lit(0))).alias("leverage"))


def recommendations(gaps: DataFrame, components: DataFrame, alignments: DataFrame, agencies: list[str]) -> DataFrame:
    """For each listed agency with gaps a priority, an action, a timeline and a rationale, by priority."""
    g = gaps_by_agency(gaps).where(F.col("agency").isin(agencies)).join(leverage(components, alignments), "agency", "left").fillna({"leverage": 0})
    first = lambda a, b, c, d: F.when(F.col("unassigned") > 0, a).when(F.col("resource") > 0, b).when(F.col("broken") > 0, c).otherwise(d)
    action = first(F.concat(F.lit("Assume lead responsibility for "), F.col("unassigned").cast("string"), F.lit(" unassigned component(s)")), F.lit("Conduct resource needs assessment for high-priority requirements"), F.lit("Establish coordination mechanisms to bridge identified gaps"), F.lit("Review and align internal planning with federal governance directives"))
    timeline = first(F.lit("IMMEDIATE"), F.lit("30D"), F.lit("90D"), F.lit("90D"))
    why = F.concat_ws(". ", F.when(F.col("leverage") > 0, F.concat(F.lit("Can leverage "), F.col("leverage").cast("string"), F.lit(" existing alignments"))), F.concat(F.lit("Addresses "), F.col("gaps").cast("string"), F.lit(" identified gaps")))
    out = g.select("agency", "priority", action.alias("action"), timeline.alias("timeline"), why.alias("rationale"), "leverage")
    return out.orderBy(severity_rank(F.col("priority")), "agency")


def mean_of_first(left: DataFrame, right: DataFrame, n: int = 1000) -> DataFrame:
    """The mean Jaccard of the keyword sets (pos, words) of the first n pairs, row by row of left against all of right."""
    width = right.count()
    if not width:
        return left.sparkSession.range(1).select(F.lit(0.0).alias("mean"))
    # The first n pairs take as many rows of left as fill n, and n of right at most.
    a = left.orderBy("pos").limit(-(-n // width)).withColumn("i", F.row_number().over(W.orderBy("pos")) - 1).select("i", F.col("words").alias("x"))
    b = right.orderBy("pos").limit(n).withColumn("j", F.row_number().over(W.orderBy("pos")) - 1).select("j", F.col("words").alias("y"))
    both, union = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    pairs = a.crossJoin(b).where(F.col("i") * width + F.col("j") < n)
    return pairs.agg(F.coalesce(F.avg(F.when(union > 0, both / union).otherwise(0.0)), F.lit(0.0)).alias("mean"))


def themes_present(descriptions: DataFrame, column: str, themes: dict[str, list[str]] | None = None) -> DataFrame:
    """(theme, present) for each theme: whether any description holds one of its keywords. One aggregate over the table."""
    themes = themes or THEMES
    low = F.lower(F.col(column))

    def any_of(words: list[str]) -> Column:
        hit = F.lit(False)
        for w in words:
            hit |= F.contains(low, F.lit(w))
        return hit

    flags = descriptions.agg(*[F.coalesce(F.bool_or(any_of(words)), F.lit(False)).alias(t) for t, words in themes.items()])
    return flags.select(F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"`{t}`").alias("present")) for t in themes])).alias("r")).select("r.*")


def executive_counts(audit: DataFrame, candidates: DataFrame, components: DataFrame, alignments: DataFrame) -> DataFrame:
    """One row: sources, outdated ones, new .gov candidates, new components, alignments, those with a score of at least 0.55."""
    parts = [
        audit.agg(F.count("*").alias("sources"), F.count_if(F.coalesce("outdated", F.lit(False))).alias("outdated")),
        candidates.agg(F.count_if(F.coalesce("is_gov", F.lit(False)) & ~F.coalesce("known", F.lit(False))).alias("new_candidates")),
        components.agg(F.count("*").alias("new_components")),
        alignments.agg(F.count("*").alias("alignments"), F.count_if(F.col("score") >= 0.55).alias("high_confidence")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))
    return out


def error_flags(wide: DataFrame, groups: DataFrame, key: str = "key") -> DataFrame:
    """The rows of (key, enabling_/dependent_ source, description, url) with four flags, by groups (key, role, group) of their components.

    multiple_descriptions, same_description, multiple_urls: the role whose component has the fault, DEPENDENT where both have it;
    same_source: YES where the squashed sources have a ratio above 0.95. Empty texts otherwise.
    """
    roles = [wide.select(F.col(key).alias("key"), F.lit(r).alias("role"), X.squash(F.col(f"{r}_description")).alias("d"), X.squash(F.col(f"{r}_url")).alias("u")) for r in ("enabling", "dependent")]
    c = roles[0].unionByName(roles[1]).join(groups.select("key", "role", "group"), ["key", "role"]).withColumns({"d": F.nullif("d", F.lit("")), "u": F.nullif("u", F.lit(""))})
    by_group = c.groupBy("group").agg((F.countDistinct("d") > 1).alias("many_d"), (F.countDistinct("u") > 1).alias("many_u"))
    by_text = c.where("d is not null").groupBy("d").agg((F.countDistinct("group") > 1).alias("shared"))
    flagged = c.join(by_group, "group").join(by_text, "d", "left")
    role = lambda f: F.coalesce(F.max(F.when(F.col(f) & (F.col("role") == "dependent"), F.lit("DEPENDENT"))), F.max(F.when(F.col(f), F.lit("ENABLING"))), F.lit(""))
    per_row = flagged.groupBy("key").agg(role("many_d").alias("multiple_descriptions"), role("shared").alias("same_description"), role("many_u").alias("multiple_urls"))
    a, b = X.squash(F.col("enabling_source")), X.squash(F.col("dependent_source"))
    alike = F.when(a == b, F.lit(True)).otherwise(fuzzy.ratio(a, b) > 0.95)
    out = wide.select(F.col(key).alias("key"), F.when(F.coalesce(alike, F.lit(False)), "YES").otherwise("").alias("same_source"))
    return out.join(per_row, "key", "left").fillna("", ["multiple_descriptions", "same_description", "multiple_urls"]).select("key", "multiple_descriptions", "same_description", "multiple_urls", "same_source")
