"""Data-quality checks. Each gives an issue table or one row of counters; nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# What a proposal package must hold.
PACKAGE_FIELDS = ["decision_question", "evidence_graph", "authority_chain", "change_hypothesis", "impact_analysis", "alternatives", "confidence", "source_trace", "implementation_path"]
AUTHORITY_LAYERS = ["constitutional", "statutory", "executive", "regulatory", "agency"]


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    """V01, V02."""
    return [c for c in required if c not in df.columns]


def output_evaluation(df: DataFrame, ids: list[str]) -> DataFrame:
    """Counters of ids without '::' and of 'nan' or 'None' written as text."""
    text = [c for c, t in df.dtypes if t == "string"]
    bad = lambda c: F.count_if(F.lower(F.col(c)).isin("nan", "none"))
    return df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNotNull() & ~F.col(c).contains("::")).alias(f"{c}_without_separator") for c in ids], *[bad(c).alias(f"{c}_nan") for c in text])


def first_rows(df: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """The fields of the first row of each key."""
    return df.groupBy(key).agg(*[F.min_by(F.struct(F.col(f).alias("v")), order)["v"].alias(f"first_{f}") for f in fields])


def mismatches(out: DataFrame, known: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """(key, field, found, expected) where a row differs from the first known row of its key; null-safe."""
    joined = out.join(first_rows(known, key, fields, order), key)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("found"), F.col(f"first_{f}").cast("string").alias("expected")) for f in fields])
    return joined.select(key, F.explode(cells).alias("c")).select(key, "c.*").where(~F.col("found").eqNullSafe(F.col("expected")))


def inconsistent(df: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Rows that differ from the first row of their key."""
    w = W.partitionBy(key).orderBy(order)
    first = df.withColumns({f"_f_{f}": F.first(f).over(w) for f in fields})
    differs = F.lit(False)
    for f in fields:
        differs |= ~F.col(f).eqNullSafe(F.col(f"_f_{f}"))
    return first.where(differs).select(*df.columns)


def missing_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field) of unusable values."""
    gaps = F.array_compact(F.array(*[F.when(X.usable(F.col(f)).isNull(), F.lit(f)) for f in fields]))
    return df.select(key, F.explode(gaps).alias("field"))


def duplicate_records(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys with several different field combinations, and their number."""
    whole = F.struct(*[F.coalesce(F.col(f).cast("string"), F.lit("\0")).alias(f) for f in fields])
    return df.groupBy(key).agg(F.countDistinct(whole).alias("n_variants")).where("n_variants > 1")


def swapped(out: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, value) of out that no known row has."""
    long = lambda df: df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")).select(key, "c.*").where("value is not null").distinct()
    return long(out).join(long(known), [key, "field", "value"], "left_anti")


def corruption_profile(issues: DataFrame) -> DataFrame:
    """Counts by type, field and column in one pass, with the number of affected keys."""
    return issues.groupingSets([[F.col("issue")], [F.col("field")]], "issue", "field").agg(F.count("*").alias("n"), F.countDistinct("key").alias("affected"), F.grouping_id().alias("level"))


def verify_sources(pairs: DataFrame, master: DataFrame) -> DataFrame:
    """component_id, source against a master (component_id, valid_source): status and confidence."""
    j = pairs.join(master, "component_id", "left")
    has = X.usable(F.col("source")).isNotNull()
    known = F.col("valid_source").isNotNull()
    same = X.source_key(F.col("source")) == X.source_key(F.col("valid_source"))
    status = F.when(~known, "NO_MASTER").when(~has, "NO_SOURCE").when(same, "VALID").otherwise("MISMATCH")
    confidence = F.when(~known | ~has, 50).when(same, 100).otherwise(0)
    return j.select("component_id", "source", "valid_source", status.alias("status"), confidence.alias("confidence"))


def pair_confidence(valid_a: Column, valid_b: Column, same_source: Column) -> Column:
    """100, less 50 for each invalid side and 25 for a shared source, at least 0."""
    less = F.when(valid_a, 0).otherwise(50) + F.when(valid_b, 0).otherwise(50) + F.when(same_source, 25).otherwise(0)
    return F.greatest(F.lit(0), 100 - less)


def relationship_status(score: Column, a: Column, b: Column, same_source: Column, threshold: float = 0.8) -> Column:
    """Rejected for short texts or a shared source, else by the threshold and 0.75 of it."""
    short = (F.char_length(F.trim(a)) < 10) | (F.char_length(F.trim(b)) < 10)
    return F.when(F.coalesce(short, F.lit(True)), "INSUFFICIENT_TEXT").when(same_source, "SAME_SOURCE").when(score >= threshold, "VALID").when(score >= 0.75 * threshold, "REVIEW").otherwise("REJECTED")


def issue_rows(messages: DataFrame, column: str = "message") -> DataFrame:
    """Row number and component taken from messages like 'Row 12: component 'X' ...'."""
    c = F.col(column)
    return messages.select("*", F.expr(f"try_cast(regexp_extract({column}, '(?i)row (\\\\d+)', 1) as int)").alias("row"), F.nullif(F.regexp_extract(c, "(?i)component '([^']*)'", 1), F.lit("")).alias("component"))


def exception_report(alignments: DataFrame, components: DataFrame, score: str = "score", bucket: str = "bucket") -> DataFrame:
    """(kind, id) of same-source pairs, high scores not confirmed, and components without an alignment."""
    ident = F.concat_ws("->", "enabling_component_id", "dependent_component_id").alias("id")
    same = alignments.where(X.same_source(F.col("enabling_source"), F.col("dependent_source"))).select(F.lit("same_source").alias("kind"), ident)
    high = alignments.where((F.col(score) >= 0.7) & (F.col(bucket) != "Confirmed")).select(F.lit("high_score_not_confirmed").alias("kind"), ident)
    used = alignments.select(F.col("enabling_component_id").alias("component_id")).unionByName(alignments.select(F.col("dependent_component_id").alias("component_id")))
    orphan = components.join(used, "component_id", "left_anti").select(F.lit("orphan").alias("kind"), F.col("component_id").cast("string").alias("id"))
    return same.unionByName(high).unionByName(orphan)


def referential_issues(sources: DataFrame, components: DataFrame, alignments: DataFrame) -> DataFrame:
    """(issue, id) over sources (source), components (id, source) and alignments (src, dst)."""
    out = lambda df, name, c: df.select(F.lit(name).alias("issue"), F.col(c).cast("string").alias("id"))
    edge = alignments.withColumn("id", F.concat_ws("->", "src", "dst"))
    c = components.select(F.col("id"), F.col("source"))
    one = c.groupBy("id").agg(F.min("source").alias("source"))
    ends = edge.select("id", F.explode(F.array("src", "dst")).alias("c"))
    pair = edge.join(one.select(F.col("id").alias("src"), F.col("source").alias("s1")), "src").join(one.select(F.col("id").alias("dst"), F.col("source").alias("s2")), "dst")
    return (
        out(c.groupBy("id").count().where("count > 1"), "duplicate_component", "id")
        .unionByName(out(c.join(sources, "source", "left_anti"), "missing_source", "id"))
        .unionByName(out(ends.join(c.select(F.col("id").alias("c")), "c", "left_anti").select("id").distinct(), "missing_component", "id"))
        .unionByName(out(edge.where("src = dst"), "reflexive", "id"))
        .unionByName(out(pair.where("src != dst and s1 = s2"), "same_source", "id"))
        .unionByName(out(edge.groupBy("id").count().where("count > 1"), "duplicate_alignment", "id"))
    )


def hash_check(df: DataFrame, name: str, description: str, source: str, stored: str) -> DataFrame:
    """Rows with their right hash and whether the stored one is."""
    good = X.triad_hash(F.col(name), F.col(description), F.col(source))
    return df.withColumn("expected_hash", good).withColumn("hash_ok", F.col(stored).eqNullSafe(F.col("expected_hash")))


def output_verification(pairs: DataFrame, score: str = "score") -> DataFrame:
    """One row of counters: self matches, same and related sources, buckets, score statistics."""
    a, b = F.col("a_source"), F.col("b_source")
    same = F.lower(F.trim(a)) == F.lower(F.trim(b))
    return pairs.agg(
        F.count("*").alias("rows"), F.count_if(X.same_component(F.col("a_name"), F.col("b_name"))).alias("self_matches"), F.count_if(same).alias("same_source"),
        F.count_if(~same & (X.source_key(a) == X.source_key(b))).alias("related_source"), F.count_if(F.col(score) >= 0.8).alias("high"),
        F.count_if((F.col(score) >= 0.6) & (F.col(score) < 0.8)).alias("medium"), F.count_if(F.col(score) < 0.6).alias("low"), F.avg(score).alias("mean_score"),
    )


def package_issues(p: Column, fields: list[str]) -> Column:
    """Messages for a proposal package struct; fields are the ones that the struct has."""
    miss = [F.lit(f"Missing required field: {f}") if f not in fields else F.when(p[f].isNull(), F.lit(f"Missing required field: {f}")) for f in PACKAGE_FIELDS]
    chain = F.map_keys(p["authority_chain"]) if "authority_chain" in fields else F.array().cast("array<string>")
    layers = [F.when(~F.coalesce(F.array_contains(chain, layer), F.lit(False)), F.lit(f"Authority chain missing layer: {layer}")) for layer in AUTHORITY_LAYERS]
    few = F.when(F.coalesce(F.size(p["alternatives"]), F.lit(0)) < 2, F.lit("At least two alternatives are required (including no-change baseline).")) if "alternatives" in fields else F.lit(None).cast("string")
    score = p["confidence"]["score"] if "confidence" in fields else F.lit(None).cast("double")
    label = F.when(score >= 0.8, "High").when(score >= 0.5, "Medium").otherwise("Low")
    rated = F.when(score.isNull(), F.lit("Confidence score is required.")).when((score < 0) | (score > 1), F.lit("confidence_score must be between 0.00 and 1.00"))
    if "confidence" in fields:
        rated = rated.when(~p["confidence"]["label"].eqNullSafe(label), F.concat(F.lit("Confidence label does not match score threshold. Expected '"), label, F.lit("'.")))
    trace = F.when(F.coalesce(F.size(p["source_trace"]), F.lit(0)) < 1, F.lit("Source trace must include at least one evidence reference.")) if "source_trace" in fields else F.lit("Source trace must include at least one evidence reference.")
    return F.array_compact(F.array(*miss, *layers, few, rated, trace))


def brief(p: Column, audience: str) -> Column:
    """The points of a package for executive, oversight or implementation readers."""
    base = [F.concat(F.lit("Decision: "), p["decision_question"]), F.concat(F.lit("Change: "), p["change_hypothesis"]), F.concat(F.lit("Confidence: "), p["confidence"]["label"])]
    more = {
        "executive": [F.concat(F.lit("Alternatives: "), F.size(p["alternatives"]).cast("string"))],
        "oversight": [F.concat(F.lit("Evidence links: "), F.size(p["evidence_graph"]).cast("string")), F.concat(F.lit("Sources: "), F.size(p["source_trace"]).cast("string"))],
        "implementation": [F.concat(F.lit("Steps: "), F.size(p["implementation_path"]).cast("string"))],
    }
    return F.array(*base, *more[audience])


def freshness(url: Column, year: Column, current: int) -> Column:
    """UPDATE for a government source of an earlier year, CHECK for others without a year."""
    return F.when(X.gov_host(url) & (year < current), "UPDATE").when(year.isNull(), "CHECK").otherwise("CURRENT")


def discovery_status(found: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """KNOWN or NEW for each address found."""
    k = known.select(url).distinct().withColumn("_known", F.lit(True))
    return found.join(k, url, "left").select(*found.columns, F.when(F.col("_known"), "KNOWN").otherwise("NEW").alias("status"))


def proposal_package(df: DataFrame) -> DataFrame:
    """Rows of the package's parts (decision_question, evidence_graph, authority_chain, change_hypothesis, impact_analysis, alternatives,
    implementation_path, confidence_score, source_trace, assumptions) as a package with its label, issues and readiness."""
    score = F.col("confidence_score")
    label = F.when(score >= 0.8, "High").when(score >= 0.5, "Medium").when(score.isNotNull(), "Low")
    fields = ["decision_question", "evidence_graph", "authority_chain", "change_hypothesis", "impact_analysis", "alternatives", "source_trace", "implementation_path"]
    package = F.struct(*fields, F.struct(score.alias("score"), label.alias("label")).alias("confidence"))
    issues = package_issues(F.col("package"), [*fields, "confidence"])
    out = df.withColumn("package", package).withColumn("assumptions", F.coalesce("assumptions", F.array().cast("array<string>")))
    out = out.withColumn("validation_issues", issues)
    return out.select(*[c for c in df.columns if c not in (*fields, "confidence_score", "assumptions")], "package", "assumptions", "validation_issues", (F.size("validation_issues") == 0).alias("is_decision_ready"))


def with_hashes(df: DataFrame, name: str, description: str, source: str, column: str = "hash") -> DataFrame:
    """Missing and wrong integrity hashes are set right; repaired says where."""
    right = X.triad_hash(F.col(name), F.col(description), F.col(source))
    old = F.col(column) if column in df.columns else F.lit(None).cast("string")
    return df.withColumn("repaired", ~old.eqNullSafe(right)).withColumn(column, right)
