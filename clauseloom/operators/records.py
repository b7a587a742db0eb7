"""Normalising, aggregating, ranking, deduplicating and comparing record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


# ---- columns ------------------------------------------------------------------------------------------
def _bare(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def find_column(columns: list[str], options: list[str], partial: bool = False) -> str | None:
    """The first option that a column matches by letters and digits; with partial also by inclusion."""
    for o in options:
        for c in columns:
            if _bare(c) == _bare(o):
                return c
    if partial:
        for o in options:
            for c in columns:
                if _bare(o) in _bare(c) or _bare(c) in _bare(o):
                    return c
    return None


def classify_columns(columns: list[str]) -> dict[str, list[str]]:
    """Columns by what their names say."""
    kinds = {"urls": ("url", "link"), "descriptions": ("description",), "sources": ("source",), "components": ("component",)}
    out: dict[str, list[str]] = {k: [] for k in ("components", "descriptions", "sources", "urls")}
    for c in columns:
        for kind, words in kinds.items():
            if any(w in c.lower() for w in words):
                out[kind].append(c)
                break
    return out


def matching_column(column: str, related: list[str]) -> str | None:
    """The related column of the same role, else the first."""
    role = next((r for r in ("enabling", "dependent") if r in column.lower()), None)
    same = [c for c in related if role and role in c.lower()]
    return (same or related or [None])[0]


def longest_text_column(df: DataFrame) -> str | None:
    """The string column with the greatest mean length, by one aggregate."""
    names = [c for c, t in df.dtypes if t == "string"]
    if not names:
        return None
    means = df.agg(*[F.avg(F.char_length(c)).alias(c) for c in names]).first()
    return max(names, key=lambda c: means[c] or 0)


def text_pair(df: DataFrame) -> tuple[str, str] | None:
    """Two description columns, else two component columns, else two string columns of mean length over 10."""
    for word in ("description", "component"):
        found = [c for c in df.columns if word in c.lower()]
        if len(found) >= 2:
            return found[0], found[1]
    names = [c for c, t in df.dtypes if t == "string"]
    means = df.agg(*[F.avg(F.char_length(c)).alias(c) for c in names]).first() if names else {}
    found = [c for c in names if (means[c] or 0) > 10]
    return (found[0], found[1]) if len(found) >= 2 else None


def with_columns_in_order(df: DataFrame, order: list[str], rest: bool = False) -> DataFrame:
    """The columns in order, missing ones blank; with rest the others follow."""
    more = [c for c in df.columns if c not in order] if rest else []
    return df.select(*[F.col(c) if c in df.columns else F.lit("").alias(c) for c in order], *more)


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """P12."""
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


def forward_fill(df: DataFrame, columns: list[str], order: str, partition: str | None = None) -> DataFrame:
    """Nulls take the last value before them, within the partition where one is given.

    Without one the rows are cut into ranges of the order, and each range takes what the ranges before it end with.
    """
    if partition:
        w = W.partitionBy(partition).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})
    cut = in_ranges(df, order)
    ends = cut.groupBy("_range").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns])
    # One row a range.
    w = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ends.select("_range", *[F.last(c, ignorenulls=True).over(w).alias(f"_before_{c}") for c in columns])
    w = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    filled = cut.join(F.broadcast(before), "_range")
    return filled.select(*[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_before_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df with _range, the number of the range of the order that a row is in; computed once, as ranges are drawn from a sample."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return once(df.sparkSession)(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def numbered(df: DataFrame, column: str, *order: str) -> DataFrame:
    """Df with numbers from 1 in the order, which must tell all rows apart; ranges are numbered by themselves and moved on."""
    cut = in_ranges(df, *order)
    # One row a range.
    sizes = cut.groupBy("_range").agg(F.count("*").alias("_size"))
    offset = F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return cut.join(F.broadcast(sizes.select("_range", offset.alias("_offset"))), "_range").withColumn(column, own + F.col("_offset")).drop("_range", "_offset")


def running(df: DataFrame, sums: dict[str, Column], *order: str) -> DataFrame:
    """df with a column for each sum up to and with the row, in the order, which must tell all rows apart; ranges are summed by themselves and moved on."""
    cut = in_ranges(df.withColumns(sums), *order)
    names = list(sums)
    # One row a range.
    sizes = cut.groupBy("_range").agg(*[F.sum(c).alias(c) for c in names])
    w = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_range", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_before_{c}") for c in names])
    own = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    moved = cut.withColumns({c: F.sum(c).over(own) for c in names}).join(F.broadcast(offsets), "_range")
    return moved.withColumns({c: F.col(c) + F.col(f"_before_{c}") for c in names}).drop("_range", *[f"_before_{c}" for c in names])


def once(spark):
    """Computes a plan that others build on: a checkpoint where the session has a folder for it, else a cached copy."""
    return (lambda df: df.checkpoint()) if not spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty() else (lambda df: df.persist())


def score_json(*scores: str) -> Column:
    """The scores to four decimals as JSON, nulls kept."""
    return F.to_json(F.struct(*[F.round(c, 4).alias(c) for c in scores]), {"ignoreNullFields": "false"})


# ---- aggregates ----------------------------------------------------------------------------------------
def longest_value(value: str, order: str) -> Column:
    """An aggregate of the longest text; of equals the earliest."""
    return F.max_by(value, F.when(X.usable(F.col(value)).isNotNull(), F.struct(F.char_length(value), -F.col(order))))


def normalise(wide: DataFrame, order: str) -> dict[str, DataFrame]:
    """A10: sources, components and alignments of a table with enabling_/dependent_ source, component and description.

    The longest description of a component wins; of repeated alignments the last. A null source or name gives a null id.
    """
    roles = [wide.select(*[F.col(f"{r}_{c}").alias(c) for c in ("source", "component", "description")], F.col(order).alias("_order")) for r in ("enabling", "dependent")]
    both = roles[0].unionByName(roles[1])
    named = both.withColumn("component_id", X.composite_id(F.col("source"), F.col("component")))
    components = named.groupBy("source", "component", "component_id").agg(longest_value("description", "_order").alias("description"))
    ids = {r: X.composite_id(F.col(f"{r}_source"), F.col(f"{r}_component")).alias(f"{r}_component_id") for r in ("enabling", "dependent")}
    edges = wide.select("*", *ids.values())
    rest = [c for c in edges.columns if not c.endswith("_component_id")]
    alignments = edges.groupBy(*[f"{r}_component_id" for r in ids]).agg(F.max_by(F.struct(*rest), order).alias("s")).select("enabling_component_id", "dependent_component_id", "s.*")
    return {"sources": both.select("source").where("source is not null").distinct(), "components": components, "alignments": alignments}


def quantiles(df: DataFrame, value: str, at: dict[str, Column | float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles between the two nearest values, as percentile gives them, for each group of by; at has a share (0 to 1) for each new column, by literal or from the number of values _total.

    Distinct values with their counts lie in ranges of the order; counts of earlier ranges are carried on, so no group is one task's load.
    Groups without values have no row, except that the whole table has one of nulls.
    """
    by = by or []
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    cut = in_ranges(counted, *by, "_v")
    # One row for each range and group in it.
    sizes = cut.groupBy("_range", *by).agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("_range").alias("_at"), *[F.col(c).alias(f"_by_{c}") for c in by], before.alias("_before"), F.sum("_size").over(W.partitionBy(*by)).alias("_total"))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    own = F.sum("_n").over(W.partitionBy("_range", *by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    upto = cut.withColumn("_upto", own).join(sizes, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    # The value at place i (from 0) is the least one with more than i values up to it.
    place = {c: (q if isinstance(q, Column) else F.lit(float(q))) * (F.col("_total") - 1) for c, q in at.items()}
    least = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v")))
    found = upto.groupBy(*by).agg(*[x for c, i in place.items() for x in (least(F.floor(i)).alias(f"_lo_{c}"), least(F.ceil(i)).alias(f"_hi_{c}"), F.max(i).alias(f"_i_{c}"))])
    lo, hi, i = (lambda c, p=p: F.col(f"_{p}_{c}") for p in ("lo", "hi", "i"))
    between = lambda c: F.when(lo(c) == hi(c), lo(c)).otherwise((F.ceil(i(c)) - i(c)) * lo(c) + (i(c) - F.floor(i(c))) * hi(c))
    return found.select(*by, *[between(c).alias(c) for c in at])


def summary(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Count, mean, median, sample deviation, least and greatest."""
    by = by or []
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    middle = quantiles(df, value, {"median": 0.5}, by).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    return out.join(middle, same, "left").select(*by, "n", "mean", "median", "std", "min", "max")


def threshold_for_rows(df: DataFrame, value: str, rows: int) -> DataFrame:
    """The exact quantile above which about so many rows lie, with seven percentiles."""
    share = F.greatest(F.lit(0.0), 1 - F.lit(float(rows)) / F.col("_total"))
    at = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]
    return quantiles(df, value, {"threshold": share, **{f"p{int(q * 100)}": q for q in at}})


def nth_largest(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n-th largest value, or the least if there are fewer."""
    return df.select(value).orderBy(F.desc(value)).limit(n).agg(F.min(value).alias("threshold"))


def recommended_score(df: DataFrame, value: str, head: int = 100, rank: int = 1000) -> DataFrame:
    """Mean of the head largest values and the value at the rank (the least, if there are fewer)."""
    top = df.select(value).orderBy(F.desc(value)).limit(rank)
    ranked = top.withColumn("rn", F.row_number().over(W.orderBy(F.desc(value))))
    return ranked.agg(F.avg(F.when(F.col("rn") <= head, F.col(value))).alias("mean_head"), F.min(value).alias("at_rank"))


def halved_threshold(df: DataFrame, value: str, start: float = 0.64, tries: int = 10) -> DataFrame:
    """Start halved as often as needed for a row to qualify, at most tries times; null if none does."""
    steps = F.array(*[F.lit(start / 2**i) for i in range(tries + 1)])
    return df.agg(F.max(value).alias("m")).select(F.element_at(F.filter(steps, lambda s: s <= F.col("m")), 1).alias("threshold")) if tries else df.agg(F.lit(start).alias("threshold"))


def group_members(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """All rows of keys that occur at least least times."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") >= least).drop("_n")


def conflicting(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Keys with more than one distinct value, and the number."""
    return df.groupBy(key).agg(F.countDistinct(value).alias("n_values")).where("n_values > 1")


def frequency_ratio(words: DataFrame) -> DataFrame:
    """Each word's share of all words of (word)."""
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    total = words.agg(F.count("*").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("word", "n", (F.col("n") / F.col("total")).alias("ratio"))


def uncommonality(ratios: DataFrame, common: DataFrame) -> DataFrame:
    """A word's share over its share of common (word, common_ratio); 1e-10 stands for a missing one."""
    return ratios.join(common, "word", "left").select("word", (F.col("ratio") / F.coalesce("common_ratio", F.lit(1e-10))).alias("uncommonality"))


def pair_rules(baskets: DataFrame, basket: str, item: str, support: float, lift: float = 1.0) -> DataFrame:
    """Rules a -> b of single items with support, confidence and lift. Frequent items are found before pairs are built."""
    rows = baskets.select(basket, item).distinct()
    n = rows.select(basket).distinct().count()
    often = rows.groupBy(item).agg(F.count("*").alias("c")).where(F.col("c") >= support * n)
    kept = rows.join(often, item)
    a, b = kept.select(basket, F.col(item).alias("a"), F.col("c").alias("ca")), kept.select(basket, F.col(item).alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, basket).where("a != b").groupBy("a", "b", "ca", "cb").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= support * n)
    out = pairs.select("a", "b", (F.col("n_both") / n).alias("support"), (F.col("n_both") / F.col("ca")).alias("confidence"), (F.col("n_both") * n / (F.col("ca") * F.col("cb"))).alias("lift"))
    return out.where(F.col("lift") >= lift)


def itemsets(baskets: DataFrame, basket: str, item: str, support: float) -> DataFrame:
    """(items, n, support) of all sets of items, in order, that stand together in at least the share support of the baskets."""
    from pyspark.ml.fpm import FPGrowth

    rows = baskets.select(basket, F.col(item).cast("string").alias("item")).where("item is not null")
    sets = rows.groupBy(basket).agg(F.collect_set("item").alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(sets)
    total = sets.agg(F.count("*").alias("total"))
    return model.freqItemsets.crossJoin(F.broadcast(total)).select(F.array_sort("items").alias("items"), F.col("freq").alias("n"), (F.col("freq") / F.col("total")).alias("support"))


def itemset_rules(sets: DataFrame, lift: float = 1.0) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) for every way to part an itemset of (items, support) in two, from the lift on."""
    parted = sets.where(F.size("items") > 1).select("items", "support", F.expr("explode(sequence(1, shiftleft(1, size(items)) - 2)) AS mask"))
    sides = parted.select("support", *[F.expr(f"filter(items, (x, i) -> shiftright(mask, i) % 2 = {bit})").alias(name) for bit, name in ((1, "antecedent"), (0, "consequent"))])
    of = lambda name: sets.select(F.col("items").alias(name), F.col("support").alias(f"_{name}"))
    out = sides.join(of("antecedent"), "antecedent").join(of("consequent"), "consequent")
    confidence = F.col("support") / F.col("_antecedent")
    return out.select("antecedent", "consequent", "support", confidence.alias("confidence"), (confidence / F.col("_consequent")).alias("lift")).where(F.col("lift") >= lift)


def differential_terms(tokens: DataFrame, label: str, k: int = 40) -> DataFrame:
    """The k terms with the highest and the lowest count in accepted minus rejected rows of (label 0/1, term)."""
    net = tokens.groupBy("term").agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(-1)).alias("net"))
    pos = net.where("net > 0").orderBy(F.desc("net"), "term").limit(k).withColumn("side", F.lit("positive"))
    return pos.unionByName(net.where("net < 0").orderBy("net", "term").limit(k).withColumn("side", F.lit("negative")))


# ---- sets -------------------------------------------------------------------------------------------------
def common_keywords(a: Column, b: Column) -> Column:
    """The left keywords that the right has, without regard to case."""
    low = F.transform(b, lambda x: F.lower(x))
    return F.filter(a, lambda x: F.array_contains(low, F.lower(x)))


def cell_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, column, left, right) of the cells that differ, null-safe."""
    cols = [c for c in a.columns if c != key and c in b.columns]
    x = a.select(key, *[F.col(c).cast("string").alias(f"l_{c}") for c in cols])
    y = b.select(key, *[F.col(c).cast("string").alias(f"r_{c}") for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right")) for c in cols])
    return x.join(y, key, "full_outer").select(key, F.explode(cells).alias("c")).select(key, "c.*").where(~F.col("left").eqNullSafe(F.col("right")))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table only, with the side."""
    cols = [c for c in a.columns if c in b.columns]
    x, y = a.select(cols), b.select(cols)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


# ---- dedupe -----------------------------------------------------------------------------------------------
def canonical_values(groups: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """The longest value of each group; of equals the first."""
    return groups.groupBy(group).agg(F.max_by(value, F.struct(F.char_length(value), -F.col(order))).alias("canonical"))


def apply_canonical(df: DataFrame, mapping: DataFrame, columns: list[str]) -> DataFrame:
    """The columns' values by (value, canonical), others as they are."""
    for c in columns:
        m = mapping.select(F.col("value").alias(c), F.col("canonical").alias("_canonical"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("_canonical", c)).drop("_canonical")
    return df


def upsert_nodes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet are added."""
    return old.unionByName(new.dropDuplicates([key]).join(old, key, "left_anti").select(*old.columns))


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends known are merged; equal edges once."""
    ids = nodes.select("id")
    known = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.unionByName(known.select(*old.columns)).distinct()


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
