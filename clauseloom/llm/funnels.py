"""Ordered funnel counting by one reverse sweep.

A funnel is a list of steps (kinds of rows) and a kind that ends an attempt. Each row of the first step starts an
attempt; the next step is the client's earliest row of its kind later than the one before, within a time limit and
without an excluded row in between.

Rows are first put together by (client, time) with the set of their kinds, so repeated rows fall away before
they shuffle. A client's time is cut into spans; a span also gets the rows after its end that an attempt can
still reach (steps - 1 times the limit), so one client's rows go to many tasks and no attempt is cut. Each span is
swept once, from its last time to its first. For each step the sweep holds the ready-made chain from the
earliest later row of that step on, and the time of the next excluded row. A new row takes the chain of the step
after its own, so an attempt costs the same however long it is, and the state is one chain a step.

Times between steps are counted, not listed: (funnel, client, step, time) with the number of attempts. Their
ranks are found by three rounds of counts over bins (about a second, a millisecond, a microsecond), so no client's
times meet in one task, and no round holds more than about a thousand rows of a client's step together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import lean, stage_dir

MINUTE = 60_000_000
#: Length of a client's span.
SPAN = 180 * MINUTE
#: Counts that a task holds before it gives them on.
_HELD = 100_000


def wall_micros(ts: Column) -> Column:
    """Microseconds since 1970 as the clock on the wall shows them, for times with and without a zone."""
    days, hours, minutes = F.unix_date(ts.cast("date")).cast("long"), F.hour(ts).cast("long"), F.minute(ts).cast("long")
    return ((days * 24 + hours) * 60 + minutes) * MINUTE + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _plans(funnels: dict, kinds: list[str]) -> list[list[tuple]]:
    """For each set of kinds, as bits: (funnel, steps of these kinds in order, whether it holds the excluded kind)."""
    out = []
    for bits in range(1 << len(kinds)):
        have = {k for i, k in enumerate(kinds) if bits >> i & 1}
        rows = [(f, [j for j, k in enumerate(steps) if k in have], excluded in have) for f, (steps, excluded) in enumerate(funnels.values())]
        out.append([r for r in rows if r[1] or r[2]])
    return out


def _sweep(funnels: dict, kinds: list[str], within: int, span: int, client: pa.DataType):
    plans, lengths = _plans(funnels, kinds), [len(steps) for steps, _ in funnels.values()]
    schema = pa.schema([("funnel", pa.int32()), ("client", client), ("step", pa.int32()), ("gap", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, end, counts, chains, excluded = None, 0, {}, [], []
        out: list[tuple] = []

        def given():
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        def counted(who):
            out.extend([(f, who, step, gap, n) for (f, step, gap), n in counts.items()])
            counts.clear()

        for b in batches:
            for who, at, us, bits in zip(b["client"].to_pylist(), *(b[c].to_numpy().tolist() for c in ("span", "us", "kinds")), strict=True):
                if now is None or at != now[1] or who != now[0]:
                    if counts:
                        counted(now[0])
                        if len(out) >= _HELD:
                            yield given()
                    now, end = (who, at), (at + 1) * span
                    # A chain: the time of its first row and the times from step to step that follow.
                    chains, excluded = [[None] * (n + 1) for n in lengths], [None] * len(lengths)
                for f, steps, ends in plans[bits]:
                    own, stop = chains[f], excluded[f]
                    for j in steps:
                        later = own[j + 1]
                        if later is not None and later[0] - us <= within and (stop is None or stop > later[0]):
                            made = (us, (later[0] - us, *later[1]))
                        else:
                            made = (us, ())
                        if j == 0 and us < end:
                            key = (f, 1, 0)
                            counts[key] = counts.get(key, 0) + 1
                            for k, gap in enumerate(made[1], 2):
                                key = (f, k, gap)
                                counts[key] = counts.get(key, 0) + 1
                        # Steps come in order, so the chain of the next step is still that of later rows.
                        own[j] = made
                    if ends:
                        excluded[f] = us
                if len(counts) >= _HELD:
                    counted(who)
                    yield given()
        if counts:
            counted(now[0])
        if out:
            yield given()

    return run


def step_times(events: DataFrame, funnels: dict, within: int = 15 * MINUTE, span: int = SPAN, client_col: str = "client_id", kind_col: str = "kind", time_col: str = "ts") -> DataFrame:
    """(funnel, client, step, gap, n): n attempts of the client took gap microseconds from the step before; step 1 has gap 0."""
    kinds = sorted({k for steps, excluded in funnels.values() for k in (*steps, excluded) if k is not None})
    reach = within * (max(len(steps) for steps, _ in funnels.values()) - 1)
    bit = F.coalesce(*[F.when(F.col(kind_col) == k, 1 << i) for i, k in enumerate(kinds)])
    client = F.col(client_col)
    known = events.where(F.col(kind_col).isin(kinds) & client.isNotNull() & F.col(time_col).isNotNull())
    groups = known.select(client.alias("client"), wall_micros(F.col(time_col)).alias("us"), bit.alias("bit")).groupBy("client", "us").agg(F.bit_or("bit").alias("kinds"))
    spans = F.sequence(F.floor((F.col("us") - reach) / span), F.floor(F.col("us") / span))
    dealt = groups.withColumn("span", F.explode(spans)).repartition("client", "span").sortWithinPartitions("client", "span", F.desc("us"))
    kind = groups.schema["client"].dataType
    run = _sweep(funnels, kinds, within, span, _arrow(kind))
    counted = dealt.mapInArrow(lean(run), f"funnel int, client {kind.simpleString()}, step int, gap long, n long")
    return counted.groupBy("funnel", "client", "step", "gap").agg(F.sum("n").alias("n"))


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def ranked_times(times: DataFrame, percent: int) -> DataFrame:
    """(funnel, client, step, gap): of each step after the first, the ceil(percent * n / 100)-th smallest of its n times."""
    keys, levels = ["funnel", "client", "step"], ["bin", "fine", "gap"]
    times = times.where("step > 1").withColumns({"bin": F.shiftright("gap", 20), "fine": F.shiftright("gap", 10)})
    for i, level in enumerate(levels):
        upper = levels[:i]
        # Times meet the bins that hold the wanted rank by bin; neither side may go to one task or to all.
        left = times.hint("merge").join(rank.hint("merge"), keys + upper) if upper else times.withColumn("rank", F.lit(None).cast("long"))
        counts = left.groupBy(*keys, *upper, level, "rank").agg(F.sum("n").alias("n"))
        ordered, whole = W.partitionBy(*keys).orderBy(level), W.partitionBy(*keys)
        counts = counts.select("*", F.sum("n").over(ordered).alias("upto"), F.sum("n").over(whole).alias("all"))
        counts = counts.withColumn("rank", F.coalesce("rank", F.expr(f"(`all` * {percent} + 99) DIV 100")))
        rank = counts.where("rank <= upto AND rank > upto - n").select(*keys, *upper, level, F.expr("rank - (upto - n)").alias("rank"))
    return rank.select(*keys, "gap")


def count_funnels(events: DataFrame, funnels: dict, within: int = 15 * MINUTE, percent: int = 50, span: int = SPAN, client_col: str = "client_id", kind_col: str = "kind", time_col: str = "ts") -> DataFrame:
    """For each funnel and client with attempts: n1, n2, ... (attempts that reach each step), deepest (the last step any
    of them reaches), t2, t3, ... (the ceil(percent * n / 100)-th smallest time in microseconds from the step before,
    over the n attempts that reach the step; null without any) and same_depth (clients of equal funnel and deepest).

    funnels maps a name to (kinds of the steps, kind that ends an attempt or None). Rows that repeat (client, kind, time)
    count once; rows with a null in one of the three take no part. Rows of one time are neither before nor after each
    other: a step lies strictly later than the one before, and an excluded row at the time of the next step ends the
    attempt, one at the time of the step before does not. Funnels of fewer steps than the longest have nulls in the
    further columns. An empty table gives no rows. Other columns are not read.
    """
    names, most = list(funnels), max(len(steps) for steps, _ in funnels.values())
    path = f"{stage_dir(events.sparkSession, 'funnels')}/times"
    step_times(events, funnels, within, span, client_col, kind_col, time_col).write.parquet(path)
    times = events.sparkSession.read.parquet(path)
    lengths = F.array(*[F.lit(len(steps)) for steps, _ in funnels.values()])
    n = [F.sum(F.when(F.col("step") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(1, most + 1)]
    counts = times.groupBy("funnel", "client").agg(*n, F.max("step").alias("deepest"))
    # One row for each funnel and step, whatever the number of clients.
    depths = counts.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    middle = ranked_times(times, percent).groupBy("funnel", "client").agg(*[F.max(F.when(F.col("step") == k, F.col("gap"))).alias(f"t{k}") for k in range(2, most + 1)])
    out = counts.hint("merge").join(middle.hint("merge"), ["funnel", "client"], "left").join(F.broadcast(depths), ["funnel", "deepest"])
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("funnel") + 1)
    has = F.element_at(lengths, F.col("funnel") + 1)
    return out.select(
        label.alias("funnel"), F.col("client").alias(client_col),
        *[F.when(has >= k, F.col(f"n{k}")).alias(f"n{k}") for k in range(1, most + 1)],
        "deepest", *[F.col(f"t{k}") for k in range(2, most + 1)], "same_depth",
    )


FUNNELS = {
    "A": (("view", "click", "view", "purchase"), "error"),
    "B": (("signup", "view", "click", "purchase"), "error"),
    "C": (("click", "click", "purchase", "view"), "signup"),
}


def query(spark, sf_dir: str) -> DataFrame:
    return count_funnels(spark.read.parquet(f"{sf_dir}/clicks.parquet"), FUNNELS)


def _step(k: int) -> str:
    """The k-th step by two as-of joins: the next row of its kind and the next excluded row."""
    return f"""
s{k} AS (
  SELECT a.*, CASE WHEN n.ts - a.t{k - 1} <= INTERVAL 15 MINUTE AND NOT coalesce(x.ts <= n.ts, false) THEN n.ts END AS t{k}
  FROM s{k - 1} a
  ASOF LEFT JOIN e n ON a.client_id = n.client_id AND a.k{k} = n.kind AND a.t{k - 1} < n.ts
  ASOF LEFT JOIN e x ON a.client_id = x.client_id AND a.kx = x.kind AND a.t{k - 1} < x.ts)"""


SQL = f"""
WITH e AS (SELECT DISTINCT client_id, kind, ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
f(funnel, k1, k2, k3, k4, kx) AS (VALUES {", ".join("(" + ", ".join(f"'{x}'" for x in (name, *steps, excluded)) + ")" for name, (steps, excluded) in FUNNELS.items())}),
s1 AS (SELECT f.*, client_id, ts AS t1 FROM e JOIN f ON kind = k1),{",".join(_step(k) for k in (2, 3, 4))},
g AS (
  SELECT funnel, client_id, count(t1) AS n1, count(t2) AS n2, count(t3) AS n3, count(t4) AS n4,
    list_sort(list(epoch_us(t2) - epoch_us(t1)) FILTER (t2 IS NOT NULL)) AS g2,
    list_sort(list(epoch_us(t3) - epoch_us(t2)) FILTER (t3 IS NOT NULL)) AS g3,
    list_sort(list(epoch_us(t4) - epoch_us(t3)) FILTER (t4 IS NOT NULL)) AS g4
  FROM s4 GROUP BY ALL),
d AS (SELECT *, (1 + (n2 > 0)::INT + (n3 > 0)::INT + (n4 > 0)::INT)::INT AS deepest FROM g)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, g2[(n2 + 1) // 2] AS t2, g3[(n3 + 1) // 2] AS t3, g4[(n4 + 1) // 2] AS t4,
  count(*) OVER (PARTITION BY funnel, deepest) AS same_depth
FROM d
"""
